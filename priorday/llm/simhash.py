"""SimHash fingerprints and near-duplicate classes by the generalised pigeonhole principle.

`fingerprints` hashes word shingles. `near_duplicates` links fingerprints that
differ in at most `radius` bits and returns each row's component:

1. equal fingerprints are grouped first, so exact copies cost one row;
2. correlated bits (from a 64 x 64 table counted in Spark) are put into the same
   partition of the 64 bits;
3. thresholds t_1..t_m with sum(t_i) = radius - m + 1 are chosen by dynamic
   programming on estimated candidate pairs and probe rows; any two fingerprints
   within `radius` bits then agree to within t_i bits on some partition i;
4. each partition is probed (a threshold of -1 skips it, 0 takes its value as
   the key, t > 0 takes the value with every choice of t bits masked);
5. fingerprints with an equal key are verified on all 64 bits.

In a bucket, links are found block by block around leaders, so that a dense
group of near copies costs one link per member and not one per pair; between
stars only members that the triangle inequality allows are compared. Nothing is
capped: no link between components is lost.

Defined results: a text without words (null, empty, white space) has fingerprint
zero and is linked like any other. Each row has the class of its own text, also
where doc_ids repeat. A null doc_id never names a component unless it is alone. An empty table gives an empty result. Extra columns are ignored."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorday.operators.components import connected_components

from .common import batched, forget, salted_join, text_bytes, written

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
BUCKET = 2048  # bucket rows compared pair by pair in one block


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 values of all shingles, repeats included."""
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(x), seed) for x in zip(*(words[k:] for k in range(shingle)), strict=False)]
    count = np.zeros(BITS, np.int64)
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(packed), 1 << 16):
        count += np.unpackbits(packed[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * count > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, mark, fp) for every row; fp is the fingerprint as a signed long, mark a hash of the text."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = text_bytes(batch.column("text"))
        raw = data.tobytes().lower()  # of bytes: A-Z only
        out = [fingerprint(raw[a:b].split(), shingle, seed) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "mark", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").mapInArrow(batched(make, "text"), "doc_id long, mark long, fp long")


# --- partitions and thresholds ---------------------------------------------------


def bit_table(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and for each pair of bits in how many rows both are set (64 x 64, summed in Spark)."""

    def count(batches):
        table, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            bits = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                part = bits[at : at + (1 << 16)]
                table += part.T @ part
                rows += len(part)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(table.ravel().astype(np.int64)), pa.array(np.full(BITS * BITS, rows))], names=["cell", "both", "n"])

    got = classes.select("fp").mapInArrow(count, "cell long, both long, n long").groupBy("cell").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    table, rows = np.zeros(BITS * BITS), 0
    for x in got:  # 4,096 rows at most
        table[x.cell], rows = x.both, x.n
    return rows, table.reshape(BITS, BITS)


def grouped_bits(rows: int, table: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the bits, each grown around the free bit most correlated with those it has."""
    p = np.diag(table) / max(rows, 1)
    cov = table / max(rows, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(tie, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [max(free, key=lambda b: (tie[b][free].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            b = max(free, key=lambda b: (tie[b][part].sum(), -b))
            free.remove(b)
            part.append(b)
        parts.append(sorted(part))
    return parts


def candidate_pairs(rows: int, table: np.ndarray, part: list[int], t: int) -> float:
    """Estimated pairs within t bits on a partition, bits taken as independent."""
    if t < 0:
        return 0.0
    p = np.diag(table)[part] / max(rows, 1)
    chance = np.zeros(len(part) + 1)
    chance[0] = 1
    for d in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return rows * (rows - 1) / 2 * float(chance[: t + 1].sum())


def thresholds(rows: int, table: np.ndarray, radius: int = RADIUS, parts: tuple[int, ...] = (2, 3, 4)) -> tuple[list[list[int]], list[int]]:
    """The partitioning and thresholds of least estimated cost (candidate pairs plus probe rows)."""
    best: tuple[float, list[list[int]], list[int]] | None = None
    for m in parts:
        groups = grouped_bits(rows, table, m)
        need = radius + 1  # sum of (t_i + 1)
        cost = {0: (0.0, [])}
        for g in groups:
            then: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in cost.items():
                for t in range(-1, need - used):
                    here = c + candidate_pairs(rows, table, g, t) + (rows * comb(len(g), t) if t >= 0 else 0)
                    if used + t + 1 not in then or here < then[used + t + 1][0]:
                        then[used + t + 1] = (here, [*ts, t])
            cost = then
        if best is None or cost[need][0] < best[0]:
            best = (cost[need][0], groups, cost[need][1])
    return best[1], best[2]


# --- probe and verify --------------------------------------------------------------


def probe_keys(fp: np.ndarray, parts: list[list[int]], ts: list[int]) -> list[tuple[int, np.ndarray]]:
    """(tag, key) per probe: the partition's bits with each choice of t of them masked out."""
    out, tag = [], 0
    for part, t in zip(parts, ts, strict=True):
        if t < 0:
            continue
        whole = sum(1 << b for b in part)
        for masked in combinations(part, t):
            keep = np.uint64(whole - sum(1 << b for b in masked))
            out.append((tag, fp & keep))
            tag += 1
    return out


def bucket_links(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (index pairs) that join exactly the components of the graph "within `radius` bits".

    A small bucket is compared pair by pair. In a larger one, leaders gather all free
    fingerprints within `radius`; then, for leaders close enough to matter, members
    whose own distances allow a link are compared in blocks."""
    n = len(fp)
    if n <= 64:
        i, j = np.triu_indices(n, 1)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        return [(i[near], j[near])]
    links, free, stars = [], np.arange(n), []
    while len(free):
        lead = free[0]
        d = np.bitwise_count(fp[free] ^ fp[lead])
        inside = d <= radius
        own = free[inside]
        stars.append((lead, own, d[inside]))
        links.append((np.full(len(own) - 1, lead), own[own != lead]))
        free = free[~inside]
    lead = fp[np.array([s[0] for s in stars])]
    for a in range(len(stars)):
        d = np.bitwise_count(lead[a + 1 :] ^ lead[a])
        for b in (np.flatnonzero(d <= 3 * radius) + a + 1).tolist():
            gap = int(d[b - a - 1])
            x = stars[a][1][gap - stars[a][2].astype(int) <= 2 * radius]
            y = stars[b][1][gap - stars[b][2].astype(int) <= 2 * radius]
            for at in range(0, len(x), BUCKET):
                near = np.bitwise_count(fp[x[at : at + BUCKET]][:, None] ^ fp[y][None, :]) <= radius
                if near.any():
                    i, j = (v[0] for v in np.nonzero(near))
                    links.append((x[at + i : at + i + 1], y[j : j + 1]))
                    break
    return links


def _verified(radius: int):
    """mapInArrow function over rows sorted by (tag, key): links inside every run of equal keys."""

    def links(tag: np.ndarray, key: np.ndarray, fp: np.ndarray, node: np.ndarray):
        cut = np.flatnonzero((tag[1:] != tag[:-1]) | (key[1:] != key[:-1])) + 1
        start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(tag)]])
        size = end - start
        a, b = [], []
        small = size <= 64
        run = np.repeat(np.where(small, np.arange(len(size)), -1), size)
        for d in range(1, int(size[small].max(initial=1))):  # pairs d apart, for all small runs at once
            near = (run[d:] == run[:-d]) & (run[d:] >= 0) & (np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius)
            i = np.flatnonzero(near)
            a.append(node[i])
            b.append(node[i + d])
        for s, e in zip(start[~small].tolist(), end[~small].tolist(), strict=True):
            for i, j in bucket_links(fp[s:e], radius):
                a.append(node[s + i])
                b.append(node[s + j])
        if not a:
            return None
        x, y = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]) if len(pairs) else None

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tag", "key", "fp", "node")]
            if held:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            at = last[-1] + 1 if len(last) else 0
            held = [x[at:] for x in now]
            if at:
                out = links(now[0][:at], now[1][:at], now[2][:at].view(np.uint64), now[3][:at])
                if out is not None:
                    yield out
        if held:
            out = links(held[0], held[1], held[2].view(np.uint64), held[3])
            if out is not None:
                yield out

    return run


def fingerprint_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the nodes of `classes` (fp, node; fp distinct) that carry the components."""
    rows, table = bit_table(classes)
    parts, ts = thresholds(rows, table, radius)

    def probes(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                keys = probe_keys(fp, parts, ts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([t for t, _ in keys], np.int32), len(fp))),
                        pa.array(np.concatenate([k for _, k in keys]).view(np.int64)),
                        pa.array(np.tile(fp.view(np.int64), len(keys))),
                        pa.array(np.tile(part.column("node").to_numpy(zero_copy_only=False), len(keys))),
                    ],
                    names=["tag", "key", "fp", "node"],
                )

    rows_of = classes.select("fp", "node").mapInArrow(probes, "tag int, key long, fp long, node long")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows_of.repartition(n, "tag", "key").sortWithinPartitions("tag", "key", "fp")
    return dealt.mapInArrow(_verified(radius), "a long, b long").distinct()


def classes(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(doc_id, mark, fp, component) of every row; a component is named by one of its fingerprints."""
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = written(prints.select("fp").distinct().select("fp", F.col("fp").alias("node")), "classes")
    member = connected_components(fingerprint_links(nodes, radius)).select(F.col("node").alias("fp"), "component")
    named = nodes.join(member, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    out = written(prints.join(named, "fp").select("doc_id", "mark", "fp", "component"), "near-classes")
    forget(prints)
    forget(nodes)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    found = classes(docs, shingle, seed, radius)
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return salted_join(found, least, "component", F.col("doc_id")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row of `docs` for each component: that of the smallest doc_id (nulls last), all columns kept."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    name = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("name")
    found = classes(docs, shingle, seed, radius).groupBy("component").agg(first.alias("k")).select("k.*")
    kept = found.select(name, "mark").distinct()
    rows = docs.select(name, F.xxhash64("text").alias("mark"), F.struct(*docs.columns).alias("row"))
    # both steps need rows by (name, mark), so the texts move once
    return rows.join(kept, ["name", "mark"], "left_semi").dropDuplicates(["name", "mark"]).select("row.*")
