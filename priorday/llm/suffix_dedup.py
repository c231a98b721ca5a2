"""Removal of repeated byte strings with per-shard suffix arrays.

A byte goes if some `length`-byte string that covers it also starts elsewhere.

1. Windows are assigned to anchors: the smallest-hashed `gram`-byte string inside
   a window (leftmost on ties) depends on the window's bytes alone, so equal
   windows always have equal anchors. Consecutive windows with one anchor form a
   region. Anchors that occur once cannot hold a repeat and end here.
2. Regions with equal content are one kind, counted together; all windows of a
   kind that occurs twice are repeated. Two kinds can share a window only if they
   agree on the anchor and half of the rest, on its left or on its right. Kinds
   that share either half with another kind are cut from a text and sent to a
   shard by anchor, so equal windows meet in one shard.
3. In each shard a suffix array (Larsson-Sadakane refinement) and Kasai's common
   prefixes give the intervals of equal windows; those with two or more
   occurrences are repeated.
4. The kinds of an anchor with more than `spread` of them are dealt to several
   shards. Each sends its window digests to range-split merge groups, as many as
   the kinds need, where the runs are sorted and joined by binary search.
5. Repeated windows go back to every occurrence and merge into maximal spans.

Defined results: null and empty texts, and texts shorter than `length`, lose
nothing. Repeated rows are distinct texts, so equal rows remove each other's
windows in full. Rows that share a doc_id are told apart by a mark of the text;
rows equal in both count as separate occurrences. A null doc_id is a row like
any other. An empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, byte_values, forget, prefix_sums, salted_join, span_hash, text_bytes, written
from .suffix import common_prefixes, suffix_array

LENGTH = 400
GRAM = 32
SHARD_BYTES = 256 << 10  # region bytes of a shard
SPREAD = 500  # different regions of one anchor beyond which it is spread over shards
MERGE_KINDS = 2000  # regions of a spread anchor for each of its merge groups
SLICE = 1 << 20  # text bytes whose windows are hashed at once
_PLACE = np.uint64((1 << 28) - 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, from block-wise running minima."""
    n = len(x) - width + 1
    if n < 1:
        return x[:0]
    size = -(-len(x) // width) * width
    full = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def regions(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray] | None:
    """Every region: text number, anchor hash, content hash, first window, window count, and its halves.

    left and right are hashes of the anchor with half of a window's other bytes on
    that side (has_left, has_right: the region reaches so far)."""
    size = np.diff(off)
    counts = np.maximum(size - length + 1, 0)
    if not counts.any():
        return None
    sums = prefix_sums(byte_values(data))
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(sums, at, at + gram)
    least = sliding_least((grams & ~_PLACE) | at.astype(np.uint64), length - gram + 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + off[:-1][owner]
    anchor = (least[start] & _PLACE).astype(np.int64)
    head = np.ones(len(start), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(head)
    n = np.diff(np.append(first, len(start)))
    begin, anchor, text = start[first], anchor[first], owner[first]
    end, half, raw = begin + n + length - 1, (length - gram) // 2, data.tobytes()
    content = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64)
    has_left, has_right = anchor - half >= begin, anchor + gram + half <= end
    left = span_hash(sums, np.where(has_left, anchor - half, anchor), anchor + gram)
    right = ~span_hash(sums, anchor, np.where(has_right, anchor + gram + half, anchor + gram))
    return {"text": text, "anchor": grams[anchor].view(np.int64), "content": content.view(np.int64), "first": begin - off[text], "n": n, "left": left.view(np.int64), "right": right.view(np.int64), "has_left": has_left, "has_right": has_right}


def window_groups(texts: list[bytes], n_windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of some regions in suffix order: region, window number, and group of equal windows.

    Regions are joined by a code below all bytes; windows end before it, so common
    prefixes that run past it change no group."""
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    codes[base[1:] - 1] = 0
    sa = suffix_array(codes)
    prefix = common_prefixes(codes, sa)
    region = np.repeat(np.arange(len(texts)), sizes + 1)[sa]
    window = sa - base[region]
    group = np.cumsum(prefix[sa] < length)
    real = window < n_windows[region]
    return region[real], window[real], group[real]


def _runs(flags: np.ndarray) -> bytes:
    """Runs of true flags as 32-bit (start, length) pairs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    return np.stack([start, end - start], 1).astype(np.uint32).tobytes()


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))


OCCURRENCE = "anchor long, content long, doc_id long, mark long, first long, n int, left long, right long"
KEY = ["anchor", "content", "n"]


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Every region of every text (see OCCURRENCE)."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = regions(*text_bytes(batch.column("text")), length, gram)
        if found is None:
            return None
        by = pa.array(found["text"])
        columns = {
            **{c: pa.array(found[c]) for c in ("anchor", "content", "first")},
            **{c: batch.column(c).take(by) for c in ("doc_id", "mark")},
            **{c: pa.array(found[c], mask=~found[f"has_{c}"]) for c in ("left", "right")},
            "n": pa.array(found["n"].astype(np.int32)),
        }
        names = [x.split()[0] for x in OCCURRENCE.split(", ")]
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return _marked(docs).mapInArrow(batched(find, "text", SLICE), OCCURRENCE)


def region_kinds(occ: DataFrame) -> DataFrame:
    """(anchor, content, n, left, right, times, doc_id, mark, first, n_kinds): regions of equal content, with one of
    their places, if their anchor occurs more than once; n_kinds is how many of them it has."""
    one = [F.first(c).alias(c) for c in ("left", "right", "doc_id", "mark", "first")]
    kinds = occ.groupBy(*KEY).agg(F.count("*").alias("times"), *one)
    kinds = written(kinds, "kinds-of-regions")
    anchors = kinds.groupBy("anchor").agg(F.sum("times").alias("all_times"), F.count("*").alias("n_kinds")).where("all_times > 1").drop("all_times")
    out = written(kinds.join(anchors, "anchor"), "region-kinds")
    forget(kinds)
    return out


def half_shared(kinds: DataFrame) -> DataFrame:
    """The kinds that share a half with another kind."""
    sides = kinds.where("n_kinds > 1").withColumn("half", F.explode(F.array("left", "right"))).where("half is not null")
    shared = sides.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    return salted_join(sides, shared, "half", F.col("content")).drop("half", "left", "right").dropDuplicates(KEY)


def repeated_windows(docs: DataFrame, kinds: DataFrame, length: int, shard_bytes: int, spread: int) -> DataFrame:
    """(anchor, content, n, runs): the windows of each kind that occur twice or more; null runs are all of them."""
    wanted = written(half_shared(kinds), "wanted-kinds")
    total = wanted.agg(F.sum(F.col("n") + F.lit(length))).first()[0] or 0
    shards = int(total // shard_bytes) + 1
    carried = [*KEY, "times", "n_kinds"]
    per_text = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark")).agg(F.collect_list(F.struct("first", *carried)).alias("rs"))
    whole = _marked(docs).join(per_text, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).select("text", "rs")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = text_bytes(batch.column("text"))
        raw = data.tobytes()
        rs = batch.column("rs")
        flat = rs.flatten()
        count = np.diff(rs.offsets.to_numpy())
        base = np.repeat(off[:-1], count) + flat.field("first").to_numpy()
        size = flat.field("n").to_numpy() + length - 1
        body = [raw[a : a + b] for a, b in zip(base.tolist(), size.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(flat.field(c) for c in carried), pa.array(body, pa.binary())], names=[*carried, "body"])

    bodies = whole.mapInArrow(batched(cut, "text"), "anchor long, content long, n int, times long, n_kinds long, body binary")
    parts = F.greatest(F.ceil(F.col("n_kinds") / F.lit(spread)), F.lit(1))
    shard = F.when(parts > 1, F.xxhash64("anchor", F.pmod("content", parts))).otherwise(F.xxhash64("anchor"))
    bodies = bodies.withColumn("spread", parts > 1).withColumn("shard", F.pmod(shard, F.lit(shards)))

    def search(table: pa.Table) -> pa.Table:
        keys = np.stack([table[c].to_numpy().astype(np.int64) for c in KEY], 1)
        table = table.take(pa.array(np.unique(keys, axis=0, return_index=True)[1]))  # rows of one doc_id and text bring a region twice
        texts, n = table["body"].to_pylist(), table["n"].to_numpy().astype(np.int64)
        times, wide = table["times"].to_numpy(), table["spread"].to_numpy()
        region, window, group = window_groups(texts, n, length)
        _, group = np.unique(group, return_inverse=True)
        total = np.bincount(group, times[region]).astype(np.int64)
        base = np.cumsum(n) - n
        hit = np.zeros(int(n.sum()), bool)
        hit[(base[region] + window)[total[group] > 1]] = True
        runs = [_runs(hit[a : a + b]) for a, b in zip(base.tolist(), n.tolist(), strict=True)]
        side: dict[int, tuple[bytes, bytes]] = {}  # digests of the windows of spread anchors, and their total count here
        counted = np.zeros(int(n.sum()), np.int64)
        counted[base[region] + window] = total[group]
        for r in np.flatnonzero(wide).tolist():
            row = b"".join(hashlib.blake2b(texts[r][i : i + length], digest_size=16).digest() for i in range(int(n[r])))
            side[r] = (row, counted[base[r] : base[r] + n[r]].astype("<i8").tobytes())
        return pa.table({**{c: table[c] for c in (*carried, "spread", "shard")}, "runs": pa.array(runs, pa.binary()), "digests": pa.array([side.get(i, (None, None))[0] for i in range(len(texts))], pa.binary()), "totals": pa.array([side.get(i, (None, None))[1] for i in range(len(texts))], pa.binary())})

    found = bodies.groupBy("shard").applyInArrow(search, "anchor long, content long, n int, times long, n_kinds long, spread boolean, shard long, runs binary, digests binary, totals binary")
    found = written(found, "shard-repeats")
    forget(wanted)
    local = found.where("times = 1 and length(runs) > 0").select(*KEY, "runs")
    often = kinds.where("times > 1").select(*KEY, F.lit(None).cast("binary").alias("runs"))
    return often.unionByName(local).unionByName(merged_shards(found.where("spread")))


def merged_shards(found: DataFrame) -> DataFrame:
    """Windows of spread anchors that several shards hold, by binary search in merged runs.

    Each region's digests are split into digest ranges, as many as its anchor's
    kinds need. In a range the distinct digests of all shards form one sorted run;
    each shard's own run is looked up in it, and windows of kinds that occur once
    whose counts over shards reach two come back."""
    names = ["anchor", "part", "shard", "content", "n", "times", "windows", "digests", "totals"]

    def split(batches):
        for batch in batches:
            out = []
            for anchor, content, n, times, n_kinds, shard, digests, totals in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "n", "times", "n_kinds", "shard", "digests", "totals")), strict=True):
                whole, t = np.frombuffer(digests, np.uint8).reshape(-1, 16), np.frombuffer(totals, "<i8")
                groups = min(-(-n_kinds // MERGE_KINDS), 1 << 24)
                high = np.ascontiguousarray(whole[:, :4]).view(">u4").ravel().astype(np.int64)
                part = high * groups >> 32
                for p in np.unique(part).tolist():
                    at = np.flatnonzero(part == p)
                    out.append((anchor, p, shard, content, n, times, at.astype(np.uint32).tobytes(), whole[at].tobytes(), t[at].tobytes()))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def merge(table: pa.Table) -> pa.Table:
        cols = {c: table[c].to_pylist() for c in names}
        pairs = np.concatenate([np.frombuffer(x, "<u8").reshape(-1, 2) for x in cols["digests"]])
        key = np.empty(len(pairs), [("a", "<u8"), ("b", "<u8")])
        key["a"], key["b"] = pairs[:, 0], pairs[:, 1]
        shard = np.repeat(cols["shard"], [len(x) // 16 for x in cols["digests"]])
        total = np.concatenate([np.frombuffer(x, "<i8") for x in cols["totals"]])
        run = np.unique(key)  # the merged, sorted run
        place = np.searchsorted(run, key)  # each shard's run, found by binary search
        by_shard = np.unique(np.stack([place, shard, total], 1), axis=0)  # a shard's total counts once
        count = np.bincount(by_shard[:, 0], by_shard[:, 2], len(run)).astype(np.int64)
        at, out = 0, []
        for i, w in enumerate(cols["windows"]):
            w = np.frombuffer(w, np.uint32).astype(np.int64)
            hit = np.zeros(cols["n"][i], bool)
            hit[w[count[place[at : at + len(w)]] > 1]] = True
            at += len(w)
            if hit.any() and cols["times"][i] == 1:
                out.append((cols["anchor"][i], cols["content"][i], cols["n"][i], _runs(hit)))
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({c: pa.array(x, k) for c, x, k in zip((*KEY, "runs"), columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)})

    schema = "anchor long, part int, shard long, content long, n int, times long, windows binary, digests binary, totals binary"
    return found.select("anchor", "content", "n", "times", "n_kinds", "shard", "digests", "totals").mapInArrow(split, schema).groupBy("anchor", "part").applyInArrow(merge, "anchor long, content long, n int, runs binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, spread: int = SPREAD) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256."""
    occ = written(occurrences(docs, length, gram), "regions")
    kinds = region_kinds(occ)
    found = repeated_windows(docs, kinds, length, shard_bytes, spread)
    spans = occ.select(*KEY, "doc_id", "mark", "first").join(found, KEY).groupBy(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark")).agg(F.collect_list(F.struct("first", "n", "runs")).alias("spans"))
    spans = written(spans, "repeat-spans")
    forget(occ)
    forget(kinds)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = text_bytes(batch.column("text"))
        out = []
        for i, found in enumerate(batch.column("spans").to_pylist()):
            text = data[off[i] : off[i + 1]]
            edge = np.zeros(len(text) + 1, np.int64)
            for span in found or ():
                run = np.array([[0, span["n"]]]) if span["runs"] is None else np.frombuffer(span["runs"], np.uint32).reshape(-1, 2).astype(np.int64)
                np.add.at(edge, run[:, 0] + span["first"], 1)
                np.add.at(edge, run[:, 0] + span["first"] + run[:, 1] + length - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = text[~gone].tobytes()
            n_spans = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0]))
            out.append((len(text), int(gone.sum()), n_spans, kept, hashlib.sha256(kept).hexdigest()))
        kinds = [pa.int64()] * 3 + [pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = _marked(docs).join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(batched(cut, "text"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
