"""Removal of repeated token windows by Rabin-Karp hashes counted in Spark.

Every window of `width` consecutive words gets two rolling hashes: one of 64 bits
and one of 32 from other hashes of the same words, which verifies matches of the
first; words of up to seven bytes differ in both. Windows are
dealt by hash; for each hash the smallest doc_id that holds it is found, and
every window of a larger doc_id is reported back to its document, where touching
windows merge into maximal removal intervals. Windows travel packed: one row per
hash bucket and text slice, with hashes, documents and position gaps as arrays.
There is a bucket for every BUCKET_BYTES of text, so a bucket's memory does not
grow with the input.

Defined results: a null or empty text has no words and keeps the empty text's
digest. A row with a null doc_id has no order, so it neither removes nor loses
words. Rows that share a doc_id never remove from each other (neither is
smaller); each row is judged on its own text. An empty table gives an empty
result; further columns of `docs` are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, mixed, prefix_sums, span_hash, text_bytes, word_hashes, word_spans, written

WIDTH = 13
BUCKET_BYTES = 16 << 20  # text bytes whose windows make up one bucket
PACKED = "bucket int, docs binary, marks binary, counts binary, gaps binary, wide binary, low binary, mid binary, high binary, proof binary"


def windows(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, verifying hash, text number and first word number (within its text) of every window."""
    starts, ends, first = word_spans(data, off)
    counts = np.maximum(np.diff(first) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[:-1][owner] + place
    words, others = word_hashes(data, starts, ends)
    proof = span_hash(prefix_sums(others), at, at + width)
    return span_hash(prefix_sums(words), at, at + width), (proof >> np.uint64(32)).astype(np.uint32), owner, place


def packed(hashes: np.ndarray, proof: np.ndarray, owner: np.ndarray, place: np.ndarray, doc: np.ndarray, mark: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of PACKED: the windows of a slice by bucket, in text order."""
    bucket = (hashes % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    rest = hashes // np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, rest, proof, owner, place = bucket[order], rest[order], proof[order], owner[order], place[order]
    cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    out = []
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
        own, pos, h = owner[s:e], place[s:e], rest[s:e]
        head = np.ones(e - s, bool)
        head[1:] = own[1:] != own[:-1]
        runs = np.flatnonzero(head)
        gap = pos.copy()
        gap[1:] -= np.where(head[1:], 0, pos[:-1])
        far = np.flatnonzero(gap > 255)
        n = np.diff(np.append(runs, e - s))
        out.append(
            (
                int(bucket[s]),
                _numbers(doc[own[runs]]),
                mark[own[runs]].tobytes(),
                n.astype(np.uint8 if n.max() < 256 else np.uint32).tobytes(),
                (gap & 255).astype(np.uint8).tobytes(),
                np.stack([far, gap[far] >> 8]).astype(np.uint32).tobytes(),
                (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes(),
                ((h >> np.uint64(48)) & np.uint64(0xFF)).astype(np.uint8).tobytes(),
                proof[s:e].tobytes(),
            )
        )
    return out


def _numbers(x: np.ndarray) -> bytes:
    """64-bit numbers: the least, then 32-bit steps above it where they are enough, else all of them."""
    low = int(x.min())
    if int(x.max()) - low < 1 << 32 and len(x) > 1:
        return np.int64(low).tobytes() + (x - low).astype(np.uint32).tobytes()
    return x.tobytes()


def _numbers_of(raw: bytes, n: int) -> np.ndarray:
    if len(raw) == 8 * n:
        return np.frombuffer(raw, np.int64)
    return np.frombuffer(raw, np.int64, 1)[0] + np.frombuffer(raw, np.uint32, n, 8).astype(np.int64)


def unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Hash remainder, verifying hash, doc_id, text mark and position of every window of a bucket."""
    parts = []
    for _, docs, marks, counts, gaps, wide, low, mid, high, proof in zip(*(c.to_pylist() for c in table.columns), strict=True):
        mark = np.frombuffer(marks, np.int64)
        doc = _numbers_of(docs, len(mark))
        n = np.frombuffer(counts, np.uint8 if len(counts) == len(mark) else np.uint32).astype(np.int64)
        gap = np.frombuffer(gaps, np.uint8).astype(np.int64)
        far, more = np.frombuffer(wide, np.uint32).reshape(2, -1).astype(np.int64)
        gap[far] += more << 8
        total = np.cumsum(gap)
        begin = np.cumsum(n) - n
        pos = total - np.repeat(total[begin] - gap[begin], n)
        h = np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(mid, np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(48)
        parts.append((h, np.frombuffer(proof, np.uint32), np.repeat(doc, n), np.repeat(mark, n), pos.astype(np.uint32)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _doc_runs(doc: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal (doc, mark) in sorted arrays."""
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    first = np.flatnonzero(head)
    return first, np.diff(np.append(first, len(doc)))


LATE = "part int, docs binary, marks binary, counts binary, starts binary"


def later_windows(table: pa.Table, parts: int) -> pa.Table:
    """Windows of one bucket that a smaller doc_id holds too, packed by part of the documents (see LATE)."""
    h, proof, doc, mark, pos = unpacked(table)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if (same & (proof[order[1:]] != proof[order[:-1]])).any():  # unequal windows with one hash
        order = np.lexsort((proof, h))
        same = (h[order[1:]] == h[order[:-1]]) & (proof[order[1:]] == proof[order[:-1]])
    h, doc, mark, pos = h[order], doc[order], mark[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    least = np.minimum.reduceat(doc, first)
    late = doc > np.repeat(least, np.diff(np.append(first, len(h))))
    doc, mark, pos = doc[late], mark[late], pos[late]
    part = (mixed(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((pos, mark, doc, part))
    doc, mark, pos, part = doc[order], mark[order], pos[order], part[order]
    cut = np.flatnonzero(part[1:] != part[:-1]) + 1
    out = []
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(part)], strict=True):
        if e > s:
            first, n = _doc_runs(doc[s:e], mark[s:e])
            out.append((int(part[s]), doc[s + first].tobytes(), mark[s + first].tobytes(), n.astype(np.uint32).tobytes(), pos[s:e].tobytes()))
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.table({c.split()[0]: pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, (c, x) in enumerate(zip(LATE.split(", "), columns, strict=True))})


def gathered(table: pa.Table) -> pa.Table:
    """All windows of a part of the documents: one row (doc_id, mark, starts) per document."""
    docs, marks, counts, starts = (np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()]) for c, kind in (("docs", np.int64), ("marks", np.int64), ("counts", np.uint32), ("starts", np.uint32)))
    doc, mark = np.repeat(docs, counts), np.repeat(marks, counts)
    order = np.lexsort((starts, mark, doc))
    doc, mark, pos = doc[order], mark[order], starts[order]
    first, n = _doc_runs(doc, mark)
    return pa.table({"doc_id": pa.array(doc[first], pa.int64()), "mark": pa.array(mark[first], pa.int64()), "starts": pa.array([pos[s : s + k].tobytes() for s, k in zip(first.tolist(), n.tolist(), strict=True)], pa.binary())})


def kept_mask(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places no span of `width` from `starts` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) == 0


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and a mark of the text, which tells rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))


def repeated_starts(docs: DataFrame, width: int = WIDTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, mark, starts): windows to remove, as little-endian 32-bit word numbers."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    names = [x.split()[0] for x in PACKED.split(", ")]

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, off = text_bytes(batch.column("text"))
        hashes, proof, owner, place = windows(data, off, width)
        if not len(hashes):
            return None
        rows = packed(hashes, proof, owner, place, batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("mark").to_numpy(zero_copy_only=False), buckets)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    rows = _marked(docs).where("doc_id is not null").mapInArrow(batched(pack, "text"), PACKED)
    late = rows.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(lambda table: later_windows(table, buckets), LATE)
    return late.repartitionById(buckets, "part").groupBy("part").applyInArrow(gathered, "doc_id long, mark long, starts binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_removed, n_spans, kept_text, kept_sha256."""
    late = written(repeated_starts(docs, width), "late-windows")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = text_bytes(batch.column("text"))
        starts, ends, first = word_spans(data, off)
        raw, out = data.tobytes(), []
        for i, found in enumerate(batch.column("starts").to_pylist()):
            a, b = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
            keep = np.ones(len(a), bool)
            if found:
                keep = kept_mask(len(a), np.frombuffer(found, np.uint32).astype(np.int64), width)
            text = b" ".join([raw[x:y] for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True)])
            gone = ~keep
            out.append((len(a), int(gone.sum()), int((gone[1:] & keep[:-1]).sum() + (len(gone) and gone[0])), text.decode(), hashlib.sha256(text).hexdigest()))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "n_spans", "kept_text", "kept_sha256"])

    joined = _marked(docs).join(late, ["doc_id", "mark"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(batched(cut, "text"), "doc_id long, n_words long, n_removed long, n_spans long, kept_text string, kept_sha256 string")
