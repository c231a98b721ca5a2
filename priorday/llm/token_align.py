"""Alignment of two tokenizers' tokens, by divide and conquer at byte offsets where both end.

Every text is encoded by a byte-level tokenizer (A, over space+text) and a piece
tokenizer (B, which adds that space itself). An interval of tokens is cut at a common
end near its middle, found by bisecting B's ends for A's ends from the middle
outwards; both halves go on, and an interval without such an end is a leaf: one
group. All intervals of a level are handled at once, over all texts of a block.
A group links each of its A tokens with each of its B tokens.

How many documents hold a linked pair of ids is counted in Spark: a block gives each
pair once with its number of documents, pairs are summed map-side first, and an id's
highest count is a table of at most one row per token of A. Blocks then ask for the
counts of their own pairs; a pair is asked for once a block, so none is hot.

Encoding runs over chunks of a text, cut before each space that follows other than
white space: there both tokenizers always start a token (checked for B when it is
loaded). A worker keeps the chunks it has encoded.

Defined results: null and empty texts, and texts whose tokens do not spell
space+text byte for byte, have no tokens: zeros and an empty groups_sha256. Each row
is a document of its own: rows sharing a doc_id, or with a null one, are kept and
counted apart. Long texts take time in proportion (times the logarithm); of a group
over WIDE pairs only distinct ids are paired. Equal counts of an id all are its best.
An empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters, default_path
from .common import batched, written

BLOCK_BYTES = 2 << 20  # text whose pairs ask for their counts together
CHUNKS = 400_000  # encoded chunks a worker keeps; it starts anew when full
LONG_CHUNK = 2_000  # characters from which the library with a heap encodes A
WIDE = 64  # occurrence pairs of a group beyond which its ids are made distinct first
PAIR_BITS = 36  # two ids of up to 18 bits
DOUBLE = re.compile(r"\s\s").search
CHUNK = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?|\s+").findall
_NONE = np.zeros(0, np.uint32)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Places(dict):
    """Numbers of chunks, given when first asked for."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


class Both:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        made = [vocab["".join(p if isinstance(p, list) else p.split(" "))] for p in spec["model"]["merges"]]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        self.library = Tokenizer.from_file(path_a)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        special = {x["id"] for x in spec.get("added_tokens", [])}
        ranked = all(x < y for x, y in zip(made, made[1:], strict=False))  # ids in the order of the merges can stand for ranks
        self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for b, i in ranks.items() if i not in special}, special_tokens={}) if ranked else None
        by_id = {i: b for b, i in ranks.items()}
        self.bytes_a = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)
        self.sizes = tuple(np.array([max(len(b), 1) for b in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.spelling = _spelling(len(self.bytes_a), len(self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.place = _Places()
        self.ids = [np.zeros(0, np.uint32), np.zeros(0, np.uint32)]
        self.counts = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.exact = np.zeros(0, bool)

    def chunks(self, text: str) -> list[str]:
        """A text cut before each space that follows other than white space; that space is left out."""
        if not self.cuts:
            return [text]
        if not DOUBLE(text) and not text[-1:].isspace() and not text[:1].isspace():
            return text.split(" ")
        return [x[1:] for x in CHUNK(" " + text)]

    def encode_a(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of each chunk with its space. Chunks are encoded joined, but for those of which the next one's space would change the encoding."""
        alone = [i for i, x in enumerate(chunks) if self.ranked is None or not self.cuts or len(x) > LONG_CHUNK or not x or x[-1].isspace()]
        out: list[np.ndarray] = [_NONE] * len(chunks)
        for i in alone:
            easy = self.ranked is not None and len(chunks[i]) <= LONG_CHUNK
            out[i] = np.array(self.ranked.encode_ordinary(" " + chunks[i]) if easy else self.library.encode(" " + chunks[i], add_special_tokens=False).ids, np.uint32)
        rest = np.setdiff1d(np.arange(len(chunks)), alone)
        if len(rest):
            many = [" " + chunks[i] for i in rest.tolist()]
            ids = np.array(self.ranked.encode_ordinary("".join(many)), np.uint32)
            ends = np.searchsorted(np.cumsum(self.sizes[0][ids]), np.cumsum([len(x.encode()) for x in many])) + 1
            for i, x in zip(rest.tolist(), np.split(ids, ends[:-1]), strict=True):
                out[i] = x
        return out

    def spelled(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = b" " + text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))

    def learn(self, new: list[str]) -> None:
        a = self.encode_a(new)
        b = self.pieces.encode(new, num_threads=1)
        counts = [np.fromiter(map(len, x), np.int64, len(new)) for x in (a, b)]
        ids = [np.concatenate(a), np.fromiter(chain.from_iterable(b), np.uint32, counts[1].sum())]
        exact = np.array([self.spelled(x, y.tolist(), z) for x, y, z in zip(new, a, b, strict=True)], bool)
        self.ids = [np.concatenate(x) for x in zip(self.ids, ids, strict=True)]
        self.counts = [np.concatenate(x) for x in zip(self.counts, counts, strict=True)]
        self.exact = np.concatenate([self.exact, exact])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts by A and how many each has, then the same by B; a text that is not spelled exactly has none."""
        if len(self.place) > CHUNKS:
            self.forget()
        chunks = [self.chunks(t) if t else [] for t in texts]
        known = len(self.place)
        counts = np.array(list(map(len, chunks)), np.int64)
        codes = np.fromiter(map(self.place.__getitem__, chain.from_iterable(chunks)), np.int64, counts.sum())
        if len(self.place) > known:
            self.learn(list(islice(self.place, known, None)))
        owner = np.repeat(np.arange(len(texts)), counts)
        lost = np.zeros(len(texts), bool)
        for i in np.unique(owner[~self.exact[codes]]).tolist():
            lost[i] = not self.spelled(texts[i], *(_ragged(ids, n, codes[owner == i]).tolist() for ids, n in zip(self.ids, self.counts, strict=True)))
        if lost.any():
            codes, owner = codes[~lost[owner]], owner[~lost[owner]]
        out = []
        for ids, n in zip(self.ids, self.counts, strict=True):
            out += [_ragged(ids, n, codes), np.bincount(owner, n[codes], len(texts)).astype(np.int64)]
        return tuple(out)


def _ragged(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of `values` (of given sizes, one after the other) that `which` names, joined."""
    start = np.cumsum(sizes) - sizes
    return values[_spread(start[which], sizes[which])]


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


@lru_cache(maxsize=2)
def both(path_a: str, path_b: str) -> Both:
    return Both(path_a, path_b)


def shared_groups(end_a: np.ndarray, end_b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ends (as A token numbers, exclusive) of all groups, in order.

    end_a, end_b: rising byte ends of all tokens; last: A token numbers (exclusive) where
    texts end, which are common ends. Intervals stay in order, so bisecting walks forward."""
    hi = last
    lo = np.concatenate([[0], last[:-1]])
    done = []
    while len(lo):
        one = hi - lo == 1
        done.append(hi[one])
        lo, hi = lo[~one], hi[~one]
        middle = (lo + hi - 2) >> 1
        hit = end_b[np.searchsorted(end_b, end_a[middle])] == end_a[middle]
        cut = np.where(hit, middle, -1)
        live, step = np.flatnonzero(~hit), 0
        while len(live):
            step += 1
            for at in (middle[live] + step, middle[live] - step):
                open_ = (at >= lo[live]) & (at < hi[live] - 1) & (cut[live] < 0)
                ask = at[open_]
                hit = end_b[np.searchsorted(end_b, end_a[ask])] == end_a[ask]
                cut[live[open_][hit]] = ask[hit]
            live = live[(cut[live] < 0) & ((middle[live] + step + 1 < hi[live] - 1) | (middle[live] - step > lo[live]))]
        whole = cut < 0
        done.append(hi[whole])
        lo, hi, cut = lo[~whole], hi[~whole], cut[~whole] + 1
        lo, hi = np.stack([lo, cut], 1).ravel(), np.stack([cut, hi], 1).ravel()
    return np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)


def linked(ids_a: np.ndarray, ids_b: np.ndarray, na: np.ndarray, nb: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, pair of ids) keys in order, and how many occurrence pairs each has.

    na, nb, owner: tokens and text of every group."""
    at_a, at_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    key = lambda who, a, b: who << PAIR_BITS | a.astype(np.int64) << (PAIR_BITS // 2) | b.astype(np.int64)
    small = np.flatnonzero(na * nb <= WIDE)
    a = _spread(at_a[small], na[small])
    n = np.repeat(nb[small], na[small])
    keys = np.sort(key(np.repeat(np.repeat(owner[small], na[small]), n), np.repeat(ids_a[a], n), ids_b[_spread(np.repeat(at_b[small], na[small]), n)]))
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    found, times = [keys[head]], [np.diff(np.append(head, len(keys)))]
    for g in np.flatnonzero(na * nb > WIDE).tolist():
        x, cx = np.unique(ids_a[at_a[g] : at_a[g] + na[g]], return_counts=True)
        y, cy = np.unique(ids_b[at_b[g] : at_b[g] + nb[g]], return_counts=True)
        found.append(key(owner[g], np.repeat(x, len(y)), np.tile(y, len(x))))
        times.append(np.outer(cx, cy).ravel())
    if len(found) == 1:
        return found[0], times[0]
    keys, times = np.concatenate(found), np.concatenate(times)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[head], np.add.reduceat(times, head)


def _spelling(n_a: int, n_b: int) -> np.ndarray:
    """Decimal ids with the sign that follows them, padded with zero bytes to eight: of id i row 2i, or 2i+1 where its
    group's side ends; B's rows after A's."""
    return np.array([f"{i}{s}".encode() for n, signs in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for s in signs], "S8").view(np.uint64)


def _spelled_groups(table: np.ndarray, n_a: int, ids_a: np.ndarray, ids_b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The padded spellings of all tokens, group by group."""
    size = na + nb
    start = np.cumsum(size) - size
    row = np.empty(size.sum(), np.int64)
    row[_spread(start, na)] = 2 * ids_a.astype(np.int64)
    row[_spread(start + na, nb)] = 2 * ids_b.astype(np.int64) + 2 * n_a
    row[start + na - 1] += 1
    row[start + size - 1] += 1
    return table[row]


def aligned(texts: list[str | None], path_a: str, path_b: str) -> dict[str, np.ndarray | list]:
    """Of every text: tokens, groups, links, digest; and the keys and times of `linked`."""
    t = both(path_a, path_b)
    ids_a, n_a, ids_b, n_b = t.encode(texts)
    end_a, end_b = np.cumsum(t.sizes[0][ids_a]), np.cumsum(t.sizes[1][ids_b])
    full = n_a > 0
    to = shared_groups(end_a, end_b, np.cumsum(n_a)[full])
    to_b = np.searchsorted(end_b, end_a[to - 1]) + 1
    na, nb = np.diff(to, prepend=0), np.diff(to_b, prepend=0)
    owner = np.searchsorted(np.cumsum(n_a), to - 1, "right")
    keys, times = linked(ids_a, ids_b, na, nb, owner)
    padded = _spelled_groups(t.spelling, len(t.bytes_a), ids_a, ids_b, na, nb)
    ends = np.cumsum(n_a + n_b).tolist()
    digests = [hashlib.sha256(padded[e - n : e].tobytes().translate(None, b"\0")[:-1]).hexdigest() if n else "" for e, n in zip(ends, (n_a + n_b).tolist(), strict=True)]
    return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(owner, minlength=len(texts)), "n_links": np.bincount(owner, na * nb, len(texts)).astype(np.int64), "groups_sha256": digests, "keys": keys, "times": times}


def groups(text: str, path_a: str | None = None, path_b: str | None = None) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: (ids of A, ids of B) each."""
    t = both(path_a or default_path(), path_b or default_pieces())
    ids_a, _, ids_b, _ = t.encode([text])
    end_a, end_b = np.cumsum(t.sizes[0][ids_a]), np.cumsum(t.sizes[1][ids_b])
    to = shared_groups(end_a, end_b, np.array([len(ids_a)] if len(ids_a) else [], np.int64))
    to_b = np.searchsorted(end_b, end_a[to - 1]) + 1
    cut = lambda ids, ends: [ids[s:e].tolist() for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return list(zip(cut(ids_a, to), cut(ids_b, to_b), strict=True))


PER_DOC = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, sizes array<int>, codes binary, times binary, pairs array<long>, docs array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which packs well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per block of documents (see BLOCKS): figures of its documents, its distinct pairs with their number of
    documents, and for every document the places of its pairs in that list and their times."""
    kinds = [f.split(" ")[1] for f in BLOCKS.split(", ")]
    names = [f.split(" ")[0] for f in BLOCKS.split(", ")]
    arrow = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0

        def block(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal n
            made = aligned(batch.column("text").to_pylist(), path_a, path_b)
            keys = made.pop("keys")
            pairs, at, documents = np.unique(keys & ((1 << PAIR_BITS) - 1), return_inverse=True, return_counts=True)
            row = {"block": part << 32 | n, "doc_id": batch.column("doc_id").to_pylist()} | made
            row |= {"sizes": np.bincount(keys >> PAIR_BITS, minlength=batch.num_rows), "codes": _planes(at), "times": _planes(made["times"]), "pairs": pairs, "docs": documents}
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([row[c]], arrow[k]) for c, k in zip(names, kinds, strict=True)], names=names)

        yield from batched(block, "text", BLOCK_BYTES)(batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no pair of its A id is held by more.

    The highest counts have a row per id of A at most, which bounds the broadcast."""
    counts = held.select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n"))
    counts = written(counts, "pair-counts")
    id_a = F.shiftright("pair", PAIR_BITS // 2)
    most = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", id_a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _judged(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of one block with the counts of their pairs summed."""
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    row = {c: asked[c].to_pylist()[0] for c in asked.column_names if c != "block"}
    n = np.zeros(counted.num_rows, np.int64)
    best = np.zeros(counted.num_rows, bool)
    place = counted["at"].to_numpy()
    n[place], best[place] = counted["n"].to_numpy(), counted["best"].to_numpy(zero_copy_only=False)
    codes, times, sizes = _of_planes(row["codes"]), _of_planes(row["times"]), np.array(row["sizes"], np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # sums of whole numbers, exact at any size
    row["count_sum"] = _sums(times * n[codes], owner, len(sizes))
    row["n_best"] = _sums(times * best[codes], owner, len(sizes))
    return pa.table({c: pa.array(row[c], pa.string() if c == "groups_sha256" else pa.int64()) for c in names})


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    edge = np.searchsorted(owner, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text); see RESULT and the module's text."""
    held = written(blocks(docs, path_a or default_path(), path_b or default_pieces()), "token-blocks")
    counts = pair_counts(held)
    asks = held.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    answers = asks.join(counts, "pair").select("of", "at", "n", "best")
    docs_of = held.drop("pairs", "docs")
    return docs_of.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_judged, RESULT)
