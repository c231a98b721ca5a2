"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one vocabulary token ends its encoding. An
Aho-Corasick automaton (a trie with suffix links) lists the tokens that end at
each position; the right one is the token that is compatible with the last token
of the prefix before it, that is, whose pair encodes back to itself. The last
tokens are stored and followed backwards to give the ids. Texts are first split
at added tokens and by the tokenizer's pattern, as the tokenizers library does.

Defined results: null and empty texts have no ids and decode to the empty text.
Rows are encoded one by one: repeated rows and shared doc_ids give equal results,
a null doc_id is kept. Long texts and long pieces take linear time. An empty
table gives an empty result; further columns are ignored."""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batched

# Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
PIECES = 300_000  # encoded pieces a worker keeps; it starts anew when full
PAIRS = 2_000_000  # pair verdicts a worker keeps


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: byte by letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """One tokenizer file, made ready for encoding and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {vocab[t]: b for t, b in raw.items()} | {i: t.encode() for t, i in self.special.items()}
        self.single = {b: vocab[t] for t, b in raw.items() if len(b) == 1}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        made = {new for _, new in self.merge.values()}
        self.automaton = ahocorasick.Automaton()
        for t, b in raw.items():
            if len(b) == 1 or vocab[t] in made:
                self.automaton.add_word(b.decode("latin-1"), (vocab[t], len(b)))
        self.automaton.make_automaton()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.pairs: dict[int, bool] = {}
        self.wholes: dict[int, bool] = {}
        self.pieces = _Pieces(self)

    def merged(self, ids: list[int]) -> list[int]:
        """The merge rules applied to a short list of ids: lowest rank first, leftmost among equals."""
        ids, get, never = list(ids), self.merge.get, (1 << 62, -1)
        found = [get(p, never) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is never:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), never)
        return ids

    def spelled(self, token: int) -> list[int]:
        return [self.single[bytes([b])] for b in self.bytes_of[token]]

    def whole(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself."""
        if (ok := self.wholes.get(token)) is None:
            ok = self.wholes[token] = self.merged(self.spelled(token)) == [token]
        return ok

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of two neighbouring tokens encode to just these two."""
        key = a << 32 | b
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = (a, b) not in self.merge and self.whole(b) and self.merged(self.spelled(a) + self.spelled(b)) == [a, b]
        return ok

    def piece(self, text: bytes) -> list[int]:
        """Ids of one piece, by last tokens of prefixes and back-pointers."""
        n = len(text)
        last = [(-1, 0)] * (n + 1)
        for end, (token, size) in self.automaton.iter(text.decode("latin-1")):
            if last[end + 1][0] >= 0:
                continue
            start = end + 1 - size
            if self.whole(token) if start == 0 else last[start][0] >= 0 and self.compatible(last[start][0], token):
                last[end + 1] = (token, size)
        ids, at = [], n
        while at:
            token, size = last[at]
            if token < 0:
                raise ValueError("the vocabulary cannot spell this piece")
            ids.append(token)
            at -= size
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not self.special or not any(t in text for t in self.special):
            out = b"".join(map(self.pieces.__getitem__, self.find(text)))
        else:
            out = b"".join(
                np.uint32(self.special[part]).tobytes() if i % 2 else b"".join(map(self.pieces.__getitem__, self.find(part)))
                for i, part in enumerate(self.split_special.split(text))
            )
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Pieces(dict):
    """Encoded pieces, made when first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.encoder.piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids (binary, 32-bit little-endian), decoded (the ids turned back into text)."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path)
        ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    return docs.select("doc_id", "text").mapInArrow(batched(run, "text"), "doc_id long, n_tokens long, ids binary, decoded string")
