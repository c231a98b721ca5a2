"""Shared helpers: written tables, Arrow slices and span hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorday.sources.shared import forget, shared_dir, written

__all__ = ["forget", "shared_dir", "written", "batched", "byte_values", "mixed", "offsets", "powers", "prefix_sums", "salted_join", "slices", "span_hash", "text_bytes", "word_codes", "word_hashes", "word_spans"]

SLICE_BYTES = 2 << 20  # text handled at once inside a Python worker


def salted_join(rows: DataFrame, one: DataFrame, key: str, spread: Column, salts: int = 8) -> DataFrame:
    """Inner join of `rows` with `one` (a row per key): rows of a hot key are dealt to several tasks by `spread`."""
    many = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(many, [key, "salt"]).drop("salt")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch holding about `most` bytes of `column`; one long value is never cut."""
    if not batch.num_rows:
        return
    ends = offsets(batch.column(column))[1:].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, from 0; nulls are empty."""
    array = _plain(array)
    raw = np.frombuffer(array.buffers()[1], np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32)
    raw = raw[array.offset : array.offset + len(array) + 1]
    return raw - raw[0]


def _plain(array: pa.Array) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not array.null_count:
        return array
    return array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in one uint8 array, and the offsets of its values."""
    array = _plain(array)
    off = offsets(array).astype(np.int64)
    if not off[-1]:
        return np.zeros(0, np.uint8), off
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    first = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset]
    return np.frombuffer(array.buffers()[2], np.uint8)[first : first + off[-1]], off


def batched(make: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str, most: int = SLICE_BYTES):
    """A mapInArrow function that applies `make` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = make(part)
                if out is not None and out.num_rows:
                    yield out

    return run


# --- words and hashes of spans -------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SECOND = np.uint64(0xD1B54A32D192ED03)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept up to the longest asked for."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        row = np.full(max(n, 1), base, np.uint64)
        row[0] = 1
        have = np.cumprod(row, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Rabin-Karp prefix sums: sums[j] - sums[i] is the weighted content of i..j-1."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
        return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit content hashes of spans; equal content gives equal hashes wherever it stands.

    For spans of up to some hundred values; long regular sequences can collide, so
    whole words, lines and regions are hashed by other means."""
    with np.errstate(over="ignore"):
        inverse = powers(_INVERSE, len(sums))
        return mixed((sums[end] - sums[start]) * inverse[start])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of every text, and each text's first word number."""
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = off[:-1][np.diff(off) > 0]
    begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = off[1:][np.diff(off) > 0] - 1
    end[last] = inside[last]
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


_LOW = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
SHORT_WORD = 7  # bytes up to which a word and its length fit a 64-bit key


def _word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of byte spans that hold bytes and length, for spans up to SHORT_WORD; the numbers of the longer spans."""
    n = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    keys = (lanes[starts] & _LOW[np.minimum(n, SHORT_WORD)]) | (n.astype(np.uint64) << np.uint64(56))
    return keys, np.flatnonzero(n > SHORT_WORD)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of byte spans, the same for equal spans and for no others."""
    keys, long = _word_keys(data, starts, ends)
    raw, found = data.tobytes(), {}
    mark = (SHORT_WORD + 1) << 56
    keys[long] = [mark + found.setdefault(raw[a:b], len(found)) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return np.unique(keys, return_inverse=True)[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each byte span. Short spans differ in both wherever they differ at all; those of long
    spans are the halves of XXH3-128 and independent of each other."""
    keys, long = _word_keys(data, starts, ends)
    one, two = mixed(keys), mixed(keys ^ _SECOND)
    if len(long):
        raw = data.tobytes()
        both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]), ">u8").astype(np.uint64).reshape(-1, 2)
        one[long], two[long] = both[:, 0], both[:, 1]
    return one, two
