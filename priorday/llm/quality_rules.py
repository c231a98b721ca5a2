"""Quality rules on repetition inside a text, found with suffix arrays over its words.

Words are `[^\\x20\\x09-\\x0D]+`. For a slice of texts one suffix array is built
over words made distinct by text, so no repeat crosses two texts. The
longest-common-prefix interval of every suffix gives the maximal repeated
substring that starts there; spans of at least `min_repeat` words are united.
A text is kept if the base rules hold, the united spans cover at most
`max_covered` of its words and no repeat is longer than `max_repeat` of them.

Defined results: a null or empty text has no words, fails the base rules and is
not kept. Words are told apart by their bytes, long ones too. A text over the slice
size is a slice of its own. Rows are judged one by one, so repeated rows and ties get equal
results; other columns are passed over (`text` and `doc_id` are read by name).
An empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batched, text_bytes, word_codes, word_spans
from .suffix import longest_repeats

MIN_REPEAT = 16  # words of the shortest repeat that counts as covered
MAX_COVERED = 0.25  # share of words that repeats may cover
MAX_REPEAT = 0.2  # longest repeat as a share of the words
MIN_WORDS = 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_words long, longest_repeat long"
)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def repetition(data: np.ndarray, off: np.ndarray, min_repeat: int) -> tuple[np.ndarray, ...]:
    """Per text: words, words in repeated 3-word windows, words in long repeats, longest repeat."""
    starts, ends, first = word_spans(data, off)
    n, counts = len(starts), np.diff(first)
    if not n:
        zero = np.zeros(len(counts), np.int64)
        return counts, zero, zero, zero
    word = word_codes(data, starts, ends)
    owner = np.repeat(np.arange(len(counts)), counts)
    _, codes = np.unique(owner * (word.max() + 1) + word, return_inverse=True)
    longest = longest_repeats(codes)
    three = np.flatnonzero(longest >= 3)
    in_three = _covered(three, np.full(len(three), 3), n)
    long = np.flatnonzero(longest >= min_repeat)
    in_long = _covered(long, longest[long], n)
    most = np.zeros(len(counts), np.int64)
    full = counts > 0
    most[full] = np.maximum.reduceat(longest, first[:-1][full])
    return counts, _per_text(in_three, first), _per_text(in_long, first), most


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def judged(batch: pa.RecordBatch, min_repeat: int, max_covered: float, max_repeat: float, min_words: int) -> dict[str, np.ndarray]:
    """The counts and verdicts of a slice's texts."""
    data, off = text_bytes(batch.column("text"))
    n_words, three, covered, longest = repetition(data, off, min_repeat)
    point = ((data & 0xC0) != 0x80) & ~_SPACES[data]
    raw = data.tobytes()
    lines = [dup_lines(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    failed = (n_words < min_words) | (100 * three > 50 * n_words)
    kept = ~failed & (covered <= max_covered * n_words) & (longest <= np.maximum(max_repeat * n_words, min_repeat))
    return {
        "n_words": n_words,
        "word_chars": _per_text(point, off),
        "n_symbols": _per_text(_SYMBOL[data], off),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": three,
        "base_failed": failed,
        "kept": kept,
        "covered_words": covered,
        "longest_repeat": longest,
    }


def repetition_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: float = MAX_REPEAT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text) with its counts and verdict; see the module's text."""

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = judged(batch, min_repeat, max_covered, max_repeat, min_words)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, made.values())], names=["doc_id", *made])

    return docs.select("doc_id", "text").mapInArrow(batched(judge, "text"), SCHEMA)


def passing(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: float = MAX_REPEAT, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns."""

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(judged(batch, min_repeat, max_covered, max_repeat, min_words)["kept"]))

    return docs.mapInArrow(batched(keep, "text"), docs.schema)
