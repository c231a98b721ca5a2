"""Near-dedup, window and suffix dedup against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from priorday.llm import common, quality_rules, simhash, substring_dedup, suffix, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocab = ["ab", "cde", "é", "fgh", "ij,", "K", "漢字"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90))) for _ in range(14)]
    out = []
    for i in range(40):
        t = base[rng.randrange(14)]
        if i % 3 == 0:
            t += "\n" + base[rng.randrange(14)]
        if i % 5 == 0:
            t = t.replace("ab", "AB", 1)
        out.append((i * 3, t))
    return [*out, (200, None), (201, ""), (202, " \t\n"), (203, out[0][1]), (203, out[1][1]), (None, out[2][1]), (204, "x"), (205, "a" * 300)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*r, "src", 7, "t") for r in texts], "doc_id long, text string, source string, mark long, _mark string").repartition(3)


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(200):
        codes = rng.integers(0, rng.integers(1, 4), rng.integers(0, 40)).astype(np.int64)
        text, sa = codes.tolist(), suffix.suffix_array(codes)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffix.common_prefixes(codes, sa)
        for r in range(1, len(text)):
            a, b, k = sa[r], sa[r - 1], 0
            while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert lcp[a] == k


def test_bucket_links_carry_the_components():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    for n in (3, 64, 400):
        fp = centre[rng.integers(0, 6, n)]
        for _ in range(3):
            fp = np.where(rng.random(n) < 0.8, fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), fp)
        fp = np.unique(fp)
        label = np.arange(len(fp))
        for i, j in simhash.bucket_links(fp):
            for a, b in zip(i, j, strict=True):
                assert np.bitwise_count(fp[a] ^ fp[b]) <= 3
                label[label == label[a]] = label[b]
        for a in range(len(fp)):
            near = np.flatnonzero(np.bitwise_count(fp ^ fp[a]) <= 3)
            assert (label[near] == label[a]).all()


def test_thresholds_sum_as_the_principle_asks():
    table = np.full((64, 64), 250.0) + np.diag(np.full(64, 250.0))
    for n in (10, 10**6, 10**10):
        parts, ts = simhash.thresholds(n, table)
        assert sorted(b for p in parts for b in p) == list(range(64)) and sum(t + 1 for t in ts) == simhash.RADIUS + 1


def brute_fingerprint(text, xxh):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh[g] for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_match_brute_force(spark, texts, docs):
    grams = set()
    for _, t in texts:
        words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(t or "")]
        grams |= {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    xxh = {r.g: r.h & (1 << 64) - 1 for r in spark.createDataFrame([(g,) for g in grams], "g string").select("g", F.xxhash64("g").alias("h")).collect()}
    fps = [brute_fingerprint(t, xxh) for _, t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), k in zip(texts, label, strict=True):
        if doc is not None:
            least[k] = min(least.get(k, doc), doc)
    want = sorted((str(d), f"{f:016x}", str(least.get(k))) for (d, _), f, k in zip(texts, fps, label, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(label))


def brute_windows(texts, width):
    words = [WORD.findall(t or "") for _, t in texts]
    first = {}
    for (doc, _), w in zip(texts, words, strict=True):
        for k in range(len(w) - width + 1):
            if doc is not None:
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), w in zip(texts, words, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if doc is not None and first[tuple(w[k : k + width])] < doc:
                keep[k : k + width] = [False] * width
        out.append((str(doc), len(w), keep.count(False), hashlib.sha256(" ".join(x for x, y in zip(w, keep, strict=True) if y).encode()).hexdigest()))
    return sorted(out)


def test_window_dedup_matches_brute_force(texts, docs):
    for width in (4, 13):
        got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, width).collect())
        assert got == brute_windows(texts, width)


def brute_bytes(texts, length):
    seen = {}
    raw = [(t or "").encode() for _, t in texts]
    for b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for (doc, _), b in zip(texts, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(doc), len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 4000, "spread": 1}])
def test_suffix_dedup_matches_brute_force(texts, docs, how):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length=60, gram=8, **how).collect())
    assert got == brute_bytes(texts, 60)


@pytest.fixture(scope="module")
def shared_passages():
    """700 texts around one passage, so that its anchor has more kinds than SPREAD; texts 2i and 2i+1 share more."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz      "
    made = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, out = made(450), []
    for i in range(0, 700, 2):
        more = made(120)
        out += [(i + d, made(200) + passage + more + made(150)) for d in (0, 1)]
    return [*out, (900, passage), (901, passage[:399])]


def test_suffix_dedup_at_full_length_merges_shards(spark, shared_passages):
    docs = spark.createDataFrame(shared_passages, "doc_id long, text string").repartition(4)
    kinds = suffix_dedup.region_kinds(suffix_dedup.occurrences(docs, suffix_dedup.LENGTH, suffix_dedup.GRAM))
    assert kinds.agg(F.max("n_kinds")).first()[0] > suffix_dedup.SPREAD
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute_bytes(shared_passages, 400)


def test_suffix_dedup_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute_bytes(rows, 400)


def thue_morse(n):
    """Two words whose sums of powers modulo 2**64 agree for every odd base and any two letter values."""
    word = ["ab"[bin(i).count("1") & 1] for i in range(n)]
    return "".join(word), "".join("ab"["ab".index(c) ^ 1] for c in word)


def test_words_with_equal_sums_of_powers_stay_apart(spark):
    a, b = thue_morse(1 << 10)
    rest = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, a + "\n" + "x" * 40), (4, b + "\n" + "y" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_removed == 0 for r in substring_dedup.remove_repeats(docs).collect())
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute_bytes(rows, 400)


def test_windows_with_one_hash_are_told_apart(monkeypatch, texts, docs):
    """With the first hash cut to 8 bits the verifying hash alone keeps the result right."""
    plain = substring_dedup.windows

    def dull(*args):
        h, *rest = plain(*args)
        return h & np.uint64(0xFF), *rest

    monkeypatch.setattr(substring_dedup, "windows", dull)
    h, proof, owner, place = substring_dedup.windows(*_bytes([t for _, t in texts]), 4)
    table = _bucket(h, proof, owner, place, [-1 if d is None else d for d, _ in texts])
    late = substring_dedup.gathered(substring_dedup.later_windows(table, 1))
    words = [WORD.findall(t or "") for _, t in texts]
    first = {}
    for (doc, _), w in zip(texts, words, strict=True):
        for k in range(len(w) - 3):
            first[tuple(w[k : k + 4])] = min(first.get(tuple(w[k : k + 4]), 999), -1 if doc is None else doc)
    want = sorted((-1 if d is None else d, k) for (d, _), w in zip(texts, words, strict=True) for k in range(len(w) - 3) if first[tuple(w[k : k + 4])] < (-1 if d is None else d))
    assert sorted((d, k) for d, s in zip(late["doc_id"].to_pylist(), late["starts"].to_pylist(), strict=True) for k in np.frombuffer(s, np.uint32).tolist()) == want


def _bytes(values):
    return common.text_bytes(pa.array(values, pa.string()))


def _bucket(h, proof, owner, place, doc):
    doc = np.array(doc, np.int64)
    rows = substring_dedup.packed(h, proof, owner, place, doc, np.arange(len(doc)), 1)
    return pa.table({c.split()[0]: [r[i] for r in rows] for i, c in enumerate(substring_dedup.PACKED.split(", "))})


def test_very_long_texts(spark):
    """A megabyte in one text, of one word and of many, in bounded time."""
    rng = random.Random(13)
    many = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(170_000))
    rows = [(1, "x" * 1_000_000), (2, many), (3, many[500:1500]), (4, "ab " * 330_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    nine = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    eight = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert time.time() - began < 180
    assert nine[1].n_removed == nine[2].n_removed == nine[4].n_removed == 0 and nine[3].n_removed >= nine[3].n_words - 2
    assert eight[1].n_removed == 1_000_000 and eight[4].n_removed == 990_000 and eight[2].n_removed == eight[3].n_removed == 1000


def test_empty_tables(docs):
    none = docs.where("doc_id < 0")
    assert simhash.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


# Two words that one chained 64-bit word hash cannot tell apart.
ALIKE = ("r?iGp/58!@@!!!@!", "'b&#z9PRzhqMD#vE")


def test_words_are_told_apart(spark):
    rng = random.Random(14)
    words = list({"".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 9))) for _ in range(4000)} | set(ALIKE))
    raw = [w.encode() for w in words]
    ends = np.cumsum(list(map(len, raw)))
    at = (np.frombuffer(b"".join(raw), np.uint8), ends - list(map(len, raw)), ends)
    assert len(set(common.word_codes(*at).tolist())) == len(words)
    for hashes in common.word_hashes(*at):
        assert len(set(hashes.tolist())) == len(words)
    rest = " ".join(f"w{i}" for i in range(12))
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(i, f"{rest} {w}") for i, w in enumerate(ALIKE)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in rows] == [0, 0]
    both = " ".join(f"x{i} {w} y z{i}" for i in range(1) for w in ALIKE) + " q" * 1
    judged = quality_rules.repetition_rules(spark.createDataFrame([(0, f"a {ALIKE[0]} b mid a {ALIKE[1]} b"), (1, both)], "doc_id long, text string")).collect()
    assert [r.n_repeat_words for r in judged] == [0, 0]
