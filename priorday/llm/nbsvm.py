"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are hashed indicators of word uni- and bigrams (ASCII lower case) and of
uni-, bi- and trigrams of word shapes (runs of letters, capitals and digits
collapsed). Their document counts by class come from every labelled training row
in Spark; the smoothed log ratio of class frequencies scales each indicator, and
each text is brought to unit length. A linear hinge-loss model is then fitted by
dual coordinate descent on a bounded sample of labelled documents, those with the
smallest id hashes: at most SAMPLE of them, and no more than hold SAMPLE_FEATURES
indicators together (4 bytes each on the driver), which is the one sample here.
Every text is scored.

Defined results: null and empty texts are scored by the model's bias alone. A row
with a null doc_id is scored but never labelled. Repeated label rows of one
doc_id count once, with the smaller quality; of repeated rows of a labelled doc_id
all count in the ratios and one is fitted on. Texts of any length are read whole. Without any labels every score is
0.5; with one class only, every score is that class. An empty table gives an
empty result; lang, source and further columns are never read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, byte_values, mixed, prefix_sums, span_hash, text_bytes, word_spans, written

FEATURE_BITS = 18
SAMPLE = 8000  # labelled rows that the hinge-loss model is fitted on, at most
SAMPLE_FEATURES = 40_000_000  # indicators of those rows, at most
SMOOTH = 1.0
C = 1.0
EPOCHS = 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_RUN = np.zeros(256, bool)
_RUN[[ord("a"), ord("A"), ord("0")]] = True


def text_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of every distinct (text, feature), sorted."""
    starts, ends, first = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(first))
    words = span_hash(prefix_sums(byte_values(_LOWER[data])), starts, ends)
    kinds = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~((kinds[1:] == kinds[:-1]) & _RUN[kinds[1:]])
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = span_hash(prefix_sums(byte_values(kinds[keep])), place[starts], place[ends])
    found = []
    for salt, (base, most) in enumerate(((words, 2), (shapes, 3))):
        gram = mixed(base + np.uint64(salt + 1))
        for n in range(1, most + 1):
            if n > 1:
                with np.errstate(over="ignore"):
                    gram = mixed(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + base[n - 1 :])
            inside = owner[: len(gram)] == owner[n - 1 :][: len(gram)]
            found.append(owner[: len(gram)][inside] << FEATURE_BITS | (gram[inside] >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> FEATURE_BITS, both & ((1 << FEATURE_BITS) - 1)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def log_ratios(counts: list, n0: int, n1: int) -> np.ndarray:
    """Smoothed log ratio of each feature's document frequency in class 1 against class 0."""
    rows = np.zeros((2, 1 << FEATURE_BITS))
    for x in counts:
        rows[0, x.feature], rows[1, x.feature] = x.n0, x.n1
    return np.log((rows[1] + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((rows[0] + SMOOTH) / (n0 + 2 * SMOOTH))


def fitted(docs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = C, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights (by feature) and bias of the hinge-loss model, by dual coordinate descent, and the dual variables.

    Rows are unit-length scaled indicators with a constant 1 for the bias; classes
    weigh the same in sum."""
    x = [ratio[d] / max(np.sqrt((ratio[d] ** 2).sum()), 1e-12) for d in docs]
    square = np.array([(v**2).sum() + 1 for v in x])
    most = c * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    alpha, w, bias = np.zeros(len(y)), np.zeros(len(ratio)), 0.0
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(y)).tolist():
            slope = y[i] * (w[docs[i]] @ x[i] + bias) - 1
            now = min(max(alpha[i] - slope / square[i], 0.0), most[i])
            step = (now - alpha[i]) * y[i]
            if step:
                w[docs[i]] += step * x[i]
                bias += step
                alpha[i] = now
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w, bias, alpha


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_FEATURES) -> tuple[np.ndarray, np.ndarray, float] | float:
    """(log ratios, weights, bias), or a constant score if there are not two classes."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good")).where(~held_out())
    known = known.withColumn("order", F.xxhash64("doc_id"))
    edge = known.orderBy("order").limit(sample).agg(F.max("order")).first()[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out()).join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "good", (F.col("order") <= F.lit(edge)).alias("sampled"))

    def count(batches):
        totals, n = np.zeros((2, 1 << FEATURE_BITS), np.int64), [0, 0]
        out = []

        def make(part):
            data, off = text_bytes(part.column("text"))
            owner, feature = text_features(data, off)
            good = part.column("good").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                totals[k] += np.bincount(feature[good[owner] == k], minlength=1 << FEATURE_BITS)
                n[k] += int((good == k).sum())
            chosen = np.flatnonzero(part.column("sampled").to_numpy(zero_copy_only=False))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            cut = np.searchsorted(owner, np.arange(len(off)))
            body = [feature[cut[i] : cut[i + 1]].astype("<i4").tobytes() for i in chosen]
            out.append((np.full(len(chosen), -2), good[chosen].astype(np.int64), ids[chosen], body))

        for _ in batched(make, "text")(batches):
            pass
        used = np.flatnonzero(totals.any(axis=0))
        out.append((np.append(used, -1), np.append(totals[0, used], n[0]), np.append(totals[1, used], n[1]), [None] * (len(used) + 1)))
        for a, b, c, d in out:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["feature", "n0", "n1", "body"])

    # feature >= 0: counts by class; -1: rows by class; -2: a sampled row (n0 its class, n1 its id)
    made = written(rows.mapInArrow(count, "feature int, n0 long, n1 long, body binary"), "feature-counts")
    counts = made.where("feature >= -1").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()  # 2**18 + 1 rows at most
    n0, n1 = next(((x.n0, x.n1) for x in counts if x.feature == -1), (0, 0))
    if not n0 or not n1:
        return 0.5 if not n0 and not n1 else float(n1 > 0)
    ratio = log_ratios([x for x in counts if x.feature >= 0], n0, n1)
    once = made.where("feature = -2").groupBy(F.col("n1").alias("id")).agg(F.min(F.struct("body", "n0")).alias("x")).withColumn("order", F.xxhash64("id"))
    sizes = once.select("order", F.octet_length("x.body").alias("size")).orderBy("order").collect()  # `sample` small rows
    room = np.searchsorted(np.cumsum([x["size"] // 4 for x in sizes]), most, "right")
    if not room:
        raise ValueError("the first labelled row holds more than the features allowed")
    chosen = [(x.id, x.n0, x.body) for x in once.where(F.col("order") <= sizes[room - 1].order).select("id", "x.n0", "x.body").orderBy("id").collect()]
    y = np.array([1.0 if good else -1.0 for _, good, _ in chosen])
    if len(set(y.tolist())) < 2:
        return float(y[0] > 0)
    w, bias, _ = fitted([np.frombuffer(b, "<i4") for _, _, b in chosen], y, ratio)
    return ratio, w, bias


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score (0 to 1), predicted (0 or 1)."""
    model = trained(docs, labels, sample)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    if isinstance(model, float):
        return whole.select("doc_id", "held_out", F.lit(model).alias("score"), F.lit(int(model >= 0.5)).alias("predicted"))
    ratio, w, bias = model
    sent = docs.sparkSession.sparkContext.broadcast((w * ratio, ratio**2))  # 2**18 numbers each

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        weight, square = sent.value
        data, off = text_bytes(batch.column("text"))
        owner, feature = text_features(data, off)
        dot = np.bincount(owner, weight[feature], len(off) - 1)
        norm = np.sqrt(np.bincount(owner, square[feature], len(off) - 1))
        margin = dot / np.maximum(norm, 1e-12) + bias
        p = 1 / (1 + np.exp(-2 * np.clip(margin, -15, 15)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return whole.mapInArrow(batched(score, "text"), "doc_id long, held_out boolean, score double, predicted int")
