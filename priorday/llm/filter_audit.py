"""Audit of filters that act on one another: what each removes under every order of applying them.

A document's failed filters are a mask. Under an order it is removed at the first
step whose filter it fails, so the orders in which a mask falls at a step are those
that begin with passed filters followed by a failed one: in lexicographic (Lehmer)
rank such orders form intervals. Documents are counted by part and mask; counts are
added at the ends of their masks' intervals, and prefix sums over the ranks give
the removals of every order and step. Work after the counting depends on parts
alone: at most 2**k masks for k filters, 587 intervals for five.

The filter of repeated texts fails a document whose text a smaller doc_id has too.
Texts are told apart by SHA-256. Copies are summed by text, part, mask and labels
before any shuffle of their key, and the first document of a text is found by
joining on text and smallest doc_id, so no group of copies meets in one task.

Defined results: a null text is empty; empty texts are copies of each other. A null
part is the empty string. A null doc_id has no order and no labels: it neither fails
as a copy nor makes others fail. Rows sharing a doc_id count each; none of those
with the smallest doc_id of a text fails. Repeated labels of a doc_id: good (toxic)
if any of them is 1. Null labels are neither. Long texts are whole rows of one task.
An empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MOST_FILTERS = 6  # 720 orders; every further one multiplies the result
SPACES = r"[\x20\x09-\x0D]+"


def default_filters() -> dict[str, Column | None]:
    """Columns that are true where `text` fails; None stands for the filter of repeated texts.

    A: under 200 words; B: less than half of them distinct; C: over 2 % capitals; D: holds a symbol."""
    words = F.array_remove(F.split("text", SPACES), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": F.regexp_count("text", F.lit("[A-Z]")).cast("long") * 100 > F.length("text").cast("long") * 2,
        "D": F.col("text").rlike("[#$%&*|]"),
        "E": None,
    }


def orders(letters: str) -> list[str]:
    """All orders of the letters by Lehmer rank, which is lexicographic."""
    return ["".join(p) for p in permutations(sorted(letters))]


def removal_intervals(k: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, lo, hi): a document failing `mask` is removed at `step` in the orders of ranks lo..hi-1, and in no others."""
    found: list[tuple[int, int, int, int]] = []

    def walk(mask: int, step: int, rank: int, left: tuple[int, ...]) -> None:
        width = factorial(len(left) - 1)
        for digit, f in enumerate(left):
            lo = rank + digit * width
            if not mask >> f & 1:
                walk(mask, step + 1, lo, left[:digit] + left[digit + 1 :])
            elif found and found[-1][:2] == (mask, step) and found[-1][3] == lo:  # the interval before goes on
                found[-1] = (*found[-1][:3], lo + width)
            else:
                found.append((mask, step, lo, lo + width))

    for mask in range(1, 1 << k):
        walk(mask, 1, 0, tuple(range(k)))
    return found


def _judged(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | None], part: str) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by part and set of failed filters (bit i: the i-th letter)."""
    letters = sorted(filters)
    bit = {c: 1 << i for i, c in enumerate(letters)}
    plain = [F.when(x, bit[c]).otherwise(0) for c, x in sorted(filters.items()) if x is not None]
    twice = sum(bit[c] for c, x in filters.items() if x is None)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = reduce(Column.bitwiseOR, plain, F.lit(0))
    rows = texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096)).cast("int")).otherwise(0))  # null doc_ids match nothing and need not meet
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks.withColumn("spread", F.lit(0)), ["doc_id", "spread"], "left")
    kind = ["digest", "mask", "part", "good", "toxic"]
    # by document first, which needs no shuffle after the join
    by_id = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).groupBy("doc_id", "spread", *kind).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)
    copies = by_id.groupBy(*kind).agg(F.sum(known).alias("n"), F.sum(F.col("n") - known).alias("n_unordered"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    copies = written(copies, "copies")
    firsts = copies.groupBy("digest").agg(F.min("least").alias("least")).withColumn("first", F.lit(True))
    n_first = F.when(F.coalesce("first", F.lit(False)), F.col("n_least")).otherwise(0) if twice else F.col("n")
    told = copies.join(firsts, ["digest", "least"], "left").withColumn("n_first", n_first)
    entry = lambda m, n: F.struct(m.cast("int").alias("mask"), n.alias("n"))
    both = F.array(entry(F.col("mask"), F.col("n_first") + F.col("n_unordered")), entry(F.col("mask").bitwiseOR(F.lit(twice)), F.col("n") - F.col("n_first")))
    each = told.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | None] | None = None, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step; see the module's text.

    docs: doc_id, text and the part's column; labels: doc_id, quality, toxic.
    Returns part, filter_order, step, and of documents of the part: kept (after the step), removed (by it), redundant
    (fail its filter, removed before), unique_fails (fail its filter alone), good_lost and toxic_lost (removed by it),
    shapley (removed by its filter, over all orders)."""
    filters = default_filters() if filters is None else filters
    letters = sorted(filters)
    k = len(letters)
    if not 1 <= k <= MOST_FILTERS or any(len(c) != 1 for c in letters):
        raise ValueError(f"one to {MOST_FILTERS} filters with names of one letter")
    spark = docs.sparkSession
    counts = written(_judged(docs, labels, filters, part), "masks")
    spans = spark.createDataFrame(removal_intervals(k), "mask int, step int, lo int, hi int")
    sums = ("removed", "good_lost", "toxic_lost")
    end = lambda at, sign: F.struct(F.col(at).alias("rank"), *((F.col(n) * sign).alias(s) for n, s in zip(("n", "n_good", "n_toxic"), sums, strict=True)))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("total", "fails", "unique_fails")]
    ends = counts.join(F.broadcast(spans), "mask").select("part", "step", F.inline(F.array(end("lo", 1), end("hi", -1))), *nothing).where(F.col("rank") < factorial(k))

    # every order and step of every part, with the counts that do not depend on ranks
    when = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    of = lambda make: F.array(*(make(1 << i) for i in range(k)))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"), of(lambda b: when(F.col("mask").bitwiseAND(F.lit(b)) > 0)).alias("fails"), of(lambda b: when(F.col("mask") == b)).alias("alone"))
    grid = parts.select("*", F.posexplode(F.array(*map(F.lit, orders("".join(letters))))).alias("rank", "filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    which = lambda order, step: F.instr(F.lit("".join(letters)), F.substring(order, step, F.lit(1)))
    at = which(F.col("filter_order"), F.col("step"))
    grid = grid.select("part", "step", "rank", *(F.lit(0).cast("long").alias(s) for s in sums), "total", F.element_at("fails", at).alias("fails"), F.element_at("alone", at).alias("unique_fails"))

    numbers = (*sums, "total", "fails", "unique_fails")
    # all windows below are inside a part, which has as many rows as any other
    steps = ends.unionByName(grid).repartition("part").groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in numbers))
    over_ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    over_steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    order = F.element_at(F.array(*map(F.lit, orders("".join(letters)))), F.col("rank") + 1)
    steps = steps.withColumns({c: F.sum(c).over(over_ranks) for c in sums})
    steps = steps.withColumn("kept", F.col("total") - F.sum("removed").over(over_steps)).withColumn("filter_order", order)
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1))).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))
    # those that fail its filter and are gone by then: all that fail it, less those it removes itself
    return steps.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, doc_id, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM texts
), masks AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5
), steps AS (
  SELECT *, substr(filter_order, step, 1) AS letter,
    CASE WHEN fails = '' THEN 9 ELSE list_min(list_transform(string_split(fails, ''), lambda c: strpos(filter_order, c))) END AS gone
  FROM masks, orders, (SELECT unnest(range(1, 6)) AS step)
), sums AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (gone > step) AS kept, sum(n) FILTER (gone = step) AS removed,
    sum(n) FILTER (gone < step AND contains(fails, letter)) AS redundant, sum(n) FILTER (fails = letter) AS unique_fails,
    sum(g) FILTER (gone = step) AS good_lost, sum(x) FILTER (gone = step) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM sums
"""
