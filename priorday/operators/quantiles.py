"""Exact quantiles of all groups at once, by ranks that histograms narrow down.

A quantile lies between two ranks. For every rank asked for, the values that can
hold it are kept as an interval with the number of values below it. One job a round
counts the values of all intervals in bins, and each interval shrinks to the bin of
its rank, to that bin's least and greatest value; copies of one value end it. When
an interval holds at most `leaf` values they are put in order. No aggregate holds
the distinct values of a group, and the rounds do not depend on the number of
groups: two or three as a rule, and never more than a few hundred, since each one
drops eight powers of two of the range at least.

Nulls and NaN are left out; a group without other values has no row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorday.sources.shared import forget, written

BINS = 256
LEAF = 10_000  # values of an interval that are put in order in one task
SMALL = 20_000  # intervals up to which their table is broadcast


def exact_quantiles(rows: DataFrame, groups: Sequence[str], value: str, quantiles: Sequence[float], leaf: int = LEAF) -> DataFrame:
    """(groups, q, value) for every q in `quantiles`, interpolated between ranks floor and ceil of q * (n - 1)."""
    keys = [f"g{i}" for i in range(len(groups))]
    v = F.col("v")
    values = rows.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), (F.col(value).cast("double") + 0.0).alias("v")).where(v.isNotNull() & ~F.isnan("v"))
    same: list[Column] = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys]

    def within(cells: DataFrame, count: int) -> DataFrame:
        """Values with every interval of their group that holds them."""
        t = cells.withColumnsRenamed({k: f"t_{k}" for k in keys})
        t = F.broadcast(t) if count <= SMALL else t
        condition = (v >= F.col("lo")) & (v <= F.col("hi"))
        for c in same:
            condition = condition & c
        return values.join(t, condition).drop(*keys).withColumnsRenamed({f"t_{k}": k for k in keys})

    totals = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = totals.select(*keys, "n", "lo", "hi", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("q"))
    asked = written(asked.withColumn("at", F.col("q") * (F.col("n") - 1)), "quantiles")
    ranks = asked.select(*keys, "n", "lo", "hi", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    cells = written(ranks.select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "intervals")
    wide = (F.col("inside") > leaf) & (F.col("lo") < F.col("hi"))
    while n_wide := cells.where(wide).count():
        # halves keep the widest range finite; the bin rises with the value
        share = (v / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bins = within(cells.where(wide), n_wide).groupBy(*keys, "rank", "below", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("inside").over(Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = bins.withColumn("below", F.col("below") + before).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside")))
        then = written(bins.select(*cells.columns).unionByName(cells.where(~wide)), "intervals")
        forget(cells)
        cells = then
    narrow = F.col("lo") < F.col("hi")
    place = F.row_number().over(Window.partitionBy(*keys, "rank").orderBy("v")) - 1 + F.col("below")
    ordered = within(cells.where(narrow), cells.where(narrow).count()).withColumn("place", place).where(F.col("place") == F.col("rank"))
    found = ordered.select(*keys, "rank", "v").unionByName(cells.where(~narrow).select(*keys, "rank", F.col("lo").alias("v")))
    joined = asked
    for name, at in (("low", F.floor("at")), ("high", F.ceil("at"))):
        one = found.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.col("rank").alias(f"{name}_rank"), F.col("v").alias(name))
        on = at == F.col(f"{name}_rank")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{name}_{k}"))
        joined = joined.join(one, on)
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high"))
    return joined.select(*(F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)), "q", between.alias("value"))
