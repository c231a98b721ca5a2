"""Running values of a key over time, in two levels, so that a key's rows are not one task's.

A key's time is cut into segments. Windows run inside segments only; a segment's own
totals are one small row, over which a second window carries the values of the
segments before. Segments are named by the rows themselves (a span of the calendar),
so a task that is run again gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 256  # days of a segment


def calendar(day: str, span: int = SPAN) -> Column:
    """The segment of a date."""
    return F.floor(F.unix_date(day) / span)


def last_of(values: Column, n: int) -> Column:
    """The last n elements of an array."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, sums: Sequence[str] = (), lasts: Sequence[str] = (), tails: Sequence[tuple[str, int]] = (), own: bool = False) -> DataFrame:
    """Rows with what the rows before them of their key hold, as run_<column>; with `own` the row itself counts too.

    sums: running sums, 0 where there is nothing; lasts: the last value that is not null; tails: (column, n), the last n
    elements of all arrays together, none of which may be null or empty. `order` must be unique within a key, and
    `segment` must not fall along it. Rows with a null key are left out."""
    part, end = [*keys, "_segment"], 0 if own else -1
    cut = rows.dropna(subset=list(keys)).withColumn("_segment", segment).repartition(*part)  # one exchange, which both branches read
    at = F.struct(*order)
    whole = cut.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.sum(c).alias(c) for c in sums),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in lasts),
        *(last_of(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(c).alias("x")))), lambda r: r["x"])), n).alias(c) for c, n in tails),
    )
    segments = Window.partitionBy(*keys).orderBy("_segment")
    earlier = segments.rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(
        *part,
        *(F.sum(c).over(earlier).alias(f"_carry_{c}") for c in sums),
        *(F.last(c, ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in lasts),
        *(last_of(F.flatten(F.collect_list(c).over(segments.rowsBetween(-n, -1))), n).alias(f"_carry_{c}") for c, n in tails),
    )
    inside = Window.partitionBy(*part).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, end)
    local = cut.select(
        "*",
        *(F.sum(c).over(before).alias(f"_local_{c}") for c in sums),
        *(F.last(c, ignorenulls=True).over(before).alias(f"_local_{c}") for c in lasts),
        *(F.flatten(F.collect_list(c).over(inside.rowsBetween(end + 1 - n, end))).alias(f"_local_{c}") for c, n in tails),
    )
    carried, found = lambda c: F.col(f"_carry_{c}"), lambda c: F.col(f"_local_{c}")
    return local.join(carry, part).select(
        *rows.columns,
        *((F.coalesce(found(c), F.lit(0)) + F.coalesce(carried(c), F.lit(0))).alias(f"run_{c}") for c in sums),
        *(F.coalesce(found(c), carried(c)).alias(f"run_{c}") for c in lasts),
        *(last_of(F.concat(carried(c), found(c)), n).alias(f"run_{c}") for c, n in tails),
    )
