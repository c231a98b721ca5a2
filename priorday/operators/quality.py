"""Data-quality checks: each a single pass that counts violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorday.functions.scalars import no_vig

REQUIRED = ("match_id", "match_date", "year", "team_a_id", "team_b_id", "team_a_won")


def quality_report(matches: DataFrame, min_year: int = 1971, years: tuple[int, int] | None = None) -> DataFrame:
    """(rule, violations): canonical rules over one table; a missing column is an error at once."""
    missing = [c for c in REQUIRED if c not in matches.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    low, high = years or (0, 9999)
    rules = {
        "null_id": F.col("match_id").isNull(),
        "invalid_date": F.col("match_date").isNull() | (F.year("match_date") < min_year),
        "year_outside": F.col("year").isNull() | ~F.col("year").between(low, high),
        "missing_team": F.col("team_a_id").isNull() | F.col("team_b_id").isNull(),
        "same_team": F.col("team_a_id") == F.col("team_b_id"),
        "placeholder": (F.upper("team_a_name") == "TBD") | (F.upper("team_b_name") == "TBD"),
        "no_outcome": F.col("team_a_won").isNull(),
    }
    counts = matches.agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
    repeats = matches.where("match_id is not null").groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)), F.lit(0)).alias("duplicate_id"))
    return counts.crossJoin(repeats).unpivot([], [*rules, "duplicate_id"], "rule", "violations")


def require_canonical(matches: DataFrame, **how) -> DataFrame:
    """The table itself; raises with the broken rules if there are any."""
    broken = quality_report(matches, **how).where("violations > 0").collect()  # one row per rule
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r.violations}" for r in broken))
    return matches


def date_conflicts(rows: DataFrame, id_col: str, date_col: str) -> DataFrame:
    """(id, n_dates) of ids with more than one date; a null date counts as one."""
    n = F.count_distinct(date_col) + F.max(F.col(date_col).isNull().cast("int"))
    return rows.groupBy(id_col).agg(n.cast("long").alias("n_dates")).where("n_dates > 1")


def quote_validation(quotes: DataFrame) -> DataFrame:
    """Quotes with `violation`: the first broken rule, null for a valid quote."""
    a, b = no_vig(F.col("odds_a"), F.col("odds_b"))
    need = ("captured_at", "start", "bookmaker", "market_type", "odds_a", "odds_b", "snapshot_hash")
    missing = F.lit(False)
    for c in need:
        missing = missing | F.col(c).isNull()
    return quotes.withColumn("violation", F.when(missing, "missing_field").when((F.col("odds_a") <= 1) | (F.col("odds_b") <= 1), "invalid_odds").when(F.abs(a + b - 1) >= 1e-12, "no_vig_sum"))


def source_profile(rows: DataFrame, text: str, parsed: str) -> DataFrame:
    """One row: dates that parse, their range, relative times, and absolute ISO dates in the text."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(parsed).alias("n_parseable"),
        F.min(parsed).alias("min_date"),
        F.max(parsed).alias("max_date"),
        F.count_if(F.col(text).rlike(r"\bago\b")).alias("n_relative"),
        F.count_if(F.col(text).rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")).alias("n_absolute"),
    )


def audit_report(matches: DataFrame, names: DataFrame) -> DataFrame:
    """(section, key, value): rows, ids, outcomes and names of a match table, and rows per year."""
    main = matches.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("match_id").isNull()).alias("missing_id"),
        (F.count("match_id") - F.count_distinct("match_id")).alias("duplicated_id"),
        F.count_if(F.col("team_a_won").isNull()).alias("unresolved_outcome"),
    )
    vague = names.where("ambiguous").agg(F.count(F.lit(1)).alias("ambiguous_names"))
    keys = [*main.columns, *vague.columns]
    total = main.crossJoin(vague).unpivot([], keys, "key", "value").select(F.lit("total").alias("section"), "key", "value")
    years = matches.groupBy(F.col("year").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("value")).select(F.lit("year").alias("section"), "key", "value")
    return total.unionByName(years)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null) of every column, in one pass."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    return one.unpivot(["_rows"], cols, "column_name", "n_null").select("column_name", F.col("_rows").alias("n_rows"), "n_null")
