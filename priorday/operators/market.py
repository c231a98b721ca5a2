"""Two-sided quotes: the primary one per fixture, and provider results sorted by eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorday.functions.scalars import LEAD_RANGE, TARGET_LEAD, minutes_between, with_name_key

#: First broken rule of a provider result, in the order they are tried.
REASONS = ("not_finished", "forfeit_excluded", "invalid_opponents", "missing_begin_or_end", "invalid_timestamp", "pre_or_at_cutoff", "not_completed_at_capture", "invalid_winner", "placeholder_team")


def primary_quote(observations: DataFrame, fixture: list[str], bookmaker: str, market: str = "ML") -> DataFrame:
    """Per fixture the valid quote of one bookmaker closest to an hour before the start; ties to the earlier, then the hash."""
    lead = minutes_between(F.col("captured_at"), F.col("start"))
    valid = observations.where((F.col("bookmaker") == bookmaker) & (F.col("market_type") == market) & (F.col("odds_a") > 1) & (F.col("odds_b") > 1))
    valid = valid.withColumn("lead_minutes", lead).where(F.col("lead_minutes").between(*LEAD_RANGE))
    order = Window.partitionBy(*fixture).orderBy(F.abs(F.col("lead_minutes") - TARGET_LEAD), "captured_at", "snapshot_hash")
    return valid.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def primary_record(primary: DataFrame, match: Column, record: Column) -> DataFrame:
    """The primary quote as a ledger row."""
    return primary.select(
        F.concat_ws(":", F.lit("primary"), match.cast("string"), record.cast("string")).alias("record_id"),
        F.lit("primary_market_selected").alias("record_type"),
        match.cast("string").alias("match_id"),
        record.cast("string").alias("candidate_record_id"),
        F.col("start").alias("scheduled_start"),
    )


def eligible_reason(matches: DataFrame, cutoff: str, captured_at: str) -> DataFrame:
    """Provider results with `reason`, the first rule that excludes them (null: eligible), and flat opponents."""
    m = matches.withColumns(
        {
            "_n": F.coalesce(F.size("opponents"), F.lit(0)),
            "a_id": F.try_element_at("opponents", F.lit(1))["opponent"]["id"],
            "b_id": F.try_element_at("opponents", F.lit(2))["opponent"]["id"],
            "a_name": F.try_element_at("opponents", F.lit(1))["opponent"]["name"],
            "b_name": F.try_element_at("opponents", F.lit(2))["opponent"]["name"],
            "_begin": F.try_to_timestamp("begin_at"),
            "_end": F.try_to_timestamp("end_at"),
        }
    )
    m = with_name_key(with_name_key(m, "a_name", "_ka"), "b_name", "_kb")
    blank = lambda k: F.coalesce(F.col(k), F.lit("")).isin("", "tbd")
    rules = [
        F.coalesce(F.col("status"), F.lit("")) != "finished",
        F.coalesce("forfeit", F.lit(False)),
        (F.col("_n") != 2) | F.col("a_id").isNull() | F.col("b_id").isNull() | (F.col("a_id") == F.col("b_id")),
        F.coalesce("begin_at", F.lit("")).eqNullSafe("") | F.coalesce("end_at", F.lit("")).eqNullSafe(""),
        F.col("_begin").isNull() | F.col("_end").isNull(),
        F.to_date("_begin") <= F.to_date(F.lit(cutoff)),
        F.col("_end") > F.to_timestamp(F.lit(captured_at)),
        F.col("winner_id").isNull() | ~((F.col("winner_id") == F.col("a_id")) | (F.col("winner_id") == F.col("b_id"))),
        blank("_ka") | blank("_kb"),
    ]
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(zip(REASONS, rules, strict=True))):
        reason = F.when(rule, name).otherwise(reason)
    return m.withColumn("reason", reason).drop("_n", "_ka", "_kb", "_end")


def eligible_split(matches: DataFrame, cutoff: str, captured_at: str) -> tuple[DataFrame, DataFrame]:
    """(eligible matches, excluded ids with their reason)."""
    m = eligible_reason(matches, cutoff, captured_at)
    fine = m.where("reason is null").select(
        F.concat(F.lit("ps:"), F.col("id").cast("string")).alias("match_id"),
        F.to_date("_begin").alias("match_date"),
        F.year("_begin").alias("year"),
        F.col("a_id").alias("provider_a_id"),
        F.col("a_name").alias("team_a_name"),
        F.col("b_id").alias("provider_b_id"),
        F.col("b_name").alias("team_b_name"),
        (F.col("winner_id") == F.col("a_id")).alias("team_a_won"),
        "tournament",
    )
    return fine, m.where("reason is not null").select("id", "reason")


def terminal_class(results: DataFrame) -> DataFrame:
    """Results with outcome_type (outcome_attached, terminal_exclusion or null: still open) and reason.

    results: status, forfeit, winner_id, opponent_ids, team_a_id."""
    forfeit = F.coalesce("forfeit", F.lit(False))
    closed = F.coalesce(F.col("status").isin("finished", "canceled", "cancelled", "abandoned"), F.lit(False)) | forfeit
    won = (F.col("status") == "finished") & ~forfeit & F.coalesce(F.array_contains("opponent_ids", F.col("winner_id")), F.lit(False))
    kind = F.when(~closed, None).when(won, "outcome_attached").otherwise("terminal_exclusion")
    reason = F.when(F.col("status").isin("canceled", "cancelled"), "cancelled").when(forfeit, "forfeit_excluded").otherwise("unresolved_or_invalid_result")
    return results.withColumn("outcome_type", kind).withColumn("reason", F.when(F.col("outcome_type") == "terminal_exclusion", reason)).withColumn("team_a_won", F.when(F.col("outcome_type") == "outcome_attached", F.col("winner_id") == F.col("team_a_id")))
