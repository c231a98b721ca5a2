"""The append-only forecast ledger: what one pass over fixtures, quotes and results adds to it.

Ledger rows have RECORD's columns. Every step returns new rows and never changes
old ones; ids are built from what a row is about, so a repeated pass adds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorday.functions.scalars import LEAD_RANGE, minutes_between, needs_new_forecast, no_vig, snapshot_current, win_probability

from priorday.sources.shared import written

from .market import primary_quote, terminal_class
from .rating import as_of_states
from .resolve import fixture_reconcile

RECORD = {
    "record_id": "string",
    "record_type": "string",
    "match_id": "string",
    "recorded_at": "timestamp",
    "scheduled_start": "timestamp",
    "refers_to": "string",
    "reason": "string",
    "team_a_id": "long",
    "team_b_id": "long",
    "p_team_a": "double",
    "odds_a": "double",
    "odds_b": "double",
    "team_a_won": "boolean",
}
# Parts of column names that look like credentials.
FORBIDDEN = ("token", "api_key", "authorization", "password", "secret")


def as_records(df: DataFrame) -> DataFrame:
    """The columns of RECORD, missing ones null."""
    return df.select(*((F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in RECORD.items()))


def check_keys(df: DataFrame) -> DataFrame:
    """The frame itself; raises if it lacks an id or type, or a column name looks like a credential."""
    lacking = {"record_id", "record_type"} - set(df.columns)
    if lacking:
        raise ValueError(f"missing columns: {sorted(lacking)}")
    bad = [c for c in df.columns if any(w in c.casefold() for w in FORBIDDEN)]
    if bad:
        raise ValueError(f"columns that look like credentials: {bad}")
    return df


def ledger_append(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of `new` that may be appended: with id and type, the first of each id, none that the ledger has."""
    first = Window.partitionBy("record_id").orderBy(*[c for c in ("recorded_at", "record_type", "match_id") if c in new.columns])
    once = check_keys(new).where("record_id is not null and record_type is not null").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return once.join(ledger.select("record_id"), "record_id", "left_anti").select(*new.columns)


def lifecycle(ledger: DataFrame) -> DataFrame:
    """(match_id, record_types): the sorted set of record types per match."""
    return ledger.groupBy("match_id").agg(F.sort_array(F.collect_set("record_type")).alias("record_types"))


def completed(ledger: DataFrame) -> DataFrame:
    """Matches with forecast, primary quote and outcome, and no terminal exclusion."""
    has = lambda t: F.bool_or(F.col("record_type") == t).alias(t)
    per = ledger.groupBy("match_id").agg(*map(has, ("forecast_generated", "primary_market_selected", "outcome_attached", "terminal_exclusion")))
    return per.where("forecast_generated and primary_market_selected and outcome_attached and not terminal_exclusion").select("match_id")


def eligible_completed(ledger: DataFrame) -> DataFrame:
    return completed(ledger).agg(F.count(F.lit(1)).alias("eligible_completed"))


def ledger_status(ledger: DataFrame) -> DataFrame:
    """(record_type, n): counts only, never a performance figure."""
    return ledger.groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))


def moment(now: str) -> Column:
    return F.to_timestamp(F.lit(now))


def _id(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _at(start: Column) -> Column:
    return F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window_candidates(fixtures: DataFrame, now: str) -> DataFrame:
    """Fixtures with two teams that start in 45 to 75 minutes."""
    lead = minutes_between(moment(now), F.col("scheduled_at"))
    return fixtures.where("team_a_id is not null and team_b_id is not null").withColumn("lead_minutes", lead).where(F.col("lead_minutes").between(*LEAD_RANGE))


def active_starts(ledger: DataFrame) -> DataFrame:
    """(match_id, active_start): the latest reschedule's start, else the first recorded one."""
    at = F.struct("recorded_at", "record_id")
    moved = F.max_by(F.when(F.col("record_type") == "reschedule", F.col("scheduled_start")), F.when(F.col("record_type") == "reschedule", at))
    return ledger.where("scheduled_start is not null").groupBy("match_id").agg(F.coalesce(moved, F.min_by("scheduled_start", at)).alias("active_start"))


def first_starts(ledger: DataFrame) -> DataFrame:
    """(match_id, active_start): the first recorded start, whatever was rescheduled since."""
    at = F.struct("recorded_at", "record_id")
    return ledger.where("scheduled_start is not null").groupBy("match_id").agg(F.min_by("scheduled_start", at).alias("active_start"))


def missed_forecasts(fixtures: DataFrame, ledger: DataFrame, now: str) -> DataFrame:
    """Terminal rows for fixtures first seen at or after their start."""
    late = fixtures.where(F.col("scheduled_at") <= moment(now)).join(ledger.select("match_id").distinct(), "match_id", "left_anti")
    return as_records(late.select(_id("terminal", F.col("match_id"), "missed_prospective_forecast").alias("record_id"), F.lit("terminal_exclusion").alias("record_type"), "match_id", moment(now).alias("recorded_at"), F.lit("missed_prospective_forecast").alias("reason")))


def moved_fixtures(fixtures: DataFrame, ledger: DataFrame, against: str = "active") -> DataFrame:
    """Fixtures whose start moved by more than an hour from the active one, or from the `first` recorded one."""
    starts = {"active": active_starts, "first": first_starts}[against]
    return fixtures.join(starts(ledger), "match_id").where(~snapshot_current(F.col("active_start"), F.col("scheduled_at")))


def reschedules(fixtures: DataFrame, ledger: DataFrame, now: str, against: str = "active") -> DataFrame:
    """A reschedule row per moved fixture, and one that supersedes each of its primary quotes; see moved_fixtures for `against`.

    Against the first start a fixture that was moved and moved on by less than an hour gives a row for each of its
    starts, and one that was moved back gives none."""
    moved = moved_fixtures(fixtures, ledger, against).select("match_id", F.col("scheduled_at").alias("scheduled_start"), moment(now).alias("recorded_at"))
    rows = moved.select("*", _id("reschedule", F.col("match_id"), _at(F.col("scheduled_start"))).alias("record_id"), F.lit("reschedule").alias("record_type"))
    old = ledger.where("record_type = 'primary_market_selected'").select("match_id", F.col("record_id").alias("refers_to"))
    stale = moved.join(old, "match_id").select("*", _id("primary_superseded", F.col("refers_to"), _at(F.col("scheduled_start"))).alias("record_id"), F.lit("primary_market_superseded").alias("record_type"))
    return as_records(rows).unionByName(as_records(stale))


def active_forecasts(ledger: DataFrame) -> DataFrame:
    """Forecast rows that no forecast_superseded row refers to."""
    gone = ledger.where("record_type = 'forecast_superseded'").select(F.col("refers_to").alias("record_id")).distinct()
    return ledger.where("record_type = 'forecast_generated'").join(gone, "record_id", "left_anti").select(*ledger.columns)


def with_forecast(fixtures: DataFrame, states: DataFrame) -> DataFrame:
    """Fixtures with p_team_a from both teams' ratings strictly before the start's date."""
    x = fixtures.withColumn("as_of", F.to_date("scheduled_at"))
    for s in ("a", "b"):
        x = as_of_states(x, states, team=f"team_{s}_id").withColumnsRenamed({"rating": f"rating_{s}", "n_prior": f"n_prior_{s}"}).drop("last_date")
    return x.withColumn("p_team_a", win_probability(F.col("rating_a"), F.col("rating_b"))).drop("as_of")


def forecast_replacement(fixtures: DataFrame, ledger: DataFrame, states: DataFrame, now: str) -> DataFrame:
    """For fixtures moved to another date: the old forecast superseded, a new one before the start or a terminal row after."""
    moved = moved_fixtures(fixtures, ledger).where(needs_new_forecast(F.col("active_start"), F.col("scheduled_at")))
    old = active_forecasts(ledger).groupBy("match_id").agg(F.min_by("record_id", F.struct("recorded_at", "record_id")).alias("refers_to"))
    due = moved.join(old, "match_id").withColumns({"recorded_at": moment(now), "scheduled_start": F.col("scheduled_at")})
    gone = due.select("match_id", "refers_to", "recorded_at", "scheduled_start", _id("forecast_superseded", F.col("refers_to"), _at(F.col("scheduled_at"))).alias("record_id"), F.lit("forecast_superseded").alias("record_type"))
    open_ = with_forecast(due.where(F.col("scheduled_at") > moment(now)), states).select("*", _id("forecast", F.col("match_id"), _at(F.col("scheduled_at"))).alias("record_id"), F.lit("forecast_generated").alias("record_type"))
    late = due.where(F.col("scheduled_at") <= moment(now)).select("match_id", "recorded_at", "scheduled_start", _id("terminal", F.col("match_id"), "missed_rescheduled_forecast", _at(F.col("scheduled_at"))).alias("record_id"), F.lit("terminal_exclusion").alias("record_type"), F.lit("missed_rescheduled_forecast").alias("reason"))
    return as_records(gone).unionByName(as_records(open_)).unionByName(as_records(late))


def due_outcomes(ledger: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Outcome or terminal rows of active forecasts past their start; a missing or open result leaves them due."""
    closed = ledger.where("record_type in ('outcome_attached', 'terminal_exclusion')").select("match_id").distinct()
    open_ = active_forecasts(ledger).groupBy("match_id").agg(F.min_by("team_a_id", F.struct("recorded_at", "record_id")).alias("team_a_id")).join(closed, "match_id", "left_anti")
    due = open_.join(active_starts(ledger), "match_id").where(F.col("active_start") <= moment(now))
    found = terminal_class(due.join(results, "match_id")).where("outcome_type is not null")
    key = F.when(F.col("outcome_type") == "outcome_attached", _id("outcome", F.col("match_id"))).otherwise(_id("terminal", F.col("match_id"), F.col("reason")))
    return as_records(found.select(key.alias("record_id"), F.col("outcome_type").alias("record_type"), "match_id", moment(now).alias("recorded_at"), "reason", "team_a_won"))


def new_forecasts(fixtures: DataFrame, events: DataFrame, ledger: DataFrame, states: DataFrame, now: str) -> DataFrame:
    """Forecasts of fixtures in the window that match one listed event and have no active forecast."""
    near = window_candidates(fixtures, now)
    left = near.select(F.col("match_id").alias("left_id"), F.col("team_a_name").alias("team_a"), F.col("team_b_name").alias("team_b"), F.col("scheduled_at").alias("start"))
    known = fixture_reconcile(left, events).select(F.col("left_id").alias("match_id"))
    todo = near.join(known, "match_id", "left_semi").join(active_forecasts(ledger).select("match_id"), "match_id", "left_anti")
    made = with_forecast(todo, states)
    return as_records(made.select("*", _id("forecast", F.col("match_id"), _at(F.col("scheduled_at"))).alias("record_id"), F.lit("forecast_generated").alias("record_type"), moment(now).alias("recorded_at"), F.col("scheduled_at").alias("scheduled_start")))


def quote_candidates(quotes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidate rows of two-sided quotes (one per event, time and odds) with the no-vig probability of side A."""
    key = _id("candidate", F.col("match_id"), F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("odds_a"), F.col("odds_b"))
    p, _ = no_vig(F.col("odds_a"), F.col("odds_b"))
    valid = quotes.where("odds_a > 1 and odds_b > 1").select("*", key.alias("record_id"), F.lit("market_candidate").alias("record_type"), F.col("captured_at").alias("recorded_at"), F.col("start").alias("scheduled_start"), p.alias("p_team_a"))
    return ledger_append(as_records(valid), ledger)


def due_primaries(ledger: DataFrame, now: str) -> DataFrame:
    """Primary rows of matches less than 45 minutes before their active start that have none for it."""
    c = ledger.where("record_type = 'market_candidate'").select("record_id", "match_id", "scheduled_start", F.col("recorded_at").alias("captured_at"), "odds_a", "odds_b")
    c = c.join(active_starts(ledger), "match_id").where("scheduled_start = active_start").where(minutes_between(moment(now), F.col("active_start")) < LEAD_RANGE[0])
    have = ledger.where("record_type = 'primary_market_selected'").select("match_id", "scheduled_start").distinct()
    c = c.join(have, ["match_id", "scheduled_start"], "left_anti").select("*", F.col("scheduled_start").alias("start"), F.lit("primary").alias("bookmaker"), F.lit("ML").alias("market_type"), F.md5("record_id").alias("snapshot_hash"))
    best = primary_quote(c, ["match_id"], "primary")
    return as_records(best.select(_id("primary", F.col("match_id"), F.col("record_id")).alias("record_id"), F.lit("primary_market_selected").alias("record_type"), "match_id", F.col("record_id").alias("refers_to"), moment(now).alias("recorded_at"), "scheduled_start"))


def ledger_step(fixtures: DataFrame, events: DataFrame, quotes: DataFrame, results: DataFrame, ledger: DataFrame, states: DataFrame, now: str) -> DataFrame:
    """All rows of one pass, later steps seeing the earlier ones' rows; not appended it is a dry run.

    Each step's rows are written to the shared folder before the next one reads
    them, so every step sees the same rows and no plan holds another twice."""
    steps = ledger_steps(fixtures, events, quotes, results, ledger, written(states, "states"), now)
    made = steps[0]
    for rows in steps[1:]:
        made = made.unionByName(rows)
    return made


def ledger_steps(fixtures: DataFrame, events: DataFrame, quotes: DataFrame, results: DataFrame, ledger: DataFrame, states: DataFrame, now: str) -> list[DataFrame]:
    """The written rows of each step of one pass; `forget` them once they are appended. `states` should be a table."""
    seen, made = as_records(ledger), []
    fixtures = fixtures if hasattr(fixtures, "written_path") else written(fixtures, "fixtures")
    for step in (
        lambda x: missed_forecasts(fixtures, x, now),
        lambda x: forecast_replacement(fixtures, x, states, now).unionByName(reschedules(fixtures, x, now)),
        lambda x: due_outcomes(x, results, now),
        lambda x: new_forecasts(fixtures, events, x, states, now),
        lambda x: quote_candidates(quotes, x),
        lambda x: due_primaries(x, now),
    ):
        rows = written(ledger_append(as_records(step(seen)), seen), "ledger-step")
        made.append(rows)
        seen = seen.unionByName(rows)
    return made


