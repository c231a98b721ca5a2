"""Features of a match that use strictly earlier dates only.

Everything is first brought to one row per (team, date), and what a row knows ends
at the row before, so rows of the same day can never see each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorday.sources.shared import written

from .rating import elo_history, rating_states, with_unseen
from .scans import SPAN, calendar, last_of, running

LAST = 10  # results that the longest win rate looks back at
TEAM_ROWS, TEAM_TASKS = 200_000, 200  # states and asks of a task of whole teams; into more than 200 parts Spark's writers sort all they write
HISTORY_FEATURES = ("elo_diff", "last_5_win_rate_diff", "last_10_win_rate_diff", "prior_match_count_diff", "min_prior_match_count", "days_since_last_match_diff", "any_missing_last_match_date")


def team_long(matches: DataFrame) -> DataFrame:
    """Two rows per match: (match_id, match_date, team_id, opponent_id, won)."""
    side = lambda s, o, won: F.struct(F.col(f"team_{s}_id").alias("team_id"), F.col(f"team_{o}_id").alias("opponent_id"), won.alias("won"))
    won = F.col("team_a_won")
    return matches.select("match_id", "match_date", F.explode(F.array(side("a", "b", won), side("b", "a", ~won))).alias("t")).select("match_id", "match_date", "t.team_id", "t.opponent_id", "t.won")


def _days(long: DataFrame) -> DataFrame:
    """One row per (team, date): the number of results, and the last ten of them in id order.

    The ten are chosen before the shuffle already (a group limit), so a day of very many matches of one team is no large group."""
    day = ["team_id", "match_date"]
    late = Window.partitionBy(*day).orderBy(F.desc("match_id"))
    ten = long.withColumn("_back", F.row_number().over(late)).where(f"_back <= {LAST}")
    results = F.transform(F.array_sort(F.collect_list(F.struct("match_id", F.col("won").cast("int").alias("won")))), lambda x: x["won"])
    return long.groupBy(*day).agg(F.count(F.lit(1)).alias("n")).join(ten.groupBy(*day).agg(results.alias("results")), day)


def team_days(long: DataFrame, span: int = SPAN) -> DataFrame:
    """(team_id, match_date, n_prior, last_5, last_10, days_since): what each team's date may know.

    Computed in segments of `span` days with what the segments before hold carried on; see `scans`."""

    def rate(n: int) -> F.Column:
        last = last_of(F.col("run_results"), n)
        return F.when(F.size("run_results") == 0, 0.5).otherwise(F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last))

    days = _days(long).withColumn("day", F.col("match_date"))
    seen = running(days, ["team_id"], ["match_date"], calendar("match_date", span), sums=["n"], lasts=["day"], tails=[("results", LAST)])
    return seen.select("team_id", "match_date", F.col("run_n").alias("n_prior"), rate(5).alias("last_5"), rate(LAST).alias("last_10"), F.datediff("match_date", "run_day").alias("days_since"))


def both_sides(matches: DataFrame, days: DataFrame, values: list[str]) -> DataFrame:
    """Matches with each side's (team, date) values as <value>_a and <value>_b."""
    out = matches
    for s in ("a", "b"):
        mine = days.select(F.col("team_id").alias(f"team_{s}_id"), "match_date", *(F.col(v).alias(f"{v}_{s}") for v in values))
        out = out.join(mine, [f"team_{s}_id", "match_date"], "left")
    return out


def prior_counts(matches: DataFrame) -> DataFrame:
    x = both_sides(matches.select("match_id", "match_date", "team_a_id", "team_b_id"), team_days(team_long(matches)), ["n_prior"])
    return x.select("match_id", (F.col("n_prior_a") - F.col("n_prior_b")).alias("prior_match_count_diff"), F.least("n_prior_a", "n_prior_b").alias("min_prior_match_count"))


def last_n_win_rate(matches: DataFrame) -> DataFrame:
    x = both_sides(matches.select("match_id", "match_date", "team_a_id", "team_b_id"), team_days(team_long(matches)), ["last_5", "last_10"])
    return x.select("match_id", (F.col("last_5_a") - F.col("last_5_b")).alias("last_5_win_rate_diff"), (F.col("last_10_a") - F.col("last_10_b")).alias("last_10_win_rate_diff"))


def days_since_last(matches: DataFrame) -> DataFrame:
    x = both_sides(matches.select("match_id", "match_date", "team_a_id", "team_b_id"), team_days(team_long(matches)), ["days_since"])
    missing = F.col("days_since_a").isNull() | F.col("days_since_b").isNull()
    return x.select("match_id", (F.col("days_since_a") - F.col("days_since_b")).alias("days_since_last_match_diff"), missing.cast("int").alias("any_missing_last_match_date"))


def feature_table(matches: DataFrame, k: float = 64.0, pool: str | None = None) -> DataFrame:
    """One row per match: ratings and probability before it, and the history features."""
    h = with_unseen(elo_history(matches, k, pool)).select("match_id", "match_date", "team_a_id", "team_b_id", "team_a_won", "rating_a_pre", "rating_b_pre", "probability_a", F.col("any_team_unseen").cast("int").alias("any_team_unseen"))
    x = both_sides(h, team_days(team_long(matches)), ["n_prior", "last_5", "last_10", "days_since"])
    missing = F.col("days_since_a").isNull() | F.col("days_since_b").isNull()
    return x.select(
        "match_id",
        "match_date",
        "team_a_id",
        "team_b_id",
        "team_a_won",
        "probability_a",
        (F.col("rating_a_pre") - F.col("rating_b_pre")).alias("elo_diff"),
        (F.col("last_5_a") - F.col("last_5_b")).alias("last_5_win_rate_diff"),
        (F.col("last_10_a") - F.col("last_10_b")).alias("last_10_win_rate_diff"),
        (F.col("n_prior_a") - F.col("n_prior_b")).alias("prior_match_count_diff"),
        F.least("n_prior_a", "n_prior_b").alias("min_prior_match_count"),
        (F.col("days_since_a") - F.col("days_since_b")).alias("days_since_last_match_diff"),
        missing.cast("int").alias("any_missing_last_match_date"),
        "any_team_unseen",
    )


def map_elo(games: DataFrame, k: float = 64.0) -> DataFrame:
    """Rating history per map; of a team's games of one day on one map the last one counts."""
    return elo_history(games, k, pool="map", last_wins=True)


def map_pool(matches: DataFrame, games: DataFrame, k: float = 64.0) -> DataFrame:
    """Per match: differences of the teams' map-rating mean, max, min, deviation and number of maps before the date.

    The fold runs once: its states are written, beside the dates asked about, which are
    numbered by team. A state holds for the asks after its date, up to the date of the
    team's next one on the map, so each ask meets one state of every map played before
    it, without a join by range. All of this reads one exchange by team, of tasks by the
    number of rows; a team has a row a map and day of the calendar at most."""
    states = rating_states(map_elo(games, k), last_wins=True).select("team_id", "match_date", F.col("pool").alias("map"), "rating", F.lit(0).alias("ask"))
    asks = team_long(matches).select(F.col("team_id").cast("long").alias("team_id"), "match_date").dropna().distinct()
    rows = written(states.unionByName(asks.select("*", F.lit(None).cast("string").alias("map"), F.lit(None).cast("double").alias("rating"), F.lit(1).alias("ask"))), "map-states")
    by_team = Window.partitionBy("team_id").orderBy("match_date")
    whole = by_team.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = rows.repartition(min(rows.count() // TEAM_ROWS + 1, TEAM_TASKS), "team_id").select("*", F.sum("ask").over(by_team).alias("i"), F.sum("ask").over(whole).alias("n_asks"))
    until = F.coalesce(F.lead("i").over(Window.partitionBy("team_id", "map", "ask").orderBy("match_date")), F.col("n_asks"))
    asked = F.col("ask") == 1
    seen = numbered.withColumn("until", until).select("team_id", F.when(asked, F.col("match_date")).alias("day"), "rating", F.explode(F.when(asked, F.array("i")).when(F.col("i") < F.col("until"), F.sequence(F.col("i") + 1, "until"))).alias("at"))
    r = F.col("rating")
    pools = seen.groupBy("team_id", "at").agg(F.max("day").alias("match_date"), F.avg(r).alias("mean"), F.max(r).alias("max"), F.min(r).alias("min"), F.stddev_pop(r).alias("std"), F.count(r).alias("n"))
    x = both_sides(matches.select("match_id", "match_date", "team_a_id", "team_b_id"), pools, ["mean", "max", "min", "std", "n"])
    fill = {"mean": 1500.0, "max": 1500.0, "min": 1500.0, "std": 0.0, "n": 0}
    v = {f"{n}_{s}": F.coalesce(f"{n}_{s}", F.lit(d)) for n, d in fill.items() for s in ("a", "b")}
    return x.select(
        "match_id",
        (v["mean_a"] - v["mean_b"]).alias("map_mean_elo_diff"),
        (v["max_a"] - v["max_b"]).alias("map_max_elo_diff"),
        (v["min_a"] - v["min_b"]).alias("map_min_elo_diff"),
        (v["std_a"] - v["std_b"]).alias("map_elo_std_diff"),
        (v["n_a"] - v["n_b"]).cast("long").alias("map_history_count_diff"),
        F.least(v["n_a"], v["n_b"]).cast("long").alias("min_map_history_count"),
    )


def roster_sets(players: DataFrame) -> DataFrame:
    """(team_id, match_date, roster): the players of a team on a date, sorted."""
    return players.where("player is not null").groupBy("team_id", "match_date").agg(F.sort_array(F.collect_set("player")).alias("roster"))


def roster_features(matches: DataFrame, players: DataFrame) -> DataFrame:
    """Per match: differences of last roster size, continuity of the last two, and distinct players of the last five."""
    by_day = Window.partitionBy("team_id").orderBy("match_date")
    fives = roster_sets(players).select("team_id", "match_date", F.collect_list("roster").over(by_day.rowsBetween(-4, 0)).alias("held"), F.lit(1).alias("o"))
    asks = team_long(matches).select("team_id", "match_date").distinct().select("*", F.lit(None).cast("array<array<string>>").alias("held"), F.lit(0).alias("o"))
    # the last state of five rosters is carried forward, over any number of dates without rosters
    order = Window.partitionBy("team_id").orderBy("match_date", "o").rowsBetween(Window.unboundedPreceding, -1)
    x = fives.unionByName(asks).withColumn("five", F.coalesce(F.last("held", ignorenulls=True).over(order), F.array().cast("array<array<string>>"))).where("o = 0")
    last, before = F.try_element_at("five", F.lit(-1)), F.try_element_at("five", F.lit(-2))
    state = x.select(
        "team_id",
        "match_date",
        F.when(F.size("five") == 0, 5).otherwise(F.size(last)).alias("last_size"),
        F.when(F.size("five") < 2, 1.0).otherwise(F.size(F.array_intersect(last, before)) / F.size(F.array_union(last, before))).alias("continuity"),
        F.when(F.size("five") == 0, 5).otherwise(F.size(F.array_distinct(F.flatten("five")))).alias("recent"),
        (F.size("five") == 0).cast("int").alias("missing"),
    )
    y = both_sides(matches.select("match_id", "match_date", "team_a_id", "team_b_id"), state, ["last_size", "continuity", "recent", "missing"])
    return y.select(
        "match_id",
        (F.col("last_size_a") - F.col("last_size_b")).cast("double").alias("roster_last_size_diff"),
        (F.col("continuity_a") - F.col("continuity_b")).alias("roster_continuity_diff"),
        (F.col("recent_a") - F.col("recent_b")).cast("double").alias("roster_recent_unique_diff"),
        F.greatest("missing_a", "missing_b").alias("any_missing_roster_history"),
    )
