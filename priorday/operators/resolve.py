"""Joins and entity resolution: conservative links, never a guess."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorday.functions.scalars import key_of_distinct, with_name_key


def canonical_filter(matches: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Matches with an outcome, two known and different teams, no placeholder; a null condition drops the row."""
    kept = matches.where("team_a_won is not null and team_a_id is not null and team_b_id is not null").where("team_a_id <> team_b_id and upper(team_a_name) <> 'TBD' and upper(team_b_name) <> 'TBD'")
    return kept if years is None else kept.where(F.col("year").isin(list(years)))


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join that fails at run time if a side that must be unique on the keys is not.

    The check is part of the plan: duplicates on the unique side raise when the
    rows are read, without a job of its own."""
    sides = {"one_to_one": (True, True), "many_to_one": (False, True), "one_to_many": (True, False)}[validate]

    def unique(df: DataFrame, name: str) -> DataFrame:
        seen = F.count(F.lit(1)).over(Window.partitionBy(*on))
        fine = F.when(F.col("_seen") > 1, F.raise_error(F.lit(f"join keys are not unique on the {name} side")).cast("boolean")).otherwise(True)
        return df.withColumn("_seen", seen).where(fine).drop("_seen")

    left = unique(left, "left") if sides[0] else left
    right = unique(right, "right") if sides[1] else right
    return left.join(right, list(on), how)


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_{k}"])
    return on


def ambiguous_key_join(rows: DataFrame, candidates: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Attach an id to rows whose key has exactly one; else null. Null keys match null keys."""
    one = candidates.groupBy(*keys).agg(F.count_distinct(id_col).alias("_n"), F.min(id_col).alias(id_col)).where("_n = 1")
    one = one.select(*(F.col(k).alias(f"_{k}") for k in keys), id_col)
    joined = rows.join(one, _null_safe(rows, one, keys), "left").drop(*(f"_{k}" for k in keys))
    return joined.withColumn("id_status", F.when(F.col(id_col).isNull(), "ambiguous_or_missing_source_key").otherwise("exact_source_key"))


def unique_names(names: DataFrame, name: str = "team_name", id_col: str = "team_id") -> DataFrame:
    """(name, id, ambiguous): the id of a name that has one, null and flagged for a name with several."""
    per = names.where(F.col(name).isNotNull()).groupBy(name).agg(F.count_distinct(id_col).alias("n"), F.min(id_col).alias("one"))
    return per.select(name, F.when(F.col("n") == 1, F.col("one")).alias(id_col), (F.col("n") > 1).alias("ambiguous"))


def exact_id_link(rows: DataFrame, id_col: str, candidates: DataFrame, candidate_id: str) -> DataFrame:
    """Rows with `linked`: whether the id occurs among the candidates."""
    ids = candidates.select(F.col(candidate_id).alias("_cid")).where("_cid is not null").distinct().withColumn("_hit", F.lit(True))
    return rows.join(ids, rows[id_col] == ids["_cid"], "left").withColumn("linked", F.coalesce("_hit", F.lit(False))).drop("_cid", "_hit")


def link_coverage(linked: DataFrame, group: str) -> DataFrame:
    """Rows, linked, unmatched and coverage in total (null group) and per group, in one pass."""
    n, hit = F.count(F.lit(1)), F.count_if("linked")
    return linked.rollup(group).agg(n.alias("n_rows"), hit.alias("n_linked"), (n - hit).alias("n_unmatched"), (hit / n).alias("coverage"))


def date_mapping(games: DataFrame, id_col: str, date_col: str, matches: DataFrame) -> DataFrame:
    """One dated row per id that has one date and is among the matches, with label tier and batch rule."""
    dated = games.groupBy(id_col).agg(F.count_distinct(date_col).alias("_n"), F.max(F.col(date_col).isNull().cast("int")).alias("_none"), F.max(date_col).alias(date_col)).where("_n + _none = 1 and _none = 0")
    return dated.join(matches.select(id_col).distinct(), id_col, "left_semi").select(id_col, date_col, F.lit("exact_id").alias("label_tier"), F.lit("same_date_simultaneous").alias("batch_rule"))


def dated_inner_join(matches: DataFrame, dates: DataFrame, snapshot: str) -> DataFrame:
    """One-to-one join to dates, with the snapshot's name."""
    return checked_join(matches, dates, ["match_id"], "inner", "one_to_one").withColumn("source_snapshot_id", F.lit(snapshot))


def normalized_unique_map(names: DataFrame, name: str = "team_name", id_col: str = "team_id") -> DataFrame:
    """(name_key, team_id as text) for normalized names that point to exactly one id.

    Names are brought to a row each with their least and greatest id first, so each is normalized once and none is joined."""
    ids = [F.min(id_col).alias("low"), F.max(id_col).alias("high")]
    per = names.where(F.col(name).isNotNull() & F.col(id_col).isNotNull()).groupBy(name).agg(*ids)
    keyed = per.withColumn("name_key", key_of_distinct(name)).where("name_key <> ''")
    of_key = keyed.groupBy("name_key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return of_key.where("low = high").select("name_key", F.col("low").cast("string").alias("historical_id"))


def identity_bridge(bridge: DataFrame, historical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provider teams mapped to historical ids by unique normalized name, else `ps:<id>`; and the audit of the mapping.

    A provider id with several names takes the linked one, then the smallest name."""
    side = lambda df, s: df.select(F.col(f"team_{s}_name").alias("team_name"), F.col(f"team_{s}_id").alias("team_id"))
    lookup = normalized_unique_map(side(historical, "a").unionByName(side(historical, "b")).distinct())
    provider = lambda s: bridge.select(F.col(f"provider_{s}_id").cast("string").alias("provider_id"), F.col(f"team_{s}_name").alias("provider_name"))
    teams = with_name_key(provider("a").unionByName(provider("b")).distinct(), "provider_name", "name_key").join(lookup, "name_key", "left")
    first = Window.partitionBy("provider_id").orderBy(F.col("historical_id").isNull(), "provider_name")
    audit = teams.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("provider_id", "provider_name", "historical_id", F.when(F.col("historical_id").isNull(), "new_provider_team").otherwise("exact_normalized_name").alias("match_method"))
    ids = audit.select("provider_id", F.coalesce("historical_id", F.concat(F.lit("ps:"), F.col("provider_id"))).alias("identity"))
    out = bridge
    for s in ("a", "b"):
        mine = ids.select(F.col("provider_id").alias(f"_p{s}"), F.col("identity").alias(f"team_{s}_id"))
        out = out.join(mine, F.col(f"provider_{s}_id").cast("string") == F.col(f"_p{s}"), "left").drop(f"_p{s}")
    return out, audit


def _candidates(rows: DataFrame, seconds: int) -> DataFrame:
    """(side, id, n, only): how many rows of the other side and the same pair lie within `seconds` of each, and the one if it is one.

    rows: side (0 or 1), id, _pair, _at. Rows and the two ends of every row's span are swept in time order: a running
    count of the other side at the end less that at the start is n, and the last one seen at the end is the one. They
    are dealt by pair and day, with rows near a day's edge in both days, so neither a much repeated pair nor a crowded
    slot makes pairs of rows."""
    reach, day = seconds * 1_000_000, max(12 * seconds, 86_400) * 1_000_000
    slot = lambda at: F.floor(at / F.lit(day))
    mark = lambda s, t, o: F.struct(s.alias("_slot"), t.alias("t"), F.lit(o).alias("o"))
    x = rows.select("side", "id", "_pair", F.unix_micros("_at").alias("at"))
    at = F.col("at")
    days = F.array_distinct(F.array(slot(at - reach), slot(at), slot(at + reach)))
    marks = F.concat(F.array(mark(slot(at), at - reach, 0), mark(slot(at), at + reach, 2)), F.transform(days, lambda s: mark(s, at, 1)))
    seen = Window.partitionBy("_pair", "_slot").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda side: (F.col("o") == 1) & (F.col("side") == side)
    other = lambda make: F.when(F.col("side") == 0, make(1)).otherwise(make(0))
    swept = x.select("side", "id", "_pair", F.inline(marks))
    swept = swept.withColumns({f"c{s}": F.sum(of(s).cast("long")).over(seen) for s in (0, 1)} | {f"last{s}": F.last(F.when(of(s), F.col("id")), ignorenulls=True).over(seen) for s in (0, 1)}).where("o <> 1")
    n, last = other(lambda s: F.col(f"c{s}")), other(lambda s: F.col(f"last{s}"))
    return swept.groupBy("side", "id").agg(F.sum(n * (F.col("o") - 1)).alias("n"), F.max(F.when(F.col("o") == 2, last)).alias("only"))


def fixture_reconcile(left: DataFrame, right: DataFrame, seconds: int = 7200) -> DataFrame:
    """(left_id, right_id) of fixtures with the same unordered name pair within `seconds`, unambiguous both ways.

    Ids of both sides have one type. Each row has its single candidate or none (see `_candidates`), and those that name
    each other meet by the right one's id; no other rows of a pair are joined. A repeated id has the candidates of all
    its rows."""

    def keyed(df: DataFrame, name: str, side: int) -> DataFrame:
        df = with_name_key(with_name_key(df, "team_a", "_ka"), "team_b", "_kb").where("start is not null and _ka <> '' and _kb <> '' and _ka <> _kb")
        return df.select(F.lit(side).alias("side"), F.col(name).alias("id"), F.array_sort(F.array("_ka", "_kb")).alias("_pair"), F.col("start").alias("_at"))

    single = _candidates(keyed(left, "left_id", 0).unionByName(keyed(right, "right_id", 1)), seconds).where("n = 1")
    mine = F.col("side") == 0
    # a right row's only candidate is the only left row that can name it
    met = single.groupBy(F.when(mine, F.col("only")).otherwise(F.col("id")).alias("right_id")).agg(F.max(F.when(mine, F.col("id"))).alias("left_id"), F.max(F.when(~mine, F.lit(True))).alias("agreed"))
    return met.where("left_id is not null and agreed").select("left_id", "right_id")


def map_and_roster_link(matches: DataFrame, games: DataFrame, players: DataFrame) -> DataFrame:
    """Per match: linked games and linked players of its two teams (zero where none)."""
    g = games.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_games"))
    sides = matches.select("match_id", F.explode(F.array("team_a_id", "team_b_id")).alias("team_id"))
    p = sides.join(players.select("match_id", "team_id", "player"), ["match_id", "team_id"]).groupBy("match_id").agg(F.count_distinct("team_id", "player").alias("n_players"))
    return matches.select("match_id").join(g, "match_id", "left").join(p, "match_id", "left").select("match_id", F.coalesce("n_games", F.lit(0)).alias("n_games"), F.coalesce("n_players", F.lit(0)).alias("n_players"))


# The text columns by which map and roster rows name their match.
MAP_KEY = ("year", "tournament", "stage", "match_type", "match_name", "team_a", "team_b")
ROSTER_KEY = ("year", "tournament", "stage", "match_type", "match_name")


def linked_rows(matches: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every match with the rows that carry its text key; a match without any keeps one row of nulls.

    matches: match_id and the key; rows: the key and what is linked. Keys are compared as text, exactly; a match whose
    key holds a null has no rows. Where matches share a key each of them gets all its rows, as the source cannot tell
    them apart."""
    text = lambda df: [F.col(c).cast("string").alias(c) for c in key]
    rest = [c for c in rows.columns if c not in key]
    return matches.select("match_id", *text(matches)).join(rows.select(*text(rows), *rest), list(key), "left").select("match_id", *rest)


def linked_maps(matches: DataFrame, maps: DataFrame) -> DataFrame:
    """Map scores of every match, by the seven columns of MAP_KEY."""
    return linked_rows(matches, maps, MAP_KEY)


def linked_rosters(matches: DataFrame, players: DataFrame) -> DataFrame:
    """Players of every match over both sides of play, by the five columns of ROSTER_KEY; per-side rows are left out."""
    return linked_rows(matches, players.where("side = 'both'").drop("side"), ROSTER_KEY)


def feature_coverage(linked: DataFrame, games: DataFrame) -> DataFrame:
    """One row: matches, those with games, those with a roster, and games in all."""
    total = games.agg(F.count(F.lit(1)).alias("map_rows"))
    return linked.agg(F.count(F.lit(1)).alias("canonical_rows"), F.count_if(F.col("n_games") > 0).alias("series_with_maps"), F.count_if(F.col("n_players") > 0).alias("series_with_roster")).crossJoin(total)
