"""Queries over matches: scalars, checks, joins, ratings and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorday.functions import scalars as S
from priorday.operators import evaluate as E
from priorday.operators import features as X
from priorday.operators import quality as Q
from priorday.operators import rating as R
from priorday.operators import rating_blocks as RB
from priorday.operators import resolve as J
from priorday.sources import contests as A
from priorday.sources import files
from priorday.sources.shared import exists, forget, written

from .base import DEVELOPMENT, GRID, K, query, sql


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.canonical_filter(A.contests(spark, sf_dir))


_pools: dict[tuple[str, str], DataFrame] = {}


def forget_pools(spark: SparkSession) -> None:
    """Let the next query find the pools of teams anew."""
    for key in [k for k in _pools if k[0] == spark.sparkContext.applicationId]:
        if exists(_pools[key]):
            forget(_pools[key])
        del _pools[key]


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical contests with the pool of their teams; pools are found once per application and written."""
    made, key = canonical(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    if key not in _pools or not exists(_pools[key]):
        _pools[key] = written(R.meeting_pools(made), "pools", keep=True)
    return R.with_pools(made, _pools[key])


def history(spark: SparkSession, sf_dir: str, k=K) -> DataFrame:
    return R.with_unseen(R.elo_history(pooled(spark, sf_dir), k, pool="pool"))


def r6(*names: str) -> list:
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]  # -0.0 becomes 0.0


# --- sources -----------------------------------------------------------------

_DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@query("raw_inventory", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM documents" for c in _DOC_COLUMNS))
def raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.null_profile(A.table(spark, sf_dir, "documents").select(*_DOC_COLUMNS))


@query("snapshot_hash", "SELECT event_id, replace(replace(props, ' ', ''), chr(10), '') AS canonical, sha256(replace(replace(props, ' ', ''), chr(10), '') || chr(10)) AS snapshot_hash FROM events")
def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.snapshot_hash(A.events(spark, sf_dir).select("event_id", "props"), "props").select("event_id", "canonical", "snapshot_hash")


# --- scalars -----------------------------------------------------------------


@query("win_probability", "SELECT s_suppkey, c_custkey, round(1 / (1 + pow(10, (c_acctbal - s_acctbal) / 400)), 9) AS p FROM customer JOIN supplier ON c_custkey % (SELECT count(*) FROM supplier) = s_suppkey % (SELECT count(*) FROM supplier)")
def win_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = A.table(spark, sf_dir, "supplier"), A.table(spark, sf_dir, "customer")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    s, c = s.crossJoin(F.broadcast(n)), c.crossJoin(F.broadcast(n))
    joined = s.withColumn("slot", F.col("s_suppkey") % F.col("n")).drop("n").join(c.withColumn("slot", F.col("c_custkey") % F.col("n")).drop("n"), "slot")
    return joined.select("s_suppkey", "c_custkey", F.round(S.win_probability(F.col("s_acctbal"), F.col("c_acctbal")), 9).alias("p"))


@query("resolved_outcome", sql("SELECT match_id, team_a_won FROM contests", "contests"))
def resolved_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.contests(spark, sf_dir).select("match_id", "team_a_won")


@query("extract_id", "SELECT page_id, nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') AS source_id FROM pages")
def extract_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", S.extract_id(F.col("url"), r"/([0-9]+)(?:[?#]|$)").alias("source_id"))


def _dated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 97 == 0, "1970-01-01").when(k % 101 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return A.table(spark, sf_dir, "orders").select(k.alias("match_id"), text.alias("date_text"))


_DATED_SQL = "SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 97 = 0 THEN '1970-01-01' WHEN o_orderkey % 101 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text FROM orders"


@query("valid_date", f"SELECT match_id, CASE WHEN year(TRY_CAST(date_text AS DATE)) >= 1990 THEN TRY_CAST(date_text AS DATE) END AS match_date FROM ({_DATED_SQL})")
def valid_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated_text(spark, sf_dir).select("match_id", S.valid_date(F.col("date_text"), 1990).alias("match_date"))


@query("canonical_filter", sql("SELECT match_id, match_date, year, team_a_id, team_a_name, team_b_id, team_b_name, team_a_won, tournament FROM canonical WHERE year BETWEEN 1996 AND 2000", "canonical"))
def canonical_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.canonical_filter(A.contests(spark, sf_dir), range(1996, 2001)).select(*A.CANONICAL)


@query("name_key", sql("SELECT team_name, team_id, name_key FROM keyed_names", "keyed_names"))
def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_name_key(A.named_ids(spark, sf_dir), "team_name", "name_key").select("team_name", "team_id", "name_key")


@query("disagreement_bucket", sql("SELECT match_id, CASE WHEN g < 0.02 THEN '<2pp' WHEN g <= 0.05 THEN '2-5pp' WHEN g <= 0.10 THEN '5-10pp' ELSE '>10pp' END AS bucket FROM (SELECT match_id, abs(p - 0.5) AS g FROM history)", "history"))
def disagreement_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("match_id", S.disagreement_bucket(F.col("probability_a"), F.lit(0.5)).alias("bucket"))


# --- checks ------------------------------------------------------------------

_RULES = {
    "null_id": "match_id IS NULL",
    "invalid_date": "match_date IS NULL OR year(match_date) < 1971",
    "year_outside": "year IS NULL OR year NOT BETWEEN 1996 AND 2000",
    "missing_team": "team_a_id IS NULL OR team_b_id IS NULL",
    "same_team": "team_a_id = team_b_id",
    "placeholder": "upper(team_a_name) = 'TBD' OR upper(team_b_name) = 'TBD'",
    "no_outcome": "team_a_won IS NULL",
}


@query("quality_report", sql(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS violations FROM contests" for n, c in _RULES.items()) + " UNION ALL SELECT 'duplicate_id', count(match_id) - count(DISTINCT match_id) FROM contests", "contests"))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_report(A.contests(spark, sf_dir), years=(1996, 2000))


@query("date_conflicts", "SELECT l_orderkey, CAST(count(DISTINCT CAST(l_shipdate AS DATE)) + max(CAST(l_shipdate IS NULL AS INTEGER)) AS BIGINT) AS n_dates FROM lineitem GROUP BY 1 HAVING count(DISTINCT CAST(l_shipdate AS DATE)) + max(CAST(l_shipdate IS NULL AS INTEGER)) > 1")
def date_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.date_conflicts(A.table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("day")), "l_orderkey", "day")


@query("source_profile", f"SELECT count(*) AS n_rows, count(d) AS n_parseable, min(d) AS min_date, max(d) AS max_date, count(*) FILTER (regexp_matches(date_text, '\\bago\\b')) AS n_relative, count(*) FILTER (regexp_matches(date_text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS n_absolute FROM (SELECT *, TRY_CAST(date_text AS DATE) AS d FROM ({_DATED_SQL}))")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.source_profile(_dated_text(spark, sf_dir).withColumn("d", F.try_to_date("date_text", "yyyy-MM-dd")), "date_text", "d")


_UNIQUE_SQL = "SELECT team_name, CASE WHEN count(DISTINCT team_id) = 1 THEN min(team_id) END AS team_id, count(DISTINCT team_id) > 1 AS ambiguous FROM named_ids WHERE team_name IS NOT NULL GROUP BY team_name"


@query(
    "audit_report",
    sql(
        f"""SELECT 'total' AS section, 'rows' AS key, count(*) AS value FROM contests
 UNION ALL SELECT 'total', 'missing_id', count(*) FILTER (match_id IS NULL) FROM contests
 UNION ALL SELECT 'total', 'duplicated_id', count(match_id) - count(DISTINCT match_id) FROM contests
 UNION ALL SELECT 'total', 'unresolved_outcome', count(*) FILTER (team_a_won IS NULL) FROM contests
 UNION ALL SELECT 'total', 'ambiguous_names', count(*) FILTER (ambiguous) FROM ({_UNIQUE_SQL})
 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM contests GROUP BY year""",
        "contests",
        "named_ids",
    ),
)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.audit_report(A.contests(spark, sf_dir), J.unique_names(A.named_ids(spark, sf_dir)))


# --- joins and resolution ------------------------------------------------------


@query(
    "ambiguous_key_join",
    """WITH one AS (SELECT c_nationkey, c_mktsegment, min(c_custkey // 100) AS group_id FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey // 100) = 1)
SELECT c_custkey, one.group_id, CASE WHEN one.group_id IS NULL THEN 'ambiguous_or_missing_source_key' ELSE 'exact_source_key' END AS id_status
FROM customer c LEFT JOIN one ON c.c_nationkey IS NOT DISTINCT FROM one.c_nationkey AND c.c_mktsegment IS NOT DISTINCT FROM one.c_mktsegment""",
)
def ambiguous_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    groups = c.select("c_nationkey", "c_mktsegment", F.expr("c_custkey div 100").alias("group_id")).distinct()
    return J.ambiguous_key_join(c, groups, ["c_nationkey", "c_mktsegment"], "group_id").select("c_custkey", "group_id", "id_status")


@query("unique_name_lookup", sql(_UNIQUE_SQL, "named_ids"))
def unique_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unique_names(A.named_ids(spark, sf_dir))


@query(
    "exact_id_link",
    """WITH l AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS linked FROM orders)
SELECT year, count(*) AS n_rows, count(*) FILTER (linked) AS n_linked, count(*) FILTER (NOT linked) AS n_unmatched, count(*) FILTER (linked) / count(*) AS coverage FROM l GROUP BY ROLLUP (year)""",
)
def exact_id_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return J.link_coverage(J.exact_id_link(o, "o_orderkey", A.table(spark, sf_dir, "lineitem"), "l_orderkey"), "year")


_MAPPING_SQL = """SELECT l_orderkey AS match_id, CAST(max(l_shipdate) AS DATE) AS day, 'exact_id' AS label_tier, 'same_date_simultaneous' AS batch_rule
FROM lineitem WHERE l_orderkey IN (SELECT match_id FROM contests) GROUP BY l_orderkey HAVING count(DISTINCT CAST(l_shipdate AS DATE)) = 1 AND count(*) = count(l_shipdate)"""


def _ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.to_date("l_shipdate").alias("day"))


@query("date_mapping", sql(_MAPPING_SQL, "contests"))
def date_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.date_mapping(_ship_days(spark, sf_dir), "match_id", "day", A.contests(spark, sf_dir))


@query("dated_inner_join", "SELECT o_orderkey AS match_id, o_custkey AS customer_id, CASE WHEN year(TRY_CAST(date_text AS DATE)) >= 1990 THEN TRY_CAST(date_text AS DATE) END AS match_date, 'orders/v1' AS source_snapshot_id FROM orders JOIN (" + _DATED_SQL + ") x ON x.match_id = o_orderkey")
def dated_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("customer_id"))
    dates = _dated_text(spark, sf_dir).select("match_id", S.valid_date(F.col("date_text"), 1990).alias("match_date"))
    return J.dated_inner_join(o, dates, "orders/v1").select("match_id", "customer_id", "match_date", "source_snapshot_id")


@query("normalized_unique_map", sql("SELECT name_key, min(CAST(team_id AS VARCHAR)) AS historical_id FROM keyed_names WHERE team_id IS NOT NULL AND name_key <> '' GROUP BY name_key HAVING count(DISTINCT team_id) = 1", "keyed_names"))
def normalized_unique_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.normalized_unique_map(A.named_ids(spark, sf_dir))


_NEW = "2000-01-01"
_FORMER = "SELECT CAST(team_{s}_id AS VARCHAR) AS team_id, CASE WHEN team_{s}_id % 3 = 0 THEN team_{s}_name || ' II' ELSE team_{s}_name END AS name FROM canonical WHERE match_date < DATE '" + _NEW + "'"


@query(
    "identity_bridge",
    sql(
        f"""SELECT provider_id, provider_name, historical_id, CASE WHEN historical_id IS NULL THEN 'new_provider_team' ELSE 'exact_normalized_name' END AS match_method FROM (
  SELECT provider_id, provider_name, historical_id, row_number() OVER (PARTITION BY provider_id ORDER BY historical_id IS NULL, provider_name) AS rn FROM (
   SELECT DISTINCT CAST(team_id + 1000 AS VARCHAR) AS provider_id, upper(name) AS provider_name FROM (
    SELECT team_a_id AS team_id, team_a_name AS name FROM canonical WHERE match_date >= DATE '{_NEW}' UNION ALL SELECT team_b_id, team_b_name FROM canonical WHERE match_date >= DATE '{_NEW}')) t
  LEFT JOIN (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key, min(team_id) AS historical_id FROM ({_FORMER.format(s="a")} UNION ALL {_FORMER.format(s="b")}) GROUP BY key HAVING count(DISTINCT team_id) = 1) h
   ON h.key = regexp_replace(lower(provider_name), '[^a-z0-9]+', '', 'g')) WHERE rn = 1""",
        "canonical",
    ),
)
def identity_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests since 2000 as a provider lists them, bridged to those before; a third of the teams were named otherwise then."""
    c = canonical(spark, sf_dir)
    former = lambda s: F.when(F.col(f"team_{s}_id") % 3 == 0, F.concat(f"team_{s}_name", F.lit(" II"))).otherwise(F.col(f"team_{s}_name"))
    old = c.where(F.col("match_date") < F.to_date(F.lit(_NEW))).withColumns({"team_a_name": former("a"), "team_b_name": former("b")})
    new = c.where(F.col("match_date") >= F.to_date(F.lit(_NEW)))
    bridge = new.select("match_id", (F.col("team_a_id") + 1000).alias("provider_a_id"), F.upper("team_a_name").alias("team_a_name"), (F.col("team_b_id") + 1000).alias("provider_b_id"), F.upper("team_b_name").alias("team_b_name"))
    return J.identity_bridge(bridge, old)[1]


@query(
    "fixture_reconcile",
    sql(
        """, l AS (SELECT match_id, least(team_a_name, team_b_name) AS n1, greatest(team_a_name, team_b_name) AS n2, CAST(match_date AS TIMESTAMP) + INTERVAL 12 HOUR AS t FROM contests WHERE team_a_name <> team_b_name),
 r0 AS (SELECT match_id, n1, n2, t + to_hours(CAST(match_id % 5 AS INTEGER)) AS t FROM l), r AS (SELECT * FROM r0 UNION ALL SELECT -match_id, n1, n2, t FROM r0 WHERE match_id % 50 = 0),
 near AS (SELECT l.match_id AS left_id, r.match_id AS right_id FROM l JOIN r USING (n1, n2) WHERE abs(epoch(l.t) - epoch(r.t)) <= 7200)
SELECT left_id, right_id FROM (SELECT *, count(*) OVER (PARTITION BY left_id) AS a, count(*) OVER (PARTITION BY right_id) AS b FROM near) WHERE a = 1 AND b = 1""",
        "contests",
    ).replace("\n, l AS", ",\nl AS"),
)
def fixture_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = A.rival_fixtures(spark, sf_dir)
    return J.fixture_reconcile(left, right)


_LINK_SQL = """SELECT c.match_id, coalesce(g.n, 0) AS n_games, coalesce(p.n, 0) AS n_players FROM canonical c
LEFT JOIN (SELECT match_id, count(*) AS n FROM map_games GROUP BY 1) g USING (match_id)
LEFT JOIN (SELECT s.match_id, count(DISTINCT s.team_id || ':' || player) AS n FROM sides s JOIN lineups l ON l.match_id = s.match_id AND l.team_id = s.team_id GROUP BY 1) p USING (match_id)"""


@query("map_and_roster_link", sql(_LINK_SQL, "canonical", "map_games", "sides", "lineups"))
def map_and_roster_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.map_and_roster_link(canonical(spark, sf_dir), A.map_games(spark, sf_dir), A.lineups(spark, sf_dir))


_TEXT_KEYS = """, named AS (SELECT match_id, year, tournament, 'Stage ' || quarter(match_date) AS stage, CASE WHEN match_id % 2 = 0 THEN 'Group' ELSE 'Final' END AS match_type, team_a_name || ' vs ' || team_b_name AS match_name, team_a_name AS team_a, team_b_name AS team_b FROM contests)
"""


def _joined_sql(text: str) -> str:
    return text.replace("\n, ", ",\n", 1)


@query(
    "linked_maps",
    _joined_sql(
        sql(
            _TEXT_KEYS
            + """SELECT m.match_id, f.map, f.game, f.score_a, f.score_b FROM named m LEFT JOIN (SELECT n.*, map, game, CASE WHEN team_a_won THEN 13 ELSE 7 END AS score_a, CASE WHEN team_a_won THEN 7 ELSE 13 END AS score_b FROM named n JOIN map_games USING (match_id) WHERE match_id % 7 <> 0) f
 ON f.year = m.year AND f.tournament = m.tournament AND f.stage = m.stage AND f.match_type = m.match_type AND f.match_name = m.match_name AND f.team_a = m.team_a AND f.team_b = m.team_b""",
            "contests",
            "map_games",
        )
    ),
)
def linked_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.linked_maps(A.text_keys(spark, sf_dir), A.map_files(spark, sf_dir)).select("match_id", "map", "game", "score_a", "score_b")


@query(
    "linked_rosters",
    _joined_sql(
        sql(
            _TEXT_KEYS
            + """SELECT m.match_id, f.team_id, f.player FROM named m LEFT JOIN (SELECT n.*, l_suppkey AS team_id, 'P' || (l_partkey % 7) AS player FROM named n JOIN lineitem ON l_orderkey = match_id WHERE match_id % 9 <> 0 AND l_linenumber % 3 <> 0) f
 ON f.year = m.year AND f.tournament = m.tournament AND f.stage = m.stage AND f.match_type = m.match_type AND f.match_name = m.match_name""",
            "contests",
        )
    ),
)
def linked_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.linked_rosters(A.text_keys(spark, sf_dir), A.overview_files(spark, sf_dir)).select("match_id", "team_id", "player")


@query("feature_coverage", sql(f"SELECT count(*) AS canonical_rows, count(*) FILTER (n_games > 0) AS series_with_maps, count(*) FILTER (n_players > 0) AS series_with_roster, (SELECT count(*) FROM map_games) AS map_rows FROM ({_LINK_SQL})", "canonical", "map_games", "sides", "lineups"))
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.feature_coverage(map_and_roster_link(spark, sf_dir), A.map_games(spark, sf_dir))


# --- ratings -------------------------------------------------------------------


@query(
    "elo_history",
    sql(
        "SELECT match_id, match_date, team_a_id, team_b_id, team_a_won, round(rating_a_pre, 6) AS rating_a_pre, round(rating_b_pre, 6) AS rating_b_pre, round(p, 6) AS probability_a, round(delta, 6) AS elo_delta_a, team_a_prior, team_b_prior, any_team_unseen FROM history",
        "history",
    ),
)
def elo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return h.select("match_id", "match_date", "team_a_id", "team_b_id", "team_a_won", *r6("rating_a_pre", "rating_b_pre", "probability_a", "elo_delta_a"), "team_a_prior", "team_b_prior", "any_team_unseen")


@query(
    "elo_blocks",
    sql("SELECT k, match_id, match_date, round(rating_a_pre, 6) AS rating_a_pre, round(rating_b_pre, 6) AS rating_b_pre, round(delta, 6) AS elo_delta_a, team_a_prior, team_b_prior FROM history", "history", ks="16.0, 32.0, 64.0"),
)
def elo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings of every K with all contests in one pool, folded block after block of days."""
    h = RB.elo_history_in_blocks(canonical(spark, sf_dir), GRID, block_rows=5_000, most_blocks=32)
    return h.select("k", "match_id", "match_date", *r6("rating_a_pre", "rating_b_pre", "elo_delta_a"), "team_a_prior", "team_b_prior")


@query("elo_final", sql("SELECT team AS team_id, round(rating, 6) AS rating FROM st WHERE d = (SELECT max(d) FROM days)", "st", "days"))
def elo_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.elo_final(history(spark, sf_dir)).select("team_id", *r6("rating"))


@query(
    "k_grid",
    sql(
        """SELECT k, n, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(accuracy, 6) AS accuracy, CAST(row_number() OVER (ORDER BY log_loss, k) AS INTEGER) AS place FROM (
 SELECT k, count(*) AS n, avg(log_loss) AS log_loss, avg(brier) AS brier, avg(CAST(correct AS DOUBLE)) AS accuracy FROM losses WHERE match_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' GROUP BY k)""",
        "losses",
        ks="16.0, 32.0, 64.0",
    ),
)
def k_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.k_grid(R.elo_history(pooled(spark, sf_dir), GRID, pool="pool"), DEVELOPMENT).select("k", "n", *r6("log_loss", "brier", "accuracy"), "place")


_CUTS = ("1996-12-31", "1997-12-31", "1998-12-31", "1999-12-31", "2000-12-31")


@query(
    "rating_distribution",
    sql(
        "SELECT cut, count(*) AS n_teams, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(min(r), 6) AS min, round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.75), 6) AS p75, round(max(r), 6) AS max FROM ("
        "SELECT cut, team_id, arg_max(rating, match_date) AS r FROM states JOIN (SELECT unnest([" + ", ".join(f"DATE '{c}'" for c in _CUTS) + "]) AS cut) ON match_date <= cut GROUP BY ALL) GROUP BY cut",
        "states",
    ),
)
def rating_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.rating_distribution(R.rating_states(history(spark, sf_dir)), _CUTS)
    return d.select("cut", "n_teams", *r6("mean", "std", "min", "p25", "median", "p75", "max"))


@query(
    "as_of_state",
    sql(
        """SELECT c_custkey, a.team_id, as_of, round(coalesce(rating, 1500), 6) AS rating, coalesce(n_prior, 0) AS n_prior, s.match_date AS last_date FROM (
  SELECT c_custkey, c_custkey % (SELECT count(*) FROM supplier) AS team_id, DATE '1995-06-01' + CAST(c_custkey % 2000 AS INTEGER) AS as_of FROM customer) a
 ASOF LEFT JOIN states s ON a.team_id = s.team_id AND a.as_of > s.match_date""",
        "states",
    ),
)
def as_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    asks = A.table(spark, sf_dir, "customer").crossJoin(F.broadcast(n)).select("c_custkey", (F.col("c_custkey") % F.col("n")).alias("team_id"), F.date_add(F.to_date(F.lit("1995-06-01")), (F.col("c_custkey") % 2000).cast("int")).alias("as_of"))
    return R.as_of_states(asks, R.rating_states(history(spark, sf_dir))).select("c_custkey", "team_id", "as_of", *r6("rating"), "n_prior", "last_date")


_MAP_CTES = """, mdays AS (SELECT map, match_date, row_number() OVER (PARTITION BY map ORDER BY match_date) AS d FROM (SELECT DISTINCT map, match_date FROM map_games)),
mg AS MATERIALIZED (SELECT d, g.map, g.match_date, match_id, game, team_a_id AS a, team_b_id AS b, team_a_won, CAST(team_a_won AS DOUBLE) AS y FROM map_games g JOIN mdays m ON m.map = g.map AND m.match_date = g.match_date),
mlast AS (SELECT map, max(d) AS last FROM mdays GROUP BY map),
mst AS (SELECT map, CAST(0 AS BIGINT) AS d, team, CAST(1500 AS DOUBLE) AS rating FROM (SELECT DISTINCT map, unnest([a, b]) AS team FROM mg)
 UNION ALL
 SELECT s.map, s.d + 1, s.team, s.rating + coalesce(x.delta, 0) FROM mst s JOIN mlast ON mlast.map = s.map AND s.d < last LEFT JOIN (
  SELECT map, team, arg_max(delta, (match_id, game)) AS delta FROM (
   SELECT g.map, match_id, game, unnest([g.a, g.b]) AS team, unnest([1, -1]) * (64 * (g.y - 1 / (1 + pow(10, (rb.rating - ra.rating) / 400)))) AS delta
   FROM mg g JOIN mst ra ON ra.map = g.map AND ra.team = g.a AND g.d = ra.d + 1 JOIN mst rb ON rb.map = g.map AND rb.team = g.b AND rb.d = ra.d) GROUP BY map, team) x
  ON x.map = s.map AND x.team = s.team),
mh AS (SELECT g.map, g.match_id, g.game, g.match_date, g.a, g.b, ra.rating AS ra, rb.rating AS rb, 1 / (1 + pow(10, (rb.rating - ra.rating) / 400)) AS p
 FROM mg g JOIN mst ra ON ra.map = g.map AND ra.team = g.a AND ra.d = g.d - 1 JOIN mst rb ON rb.map = g.map AND rb.team = g.b AND rb.d = g.d - 1)
"""


def _map_sql(body: str, *needs: str) -> str:
    text = sql(_MAP_CTES + body, "map_games", *needs)
    return text.replace("\n, mdays AS", ",\nmdays AS").replace("WITH ", "WITH RECURSIVE ", 1)


@query("map_elo", _map_sql("SELECT map, match_id, game, round(ra, 6) AS rating_a_pre, round(rb, 6) AS rating_b_pre, round(p, 6) AS probability_a FROM mh"))
def map_elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.map_elo(A.map_games(spark, sf_dir)).select(F.col("pool").alias("map"), "match_id", "game", *r6("rating_a_pre", "rating_b_pre", "probability_a"))


# --- features ------------------------------------------------------------------


@query("team_long", sql("SELECT match_id, match_date, team_id, opponent_id, won FROM sides", "sides"))
def team_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.team_long(canonical(spark, sf_dir))


@query("prior_counts", sql("SELECT match_id, a.n_prior - b.n_prior AS prior_match_count_diff, least(a.n_prior, b.n_prior) AS min_prior_match_count FROM canonical c JOIN priors a ON a.team_id = team_a_id AND a.match_date = c.match_date JOIN priors b ON b.team_id = team_b_id AND b.match_date = c.match_date", "canonical", "priors"))
def prior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.prior_counts(canonical(spark, sf_dir))


_LAST_SQL = """, seq AS (SELECT team_id, match_date, CAST(won AS DOUBLE) AS w, row_number() OVER (PARTITION BY team_id ORDER BY match_date, match_id) AS i FROM sides),
firsts AS (SELECT team_id, match_date, min(i) AS f FROM seq GROUP BY ALL),
rates AS (SELECT d.team_id, d.match_date, coalesce(avg(w) FILTER (i >= f - 5), 0.5) AS l5, coalesce(avg(w), 0.5) AS l10 FROM firsts d LEFT JOIN seq s ON s.team_id = d.team_id AND s.i BETWEEN f - 10 AND f - 1 GROUP BY ALL),
gaps AS (SELECT team_id, match_date, date_diff('day', lag(match_date) OVER (PARTITION BY team_id ORDER BY match_date), match_date) AS g FROM day_counts)
"""
_BOTH = "FROM canonical c JOIN {t} a ON a.team_id = team_a_id AND a.match_date = c.match_date JOIN {t} b ON b.team_id = team_b_id AND b.match_date = c.match_date"


@query("last_n_win_rate", sql(_LAST_SQL + "SELECT match_id, round(a.l5 - b.l5, 9) AS last_5_win_rate_diff, round(a.l10 - b.l10, 9) AS last_10_win_rate_diff " + _BOTH.format(t="rates"), "canonical", "day_counts").replace("\n, seq AS", ",\nseq AS"))
def last_n_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.last_n_win_rate(canonical(spark, sf_dir)).select("match_id", F.round("last_5_win_rate_diff", 9).alias("last_5_win_rate_diff"), F.round("last_10_win_rate_diff", 9).alias("last_10_win_rate_diff"))


@query("days_since_last", sql(_LAST_SQL + "SELECT match_id, CAST(a.g - b.g AS INTEGER) AS days_since_last_match_diff, CAST(a.g IS NULL OR b.g IS NULL AS INTEGER) AS any_missing_last_match_date " + _BOTH.format(t="gaps"), "canonical", "day_counts").replace("\n, seq AS", ",\nseq AS"))
def days_since_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.days_since_last(canonical(spark, sf_dir))


@query(
    "feature_table",
    sql(
        _LAST_SQL
        + """SELECT h.match_id, h.match_date, h.team_a_id, h.team_b_id, h.team_a_won, round(p, 6) AS probability_a, round(rating_a_pre - rating_b_pre, 6) AS elo_diff,
 round(a.l5 - b.l5, 9) AS last_5_win_rate_diff, round(a.l10 - b.l10, 9) AS last_10_win_rate_diff, team_a_prior - team_b_prior AS prior_match_count_diff, least(team_a_prior, team_b_prior) AS min_prior_match_count,
 CAST(ga.g - gb.g AS INTEGER) AS days_since_last_match_diff, CAST(ga.g IS NULL OR gb.g IS NULL AS INTEGER) AS any_missing_last_match_date, CAST(any_team_unseen AS INTEGER) AS any_team_unseen
 FROM history h JOIN rates a ON a.team_id = h.team_a_id AND a.match_date = h.match_date JOIN rates b ON b.team_id = h.team_b_id AND b.match_date = h.match_date
 JOIN gaps ga ON ga.team_id = h.team_a_id AND ga.match_date = h.match_date JOIN gaps gb ON gb.team_id = h.team_b_id AND gb.match_date = h.match_date""",
        "history",
        ks="64.0",
    ).replace("\n, seq AS", ",\nseq AS"),
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.feature_table(pooled(spark, sf_dir), pool="pool")
    return t.withColumns({"probability_a": F.round("probability_a", 6), "elo_diff": F.round("elo_diff", 6), "last_5_win_rate_diff": F.round("last_5_win_rate_diff", 9), "last_10_win_rate_diff": F.round("last_10_win_rate_diff", 9)})


@query(
    "map_pool",
    _map_sql(
        """, mstates AS (SELECT map, team, match_date, d, rating FROM mst JOIN mdays USING (map, d) WHERE EXISTS (SELECT 1 FROM mg WHERE mg.map = mst.map AND mg.d = mst.d AND (mg.a = mst.team OR mg.b = mst.team))),
pools AS (SELECT team_id, match_date, avg(r) AS mean, max(r) AS max, min(r) AS min, stddev_pop(r) AS std, count(*) AS n FROM (
 SELECT s.team_id, s.match_date, m.map, arg_max(m.rating, m.match_date) AS r FROM (SELECT DISTINCT team_id, match_date FROM sides) s JOIN mstates m ON m.team = s.team_id AND m.match_date < s.match_date GROUP BY ALL) GROUP BY ALL)
SELECT match_id, round(coalesce(a.mean, 1500) - coalesce(b.mean, 1500), 6) + 0.0::DOUBLE AS map_mean_elo_diff, round(coalesce(a.max, 1500) - coalesce(b.max, 1500), 6) + 0.0::DOUBLE AS map_max_elo_diff, round(coalesce(a.min, 1500) - coalesce(b.min, 1500), 6) + 0.0::DOUBLE AS map_min_elo_diff,
 round(coalesce(a.std, 0) - coalesce(b.std, 0), 6) + 0.0::DOUBLE AS map_elo_std_diff, coalesce(a.n, 0) - coalesce(b.n, 0) AS map_history_count_diff, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS min_map_history_count
FROM canonical c LEFT JOIN pools a ON a.team_id = team_a_id AND a.match_date = c.match_date LEFT JOIN pools b ON b.team_id = team_b_id AND b.match_date = c.match_date""",
        "sides",
    ).replace("\n, mstates AS", ",\nmstates AS"),
)
def map_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.map_pool(canonical(spark, sf_dir), A.map_games(spark, sf_dir))
    return m.select("match_id", *r6("map_mean_elo_diff", "map_max_elo_diff", "map_min_elo_diff", "map_elo_std_diff"), "map_history_count_diff", "min_map_history_count")


@query("roster_sets", sql("SELECT team_id, match_date, array_to_string(list_sort(list_distinct(list(player))), ',') AS roster FROM lineups GROUP BY ALL", "lineups"))
def roster_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.roster_sets(A.lineups(spark, sf_dir)).select("team_id", "match_date", F.array_join("roster", ",").alias("roster"))


@query(
    "roster_features",
    sql(
        """, rost AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date) AS i FROM (SELECT team_id, match_date, list_distinct(list(player)) AS roster FROM lineups GROUP BY ALL)),
asks AS (SELECT s.team_id, s.match_date, (SELECT max(i) FROM rost r WHERE r.team_id = s.team_id AND r.match_date < s.match_date) AS i FROM (SELECT DISTINCT team_id, match_date FROM sides) s),
feats AS (SELECT a.team_id, a.match_date, coalesce(len(l.roster), 5) AS last_size, CASE WHEN p.roster IS NULL THEN 1.0::DOUBLE ELSE len(list_intersect(l.roster, p.roster))::DOUBLE / len(list_distinct(list_concat(l.roster, p.roster))) END AS continuity,
  coalesce((SELECT count(DISTINCT x) FROM (SELECT unnest(roster) AS x FROM rost f WHERE f.team_id = a.team_id AND f.i BETWEEN a.i - 4 AND a.i)), 0) AS recent, CAST(a.i IS NULL AS INTEGER) AS missing
 FROM asks a LEFT JOIN rost l ON l.team_id = a.team_id AND l.i = a.i LEFT JOIN rost p ON p.team_id = a.team_id AND p.i = a.i - 1),
feat AS (SELECT team_id, match_date, last_size, continuity, CASE WHEN missing = 1 THEN 5 ELSE recent END AS recent, missing FROM feats)
SELECT match_id, CAST(a.last_size - b.last_size AS DOUBLE) AS roster_last_size_diff, round(a.continuity - b.continuity, 9) AS roster_continuity_diff, CAST(a.recent - b.recent AS DOUBLE) AS roster_recent_unique_diff, greatest(a.missing, b.missing) AS any_missing_roster_history """
        + _BOTH.format(t="feat"),
        "canonical",
        "sides",
        "lineups",
    ).replace("\n, rost AS", ",\nrost AS"),
)
def roster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.roster_features(canonical(spark, sf_dir), A.lineups(spark, sf_dir)).withColumn("roster_continuity_diff", F.round("roster_continuity_diff", 9))
