"""The registry of queries and the shared parts of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DEVELOPMENT = ("1997-01-01", "1999-12-31")
TEST_FROM = "2000-01-01"
K = 32.0
GRID = (16.0, 32.0, 64.0)
FOLDS = (("1998H1", "1998-01-01", "1998-07-01"), ("1998H2", "1998-07-01", "1999-01-01"), ("1999H1", "1999-01-01", "1999-07-01"), ("1999H2", "1999-07-01", "2000-01-01"))
NOW = "2024-01-16 06:30:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if SQL can express it, its equivalent."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


#: Common table expressions by name: (names it needs, text).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "contest_lines": (
        (),
        """SELECT l_orderkey, l_suppkey, l_partkey, l_quantity, l_extendedprice,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) AS rn FROM lineitem""",
    ),
    "contests": (
        ("contest_lines",),
        """SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, CAST(year(o_orderdate) AS INTEGER) AS year,
 a.l_suppkey AS team_a_id, sa.s_name AS team_a_name, b.l_suppkey AS team_b_id, sb.s_name AS team_b_name, na.n_name AS tournament,
 na.n_regionkey AS region_a, nb.n_regionkey AS region_b, a.l_quantity AS score_a, b.l_quantity AS score_b, a.l_partkey AS part_a, b.l_partkey AS part_b,
 a.l_extendedprice AS price_a, b.l_extendedprice AS price_b,
 CASE WHEN a.l_quantity > b.l_quantity THEN true WHEN a.l_quantity < b.l_quantity THEN false END AS team_a_won
 FROM orders JOIN contest_lines a ON a.l_orderkey = o_orderkey AND a.rn = 1 JOIN contest_lines b ON b.l_orderkey = o_orderkey AND b.rn = 2
 JOIN supplier sa ON sa.s_suppkey = a.l_suppkey JOIN nation na ON na.n_nationkey = sa.s_nationkey
 JOIN supplier sb ON sb.s_suppkey = b.l_suppkey JOIN nation nb ON nb.n_nationkey = sb.s_nationkey""",
    ),
    "canonical": (("contests",), "SELECT * FROM contests WHERE team_a_won IS NOT NULL AND team_a_id <> team_b_id AND upper(team_a_name) <> 'TBD' AND upper(team_b_name) <> 'TBD'"),
    "sides": (
        ("canonical",),
        """SELECT match_id, match_date, team_a_id AS team_id, team_b_id AS opponent_id, team_a_won AS won FROM canonical
 UNION ALL SELECT match_id, match_date, team_b_id, team_a_id, NOT team_a_won FROM canonical""",
    ),
    "day_counts": (("sides",), "SELECT team_id, match_date, count(*) AS n FROM sides GROUP BY ALL"),
    "priors": (("day_counts",), "SELECT team_id, match_date, CAST(coalesce(sum(n) OVER (PARTITION BY team_id ORDER BY match_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_prior FROM day_counts"),
    "days": (("canonical",), "SELECT match_date, row_number() OVER (ORDER BY match_date) AS d FROM (SELECT DISTINCT match_date FROM canonical)"),
    "games": (("canonical", "days"), "SELECT d, match_id, match_date, year, team_a_id AS a, team_b_id AS b, team_a_won, CAST(team_a_won AS DOUBLE) AS y FROM canonical JOIN days USING (match_date)"),
    "ks": ((), "SELECT unnest([{KS}]::DOUBLE[]) AS k"),
    "st": (
        ("games", "ks", "days"),
        """SELECT k, CAST(0 AS BIGINT) AS d, team, CAST(1500 AS DOUBLE) AS rating FROM (SELECT DISTINCT unnest([a, b]) AS team FROM games), ks
 UNION ALL
 SELECT s.k, s.d + 1, s.team, s.rating + coalesce(x.delta, 0) FROM st s LEFT JOIN (
  SELECT k, team, sum(delta) AS delta FROM (
   SELECT ra.k, unnest([g.a, g.b]) AS team, unnest([1, -1]) * (ra.k * (g.y - 1 / (1 + pow(10, (rb.rating - ra.rating) / 400)))) AS delta
   FROM games g JOIN st ra ON ra.team = g.a AND g.d = ra.d + 1 JOIN st rb ON rb.team = g.b AND rb.d = ra.d AND rb.k = ra.k)
  GROUP BY k, team) x ON x.team = s.team AND x.k = s.k
 WHERE s.d < (SELECT max(d) FROM days)""",
    ),
    "history": (
        ("st", "priors"),
        """SELECT k, match_id, g.match_date, year, a AS team_a_id, b AS team_b_id, team_a_won, ra.rating AS rating_a_pre, rb.rating AS rating_b_pre,
 1 / (1 + pow(10, (rb.rating - ra.rating) / 400)) AS p, k * (y - 1 / (1 + pow(10, (rb.rating - ra.rating) / 400))) AS delta,
 pa.n_prior AS team_a_prior, pb.n_prior AS team_b_prior, pa.n_prior = 0 OR pb.n_prior = 0 AS any_team_unseen
 FROM games g JOIN st ra ON ra.team = a AND ra.d = g.d - 1 JOIN st rb USING (k) JOIN priors pa ON pa.team_id = a AND pa.match_date = g.match_date
 JOIN priors pb ON pb.team_id = b AND pb.match_date = g.match_date WHERE rb.team = b AND rb.d = g.d - 1""",
    ),
    "losses": (
        ("history",),
        """SELECT *, -CASE WHEN team_a_won THEN ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END AS log_loss,
 pow(p - CAST(team_a_won AS DOUBLE), 2) AS brier, (p >= 0.5) = team_a_won AS correct, greatest(p, 1 - p) AS confidence FROM history""",
    ),
    "states": (
        ("history",),
        """SELECT k, team_id, match_date, max(pre) + sum(delta) AS rating, CAST(max(prior) + count(*) AS BIGINT) AS n_prior FROM (
  SELECT k, match_date, team_a_id AS team_id, rating_a_pre AS pre, delta, team_a_prior AS prior FROM history
  UNION ALL SELECT k, match_date, team_b_id, rating_b_pre, -delta, team_b_prior FROM history) GROUP BY ALL""",
    ),
    "map_games": (
        ("canonical",),
        """SELECT match_id, match_date, p_brand AS map, game, team_a_id, team_b_id, a > b AS team_a_won FROM (
  SELECT match_id, match_date, team_a_id, team_b_id, part_a AS part, 1 AS game, CAST(score_a AS DOUBLE) AS a, CAST(score_b AS DOUBLE) AS b FROM canonical
  UNION ALL SELECT match_id, match_date, team_a_id, team_b_id, part_b, 2, CAST(price_a AS DOUBLE), CAST(price_b AS DOUBLE) FROM canonical) JOIN part ON p_partkey = part WHERE a <> b""",
    ),
    "lineups": ((), "SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, l_suppkey AS team_id, 'P' || (l_partkey % 7) AS player FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "named_ids": ((), r"SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS team_name, doc_id % 50 AS team_id FROM documents"),
    "keyed_names": (("named_ids",), "SELECT team_name, team_id, regexp_replace(lower(strip_accents(team_name)), '[^a-z0-9]+', '', 'g') AS name_key FROM named_ids"),
    "quotes": (
        (),
        """SELECT event_id, user_id % 10 AS fixture_id, user_id, ts AS captured_at, date_trunc('hour', ts) + INTERVAL 90 MINUTE AS start, event_type AS bookmaker, 'ML' AS market_type,
 0.99::DOUBLE + value / 50 AS odds_a, 0.99::DOUBLE + (event_id % 400)::DOUBLE / 100.0::DOUBLE AS odds_b, md5(CAST(event_id AS VARCHAR)) AS snapshot_hash,
 (epoch_us(date_trunc('hour', ts) + INTERVAL 90 MINUTE) - epoch_us(ts)) / 6e7::DOUBLE AS lead_minutes FROM events""",
    ),
    "ledger": (
        (),
        """SELECT 'e' || event_id AS record_id, CASE event_type WHEN 'signup' THEN 'forecast_generated' WHEN 'view' THEN 'market_candidate' WHEN 'click' THEN 'primary_market_selected'
  WHEN 'purchase' THEN 'outcome_attached' WHEN 'error' THEN 'terminal_exclusion' END AS record_type, user_id || ':' || strftime(ts, '%Y-%m-%d') AS match_id, ts AS recorded_at,
 date_trunc('hour', ts) + INTERVAL 90 MINUTE AS scheduled_start, user_id % 100 AS team_a_id, (user_id * 7 + 13) % 100 AS team_b_id,
 0.99::DOUBLE + value / 50 AS odds_a, 0.99::DOUBLE + (event_id % 400)::DOUBLE / 100.0::DOUBLE AS odds_b FROM events""",
    ),
    "old_ledger": (("ledger",), "SELECT * FROM ledger WHERE recorded_at < TIMESTAMP '{NOW}'"),
    "fixtures": (
        ("ledger",),
        """SELECT match_id, any_value(team_a_id) AS team_a_id, any_value(team_b_id) AS team_b_id, max(scheduled_start) + to_hours(CAST(any_value(team_b_id) % 4 AS INTEGER)) AS scheduled_at,
 'team ' || any_value(team_a_id) AS team_a_name, 'team ' || any_value(team_b_id) AS team_b_name FROM ledger GROUP BY match_id""",
    ),
    "active_starts": (("old_ledger",), "SELECT match_id, arg_min(scheduled_start, (recorded_at, record_id)) AS active_start FROM old_ledger GROUP BY match_id"),
    "moved": (("fixtures", "active_starts"), "SELECT * FROM fixtures JOIN active_starts USING (match_id) WHERE abs(epoch_us(scheduled_at) - epoch_us(active_start)) > 3600000000"),
}


def sql(body: str, *needs: str, ks: str = "32.0") -> str:
    """A statement with the common table expressions it needs, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    recursive = "RECURSIVE " if "st" in order else ""
    parts = [f"{n}{'' if n == 'st' else ' AS MATERIALIZED' if n in ('games', 'history', 'canonical') else ' AS'}{' AS' if n == 'st' else ''} ({CTES[n][1]})" for n in order]
    text = (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body
    return text.replace("{KS}", ks).replace("{NOW}", NOW)
