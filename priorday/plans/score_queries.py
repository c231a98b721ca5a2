"""Queries over forecasts: losses, slices, calibration, bootstrap, folds, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorday.operators import evaluate as E
from priorday.operators import features as X
from priorday.operators import models as M
from priorday.sources.shared import forget, written

from .base import DEVELOPMENT, FOLDS, GRID, TEST_FROM, query, sql
from .match_queries import canonical, history, pooled, r6

_BLOCK = "count(*) AS n_matches, round(avg(log_loss), 6) AS log_loss, round(avg(brier), 6) AS brier_score, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(CAST(team_a_won AS DOUBLE)), 6) AS team_a_rate, round(avg(CAST(any_team_unseen AS DOUBLE)), 6) AS pct_any_team_unseen, round(avg(confidence), 6) AS average_confidence"
_ROUNDED = ("log_loss", "brier_score", "accuracy", "team_a_rate", "pct_any_team_unseen", "average_confidence")
_TEST = f"match_date >= DATE '{TEST_FROM}'"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c in _ROUNDED})


def test_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).where(F.col("match_date") >= F.to_date(F.lit(TEST_FROM)))


@query("per_row_losses", sql("SELECT match_id, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(log_loss - ln(2), 6) AS delta_log_loss, round(brier - 0.25, 6) AS delta_brier, correct, round(confidence, 6) AS confidence FROM losses", "losses"))
def per_row_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_row_losses(history(spark, sf_dir)).select("match_id", *r6("log_loss", "brier", "delta_log_loss", "delta_brier"), "correct", *r6("confidence"))


@query("metric_block", sql(f"SELECT {_BLOCK}, 0.6931471805599453::DOUBLE AS fifty_fifty_log_loss, 0.25::DOUBLE AS fifty_fifty_brier, (SELECT count(DISTINCT t) FROM (SELECT unnest([team_a_id, team_b_id]) AS t FROM losses)) AS n_unique_teams FROM losses", "losses"))
def metric_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.metric_block(history(spark, sf_dir)))


def _after(text: str) -> str:
    """Append further common table expressions that start the body of a statement made by `sql`."""
    return text.replace("\n, ", ",\n", 1)


_SLICE = f"CASE WHEN match_date BETWEEN DATE '{DEVELOPMENT[0]}' AND DATE '{DEVELOPMENT[1]}' THEN 'development' WHEN {_TEST} THEN 'test' ELSE 'other' END"


@query(
    "metric_slices",
    sql(
        f"""SELECT w.period, w.seen, coalesce(n_matches, 0) AS n_matches, log_loss, brier_score, accuracy, team_a_rate, pct_any_team_unseen, average_confidence
FROM (SELECT * FROM (SELECT unnest(['all', 'development', 'test']) AS period), (SELECT unnest(['all', 'any_unseen', 'both_seen']) AS seen)) w
LEFT JOIN (SELECT coalesce(period, 'all') AS period, coalesce(seen, 'all') AS seen, {_BLOCK} FROM (SELECT *, {_SLICE} AS period, CASE WHEN any_team_unseen THEN 'any_unseen' ELSE 'both_seen' END AS seen FROM losses) GROUP BY CUBE (period, seen)) m
ON m.period = w.period AND m.seen = w.seen""",
        "losses",
    ),
)
def metric_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.metric_slices(history(spark, sf_dir), DEVELOPMENT, TEST_FROM))


@query(
    "calibration",
    sql(
        f"""SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, observed FROM range(10) t(b) LEFT JOIN (
 SELECT b2, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(team_a_won AS DOUBLE)), 6) AS observed FROM history, (SELECT range AS b2 FROM range(10))
 WHERE {_TEST} AND (p > 0.0::DOUBLE + b2 * 0.1::DOUBLE OR b2 = 0) AND p <= 0.0::DOUBLE + (b2 + 1) * 0.1::DOUBLE GROUP BY b2) ON b2 = b""",
        "history",
    ),
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration(test_period(spark, sf_dir)).select("bin", "n", *r6("mean_p", "observed"))


@query(
    "favorite_calibration",
    sql(
        f"""SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, observed, gap FROM range(5) t(b) LEFT JOIN (
 SELECT b2, count(*) AS n, round(avg(confidence), 6) AS mean_p, round(avg(CAST(correct AS DOUBLE)), 6) AS observed, round(avg(CAST(correct AS DOUBLE)) - avg(confidence), 6) AS gap FROM losses, (SELECT range AS b2 FROM range(5))
 WHERE {_TEST} AND (confidence > 0.5::DOUBLE + b2 * 0.1::DOUBLE OR b2 = 0) AND confidence <= 0.5::DOUBLE + (b2 + 1) * 0.1::DOUBLE GROUP BY b2) ON b2 = b""",
        "losses",
    ),
)
def favorite_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.favorite_calibration(test_period(spark, sf_dir)).select("bin", "n", *r6("mean_p", "observed", "gap"))


_SLICES = """SELECT w.slice, w.seen, coalesce(n_matches, 0) AS n_matches, log_loss, brier_score, accuracy, team_a_rate, pct_any_team_unseen, average_confidence, coalesce(n_unique_teams, 0) AS n_unique_teams
FROM (SELECT * FROM (SELECT unnest(['all', 'development', 'test']) AS slice UNION SELECT CAST(year AS VARCHAR) FROM losses), (SELECT unnest(['all', 'any_unseen', 'both_seen']) AS seen)) w LEFT JOIN (
 SELECT slice, seen, {BLOCK} FROM labelled GROUP BY ALL) m ON m.slice = w.slice AND m.seen = w.seen
LEFT JOIN (SELECT slice, seen, count(DISTINCT t) AS n_unique_teams FROM (SELECT slice, seen, unnest([team_a_id, team_b_id]) AS t FROM labelled) GROUP BY ALL) u ON u.slice = w.slice AND u.seen = w.seen""".replace("{BLOCK}", _BLOCK)


@query(
    "yearly_slices",
    _after(
        sql(
            f""", labelled AS (SELECT * FROM (SELECT *, unnest(['all', CAST(year AS VARCHAR), {_SLICE}]) AS slice FROM (
 SELECT *, unnest(['all', CASE WHEN any_team_unseen THEN 'any_unseen' ELSE 'both_seen' END]) AS seen FROM losses)) WHERE slice <> 'other')
{_SLICES}""",
            "losses",
        )
    ),
)
def yearly_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.yearly_slices(history(spark, sf_dir), DEVELOPMENT, TEST_FROM))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test period's matches with the forecast of every K beside each other."""
    h = history(spark, sf_dir, GRID).where(F.col("match_date") >= F.to_date(F.lit(TEST_FROM)))
    return h.groupBy("match_id", "match_date", "team_a_won").agg(*(F.max(F.when(F.col("k") == k, F.col("probability_a"))).alias(f"k{k:.0f}") for k in GRID))


@query(
    "model_calibration",
    sql(
        f"""SELECT w.model, CAST(w.b AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, observed, gap FROM (SELECT * FROM (SELECT unnest(['k16', 'k32', 'k64']) AS model), range(5) t(b)) w LEFT JOIN (
 SELECT 'k' || CAST(k AS INTEGER) AS model, b2, count(*) AS n, round(avg(confidence), 6) AS mean_p, round(avg(CAST(correct AS DOUBLE)), 6) AS observed, round(avg(CAST(correct AS DOUBLE)) - avg(confidence), 6) AS gap FROM losses, (SELECT range AS b2 FROM range(5))
 WHERE {_TEST} AND (confidence > 0.5::DOUBLE + b2 * 0.1::DOUBLE OR b2 = 0) AND confidence <= 0.5::DOUBLE + (b2 + 1) * 0.1::DOUBLE GROUP BY ALL) m ON m.model = w.model AND m.b2 = w.b""",
        "losses",
        ks="16.0, 32.0, 64.0",
    ),
)
def model_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.model_calibration(_wide(spark, sf_dir), [f"k{k:.0f}" for k in GRID]).select("model", "bin", "n", *r6("mean_p", "observed", "gap"))


@query("month_segments", sql(f"SELECT strftime(match_date, '%Y-%m') AS month, {_BLOCK} FROM losses WHERE {_TEST} GROUP BY 1", "losses"))
def month_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.loss_table(test_period(spark, sf_dir), F.date_format("match_date", "yyyy-MM"), "month"))


@query("year_table", sql(f"SELECT year, {_BLOCK} FROM losses GROUP BY 1", "losses"))
def year_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.loss_table(history(spark, sf_dir), F.year("match_date"), "year"))


@query("seen_table", sql(f"SELECT CASE WHEN any_team_unseen THEN 'any_unseen' ELSE 'both_seen' END AS seen, {_BLOCK} FROM losses GROUP BY 1", "losses"))
def seen_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.loss_table(history(spark, sf_dir), F.when(F.col("any_team_unseen"), "any_unseen").otherwise("both_seen"), "seen"))


@query(
    "experience_buckets",
    sql(
        f"""SELECT w.bucket, coalesce(n_matches, 0) AS n_matches, log_loss, brier_score, accuracy, team_a_rate, pct_any_team_unseen, average_confidence FROM (SELECT unnest(['0', '1-4', '5-19', '20+']) AS bucket) w
LEFT JOIN (SELECT CASE WHEN least(team_a_prior, team_b_prior) = 0 THEN '0' WHEN least(team_a_prior, team_b_prior) < 5 THEN '1-4' WHEN least(team_a_prior, team_b_prior) < 20 THEN '5-19' ELSE '20+' END AS bucket, {_BLOCK} FROM losses GROUP BY 1) m USING (bucket)""",
        "losses",
    ),
)
def experience_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.experience_buckets(history(spark, sf_dir)))


_DRAWS = E.DRAWS


def _boot_sql(value: str, source: str) -> str:
    return f"""daily AS (SELECT match_date, sum({value}) AS total, count(*) AS n, row_number() OVER (ORDER BY match_date) - 1 AS place FROM {source} WHERE {_TEST} GROUP BY match_date),
draws AS (SELECT r, i, CAST('0x' || substr(md5('{E.SEED}:' || r || ':' || i), 1, 8) AS BIGINT) % (SELECT count(*) FROM daily) AS place FROM range({_DRAWS}) a(r), range((SELECT count(*) FROM daily)) b(i)),
means AS (SELECT r, sum(total) / sum(n) AS m FROM draws JOIN daily USING (place) GROUP BY r)
"""


_BOOT_OUT = "SELECT count(*) AS n_draws, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS p2_5, round(quantile_cont(m, 0.975), 6) AS p97_5, round(avg(CAST(m < 0 AS DOUBLE)), 6) AS share_below_zero FROM means"


@query("date_bootstrap", _after(sql(", " + _boot_sql("log_loss - ln(2)", "losses") + _BOOT_OUT, "losses")))
def date_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.date_bootstrap(E.per_row_losses(test_period(spark, sf_dir)), draws=_DRAWS)
    return b.select("n_draws", *r6("mean", "p2_5", "p97_5", "share_below_zero"))


def _boots_sql(log_loss: str, brier: str, source: str) -> str:
    """Both losses of the same draws, with their observed means."""
    out = lambda name, v: f"SELECT '{name}' AS loss, (SELECT count(*) FROM daily) AS n_dates, round((SELECT sum({v}) / sum(n) FROM daily), 6) AS observed, count(*) AS n_draws, round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.025), 6) AS p2_5, round(quantile_cont({v}, 0.975), 6) AS p97_5, round(avg(CAST({v} < 0 AS DOUBLE)), 6) AS share_below_zero FROM means"
    return f""", daily AS (SELECT match_date, sum({log_loss}) AS x, sum({brier}) AS y, count(*) AS n, row_number() OVER (ORDER BY match_date) - 1 AS place FROM {source} WHERE {_TEST} GROUP BY match_date),
draws AS (SELECT r, i, CAST('0x' || substr(md5('{E.SEED}:' || r || ':' || i), 1, 8) AS BIGINT) % (SELECT count(*) FROM daily) AS place FROM range({_DRAWS}) a(r), range((SELECT count(*) FROM daily)) b(i)),
means AS MATERIALIZED (SELECT r, sum(x) / sum(n) AS x, sum(y) / sum(n) AS y FROM draws JOIN daily USING (place) GROUP BY r)
""" + out("delta_log_loss", "x") + " UNION ALL " + out("delta_brier", "y")


_SPREAD = ("observed", "mean", "p2_5", "p97_5", "share_below_zero")


@query("bootstrap_losses", _after(sql(_boots_sql("log_loss - ln(2)", "brier - 0.25", "losses"), "losses")))
def bootstrap_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.bootstrap_losses(E.per_row_losses(test_period(spark, sf_dir)), draws=_DRAWS)
    return b.select("loss", "n_dates", "n_draws", *r6(*_SPREAD))


@query("paired_losses", _after(sql(", gaps AS (SELECT a.match_date, a.log_loss - b.log_loss AS x0, a.brier - b.brier AS y0 FROM losses a JOIN losses b USING (match_id) WHERE a.k = 64 AND b.k = 16)" + _boots_sql("x0", "y0", "gaps"), "losses", ks="16.0, 64.0")))
def paired_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.paired_losses(_wide(spark, sf_dir), "k64", "k16", _DRAWS).select("loss", "n_dates", "n_draws", *r6(*_SPREAD))


@query("resample_rows", _after(sql(", " + _boot_sql("log_loss", "losses") + "SELECT match_id, i, match_date, round(log_loss, 6) AS log_loss FROM losses JOIN daily USING (match_date) JOIN draws USING (place) WHERE r = 3", "losses")))
def resample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.resample_rows(E.per_row_losses(test_period(spark, sf_dir)), 3)
    return x.select("match_id", "i", "match_date", *r6("log_loss"))


@query("paired_delta", _after(sql(", gaps AS (SELECT a.match_date, a.log_loss - b.log_loss AS gap FROM losses a JOIN losses b USING (match_id) WHERE a.k = 64 AND b.k = 16), " + _boot_sql("gap", "gaps") + _BOOT_OUT, "losses", ks="16.0, 64.0")))
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir, (16.0, 64.0)).where(F.col("match_date") >= F.to_date(F.lit(TEST_FROM)))
    wide = h.groupBy("match_id", "match_date", "team_a_won").agg(F.max(F.when(F.col("k") == 64, F.col("probability_a"))).alias("p64"), F.max(F.when(F.col("k") == 16, F.col("probability_a"))).alias("p16"))
    return E.paired_delta(wide, "p64", "p16", draws=_DRAWS).select("n_draws", *r6("mean", "p2_5", "p97_5", "share_below_zero"))


_FOLD_SQL = "(" + " UNION ALL ".join(f"SELECT '{n}' AS fold, DATE '{s}' AS s, DATE '{e}' AS e" for n, s, e in FOLDS) + ") f"


@query("fold_assign", sql(f"SELECT match_id, match_date, fold, CASE WHEN match_date < s THEN 'train' ELSE 'evaluate' END AS role FROM canonical JOIN {_FOLD_SQL} ON match_date < e", "canonical"))
def fold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fold_assign(canonical(spark, sf_dir).select("match_id", "match_date"), FOLDS)


_FEATURES = ("prior_match_count_diff", "days_since_last_match_diff")


@query(
    "prep_stats",
    _after(
        sql(
            f""", gaps AS (SELECT team_id, match_date, date_diff('day', lag(match_date) OVER (PARTITION BY team_id ORDER BY match_date), match_date) AS g FROM day_counts),
x AS (SELECT fold, CAST(pa.n_prior - pb.n_prior AS DOUBLE) AS prior_match_count_diff, CAST(ga.g - gb.g AS DOUBLE) AS days_since_last_match_diff FROM canonical c
 JOIN priors pa ON pa.team_id = team_a_id AND pa.match_date = c.match_date JOIN priors pb ON pb.team_id = team_b_id AND pb.match_date = c.match_date
 JOIN gaps ga ON ga.team_id = team_a_id AND ga.match_date = c.match_date JOIN gaps gb ON gb.team_id = team_b_id AND gb.match_date = c.match_date JOIN {_FOLD_SQL} ON c.match_date < s),
long AS (SELECT fold, 'prior_match_count_diff' AS feature, prior_match_count_diff AS v FROM x UNION ALL SELECT fold, 'days_since_last_match_diff', days_since_last_match_diff FROM x),
med AS (SELECT fold, feature, coalesce(quantile_cont(v, 0.5), 0) AS median FROM long GROUP BY ALL)
SELECT fold, feature, median, round(avg(coalesce(v, median)), 6) AS mean, round(CASE WHEN stddev_pop(coalesce(v, median)) > 0 THEN stddev_pop(coalesce(v, median)) ELSE 1 END, 6) AS std FROM long JOIN med USING (fold, feature) GROUP BY fold, feature, median""",
            "canonical",
            "priors",
        )
    ),
)
def prep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both are read in every round of the quantiles, and made once
    c = written(canonical(spark, sf_dir).select("match_id", "match_date", "team_a_id", "team_b_id", "team_a_won"), "prep-matches")
    x = X.both_sides(c, X.team_days(X.team_long(c)), ["n_prior", "days_since"])
    rows = written(x.select("match_id", "match_date", *((F.col(f"{v}_a") - F.col(f"{v}_b")).alias(f) for f, v in zip(_FEATURES, ("n_prior", "days_since"), strict=True))), "prep-rows")
    forget(c)
    return E.prep_stats(E.fold_assign(rows, FOLDS), _FEATURES).select("fold", "feature", "median", *r6("mean", "std"))


FEATURE_SETS = {"rating_only": ("elo_diff",), "rating_recent": ("elo_diff", "last_5_win_rate_diff", "last_10_win_rate_diff"), "full": X.HISTORY_FEATURES}


@query("rolling_logistic")
def rolling_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = M.rolling_logistic(X.feature_table(pooled(spark, sf_dir), pool="pool"), FOLDS, FEATURE_SETS)
    return out.select("match_id", "match_date", "fold", "team_a_won", *(F.round(m, 5).alias(m) for m in FEATURE_SETS))


_STARTS = ", ".join(f"('{n}', DATE '{a}')" for n, a, _ in FOLDS)
_MODELS = ", ".join(f"('{m}')" for m in FEATURE_SETS)


@query("logistic_optimum", sql(f"SELECT fold, model, count(*) AS n_train, true AS optimal FROM canonical, (VALUES {_STARTS}) f(fold, s), (VALUES {_MODELS}) m(model) WHERE match_date < s GROUP BY fold, model", "canonical"))
def logistic_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fold's fits with their training rows, and whether the slope of the penalised loss is zero there."""
    g = M.fit_gradients(X.feature_table(pooled(spark, sf_dir), pool="pool"), FOLDS, FEATURE_SETS)
    return g.select("fold", "model", "n_train", (F.col("gradient") < 1e-5).alias("optimal"))


@query(
    "oof_metrics",
    _after(
        sql(
            f""", oof AS (SELECT 'k' || CAST(CAST(k AS INTEGER) AS VARCHAR) AS model, fold, l.* FROM losses l JOIN {_FOLD_SQL} ON match_date >= s AND match_date < e)
SELECT model, fold, {_BLOCK} FROM oof GROUP BY model, fold UNION ALL SELECT model, 'all', {_BLOCK} FROM oof GROUP BY model""",
            "losses",
            ks="16.0, 32.0, 64.0",
        )
    ),
)
def oof_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir, GRID)
    wide = h.groupBy("match_id", "match_date", "team_a_won", "any_team_unseen").agg(*(F.max(F.when(F.col("k") == k, F.col("probability_a"))).alias(f"k{int(k)}") for k in GRID))
    rows = E.fold_assign(wide, FOLDS).where("role = 'evaluate'")
    return rounded(E.oof_metrics(rows, [f"k{int(k)}" for k in GRID]))
