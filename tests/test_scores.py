"""Losses, bins, bootstrap, folds and models."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorday.operators import evaluate as E
from priorday.operators import models as M
from priorday.operators.quantiles import exact_quantiles

D0 = dt.date(2022, 1, 1)


@pytest.fixture(scope="module")
def forecasts(spark):
    rng = random.Random(3)
    rows = [(i, D0 + dt.timedelta(days=rng.randrange(40)), 1 + i % 5, 6 + i % 4, rng.random() < 0.6, rng.random(), i % 7, i % 6, i % 5 == 0) for i in range(120)]
    rows[0] = (0, D0, 1, 6, True, 0.0, 0, 0, False)
    rows[1] = (1, D0, 1, 6, True, 0.1, 0, 0, False)
    return spark.createDataFrame(rows, "match_id long, match_date date, team_a_id long, team_b_id long, team_a_won boolean, probability_a double, team_a_prior long, team_b_prior long, any_team_unseen boolean").cache()


def test_row_losses_add_up_to_the_block(forecasts):
    rows = E.per_row_losses(forecasts).collect()
    block = E.metric_block(forecasts).first()
    assert abs(sum(r.log_loss for r in rows) / len(rows) - block.log_loss) < 1e-9
    assert abs(sum(r.brier for r in rows) / len(rows) - block.brier_score) < 1e-9
    assert block.n_unique_teams == 9


def test_bins_are_right_closed_and_empty_ones_stay(forecasts):
    got = {r.bin: r for r in E.calibration(forecasts.where("match_id < 2")).collect()}
    assert len(got) == 10 and got[0].n == 2 and got[5].n == 0 and got[5].mean_p is None
    assert sum(r.n for r in E.calibration(forecasts).collect()) == 120


def test_slices_keep_empty_ones(forecasts):
    got = {(r.period, r.seen): r.n_matches for r in E.metric_slices(forecasts, ("1990-01-01", "1990-02-01"), "2022-01-01").collect()}
    assert got[("development", "all")] == 0 and got[("all", "all")] == 120 and got[("test", "any_unseen")] + got[("test", "both_seen")] == 120


def test_bootstrap_is_the_same_for_any_partitioning(forecasts):
    losses = E.per_row_losses(forecasts)
    a, b = E.date_bootstrap(losses, draws=50).first(), E.date_bootstrap(losses.repartition(9), draws=50).first()
    assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a, b, strict=True)) and a.p2_5 <= a.mean <= a.p97_5


def test_resample_takes_whole_dates(forecasts):
    per_day = {r.match_date: r.n for r in forecasts.groupBy("match_date").agg(F.count("*").alias("n")).collect()}
    got = E.resample_rows(E.per_row_losses(forecasts), 2).groupBy("i", "match_date").agg(F.count("*").alias("n")).collect()
    assert len(got) == len(per_day) and all(r.n == per_day[r.match_date] for r in got)


FOLDS = [("f1", "2022-01-15", "2022-01-25"), ("f2", "2022-01-25", "2022-03-01")]


def test_folds_train_before_they_evaluate(forecasts):
    got = E.fold_assign(forecasts, FOLDS)
    assert got.where("fold = 'f1' and role = 'train'").agg(F.max("match_date")).first()[0] < dt.date(2022, 1, 15)
    assert got.where("role = 'evaluate'").groupBy("match_id").count().where("count > 1").count() == 0


def test_prep_sees_training_rows_only(spark):
    rows = spark.createDataFrame([("f", "train", 1.0, None), ("f", "train", 3.0, None), ("f", "train", None, None), ("f", "evaluate", 99.0, 5.0)], "fold string, role string, x double, y double")
    got = {r.feature: (r.median, r.mean, r.std) for r in E.prep_stats(rows, ["x", "y"]).collect()}
    assert got["x"][:2] == (2.0, 2.0) and abs(got["x"][2] - math.sqrt(2 / 3)) < 1e-12 and got["y"] == (0.0, 0.0, 1.0)


def test_logistic_meets_its_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1])))
    rows = [(i, D0 + dt.timedelta(days=i // 5), float(a), float(b), bool(w)) for i, ((a, b), w) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "match_id long, match_date date, u double, v double, team_a_won boolean")
    start = D0 + dt.timedelta(days=50)
    out, weights = M.rolling_logistic(df, [("f", str(start), "2023-01-01"), ("none", "2021-01-01", "2021-02-01")], {"m": ("u", "v")})
    w = {r.feature: r.weight for r in weights.collect()}
    train = x[:250]
    z = (train - train.mean(0)) / train.std(0)
    coef = np.array([w["u"], w["v"]])
    p = 1 / (1 + np.exp(-(z @ coef + w["intercept"])))
    assert np.abs(coef + z.T @ (p - y[:250])).max() < 1e-6 and abs((p - y[:250]).sum()) < 1e-6
    assert out.count() == 50 and out.where("m is null").count() == 0
    late = (x[250:] - train.mean(0)) / train.std(0)
    for r in out.collect():
        assert abs(r.m - 1 / (1 + math.exp(-(late[r.match_id - 250] @ coef + w["intercept"])))) < 1e-9


def test_fits_share_their_jobs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x[:, 1] *= 50
    y = x[:, 0] + 0.02 * x[:, 1] > 0  # classes that a line separates: only the penalty bounds the weights
    rows = [(i, D0 + dt.timedelta(days=i // 4), *(None if rng.random() < 0.1 else float(v) for v in r), bool(w)) for i, (r, w) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "match_id long, match_date date, u double, v double, w double, team_a_won boolean").repartition(3)
    jobs, real = [], M._sums
    monkeypatch.setattr(M, "_sums", lambda *a: jobs.append(len(a[2])) or real(*a))
    folds = [(f"f{i}", str(D0 + dt.timedelta(days=20 * i)), str(D0 + dt.timedelta(days=20 * i + 20))) for i in range(5)]  # the first has no training rows
    sets = {"one": ("u",), "two": ("v", "u"), "all": ("u", "v", "w"), "none": ()}
    got = {(r.fold, r.model): r for r in M.fit_gradients(df, folds, sets).collect()}
    assert set(got) == {(f, m) for f, _, _ in folds[1:] for m in sets} and all(r.gradient < 1e-8 for r in got.values())
    assert len(jobs) <= 20 and set(jobs) == {16} and got["f2", "all"].n_train == 160
    out, _ = M.rolling_logistic(df, folds, sets)
    assert out.count() == 400 and out.where("fold = 'f0'").where("one is null and `all` is null").count() == 80 and out.where("fold <> 'f0'").where("two is null").count() == 0


def test_bins_are_those_of_their_edges(spark):
    values = [0.0, 0.1, 0.2, 0.30000000000000004, 0.3, 0.5, 0.6, 0.7000000000000001, 0.7, 0.8, 0.9, 1.0, 0.15, 0.95, 1e-300]
    rows = [(p, b) for p in values for b in range(10) if (p > 0.0 + b * 0.1 or b == 0) and p <= 0.0 + (b + 1) * 0.1]
    df = spark.createDataFrame([(p,) for p in values], "p double")
    assert sorted((r.p, r.bin) for r in E._binned(df, F.col("p"), 10, 0.0, 0.1).collect()) == sorted(rows)


def test_slices_of_years_and_both_losses(spark):
    rows = [(1, dt.date(2022, 5, 1), 1, 2, True, 0.7, False), (2, dt.date(2023, 5, 1), 2, 3, False, 0.6, True), (3, dt.date(2024, 5, 1), 4, 5, True, 0.5, False)]
    f = spark.createDataFrame(rows, "match_id long, match_date date, team_a_id long, team_b_id long, team_a_won boolean, probability_a double, any_team_unseen boolean")
    got = {(r.slice, r.seen): (r.n_matches, r.n_unique_teams) for r in E.yearly_slices(f, ("2022-01-01", "2023-12-31"), "2024-01-01").collect()}
    assert len(got) == 18 and got["2022", "all"] == (1, 2) and got["development", "all"] == (2, 3) and got["development", "any_unseen"] == (1, 2) and got["test", "any_unseen"] == (0, 0) and got["all", "all"] == (3, 5)
    b = {r.loss: r for r in E.bootstrap_losses(E.per_row_losses(f), draws=50).collect()}
    assert b["delta_brier"].n_dates == 3 and b["delta_brier"].n_draws == 50 and abs(b["delta_brier"].observed - ((0.09 + 0.36 + 0.25) / 3 - 0.25)) < 1e-12
    assert abs(b["delta_log_loss"].mean - E.date_bootstrap(E.per_row_losses(f), draws=50).first().mean) < 1e-12
    m = {(r.model, r.bin): r.n for r in E.model_calibration(f.withColumn("q", F.lit(1.0)), ["probability_a", "q"]).collect()}
    assert m == {("probability_a", 0): 2, ("probability_a", 1): 1, ("probability_a", 2): 0, ("probability_a", 3): 0, ("probability_a", 4): 0} | {("q", b): 3 * (b == 4) for b in range(5)}


@pytest.mark.parametrize("leaf", [1, 7, 10_000])
def test_quantiles_are_exact(spark, leaf):
    rng = random.Random(leaf)
    values = {
        "even": [rng.random() for _ in range(501)], "ties": [rng.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(300)], "one": [5.0], "two": [1.0, 2.0],
        "steep": [(-1.0) ** k * 2.0 ** (3 * k) for k in range(-60, 60)], "wide": [-1.7e308, 1.7e308, 0.0, -0.0, 1e-300], None: [float(k) for k in range(40)], "none": [],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("none", None), ("none", float("nan")), ("even", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.q): r.value for r in exact_quantiles(df, ["g"], "v", qs, leaf).collect()}
    assert set(got) == {(g, q) for g, vs in values.items() if vs for q in qs}
    for (g, q), x in got.items():
        vs = sorted(values[g])
        at = q * (len(vs) - 1)
        lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
        want = lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi
        assert x == want, (g, q)


def test_prep_stats_makes_its_rows_once(spark, small):
    """What the rounds of the quantiles and the moments read is a written table, not the contests anew."""
    from priorday.plans import score_queries

    plan = score_queries.prep_stats(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "match_date" in plan
