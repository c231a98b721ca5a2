"""Rolling-origin logistic models over prior-date features: all folds and feature sets fitted together.

Every fit is a small vector of weights that the driver keeps. A Newton step reads
the training rows once: each task adds up slopes and curvatures of every fit over
its rows, batch by batch, and the sums are grouped by fit and entry. So a step is
one job, and the number of jobs is that of the steps (under ten as a rule),
whatever the number of folds and feature sets. What comes back is a square of
numbers for each fit."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorday.sources.shared import written

from .evaluate import fold_assign, prep_stats

C = 1.0
TOLERANCE = 1e-9  # largest slope of the penalised mean loss at which a fit is done
STEPS = 60


@dataclass
class Fit:
    """One fold and feature set: where its features stand, how they are scaled, and its weights, the intercept last."""

    fold: str
    model: str
    features: list[str]
    start: date
    columns: np.ndarray
    median: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    n: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    gradient: float = np.inf

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """The fit's features of raw rows, imputed and scaled, with a constant 1."""
        x = x[:, self.columns]
        x = (np.where(np.isnan(x), self.median, x) - self.mean) / self.std
        return np.column_stack([x, np.ones(len(x))])


def _sums(rows: DataFrame, wanted: Sequence[str], fits: Sequence[Fit], points: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Of every fit, over its training rows at the weights given: summed loss, slope and curvature. One job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(w) + 1, len(w) + 1)) for w in points]  # curvature, with the slope and the loss at its edge
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in wanted]) if wanted else np.zeros((batch.num_rows, 0))
            y = batch.column("team_a_won").cast(pa.int8()).to_numpy(zero_copy_only=False).astype(float)
            day = batch.column("match_date").cast(pa.int32()).to_numpy()
            for fit, w, sums in zip(fits, points, total, strict=True):
                mine = day < (fit.start - date(1970, 1, 1)).days
                z, won = fit.scaled(x[mine]), y[mine]
                at = z @ w
                p = 1 / (1 + np.exp(-np.clip(at, -700, 700)))
                sums[:-1, :-1] += (z * (p * (1 - p))[:, None]).T @ z
                sums[:-1, -1] += z.T @ (p - won)
                sums[-1, -1] += (np.logaddexp(0, at) - won * at).sum()
        fit_of = np.repeat(np.arange(len(total)), [s.size for s in total])
        entry = np.concatenate([np.arange(s.size) for s in total])
        yield pa.RecordBatch.from_arrays([pa.array(fit_of, pa.int32()), pa.array(entry, pa.int32()), pa.array(np.concatenate([s.ravel() for s in total]))], names=["fit", "entry", "value"])

    made = rows.select("match_date", "team_a_won", *(F.col(f).cast("double").alias(f) for f in wanted)).mapInArrow(run, "fit int, entry int, value double").groupBy("fit", "entry").agg(F.sum("value").alias("value")).collect()
    out = []
    for i, w in enumerate(points):
        sums = np.zeros((len(w) + 1) ** 2)
        for r in made:
            if r.fit == i:
                sums[r.entry] = r.value
        sums = sums.reshape(len(w) + 1, -1)
        out.append((sums[-1, -1], sums[:-1, -1], sums[:-1, :-1]))
    return out


def fitted(rows: DataFrame, wanted: Sequence[str], fits: Sequence[Fit], c: float = C, steps: int = STEPS) -> int:
    """Bring every fit to the optimum of mean loss plus |w|^2 / (2 C n), the intercept free; the number of jobs taken.

    Newton's steps, halved for a fit whose loss they would raise."""
    fits = [f for f in fits if f.n]
    points = [np.zeros(len(f.features) + 1) for f in fits]
    best: list[tuple | None] = [None] * len(fits)  # loss, weights, step of the best point so far
    for done in range(1, steps + 1):
        if not fits:
            return done - 1
        for i, (fit, w, (loss, slope, curve)) in enumerate(zip(fits, points, _sums(rows, wanted, fits, points), strict=True)):
            penalty = np.append(np.full(len(w) - 1, 1 / (c * fit.n)), 0.0)
            loss = loss / fit.n + (penalty * w * w).sum() / 2
            slope = slope / fit.n + penalty * w
            if best[i] is None or loss <= best[i][0] + 1e-14 * abs(best[i][0]):
                step = np.linalg.lstsq(curve / fit.n + np.diag(penalty), -slope, rcond=None)[0]
                best[i] = (loss, w, step)
                fit.weights, fit.gradient = w, float(np.abs(slope).max())
            else:
                best[i] = (best[i][0], best[i][1], best[i][2] / 2)
            points[i] = best[i][1] + best[i][2]
        if all(f.gradient < TOLERANCE for f in fits):
            return done
    return steps


def _fits(rows: DataFrame, folds: Sequence[tuple[str, str, str]], feature_sets: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame, list[str], list[Fit]]:
    """(rows as a table, rows by fold and role, all features, the fits); a fit without both classes has n = 0."""
    wanted = sorted({f for fs in feature_sets.values() for f in fs})
    table = written(rows.select("match_id", "match_date", "team_a_won", *wanted), "model-rows")
    assigned = fold_assign(table, folds)
    stats = {(s.fold, s.feature): s for s in prep_stats(assigned, wanted).collect()}  # folds x features
    train = assigned.where("role = 'train'").groupBy("fold").agg(F.count("team_a_won").alias("n"), F.count_if("team_a_won").alias("wins")).collect()
    sizes = {r.fold: r.n for r in train if 0 < r.wins < r.n}
    fits = []
    for name, start, _ in folds:
        for label, features in feature_sets.items():
            if all((name, f) in stats for f in features):
                mine = [stats[name, f] for f in features]
                fits.append(Fit(name, label, list(features), date.fromisoformat(start), np.array([wanted.index(f) for f in features], int), *(np.array([getattr(s, k) for s in mine], float) for k in ("median", "mean", "std")), sizes.get(name, 0)))
    return table, assigned, wanted, fits


def rolling_logistic(rows: DataFrame, folds: Sequence[tuple[str, str, str]], feature_sets: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold probabilities (one row per evaluated match, a column per feature set) and coefficients.

    A fold with one class, or without training rows, has null probabilities. Rows meet their fold's weights in a join
    with one row a fold."""
    spark = rows.sparkSession
    table, assigned, wanted, fits = _fits(rows, folds, feature_sets)
    known = table.where("team_a_won is not null")
    fitted(known, wanted, fits)
    done = {(f.fold, f.model): f for f in fits if f.n}
    coefficients = [(f.fold, f.model, name, float(w)) for f in done.values() for name, w in zip([*f.features, "intercept"], f.weights, strict=True)]
    columns = ["fold string"] + [f"_{k}_{i} array<double>" for i in range(len(feature_sets)) for k in ("w", "median", "mean", "std")]
    values = [(name, *(v.tolist() if fit is not None else None for label in feature_sets for fit in [done.get((name, label))] for v in ((fit.weights, fit.median, fit.mean, fit.std) if fit else (None,) * 4))) for name, _, _ in folds]
    scored = assigned.where("role = 'evaluate'").join(F.broadcast(spark.createDataFrame(values, ", ".join(columns))), "fold")
    for i, (label, features) in enumerate(feature_sets.items()):
        part = lambda k, j, i=i: F.col(f"_{k}_{i}")[j]
        at = part("w", len(features))
        for j, f in enumerate(features):
            at = at + part("w", j) * (F.coalesce(F.col(f).cast("double"), part("median", j)) - part("mean", j)) / part("std", j)
        scored = scored.withColumn(label, 1 / (1 + F.exp(-at)))
    out = scored.select(*assigned.columns, *feature_sets)
    return out, spark.createDataFrame(coefficients, "fold string, model string, feature string, weight double")


def fit_gradients(rows: DataFrame, folds: Sequence[tuple[str, str, str]], feature_sets: Mapping[str, Sequence[str]], c: float = C) -> DataFrame:
    """(fold, model, n_train, gradient): the largest slope of the penalised mean loss at each fit, zero at its optimum."""
    table, _, wanted, fits = _fits(rows, folds, feature_sets)
    fitted(table.where("team_a_won is not null"), wanted, fits, c)
    return rows.sparkSession.createDataFrame([(f.fold, f.model, f.n, f.gradient) for f in fits if f.n], "fold string, model string, n_train long, gradient double")
