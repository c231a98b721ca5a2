"""Scoring of probability forecasts: losses, slices, calibration, date bootstrap, folds.

Forecasts are rows (match_id, match_date, team_a_id, team_b_id, team_a_won,
probability_a), with any_team_unseen where slices need it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorday.functions.scalars import brier, confidence, correct, log_loss

from .quantiles import exact_quantiles

# Resamples and their seed.
DRAWS, SEED = 10_000, 20260724


def per_row_losses(forecasts: DataFrame, p: str = "probability_a") -> DataFrame:
    """Forecasts with losses, their gaps to a 50/50 forecast, and confidence."""
    q, won = F.col(p), F.col("team_a_won")
    return forecasts.withColumns(
        {"log_loss": log_loss(q, won), "brier": brier(q, won), "delta_log_loss": log_loss(q, won) - F.ln(F.lit(2.0)), "delta_brier": brier(q, won) - 0.25, "correct": correct(q, won), "confidence": confidence(q)}
    )


def _block() -> list[Column]:
    p, won = F.col("probability_a"), F.col("team_a_won")
    return [
        F.count("match_id").alias("n_matches"),
        F.avg(log_loss(p, won)).alias("log_loss"),
        F.avg(brier(p, won)).alias("brier_score"),
        F.avg(correct(p, won).cast("double")).alias("accuracy"),
        F.avg(won.cast("double")).alias("team_a_rate"),
        F.avg(F.col("any_team_unseen").cast("double")).alias("pct_any_team_unseen"),
        F.avg(confidence(p)).alias("average_confidence"),
    ]


def metric_block(forecasts: DataFrame) -> DataFrame:
    """One row: counts, distinct teams, losses beside those of 50/50, unseen share, confidence."""
    teams = forecasts.select(F.explode(F.array("team_a_id", "team_b_id")).alias("t")).agg(F.count_distinct("t").alias("n_unique_teams"))
    return forecasts.agg(*_block(), F.lit(0.6931471805599453).alias("fifty_fifty_log_loss"), F.lit(0.25).alias("fifty_fifty_brier")).crossJoin(teams)


def periods(day: Column, development: tuple[str, str], test_from: str) -> Column:
    return F.when(day.between(F.to_date(F.lit(development[0])), F.to_date(F.lit(development[1]))), "development").when(day >= F.to_date(F.lit(test_from)), "test")


def metric_slices(forecasts: DataFrame, development: tuple[str, str], test_from: str) -> DataFrame:
    """Metric blocks by period, by seen group and by both, in one aggregation; empty slices stay with n = 0."""
    x = forecasts.withColumn("period", F.coalesce(periods(F.col("match_date"), development, test_from), F.lit("other"))).withColumn("seen", F.when(F.col("any_team_unseen"), "any_unseen").otherwise("both_seen"))
    made = x.cube("period", "seen").agg(*_block(), F.grouping("period").alias("gp"), F.grouping("seen").alias("gs"))
    made = made.select(F.when(F.col("gp") == 1, "all").otherwise(F.col("period")).alias("period"), F.when(F.col("gs") == 1, "all").otherwise(F.col("seen")).alias("seen"), *[c for c in made.columns if c not in ("period", "seen", "gp", "gs")])
    spark = forecasts.sparkSession
    wanted = spark.createDataFrame([(p, s) for p in ("all", "development", "test") for s in ("all", "any_unseen", "both_seen")], "period string, seen string")
    return F.broadcast(wanted).join(made, ["period", "seen"], "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def yearly_slices(forecasts: DataFrame, development: tuple[str, str], test_from: str) -> DataFrame:
    """Metric blocks with distinct teams for every year, both periods and all, by seen group; empty slices stay with n = 0.

    A row counts in at most six slices, which are summed and counted together."""
    day = F.col("match_date")
    labels = F.array_compact(F.array(F.lit("all"), F.date_format(day, "yyyy"), periods(day, development, test_from)))
    x = forecasts.select("*", F.explode(labels).alias("slice")).select("*", F.explode(F.array(F.lit("all"), F.when(F.col("any_team_unseen"), "any_unseen").otherwise("both_seen"))).alias("seen"))
    made = x.groupBy("slice", "seen").agg(*_block())
    teams = x.select("slice", "seen", F.explode(F.array("team_a_id", "team_b_id")).alias("t")).groupBy("slice", "seen").agg(F.count_distinct("t").alias("n_unique_teams"))
    names = forecasts.sparkSession.createDataFrame([(x,) for x in ("all", "development", "test")], "slice string")
    slices = names.unionByName(forecasts.select(F.date_format(day, "yyyy").alias("slice"))).distinct()
    wanted = slices.select("slice", F.explode(F.array(*map(F.lit, ("all", "any_unseen", "both_seen")))).alias("seen"))
    full = wanted.join(made, ["slice", "seen"], "left").join(teams, ["slice", "seen"], "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_matches", "n_unique_teams")})


def _bins(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("bin"))


def _binned(rows: DataFrame, value: Column, n: int, low: float, width: float) -> DataFrame:
    """Rows with `_v` and their right-closed bin, values outside dropped; the lowest bound itself falls into the first bin.

    The bin is computed and then held against its own edges, low + bin * width, so no join is needed."""
    edge = lambda i: F.lit(low) + i * F.lit(width)
    at = rows.withColumn("_v", value).where((F.col("_v") >= low) & (F.col("_v") <= F.lit(low) + F.lit(n) * F.lit(width)))
    at = at.withColumn("_g", F.least(F.greatest(F.ceil((F.col("_v") - low) / width) - 1, F.lit(0)), F.lit(n - 1)))
    g, v = F.col("_g"), F.col("_v")
    return at.withColumn("bin", F.when((g > 0) & (v <= edge(g)), g - 1).when((g < n - 1) & (v > edge(g + 1)), g + 1).otherwise(g).cast("int")).drop("_g")


def calibration(forecasts: DataFrame) -> DataFrame:
    """Ten right-closed bins on [0, 1]: n, mean probability, observed rate; empty bins stay."""
    bins = _bins(forecasts.sparkSession, 10)
    made = _binned(forecasts, F.col("probability_a"), 10, 0.0, 0.1).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("probability_a").alias("mean_p"), F.avg(F.col("team_a_won").cast("double")).alias("observed"))
    return bins.select("bin").join(made, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def favorite_calibration(forecasts: DataFrame) -> DataFrame:
    """Five bins on [.5, 1] of the favourite's probability: n, mean, observed rate and gap; empty bins stay."""
    return model_calibration(forecasts, ["probability_a"]).drop("model")


def model_calibration(forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Favourite calibration of several forecasts, columns of the same rows: (model, bin, n, mean_p, observed, gap)."""
    spark = forecasts.sparkSession
    long = forecasts.select("team_a_won", *models).unpivot("team_a_won", list(models), "model", "p")
    x = _binned(long, confidence(F.col("p")), 5, 0.5, 0.1).withColumn("hit", correct(F.col("p"), F.col("team_a_won")).cast("double"))
    made = x.groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean_p"), F.avg("hit").alias("observed"), (F.avg("hit") - F.avg("_v")).alias("gap"))
    all_bins = spark.createDataFrame([(m, b) for m in models for b in range(5)], "model string, bin int")
    return all_bins.join(made, ["model", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def loss_table(forecasts: DataFrame, by: Column, name: str) -> DataFrame:
    """Losses per value of an expression."""
    return forecasts.groupBy(by.alias(name)).agg(*_block())


def experience_buckets(forecasts: DataFrame) -> DataFrame:
    """Losses by the smaller of both teams' prior counts: 0, 1-4, 5-19, 20+; empty buckets stay."""
    least = F.least("team_a_prior", "team_b_prior")
    bucket = F.when(least == 0, "0").when(least < 5, "1-4").when(least < 20, "5-19").otherwise("20+")
    names = forecasts.sparkSession.createDataFrame([(b,) for b in ("0", "1-4", "5-19", "20+")], "bucket string")
    return names.join(loss_table(forecasts, bucket, "bucket"), "bucket", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def draw_index(seed: int, replicate: Column, i: Column, n: Column) -> Column:
    """A reproducible uniform index below n: the first 32 bits of md5('seed:replicate:i')."""
    text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), i.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def daily_sums(losses: DataFrame, value: str) -> DataFrame:
    """(place, match_date, total, n): daily sums numbered by date; one row per date, a dimension."""
    days = losses.groupBy("match_date").agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return days.withColumn("place", F.row_number().over(Window.orderBy("match_date")) - 1)


def date_draws(days: DataFrame, draws: int, seed: int) -> DataFrame:
    """(replicate, i, place): whole dates drawn with replacement, as many as there are dates."""
    n = days.agg(F.count(F.lit(1)).alias("n_days"))
    r = days.sparkSession.range(draws).select(F.col("id").alias("replicate")).crossJoin(F.broadcast(n))
    made = r.select("replicate", "n_days", F.explode(F.sequence(F.lit(0), F.col("n_days") - 1)).alias("i"))
    return made.select("replicate", "i", draw_index(seed, F.col("replicate"), F.col("i"), F.col("n_days")).alias("place"))


def date_bootstrap(losses: DataFrame, value: str = "delta_log_loss", draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """One row: mean, 2.5 and 97.5 percentiles and share below zero over resamples of whole dates.

    Rows are summed by date first, so a resample costs one row per date. The daily
    table is one row per calendar date, which bounds it."""
    days = daily_sums(losses, value)
    drawn = date_draws(days, draws, seed).join(F.broadcast(days), "place")
    means = drawn.groupBy("replicate").agg((F.sum("total") / F.sum("n")).alias("m"))
    return means.agg(F.count(F.lit(1)).alias("n_draws"), F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("p2_5"), F.percentile("m", 0.975).alias("p97_5"), F.avg((F.col("m") < 0).cast("double")).alias("share_below_zero"))


def bootstrap_losses(losses: DataFrame, values: Sequence[str] = ("delta_log_loss", "delta_brier"), draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """A row per loss: dates, draws, the observed mean, and mean, 2.5 and 97.5 percentiles and share below zero of the same resamples of whole dates."""
    days = losses.groupBy("match_date").agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(v) for v in values)).withColumn("place", F.row_number().over(Window.orderBy("match_date")) - 1)
    drawn = date_draws(days, draws, seed).join(F.broadcast(days), "place")  # a row per calendar date
    means = drawn.groupBy("replicate").agg(*((F.sum(v) / F.sum("n")).alias(v) for v in values)).unpivot("replicate", list(values), "loss", "m")
    spread = means.groupBy("loss").agg(F.count(F.lit(1)).alias("n_draws"), F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("p2_5"), F.percentile("m", 0.975).alias("p97_5"), F.avg((F.col("m") < 0).cast("double")).alias("share_below_zero"))
    total = days.agg(F.count(F.lit(1)).alias("n_dates"), *((F.sum(v) / F.sum("n")).alias(v) for v in values)).unpivot("n_dates", list(values), "loss", "observed")
    return total.join(spread, "loss", "left")


def paired_losses(forecasts: DataFrame, challenger: str, incumbent: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """`bootstrap_losses` of the challenger's log loss and Brier score less the incumbent's."""
    won = F.col("team_a_won")
    gaps = {f"delta_{n}": f(F.col(challenger), won) - f(F.col(incumbent), won) for n, f in (("log_loss", log_loss), ("brier", brier))}
    return bootstrap_losses(forecasts.withColumns(gaps), tuple(gaps), draws, seed)


def resample_rows(losses: DataFrame, replicate: int, seed: int = SEED) -> DataFrame:
    """Rows of one resample: every row of each drawn date, once per draw."""
    days = daily_sums(losses, "log_loss")
    drawn = date_draws(days, replicate + 1, seed).where(F.col("replicate") == replicate).join(F.broadcast(days.select("place", "match_date")), "place")
    return losses.join(drawn.select("i", "match_date"), "match_date")


def paired_delta(forecasts: DataFrame, challenger: str, incumbent: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """Date bootstrap of the challenger's log loss less the incumbent's."""
    won = F.col("team_a_won")
    gap = log_loss(F.col(challenger), won) - log_loss(F.col(incumbent), won)
    return date_bootstrap(forecasts.withColumn("gap", gap), "gap", draws, seed)


def fold_assign(rows: DataFrame, folds: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows per fold (name, start, end) and role: train before start, evaluate within [start, end)."""
    f = rows.sparkSession.createDataFrame(list(folds), "fold string, s string, e string").select("fold", F.to_date("s").alias("start"), F.to_date("e").alias("end"))
    joined = rows.join(F.broadcast(f), F.col("match_date") < F.col("end"))
    return joined.withColumn("role", F.when(F.col("match_date") < F.col("start"), "train").otherwise("evaluate")).drop("start", "end")


def prep_stats(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """(fold, feature, median, mean, std): of the training rows only, mean and deviation after imputing the median.

    A column without values imputes 0; a zero deviation scales by 1."""
    train = assigned.where("role = 'train'")
    long = train.select("fold", *(F.col(f).cast("double").alias(f) for f in features)).unpivot("fold", list(features), "feature", "v")
    known = exact_quantiles(long, ["fold", "feature"], "v", [0.5]).select("fold", "feature", F.col("value").alias("known"))
    med = long.select("fold", "feature").distinct().join(known, ["fold", "feature"], "left").select("fold", "feature", F.coalesce("known", F.lit(0.0)).alias("median"))
    full = long.join(F.broadcast(med), ["fold", "feature"]).withColumn("x", F.coalesce("v", "median"))
    sd = F.stddev_pop("x")
    return full.groupBy("fold", "feature").agg(F.max("median").alias("median"), F.avg("x").alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("std"))


def oof_metrics(forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """Losses per (model, fold) and per model over all folds (fold null)."""
    long = forecasts.select("match_id", "fold", "team_a_won", "any_team_unseen", *models).unpivot(["match_id", "fold", "team_a_won", "any_team_unseen"], list(models), "model", "probability_a")
    by_fold = long.groupBy("model", "fold").agg(*_block())
    return by_fold.unionByName(long.groupBy("model").agg(*_block()).withColumn("fold", F.lit("all")))


def k_grid(history: DataFrame, development: tuple[str, str]) -> DataFrame:
    """(k, n, log_loss, brier, accuracy, place): every K over the development period, best first."""
    p, won = F.col("probability_a"), F.col("team_a_won")
    dev = history.where(F.col("match_date").between(F.to_date(F.lit(development[0])), F.to_date(F.lit(development[1]))))
    made = dev.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg(log_loss(p, won)).alias("log_loss"), F.avg(brier(p, won)).alias("brier"), F.avg(correct(p, won).cast("double")).alias("accuracy"))
    return made.withColumn("place", F.row_number().over(Window.orderBy("log_loss", "k")))
