"""Adapters: the star-schema tables in the shape of matches, games, rosters, quotes and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorday.functions.scalars import resolved_outcome
from priorday.operators.resolve import canonical_filter

LINE_ORDER = ("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream, its times as instants in the session's zone."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with two lines or more: the first line's supplier against the second's."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_ORDER)
    ranked = lines.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))).where("rn <= 2")
    side = F.struct("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    both = ranked.groupBy("l_orderkey").agg(F.max(F.when(F.col("rn") == 1, side)).alias("a"), F.max(F.when(F.col("rn") == 2, side)).alias("b")).where("b is not null")
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    home = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_suppkey").alias("team_a_id"), F.col("s_name").alias("team_a_name"), F.col("n_name").alias("tournament"), F.col("n_regionkey").alias("region_a"))
    away = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(F.col("s_suppkey").alias("team_b_id"), F.col("s_name").alias("team_b_name"), F.col("n_regionkey").alias("region_b"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("match_date"))
    made = both.join(orders, both.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderkey").alias("match_id"),
        "match_date",
        F.year("match_date").alias("year"),
        F.col("a.l_suppkey").alias("team_a_id"),
        F.col("b.l_suppkey").alias("team_b_id"),
        F.col("a.l_quantity").alias("score_a"),
        F.col("b.l_quantity").alias("score_b"),
        F.col("a.l_partkey").alias("part_a"),
        F.col("b.l_partkey").alias("part_b"),
        F.col("a.l_extendedprice").alias("price_a"),
        F.col("b.l_extendedprice").alias("price_b"),
    )
    return made.join(home, "team_a_id").join(away, "team_b_id").withColumn("team_a_won", resolved_outcome(F.col("score_a"), F.col("score_b")))


CANONICAL = ("match_id", "match_date", "year", "team_a_id", "team_a_name", "team_b_id", "team_b_name", "team_a_won", "tournament")


def map_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two games per valid contest: (match_id, match_date, map, game, team_a_id, team_b_id, team_a_won)."""
    c = canonical_filter(contests(spark, sf_dir))
    brand = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    games = F.array(
        F.struct(F.col("part_a").alias("part"), F.lit(1).alias("game"), F.col("score_a").cast("double").alias("a"), F.col("score_b").cast("double").alias("b")),
        F.struct(F.col("part_b").alias("part"), F.lit(2).alias("game"), F.col("price_a").cast("double").alias("a"), F.col("price_b").cast("double").alias("b")),
    )
    g = c.select("match_id", "match_date", "team_a_id", "team_b_id", F.explode(games).alias("g")).where("g.a <> g.b")
    return g.join(brand, F.col("g.part") == brand.p_partkey).select("match_id", "match_date", F.col("p_brand").alias("map"), F.col("g.game").alias("game"), "team_a_id", "team_b_id", (F.col("g.a") > F.col("g.b")).alias("team_a_won"))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests under the text by which map and roster files name them; few names keep some contests alike."""
    c = contests(spark, sf_dir)
    return c.select(
        "match_id",
        "year",
        "tournament",
        F.concat(F.lit("Stage "), F.quarter("match_date").cast("string")).alias("stage"),
        F.when(F.col("match_id") % 2 == 0, "Group").otherwise("Final").alias("match_type"),
        F.concat("team_a_name", F.lit(" vs "), "team_b_name").alias("match_name"),
        F.col("team_a_name").alias("team_a"),
        F.col("team_b_name").alias("team_b"),
    )


def map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map scores as a file lists them: text keys in place of ids, nothing for every seventh contest."""
    keys = text_keys(spark, sf_dir).where("match_id % 7 <> 0")
    games = map_games(spark, sf_dir).select("match_id", "map", "game", F.when(F.col("team_a_won"), 13).otherwise(7).alias("score_a"), F.when(F.col("team_a_won"), 7).otherwise(13).alias("score_b"))
    return keys.join(games, "match_id").drop("match_id")


def overview_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players as a file lists them, by side of play; nothing for every ninth contest."""
    keys = text_keys(spark, sf_dir).where("match_id % 9 <> 0").drop("team_a", "team_b")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_suppkey").alias("team_id"), F.concat(F.lit("P"), (F.col("l_partkey") % 7).cast("string")).alias("player"), F.when(F.col("l_linenumber") % 3 == 0, "attack").otherwise("both").alias("side"))
    return keys.join(lines, "match_id").drop("match_id")


def lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, match_date, team_id, player) of every order line."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("match_date"), F.col("l_suppkey").alias("team_id"), F.concat(F.lit("P"), (F.col("l_partkey") % 7).cast("string")).alias("player")
    )


def named_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(team_name, team_id): every word of each document with doc_id % 50, each pair once."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("team_name"), (F.col("doc_id") % 50).alias("team_id")).distinct()


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote observations from the event stream."""
    e = events(spark, sf_dir)
    return e.select(
        "event_id",
        (F.col("user_id") % 10).alias("fixture_id"),
        "user_id",
        F.col("ts").alias("captured_at"),
        (F.date_trunc("hour", "ts") + F.expr("INTERVAL 90 MINUTES")).alias("start"),
        F.col("event_type").alias("bookmaker"),
        F.lit("ML").alias("market_type"),
        (F.lit(0.99) + F.col("value") / 50).alias("odds_a"),
        (F.lit(0.99) + (F.col("event_id") % 400) / F.lit(100.0)).alias("odds_b"),
        F.md5(F.col("event_id").cast("string")).alias("snapshot_hash"),
    )


def rival_fixtures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two listings of the contests: the second with sides swapped, starts shifted by 0-4 hours, every 50th doubled."""
    c = contests(spark, sf_dir)
    noon = F.col("match_date").cast("timestamp") + F.expr("INTERVAL 12 HOURS")
    left = c.select(F.col("match_id").alias("left_id"), F.col("team_a_name").alias("team_a"), F.col("team_b_name").alias("team_b"), noon.alias("start"))
    right = c.select(
        F.col("match_id").alias("right_id"), F.col("team_b_name").alias("team_a"), F.col("team_a_name").alias("team_b"), (noon + F.make_dt_interval(F.lit(0), (F.col("match_id") % 5).cast("int"))).alias("start")
    )
    return left, right.unionByName(right.where("right_id % 50 = 0").withColumn("right_id", -F.col("right_id")))


LEDGER_TYPES = {"signup": "forecast_generated", "view": "market_candidate", "click": "primary_market_selected", "purchase": "outcome_attached", "error": "terminal_exclusion"}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger records from the event stream: a match is a user's day."""
    e = events(spark, sf_dir)
    kind = F.create_map(*[F.lit(x) for p in LEDGER_TYPES.items() for x in p])
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("record_id"),
        kind[F.col("event_type")].alias("record_type"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("match_id"),
        F.col("ts").alias("recorded_at"),
        (F.date_trunc("hour", "ts") + F.expr("INTERVAL 90 MINUTES")).alias("scheduled_start"),
        (F.col("user_id") % 100).alias("team_a_id"),
        ((F.col("user_id") * 7 + 13) % 100).alias("team_b_id"),
        (F.lit(0.99) + F.col("value") / 50).alias("odds_a"),
        (F.lit(0.99) + (F.col("event_id") % 400) / F.lit(100.0)).alias("odds_b"),
    )


def provider_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider results with nested opponents, made from contests; every rule of the eligible split has rows to catch."""
    c = contests(spark, sf_dir)
    m = F.col("match_id")
    opponent = lambda i, n: F.struct(F.struct(i.alias("id"), n.alias("name")).alias("opponent"))
    a, b = opponent(F.col("team_a_id"), F.when(m % 41 == 0, "TBD").otherwise(F.col("team_a_name"))), opponent(F.col("team_b_id"), F.col("team_b_name"))
    begin = F.concat(F.date_format("match_date", "yyyy-MM-dd"), F.lit("T12:00:00Z"))
    end = F.concat(F.date_format("match_date", "yyyy-MM-dd"), F.lit("T15:00:00Z"))
    return c.select(
        m.alias("id"),
        F.when(m % 11 == 0, "canceled").when(m % 13 == 0, "not_started").otherwise("finished").alias("status"),
        (m % 17 == 0).alias("forfeit"),
        F.when(m % 23 == 0, None).when(m % 29 == 0, "soon").otherwise(begin).alias("begin_at"),
        F.when(m % 31 == 0, None).otherwise(end).alias("end_at"),
        F.when(F.col("team_a_won"), F.col("team_a_id")).when(~F.col("team_a_won"), F.col("team_b_id")).alias("winner_id"),
        F.when(m % 19 == 0, F.array(a)).otherwise(F.array(a, b)).alias("opponents"),
        F.col("tournament"),
    )


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upcoming fixtures: each ledger match at its last listed start, moved by 0-3 hours."""
    by = ledger(spark, sf_dir).groupBy("match_id").agg(F.min("team_a_id").alias("team_a_id"), F.min("team_b_id").alias("team_b_id"), F.max("scheduled_start").alias("last"))
    return by.select(
        "match_id",
        "team_a_id",
        "team_b_id",
        (F.col("last") + F.make_dt_interval(F.lit(0), (F.col("team_b_id") % 4).cast("int"))).alias("scheduled_at"),
        F.concat(F.lit("team "), F.col("team_a_id").cast("string")).alias("team_a_name"),
        F.concat(F.lit("team "), F.col("team_b_id").cast("string")).alias("team_b_name"),
    )


def odds_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixtures as another source lists them: sides swapped, an hour later."""
    f = fixtures(spark, sf_dir)
    return f.select(F.col("match_id").alias("right_id"), F.col("team_b_name").alias("team_a"), F.col("team_a_name").alias("team_b"), (F.col("scheduled_at") + F.expr("INTERVAL 1 HOUR")).alias("start"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result per fixture: cancelled, running, forfeited, or finished with a valid or invalid winner."""
    a, b = F.col("team_a_id"), F.col("team_b_id")
    return fixtures(spark, sf_dir).select(
        "match_id",
        F.when(a % 7 == 0, "canceled").when(a % 7 == 1, "running").otherwise("finished").alias("status"),
        (a % 11 == 0).alias("forfeit"),
        F.when(a % 3 == 0, a).when(a % 3 == 1, b).otherwise(F.lit(9999)).alias("winner_id"),
        F.array(a, b).alias("opponent_ids"),
    )


def polls(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What a poll a day would have landed, by kind, with the day it landed (`arrival`), from the event stream.

    A match is a user's three days; a day's events are its listings (with the same match of another source, sides
    swapped, an hour later), quotes and results. Every 37th event lands two days late. Every kind lands a row on every
    day, one with a null match_id where there is nothing."""
    a, b, odd = F.col("user_id") % 100, (F.col("user_id") * 7 + 13) % 100, F.col("event_id") % 2 == 1
    names = [F.concat(F.lit("team "), x.cast("string")) for x in (a, b)]
    day = F.to_date("ts")
    e = events(spark, sf_dir).withColumns(
        {
            "match_id": F.concat_ws(":", F.col("user_id").cast("string"), F.floor(F.unix_date(day) / 3).cast("string")),
            "arrival": F.when(F.col("event_id") % 37 == 0, F.date_add(day, 2)).otherwise(day),
            "start": F.when(odd, F.date_trunc("hour", "ts") + F.expr("INTERVAL 90 MINUTES")).otherwise(day.cast("timestamp") + F.expr("INTERVAL 810 MINUTES")),
            "sequence": F.col("event_id"),
        }
    )
    shapes = {
        "fixtures": (("signup", "view"), [a.alias("team_a_id"), b.alias("team_b_id"), names[0].alias("team_a_name"), names[1].alias("team_b_name"), F.col("start").alias("scheduled_at")]),
        "events": (("signup", "view"), [names[1].alias("team_a"), names[0].alias("team_b"), (F.col("start") + F.expr("INTERVAL 1 HOUR")).alias("start")]),
        "quotes": (("click",), [(F.col("start") - F.make_dt_interval(mins=(F.lit(45) + F.col("event_id") % 40).cast("int"))).alias("captured_at"), "start", (F.lit(0.99) + F.col("value") / 50).alias("odds_a"), (F.lit(0.99) + (F.col("event_id") % 400) / F.lit(100.0)).alias("odds_b")]),
        "results": (
            ("purchase", "error"),
            [
                F.when(F.col("event_type") == "purchase", "finished").when(odd, "canceled").otherwise("running").alias("status"),
                (F.col("event_id") % 11 == 0).alias("forfeit"),
                F.when(F.col("event_id") % 3 == 0, a).when(F.col("event_id") % 3 == 1, b).otherwise(F.lit(9999)).alias("winner_id"),
                F.array(a, b).alias("opponent_ids"),
            ],
        ),
    }
    days = e.agg(F.min("arrival").alias("lo"), F.max("arrival").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("arrival"))
    polled = (F.col("arrival").cast("timestamp") + F.expr("INTERVAL 750 MINUTES")).alias("polled_at")
    made = {}
    for kind, (types, columns) in shapes.items():
        rows = e.where(F.col("event_type").isin(*types)).select("arrival", polled, "sequence", "match_id", *columns)
        empty = days.select("arrival", polled, *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("arrival", "polled_at")))
        made[kind] = rows.unionByName(empty)
    return made
