"""Quotes, provider results, the ledger pass and the streams."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from priorday.functions import scalars as S
from priorday.operators import ledger as L
from priorday.operators import market as M
from priorday.operators import rating as R
from priorday.sources import files
from priorday.sources.commits import CommittedTables
from priorday.sources.shared import written
from priorday.streaming import streams

T = dt.datetime(2024, 5, 1, 12)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


NOW = "2024-05-01 12:00:00"
FIXTURE = "match_id string, team_a_id long, team_b_id long, team_a_name string, team_b_name string, scheduled_at timestamp"
STATES = "pool string, k double, team_id long, match_date date, rating double, n_prior long"


def ledger(spark, *rows):
    base = dict.fromkeys(L.RECORD)
    schema = ", ".join(f"{c} {t}" for c, t in L.RECORD.items())
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)


def test_primary_is_closest_to_an_hour_then_earlier(spark):
    q = [("f", at(-62), "x", 2.0, 2.0, "h1"), ("f", at(-58), "x", 2.0, 2.0, "h2"), ("f", at(-60), "y", 2.0, 2.0, "h3"), ("f", at(-60), "x", 1.0, 2.0, "h4"), ("f", at(5), "x", 2.0, 2.0, "h5")]
    df = spark.createDataFrame(q, "fixture string, captured_at timestamp, bookmaker string, odds_a double, odds_b double, snapshot_hash string").withColumns({"market_type": F.lit("ML"), "start": F.lit(T)})
    assert [r.snapshot_hash for r in M.primary_quote(df, ["fixture"], "x").collect()] == ["h1"]


def test_reschedule_rules(spark):
    x = spark.createDataFrame([(at(0), at(59)), (at(0), at(61)), (at(0), at(24 * 60))], "a timestamp, b timestamp")
    got = x.select(S.snapshot_current(F.col("a"), F.col("b")).alias("c"), S.needs_new_forecast(F.col("a"), F.col("b")).alias("n")).collect()
    assert [(r.c, r.n) for r in got] == [(True, False), (False, False), (False, True)]


def test_terminal_classes(spark):
    rows = [("finished", False, 1), ("finished", False, 9), ("canceled", None, None), ("running", None, None), ("not_started", True, None)]
    df = spark.createDataFrame([(*r, [1, 2], 1) for r in rows], "status string, forfeit boolean, winner_id long, opponent_ids array<long>, team_a_id long")
    got = [(r.outcome_type, r.reason, r.team_a_won) for r in M.terminal_class(df).collect()]
    assert got == [("outcome_attached", None, True), ("terminal_exclusion", "unresolved_or_invalid_result", None), ("terminal_exclusion", "cancelled", None), (None, None, None), ("terminal_exclusion", "forfeit_excluded", None)]


def test_append_rejects_duplicates_and_secrets(spark):
    old = ledger(spark, {"record_id": "a", "record_type": "t"})
    new = ledger(spark, {"record_id": "a", "record_type": "t"}, {"record_id": "b", "record_type": "t"}, {"record_id": "b", "record_type": "t"}, {"record_id": None, "record_type": "t"})
    assert [r.record_id for r in L.ledger_append(new, old).collect()] == ["b"]
    with pytest.raises(ValueError):
        L.ledger_append(new.withColumn("x_api_key", F.lit(1)), old)
    with pytest.raises(ValueError):
        L.ledger_append(new.drop("record_type"), old)


def step(spark, fixtures, records, results=(), quotes=()):
    f = spark.createDataFrame(fixtures, FIXTURE)
    events = f.select(F.col("match_id").alias("right_id"), F.col("team_b_name").alias("team_a"), F.col("team_a_name").alias("team_b"), F.col("scheduled_at").alias("start"))
    r = spark.createDataFrame(list(results), "match_id string, status string, forfeit boolean, winner_id long, opponent_ids array<long>")
    q = spark.createDataFrame(list(quotes), "match_id string, captured_at timestamp, start timestamp, odds_a double, odds_b double")
    states = spark.createDataFrame([("all", 64.0, 1, dt.date(2024, 4, 1), 1600.0, 3)], STATES)
    return L.ledger_step(f, events, q, r, records, states, NOW)


def kinds(df):
    return sorted((r.record_type, r.match_id) for r in df.collect())


def test_new_forecast_then_idempotent(spark):
    fixtures = [("m", 1, 2, "One", "Two", at(60)), ("late", 3, 4, "a", "b", at(-5)), ("far", 5, 6, "c", "d", at(600))]
    first = step(spark, fixtures, ledger(spark), quotes=[("m", at(0), at(60), 1.8, 2.1)])
    assert kinds(first) == [("forecast_generated", "m"), ("market_candidate", "m"), ("terminal_exclusion", "late")]
    p = next(r.p_team_a for r in first.collect() if r.record_type == "forecast_generated")
    assert abs(p - 1 / (1 + 10 ** (-100 / 400))) < 1e-12
    assert step(spark, fixtures, first, quotes=[("m", at(0), at(60), 1.8, 2.1)]).count() == 0


def test_moves_of_date_and_hour(spark):
    forecast = {"record_id": "f", "record_type": "forecast_generated", "match_id": "m", "recorded_at": at(-600), "scheduled_start": at(60), "team_a_id": 1, "team_b_id": 2}
    primary = {"record_id": "p", "record_type": "primary_market_selected", "match_id": "m", "recorded_at": at(-300), "scheduled_start": at(60)}
    old = ledger(spark, forecast, primary)
    assert kinds(step(spark, [("m", 1, 2, "One", "Two", at(110))], old)) == []
    assert kinds(step(spark, [("m", 1, 2, "One", "Two", at(180))], old)) == [("primary_market_superseded", "m"), ("reschedule", "m")]
    assert kinds(step(spark, [("m", 1, 2, "One", "Two", at(1500))], old)) == [("forecast_generated", "m"), ("forecast_superseded", "m"), ("primary_market_superseded", "m"), ("reschedule", "m")]
    late = kinds(step(spark, [("m", 1, 2, "One", "Two", at(-1500))], old))
    assert ("terminal_exclusion", "m") in late and ("forecast_generated", "m") not in late


def test_outcomes_and_missing_results(spark):
    forecast = {"record_id": "f", "record_type": "forecast_generated", "match_id": "m", "recorded_at": at(-600), "scheduled_start": at(-60), "team_a_id": 1, "team_b_id": 2}
    old = ledger(spark, forecast)
    fixtures = [("other", 3, 4, "x", "y", at(900))]
    assert kinds(step(spark, fixtures, old)) == []
    assert kinds(step(spark, fixtures, old, results=[("m", "running", None, None, [1, 2])])) == []
    done = step(spark, fixtures, old, results=[("m", "finished", False, 1, [1, 2])])
    assert [(r.record_type, r.team_a_won) for r in done.collect()] == [("outcome_attached", True)]
    assert step(spark, fixtures, old.unionByName(done), results=[("m", "finished", False, 1, [1, 2])]).count() == 0


def test_status_has_counts_only(spark):
    s = L.ledger_status(ledger(spark, {"record_id": "a", "record_type": "t"}))
    assert s.columns == ["record_type", "n"]


def test_missing_ledger_is_empty(spark, tmp_path):
    assert files.read_ledger(spark, f"file://{tmp_path}/none.jsonl", "record_id string, record_type string").count() == 0
    (tmp_path / "some.jsonl").write_text('{"record_id":"a","record_type":"t"}\n')
    assert files.read_ledger(spark, f"file://{tmp_path}/some.jsonl", "record_id string, record_type string").first().record_id == "a"


def test_eligible_split_takes_the_first_failing_rule(spark):
    o = lambda *t: [{"opponent": {"id": i, "name": n}} for i, n in t]
    good = (1, "finished", False, "2024-01-05T10:00:00Z", "2024-01-05T12:00:00Z", 7, o((7, "A"), (8, "B")), "cup")
    rows = [good, (2, "running", True, *good[3:]), (3, *good[1:2], True, *good[3:]), (4, *good[1:6], o((7, "A")), "cup"), (5, *good[1:3], None, *good[4:]), (6, *good[1:3], "soon", *good[4:])]
    rows += [(7, *good[1:3], "2023-12-31T10:00:00Z", *good[4:]), (8, *good[1:4], "2024-03-01T12:00:00Z", *good[5:]), (9, *good[1:5], 99, *good[6:]), (10, *good[1:6], o((7, "tbd"), (8, "B")), "cup")]
    schema = "id long, status string, forfeit boolean, begin_at string, end_at string, winner_id long, opponents array<struct<opponent: struct<id: long, name: string>>>, tournament string"
    fine, out = M.eligible_split(spark.createDataFrame(rows, schema), "2023-12-31", "2024-02-01 00:00:00")
    assert [(r.match_id, str(r.match_date), r.team_a_won) for r in fine.collect()] == [("ps:1", "2024-01-05", True)]
    assert {r.id: r.reason for r in out.collect()} == dict(zip(range(2, 11), M.REASONS, strict=True))


def test_ledger_stream_is_idempotent(spark, tmp_path):
    home = f"file://{tmp_path}"
    rows = ledger(spark, *({"record_id": str(i % 5), "record_type": "t", "match_id": "m"} for i in range(12)))
    rows.repartition(3).write.parquet(f"{home}/in")
    rows.limit(0).write.parquet(f"{home}/ledger")
    for n in (1, 2):  # a second stream with a new checkpoint replays everything
        feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
        streams.ledger_stream(feed, lambda: spark.read.schema(rows.schema).parquet(f"{home}/ledger"), f"{home}/ledger", f"{home}/check{n}").awaitTermination()
    assert spark.read.parquet(f"{home}/ledger").count() == 5


def test_rating_stream_equals_batch(spark, tmp_path):
    home = f"file://{tmp_path}"
    rows = [(str(i % 2), dt.datetime(2024, 1, 1 + i // 8), i, i % 4 * 2 + i % 2, (i + 1) % 4 * 2 + i % 2, i % 3 == 0) for i in range(64)]
    df = spark.createDataFrame(rows, "pool string, played_at timestamp, match_id long, team_a_id long, team_b_id long, team_a_won boolean")
    for lo in (0, 24, 48):  # one file after another, in time order
        df.where(F.col("match_id").between(lo, lo + 23)).coalesce(1).write.mode("append").parquet(f"{home}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    streams.elo_stream(feed).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/c").trigger(availableNow=True).start().awaitTermination()
    got = {r.match_id: r for r in spark.read.schema(R.HISTORY).parquet(f"{home}/out").collect()}
    want = {r.match_id: r for r in R.elo_history(df.withColumn("match_date", F.to_date("played_at")), 64.0, pool="pool").collect()}
    closed = {m for m, r in want.items() if r.match_date < dt.date(2024, 1, 8)}
    assert closed == set(got) and all(abs(got[m].probability_a - want[m].probability_a) < 1e-9 and got[m].team_a_prior == want[m].team_a_prior for m in closed)


def test_rating_stream_starts_from_states_and_keeps_late_rows(spark, tmp_path):
    home = f"file://{tmp_path}"
    rows = [(str(i % 2), dt.datetime(2024, 1, 1 + i // 8), i, i % 4 * 2 + i % 2, (i + 1) % 4 * 2 + i % 2, i % 3 == 0) for i in range(80)]
    df = spark.createDataFrame(rows, "pool string, played_at timestamp, match_id long, team_a_id long, team_b_id long, team_a_won boolean").withColumn("match_date", F.to_date("played_at"))
    early, held = F.col("match_date") < F.lit(dt.date(2024, 1, 4)), F.col("match_id").isin(30, 41)
    fed = df.where(~early).withColumn("landed_at", F.when(held, F.col("played_at") + F.expr("INTERVAL 4 DAYS")).otherwise(F.col("played_at")))
    for day in range(4, 11):
        fed.where(F.dayofmonth("landed_at") == day).drop("match_date").coalesce(1).write.mode("append").parquet(f"{home}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    feed = spark.readStream.schema(fed.drop("match_date").schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    states = streams.last_states(R.elo_history(df.where(early), 64.0, pool="pool"))
    streams.rated_stream(feed, states=states).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(streams.RATED).parquet(f"{home}/out").collect()
    assert {r.match_id for r in got if r.late} == {30, 41} and all(r.rating_a_pre is None and r.team_a_prior is None for r in got if r.late)
    want = {r.match_id: r for r in R.elo_history(df.where(~held), 64.0, pool="pool").collect()}
    timely = {r.match_id: r for r in got if not r.late}
    assert set(timely) == {m for m, r in want.items() if dt.date(2024, 1, 4) <= r.match_date < dt.date(2024, 1, 10)}
    assert all(abs(r.rating_a_pre - want[m].rating_a_pre) < 1e-9 and r.team_b_prior == want[m].team_b_prior for m, r in timely.items())


def test_stream_query_gives_every_contest_of_the_batch(spark, small):
    from priorday.plans import market_queries as Q

    got = {r.match_id: r for r in Q.elo_stream(spark, small).collect()}
    want = {r.match_id: r for r in R.elo_history(Q.canonical(spark, small), 64.0).collect()}
    assert got.keys() == want.keys() and want
    for m, r in want.items():
        assert (got[m].match_date, got[m].team_a_prior, got[m].team_b_prior) == (r.match_date, r.team_a_prior, r.team_b_prior)
        assert abs(got[m].rating_a_pre - r.rating_a_pre) < 1e-5 and abs(got[m].probability_a - r.probability_a) < 1e-5


POLL_DAYS = [dt.datetime(2024, 5, d, 12) for d in (1, 2, 3)]


def poll_rows():
    """Three days of polls: two fixtures are forecast, one moves to another day, one quote lands late, results follow."""
    one, two, three = POLL_DAYS
    hour = dt.timedelta(hours=1)
    listed = lambda m, a, b, start, at, n: {"match_id": m, "team_a_id": a, "team_b_id": b, "team_a_name": f"t{a}", "team_b_name": f"t{b}", "scheduled_at": start, "polled_at": at, "sequence": n}
    seen = lambda m, a, b, start, at, n: {"match_id": m, "team_a": f"t{b}", "team_b": f"t{a}", "start": start, "polled_at": at, "sequence": n}
    quote = lambda m, start, at, n: {"match_id": m, "captured_at": start - hour, "start": start, "odds_a": 1.5, "odds_b": 2.5, "polled_at": at, "sequence": n}
    result = lambda m, a, b, at, n: {"match_id": m, "status": "finished", "forfeit": False, "winner_id": a, "opponent_ids": [a, b], "polled_at": at, "sequence": n}
    return [
        {"fixtures": [listed("m1", 1, 2, one + hour, one, 1), listed("m2", 3, 4, one + hour, one, 2), listed("m3", 5, 6, one - hour, one, 3)], "events": [seen("m1", 1, 2, one + hour, one, 1), seen("m2", 3, 4, one + hour, one, 2)], "quotes": [quote("m1", one + hour, one, 1)], "results": []},
        {"fixtures": [listed("m2", 3, 4, three + hour, two, 4)], "events": [], "quotes": [], "results": [result("m1", 1, 2, two, 1)]},
        {"fixtures": [], "events": [], "quotes": [quote("m2", three + hour, three, 3)], "results": []},
    ]


def land(spark, home, days):
    for n, day in enumerate(days):
        for kind, rows in day.items():
            empty = {"match_id": None, "polled_at": POLL_DAYS[n], "sequence": None}
            schema = f"{streams.POLLS[kind]}, polled_at timestamp, sequence long"
            names = [c.split(" ")[0] for c in schema.split(", ")]
            spark.createDataFrame([tuple(r.get(c) for c in names) for r in [*rows, empty]], schema).coalesce(1).write.mode("append").json(f"{home}/{kind}")


def test_polling_stream_is_the_pass_of_every_batch(spark, tmp_path):
    home = f"file://{tmp_path}"
    land(spark, home, poll_rows())
    tables = CommittedTables(spark, f"{home}/tables", streams.POLL_TABLES)
    states = written(spark.createDataFrame([("p", 32.0, 1, dt.date(2024, 4, 1), 1600.0, 3)], STATES), "states")

    def lost(batch):
        if batch == 1:
            raise RuntimeError("lost")

    start = lambda hook, where: streams.ledger_polls(streams.poll_feed(spark, home), tables, states, f"{home}/{where}", before_commit=hook).awaitTermination()
    with pytest.raises(StreamingQueryException):
        start(lost, "c1")
    assert tables.last()[0] == 0 and tables.read("passes").count() == 1
    start(None, "c1")
    rows = {r.record_id: r for r in tables.read("ledger").collect()}
    one, three = (x.strftime("%Y-%m-%dT13:00:00Z") for x in (POLL_DAYS[0], POLL_DAYS[2]))
    candidates = sorted(k for k in rows if k.startswith("candidate:"))
    assert [k.split(":")[1] for k in candidates] == ["m1", "m2"]
    assert set(rows) - set(candidates) == {
        "terminal:m3:missed_prospective_forecast", f"forecast:m1:{one}", f"forecast:m2:{one}",
        f"reschedule:m2:{three}", f"forecast_superseded:forecast:m2:{one}:{three}", f"forecast:m2:{three}", "outcome:m1", f"primary:m1:{candidates[0]}",
    }
    assert rows["outcome:m1"].team_a_won and rows[f"forecast:m1:{one}"].p_team_a > 0.6 and rows[f"forecast:m2:{three}"].refers_to == f"forecast:m2:{one}"
    assert [(r.batch, r.appended) for r in tables.read("passes").orderBy("batch").collect()] == [(0, 4), (1, 5), (2, 1)]
    number, at = tables.last()
    start(None, "c2")  # another stream over the same polls finds its batches committed
    assert tables.last() == (number, at) and number == 2


def test_commits_change_tables_together(spark, tmp_path):
    tables = CommittedTables(spark, f"file://{tmp_path}/t", {"x": "a long", "y": "b string"}, merge_at=3)
    assert tables.last() == (-1, {}) and tables.read("x").count() == 0
    for n in range(5):
        x, y = tables.stage("x", spark.range(n, n + 2).withColumnRenamed("id", "a")), tables.stage("y", spark.createDataFrame([(str(n),)], "b string"))
        assert tables.read("x").count() == 2 * n  # staged rows do not count
        assert tables.commit(n, {"x": [x], "y": [y]}) and not tables.commit(n, {"x": [x]})
    assert sorted(r.a for r in tables.read("x").collect()) == sorted(i for n in range(5) for i in (n, n + 1))
    assert sorted(r.b for r in tables.read("y").collect()) == list("01234") and len(tables.last()[1]["x"]) < 5


def test_reschedules_against_the_first_start(spark):
    rows = [{"record_id": "f", "record_type": "forecast_generated", "match_id": "m", "recorded_at": at(-300), "scheduled_start": at(0)}, {"record_id": "r", "record_type": "reschedule", "match_id": "m", "recorded_at": at(-200), "scheduled_start": at(240)}]
    fixtures = lambda minutes: spark.createDataFrame([("m", 1, 2, "a", "b", at(minutes))], FIXTURE)
    n = lambda minutes, rule: L.reschedules(fixtures(minutes), ledger(spark, *rows), NOW, against=rule).count()
    assert [n(270, "active"), n(270, "first"), n(30, "active"), n(30, "first")] == [0, 1, 1, 0]


def test_rating_stream_reads_a_quarter_a_file(spark, small, monkeypatch):
    """No task makes a year of contests by itself: each quarter is one file, dealt by an exchange."""
    from priorday.plans import market_queries as Q

    homes, make = [], Q.scratch
    monkeypatch.setattr(Q, "scratch", lambda s, name, keep=False: homes.append(make(s, name, keep)) or homes[-1])
    Q.elo_stream(spark, small)
    files_in = spark.read.parquet(f"{homes[0]}/in").select("quarter", F.input_file_name().alias("f")).groupBy("quarter").agg(F.count_distinct("f").alias("n")).collect()
    assert len(files_in) > 20 and {r.n for r in files_in} == {1}
