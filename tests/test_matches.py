"""Ratings, features and joins on hand-made tables, and invariances that must hold on any."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorday.functions import scalars as S
from priorday.operators import components
from priorday.operators import features as X
from priorday.operators import quality as Q
from priorday.operators import rating as R
from priorday.operators import rating_blocks as RB
from priorday.operators import resolve as J
from priorday.operators import scans
from priorday.sources import files

D = [dt.date(2022, 1, d) for d in range(1, 28)]
COLS = "match_id long, match_date date, team_a_id long, team_b_id long, team_a_won boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(160):
        a, b = rng.sample(range(9), 2)
        out.append((i, D[rng.randrange(20)], a, b, rng.random() < 0.5))
    return out


def test_probability_is_symmetric(spark):
    x = spark.createDataFrame([(1500.0, 1700.0), (1500.0, 1500.0)], "a double, b double")
    got = x.select(S.win_probability(F.col("a"), F.col("b")).alias("p"), S.win_probability(F.col("b"), F.col("a")).alias("q")).collect()
    assert all(abs(r.p + r.q - 1) < 1e-12 for r in got) and got[1].p == 0.5


def fold(rows, k=32.0):
    """Plain day-batched ratings."""
    ratings, out = {}, {}
    for day in sorted({r[1] for r in rows}):
        moved = {}
        for m, d, a, b, won in rows:
            if d == day:
                ra, rb = ratings.get(a, 1500.0), ratings.get(b, 1500.0)
                p = 1 / (1 + 10 ** ((rb - ra) / 400))
                out[m] = (ra, rb, p)
                moved[a] = moved.get(a, 0) + k * (won - p)
                moved[b] = moved.get(b, 0) - k * (won - p)
        for t, v in moved.items():
            ratings[t] = ratings.get(t, 1500.0) + v
    return out, ratings


def test_history_equals_a_plain_fold_whatever_the_order(spark, rows):
    want, final = fold(rows)
    for seed in (1, 2):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        h = R.elo_history(spark.createDataFrame(shuffled, COLS).repartition(7), 32.0)
        got = {r.match_id: (r.rating_a_pre, r.rating_b_pre, r.probability_a) for r in h.collect()}
        assert got.keys() == want.keys()
        assert all(max(abs(x - y) for x, y in zip(got[m], want[m], strict=True)) < 1e-9 for m in want)
        last = {r.team_id: r.rating for r in R.elo_final(h).collect()}
        assert all(abs(last[t] - final[t]) < 1e-9 for t in final)
        assert abs(sum(last.values()) - 1500 * len(last)) < 1e-6


def test_future_cannot_change_the_past(spark, rows):
    cut = [r for r in rows if r[1] < D[10]]
    whole = {r.match_id: r for r in X.feature_table(spark.createDataFrame(rows, COLS)).collect()}
    part = {r.match_id: r for r in X.feature_table(spark.createDataFrame(cut, COLS)).collect()}
    assert part and all(part[m] == whole[m] for m in part)


def test_several_k_equal_single_runs(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    both = {(r.k, r.match_id): r.probability_a for r in R.elo_history(df, (16.0, 64.0)).collect()}
    one = {(r.k, r.match_id): r.probability_a for r in R.elo_history(df, 64.0).collect()}
    assert all(both[x] == one[x] for x in one) and len(both) == 2 * len(one)


def test_last_game_of_a_day_wins_per_map(spark):
    games = [(1, D[0], "m", 1, 1, 2, True), (1, D[0], "m", 2, 1, 2, False), (2, D[1], "m", 1, 1, 2, True)]
    h = {(r.match_id, r.game): r for r in X.map_elo(spark.createDataFrame(games, "match_id long, match_date date, map string, game int, team_a_id long, team_b_id long, team_a_won boolean"), 64.0).collect()}
    assert h[(2, 1)].rating_a_pre == 1500 - 32 and h[(2, 1)].team_a_prior == 1


def test_as_of_is_strictly_before(spark):
    states = spark.createDataFrame([("all", 32.0, 1, D[0], 1510.0, 1), ("all", 32.0, 1, D[3], 1530.0, 2)], "pool string, k double, team_id long, match_date date, rating double, n_prior long")
    asks = spark.createDataFrame([(1, D[0]), (1, D[1]), (1, D[3]), (1, D[4]), (2, D[4]), (1, D[4])], "team_id long, as_of date")
    got = sorted((r.team_id, r.as_of, r.rating, r.n_prior) for r in R.as_of_states(asks, states).collect())
    assert got == [(1, D[0], 1500.0, 0), (1, D[1], 1510.0, 1), (1, D[3], 1510.0, 1), (1, D[4], 1530.0, 2), (1, D[4], 1530.0, 2), (2, D[4], 1500.0, 0)]


def test_last_n_uses_earlier_dates_only(spark):
    rows = [(i, D[i // 2], 1, 2, i % 3 == 0) for i in range(14)]
    got = {r.match_id: r.last_5_win_rate_diff for r in X.last_n_win_rate(spark.createDataFrame(rows, COLS)).collect()}
    for i in range(14):
        past = [int(r[4]) for r in rows if r[1] < D[i // 2]][-5:]
        mean = sum(past) / len(past) if past else 0.5
        assert abs(got[i] - (mean - (1 - mean))) < 1e-12


def test_roster_features_by_hand(spark):
    matches = spark.createDataFrame([(1, D[5], 1, 2, True)], COLS)
    players = [(0, D[0], 1, "a"), (0, D[0], 1, "b"), (0, D[2], 1, "b"), (0, D[2], 1, "c"), (0, D[5], 1, "z")]
    r = X.roster_features(matches, spark.createDataFrame(players, "match_id long, match_date date, team_id long, player string")).first()
    assert (r.roster_last_size_diff, round(r.roster_continuity_diff, 6), r.roster_recent_unique_diff, r.any_missing_roster_history) == (2 - 5, round(1 / 3 - 1, 6), 3 - 5, 1)


def test_rosters_are_found_beyond_dates_without_players(spark):
    days = [dt.date(2024, 3, 1) + dt.timedelta(days=i) for i in range(20)]
    matches = spark.createDataFrame([(i, d, 1, 2, True) for i, d in enumerate(days)], COLS)
    players = [(0, days[i], 1, p) for i in range(5) for p in (f"p{i}", f"q{i}")] + [(0, days[i], 2, f"r{i}") for i in range(5)]
    r = X.roster_features(matches, spark.createDataFrame(players, "match_id long, match_date date, team_id long, player string")).where("match_id = 19").first()
    assert (r.roster_last_size_diff, r.roster_recent_unique_diff, r.any_missing_roster_history) == (2 - 1, 10 - 5, 0)


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(100, 140)] + [(5, i) for i in range(6, 30)] + [(1, 2), (2, 1), (3, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {i: 5 for i in range(6, 30)} | {2: 1}


def test_pools_of_teams_that_meet_change_no_rating(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        league = rng.choice([0, 10, 20])
        a, b = rng.sample(range(league, league + 5), 2)
        rows.append((i, D[rng.randrange(20)], a, b, rng.random() < 0.5))
    df = spark.createDataFrame([*rows, (900, D[0], 77, 77, True)], COLS)
    pools = R.meeting_pools(df)
    assert {(r.team_id, r.pool) for r in pools.collect()} == {(t, str(t // 10 * 10)) for t in (*range(5), *range(10, 15), *range(20, 25))} | {(77, "77")}
    numbers = lambda h: {r.match_id: (r.rating_a_pre, r.rating_b_pre, r.elo_delta_a, r.team_a_prior, r.team_b_prior) for r in h.collect()}
    one, many = numbers(R.elo_history(df, 32.0)), numbers(R.elo_history(R.with_pools(df, pools), 32.0, pool="pool"))
    assert one == many and len(one) == 301


def test_days_that_span_batches_move_once(spark, rows):
    whole = {r.match_id: tuple(r) for r in R.elo_history(spark.createDataFrame(rows, COLS), (16.0, 32.0)).where("k = 32").collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r.match_id: tuple(r) for r in R.elo_history(spark.createDataFrame(rows, COLS), (16.0, 32.0)).where("k = 32").collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert R.elo_history(spark.createDataFrame([], COLS)).count() == 0


def test_name_key(spark):
    written = spark.createDataFrame([("QT DIG∞",), ("Cloud 9",), ("Éclair ﬁ",), (None,), ("",), ("Straße №3",)], "n string")
    got = {r.n: r.k for r in S.with_name_key(written, "n", "k").collect()}
    assert got == {"QT DIG∞": "qtdig", "Cloud 9": "cloud9", "Éclair ﬁ": "eclairfi", None: None, "": "", "Straße №3": "straeno3"}
    names = spark.createDataFrame([("Cloud9", "1"), ("Cloud 9", "1"), ("TBD", "2"), ("TBD", "3"), (None, "4")], "team_name string, team_id string")
    assert [tuple(r) for r in J.normalized_unique_map(names).collect()] == [("cloud9", "1")]


def test_ambiguous_key_gets_no_id_and_null_keys_match(spark):
    rows = spark.createDataFrame([("x", None), ("y", "1"), ("z", "1")], "k string, l string")
    cand = spark.createDataFrame([("x", None, 7), ("y", "1", 8), ("y", "1", 9)], "k string, l string, id long")
    got = {r.k: (r.id, r.id_status) for r in J.ambiguous_key_join(rows, cand, ["k", "l"], "id").collect()}
    assert got == {"x": (7, "exact_source_key"), "y": (None, "ambiguous_or_missing_source_key"), "z": (None, "ambiguous_or_missing_source_key")}


def test_checked_join_raises_on_duplicates(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k long"), spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    assert J.checked_join(a, b.where("v = 2"), ["k"]).count() == 2
    with pytest.raises(Exception, match="not unique"):
        J.checked_join(a, b, ["k"]).collect()


def test_reconcile_needs_one_candidate_both_ways(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    left = spark.createDataFrame([(1, "A b", "C", t(10)), (2, "D", "E", t(10)), (3, "F", "F", t(10)), (4, "G", "H", None)], "left_id long, team_a string, team_b string, start timestamp")
    right = spark.createDataFrame([(1, "c", "ab", t(12)), (2, "E", "D", t(9)), (3, "D", "E", t(11)), (4, "F", "F", t(10)), (5, "G", "H", t(1))], "right_id long, team_a string, team_b string, start timestamp")
    assert [tuple(r) for r in J.fixture_reconcile(left, right).collect()] == [(1, 1)]


def test_quality_rules_and_requirement(spark):
    bad = spark.createDataFrame([(1, D[0], 2022, 1, "a", 1, "TBD", True), (1, None, 1, 1, "a", None, "b", None)], "match_id long, match_date date, year int, team_a_id long, team_a_name string, team_b_id long, team_b_name string, team_a_won boolean")
    got = {r.rule: r.violations for r in Q.quality_report(bad, years=(2021, 2023)).collect()}
    assert got == {"null_id": 0, "invalid_date": 1, "year_outside": 1, "missing_team": 1, "same_team": 1, "placeholder": 1, "no_outcome": 1, "duplicate_id": 1}
    with pytest.raises(ValueError):
        Q.require_canonical(bad)


def test_csv_keeps_nan_text_and_years(spark, tmp_path):
    for y in ("2021", "2022", "old"):
        (tmp_path / f"season_{y}").mkdir()
        (tmp_path / f"season_{y}" / "players.csv").write_text('Player,Team\nnan,"a ""b"""\n,NA\n')
    got = files.read_years(spark, str(tmp_path), "players.csv", ["Player", "Team"]).collect()
    assert sorted((r.Player or "", r.Team, r.source_partition_year) for r in got) == sorted([("nan", 'a "b"', 2021), ("", "NA", 2021), ("nan", 'a "b"', 2022), ("", "NA", 2022)])
    inv = files.file_inventory(spark, str(tmp_path / "season_2021" / "players.csv"), ["Player", "Team"]).first()
    assert (inv.n_rows, inv.null_Player, inv.null_Team, len(inv.sha256)) == (2, 1, 0, 64)


def test_typed_matches_reject_unknown_outcomes(spark):
    raw = spark.createDataFrame([("TRUE", "2022-01-01", "2022"), (None, None, None)], "team_a_won string, match_date string, year string")
    assert [r.team_a_won for r in files.typed_matches(raw).collect()] == [True, None]
    with pytest.raises(Exception, match="unreadable"):
        files.typed_matches(raw.withColumn("team_a_won", F.lit("yes"))).collect()


def test_snapshots_are_written_once(spark, tmp_path):
    df = files.snapshot_hash(spark.createDataFrame([('{"b": 1, "a": [2, 3]}',)], "raw string"), "raw")
    assert df.first().canonical == '{"a":[2,3],"b":1}'
    for _ in range(2):
        files.append_snapshots(df, f"file://{tmp_path}/snap", "2024-01-01 00:00:00")
    assert spark.read.parquet(f"file://{tmp_path}/snap").count() == 1


def test_many_small_pools_take_linear_time(spark):
    rows = [(i, D[i % 3], 2 * i, 2 * i + 1, i % 2 == 0, f"p{i:05}") for i in range(2000)] + [(i + 5000, D[4], 2 * i, 2 * i + 1, True, f"p{i:05}") for i in range(2000)]
    h = R.elo_history(spark.createDataFrame(rows, f"{COLS}, league string"), 32.0, pool="league")
    second = {r.match_id: r for r in h.where("match_id >= 5000").collect()}
    assert len(second) == 2000 and all(r.team_a_prior == 1 and (r.rating_a_pre > 1500) == ((r.match_id - 5000) % 2 == 0) for r in second.values())


def test_blocks_plan_days_within_the_limit():
    days = [(D[i], n) for i, n in enumerate([3, 4, 2, 50, 1, 9])]
    assert [b for _, b, _ in RB.planned_blocks(reversed(days), 9)] == [0, 0, 0, 1, 2, 3] and RB.planned_blocks([], 5) == []


@pytest.mark.parametrize("most", [1, 12, 60, 10_000])
def test_blocks_equal_the_fold(spark, most):
    rng = random.Random(most)
    rows = []
    for i in range(260):
        a, b = rng.sample(range(40), 2) if rng.random() < 0.8 else (0, rng.randint(1, 39))  # one team in a fifth of all
        rows.append((i, D[rng.randrange(12)] + dt.timedelta(days=100 * rng.randrange(3)), a, b, rng.random() < 0.5))
    df = spark.createDataFrame(rows, COLS)
    numbers = lambda h: {(r.k, r.match_id): (r.match_date, r.team_a_prior, r.team_b_prior, *(round(x, 7) for x in (r.rating_a_pre, r.rating_b_pre, r.probability_a, r.elo_delta_a))) for r in h.collect()}
    report = []
    assert numbers(RB.elo_history_in_blocks(df, (16.0, 32.0), block_rows=most, share=0.0, report=report)) == numbers(R.elo_history(df, (16.0, 32.0)))
    assert sum(x["rows"] for x in report) == 260 and all(x["rows"] <= most or x["days"] == 1 for x in report)
    assert RB.elo_history_in_blocks(df.where("match_id < 0")).count() == 0


def test_blocks_do_not_grow_in_number_with_the_table(spark):
    rng = random.Random(3)
    rows = [(i, D[0] + dt.timedelta(days=i % 90), *rng.sample(range(30), 2), rng.random() < 0.5) for i in range(900)]
    df = spark.createDataFrame(rows, COLS)
    numbers = lambda h: {(r.k, r.match_id): (r.team_a_prior, r.team_b_prior, round(r.rating_a_pre, 7), round(r.elo_delta_a, 7)) for r in h.collect()}
    report = []
    assert numbers(RB.elo_history_in_blocks(df, (16.0, 32.0), block_rows=10, share=0.0, most_blocks=4, report=report)) == numbers(R.elo_history(df, (16.0, 32.0)))
    assert 4 <= len(report) <= 8 and sum(x["rows"] for x in report) == 900


def test_no_task_but_the_fold_holds_a_pool(spark):
    """One pool: packed runs are all that its task sorts, and rows leave it by an exchange."""
    one = spark.range(60_000).selectExpr("id as match_id", "date_add(date'1995-01-01', cast(id div 40 as int)) as match_date", "id % 500 as team_a_id", "500 + (id * 7) % 499 as team_b_id", "id % 3 = 0 as team_a_won")
    h = R.elo_history(one)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = [r["count"] for r in h.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(spread) == 60_000 and len(spread) == 4 and max(spread) < 30_000
    rows = R.rating_rows(one, 0.0, None).drop("k").repartition("pool").sortWithinPartitions("pool", *R.ORDER)
    packed = rows.mapInArrow(R._packed_runs, R._PACKED).agg(F.sum(F.length("ids") + F.length("played"))).first()[0]
    assert packed < 60_000 * 12


def test_a_day_may_span_runs(spark):
    n = 3 * R.RUN_ROWS + 5
    crowded = spark.range(n).selectExpr("id as match_id", "if(id < 2, date'1969-12-30', if(id < %d, date'1970-01-01', date'1970-01-02')) as match_date" % (n - 2), "1L as team_a_id", "2L + id % 3 as team_b_id", "id % 2 = 0 as team_a_won").unionByName(spark.sql("select -1L as match_id, cast(null as date) as match_date, 1L as team_a_id, 2L as team_b_id, true as team_a_won"))
    got = {r.match_id: (r.team_a_prior, r.rating_a_pre) for r in R.elo_history(crowded, 0.01).collect()}
    assert len(got) == n and got[0] == got[1] == (0, 1500.0)
    assert {got[i] for i in range(2, n - 2)} == {got[2]} and got[2][0] == 2 and got[n - 1][0] == got[n - 2][0] == n - 2


def test_unique_map_reads_names_once_without_a_join(spark):
    rows = [("Cloud9", 1), ("Cloud 9", 1), ("TBD", 1), ("TBD", 2), ("tb d", 1), ("é!", 12), ("E", 12), ("--", 3), (None, 4), ("x", None), ("y", 10), ("Y", 9)]
    made = J.normalized_unique_map(spark.createDataFrame(rows, "team_name string, team_id long"))
    assert sorted(map(tuple, made.collect())) == [("cloud9", "1"), ("e", "12")]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_linked_by_their_text(spark):
    keys = "year int, tournament string, stage string, match_type string, match_name string"
    one, two = (2024, "T", "S", "M", "a vs b"), (2024, "T", "S", "M", None)
    m = spark.createDataFrame([(1, *one, "a", "b"), (2, *one, "a", "b"), (3, *two, "a", "b"), (4, *one, "b", "a")], f"match_id long, {keys}, team_a string, team_b string")
    maps = spark.createDataFrame([("2024", *one[1:], "a", "b", "x", 13), ("2024", *one[1:], "a", "b", "y", 2), ("2023", *one[1:], "a", "b", "z", 1)], f"{keys.replace('year int', 'year string')}, team_a string, team_b string, map string, score int")
    assert sorted((r.match_id, r.map or "") for r in J.linked_maps(m, maps).collect()) == [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, ""), (4, "")]
    players = spark.createDataFrame([(*one, "both", "p"), (*one, "attack", "q"), (*two, "both", "r")], f"{keys}, side string, player string")
    assert sorted((r.match_id, r.player or "") for r in J.linked_rosters(m, players).collect()) == [(1, "p"), (2, "p"), (3, ""), (4, "p")]


def test_reconcile_equals_all_pairs(spark):
    rng = random.Random(15)
    noon = dt.datetime(2024, 3, 1, 22)
    names = lambda flip: (("b", "a") if flip and rng.random() < 0.5 else ("a", "b")) if rng.random() < 0.7 else ("c", "d")
    after = lambda: dt.timedelta(seconds=rng.choice([0, 7200, 7201, 3600, 40_000, rng.randint(0, 900_000), rng.randint(0, 900_000)]))
    make = lambda n, flip: [(i, *names(flip), noon + after()) for i in range(n)]
    left, right = make(60, False), make(60, True)
    left += [(left[3][0], *left[3][1:]), (900, "a", "b", None), (901, "", "b", noon), (902, "a", "a", noon)]
    pairs = [(x[0], y[0]) for x in left for y in right if x[3] and x[1] and x[1] != x[2] and {x[1], x[2]} == {y[1], y[2]} and abs((x[3] - y[3]).total_seconds()) <= 7200]
    want = sorted(p for p in pairs if [x for x, _ in pairs].count(p[0]) == 1 and [y for _, y in pairs].count(p[1]) == 1)
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, team_a string, team_b string, start timestamp")
    assert want and sorted((r.left_id, r.right_id) for r in J.fixture_reconcile(frame(left, "left_id"), frame(right, "right_id")).collect()) == want


def test_a_crowded_slot_makes_no_pairs_of_rows(spark):
    rows = spark.range(100_000).select(F.col("id").alias("left_id"), F.lit("a").alias("team_a"), F.lit("b").alias("team_b"), (F.lit(dt.datetime(2024, 3, 1)) + F.make_dt_interval(secs=(F.col("id") % 600).cast("decimal(18,6)"))).alias("start"))
    alone = spark.createDataFrame([(200_000, "a", "b", dt.datetime(2024, 3, 9))], "left_id long, team_a string, team_b string, start timestamp")
    both = rows.unionByName(alone)
    assert [tuple(r) for r in J.fixture_reconcile(both, both.withColumnRenamed("left_id", "right_id")).collect()] == [(200_000, 200_000)]


def test_one_team_is_asked_about_in_many_tasks(spark):
    states = spark.createDataFrame([("p", 32.0, 1, D[2], 1510.0, 1), ("p", 32.0, 1, D[9], 1490.0, 2)], "pool string, k double, team_id long, match_date date, rating double, n_prior long")
    asks = spark.range(20_000).select("id", F.when(F.col("id") % 500 == 0, None).otherwise(1).cast("long").alias("team_id"), F.when(F.col("id") % 300 == 1, None).otherwise(F.date_add(F.lit(D[0]), (F.col("id") % 20).cast("int"))).alias("as_of"), F.lit(0.5).alias("other"))
    made = R.as_of_states(asks, states)
    for r in made.collect():
        late = r.team_id is not None and r.as_of is not None
        assert r.rating == (1490.0 if late and r.as_of > D[9] else 1510.0 if late and r.as_of > D[2] else 1500.0) and r.other == 0.5
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        windows = [x for x in R.as_of_states(asks, states)._jdf.queryExecution().executedPlan().toString().split("\n") if "Window" in x]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert windows and not any("_ask" in x for x in windows)  # asks themselves pass no window


@pytest.mark.parametrize("span", [1, 3, 40, 100_000])
def test_running_values_do_not_depend_on_segments(spark, span):
    """Sums, last values and tails against a loop over each key's rows, segments of any length, gaps of many."""
    rng = np.random.default_rng(7)
    rows = [(int(k), dt.date(2020, 1, 1) + dt.timedelta(int(d)), int(d) % 5, None if d % 3 else float(d), [int(d), int(d) + 1][: 1 + int(d) % 2]) for k in range(4) for d in rng.choice(900, 60, replace=False)]
    rows.append((None, dt.date(2020, 1, 1), 1, 1.0, [1]))
    df = spark.createDataFrame(rows, "k int, day date, n long, x double, xs array<int>")
    for own in (False, True):
        made = scans.running(df, ["k"], ["day"], scans.calendar("day", span), sums=["n"], lasts=["x"], tails=[("xs", 4)], own=own)
        got = {(r.k, r.day): (r.run_n, r.run_x, r.run_xs) for r in made.collect()}
        want = {}
        for key in range(4):
            total, last, tail = 0, None, []
            for _, day, n, x, xs in sorted(r for r in rows if r[0] == key):
                old = (total, last, tail)
                total, last, tail = total + n, last if x is None else x, (tail + xs)[-4:]
                want[key, day] = (total, last, tail) if own else old
        assert got == want


def test_one_hot_team_keeps_even_tasks(spark):
    """A team that plays daily for 80 years: no task of the windows holds more than a small share of its days."""
    days = spark.range(80 * 365).selectExpr("id as match_id", "date_add(date'1940-01-01', cast(id as int)) as match_date", "1L as team_a_id", "2L + id % 3 as team_b_id", "id % 2 = 0 as team_a_won")
    made = X.team_days(X.team_long(days)).where("team_id = 1")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(per_task) == 80 * 365 and len(per_task) == 4 and max(per_task) < 80 * 365 * 0.4
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    heavy = [line for line in plan.split("\n") if "Window" in line and "_local_" in line]
    assert heavy and all("_segment" in line for line in heavy)
    last = made.orderBy(F.desc("match_date")).first()
    assert (last.n_prior, last.days_since, last.last_10) == (80 * 365 - 1, 1, 0.5)


def test_many_matches_of_a_team_on_one_day(spark):
    """The day's last ten results count, and the ten are chosen before the shuffle."""
    played = spark.range(5000).selectExpr("id as match_id", "if(id < 4999, date'2020-01-01', date'2020-01-02') as match_date", "1L as team_a_id", "2L as team_b_id", "id % 4 <> 0 as team_a_won")
    made = X.team_days(X.team_long(played)).where("team_id = 1 and match_date = '2020-01-02'")
    won = [i % 4 != 0 for i in range(4999)]
    assert made.first().asDict() | {"team_id": 1} == {"team_id": 1, "match_date": dt.date(2020, 1, 2), "n_prior": 4999, "last_5": sum(won[-5:]) / 5, "last_10": sum(won[-10:]) / 10, "days_since": 1}
    assert "WindowGroupLimit" in made._jdf.queryExecution().executedPlan().toString()


def test_map_pools_meet_every_state_before_their_date(spark, monkeypatch):
    monkeypatch.setattr(X, "TEAM_ROWS", 7, raising=False)  # several tasks of whole teams
    days = [dt.date(2024, 3, 1) + dt.timedelta(days=i) for i in range(12)]
    # games on days without matches too, several of one map between two matches, one side without a date
    games = [(i, days[i % 12], "abc"[i * i % 3], i % 2, 1 + i % 4, 1 + (i + 1 + i % 3) % 4, i % 3 != 0) for i in range(40) if i % 4 != (i + 1 + i % 3) % 4]
    matches = [(i, days[j], a, b, True) for i, (j, a, b) in enumerate([(0, 1, 2), (5, 1, 2), (5, 3, 1), (6, 2, 4), (11, 4, 9), (11, 1, 3)])] + [(90, None, 1, 2, True), (91, days[11], 1, None, True)]
    g = spark.createDataFrame(games, "match_id long, match_date date, map string, game int, team_a_id long, team_b_id long, team_a_won boolean")
    made = X.map_pool(spark.createDataFrame(matches, COLS), g, 64.0)
    # a state repeated for all its dates stays in the task that made it
    assert not re.search(r"hashpartitioning\(team_id#\d+L?, (i|at)#", made._jdf.queryExecution().toString())
    states = R.rating_states(X.map_elo(g, 64.0), last_wins=True).collect()

    def pool(team, day):
        last = {s.pool: s.rating for s in sorted(states, key=lambda s: s.match_date) if day is not None and s.team_id == team and s.match_date < day}
        v = list(last.values())
        return (float(np.mean(v)), max(v), min(v), float(np.std(v)), len(v)) if v else (1500.0, 1500.0, 1500.0, 0.0, 0)

    got = {r.match_id: tuple(r)[1:] for r in made.select("match_id", *(c for c in made.columns if c != "match_id")).collect()}
    assert len(got) == len(matches)
    for i, day, a, b, _ in matches:
        x, y = pool(a, day), pool(b, day)
        assert np.allclose(got[i], [*(p - q for p, q in zip(x, y, strict=True)), min(x[4], y[4])]), i


def test_unpacked_history_stays_in_many_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i), 1 + i % 5, 6 + i % 3, i % 2 == 0) for i in range(800)]
        h = R.elo_history(spark.createDataFrame(rows, COLS), 32.0)
        assert h.select(F.spark_partition_id().alias("p")).distinct().count() > 8  # packed runs are small, what comes out of them is not
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
