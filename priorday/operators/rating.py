"""Day-batched ratings: all rows of a day are judged by the state before it and move the state together.

The recursion is sequential in dates and independent between pools (a league, a
map, a value of K, or teams that no chain of matches links). Rows are sorted by pool,
date and id in segments of the calendar, and packed into runs of about ten bytes a
row; a pool's runs go through one task in order, which judges them a day at a time in
numpy and passes the packed ratings on; they are unpacked in many tasks again. So the
task of a pool sorts packed runs only, and holds the ratings of its teams and a few
runs, and what reads the history never shares a task with it."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priorday.functions.scalars import INITIAL, SCALE

from .components import connected_components
from .quantiles import exact_quantiles
from .scans import SPAN, calendar, running

HISTORY = "pool string, k double, match_id long, game int, match_date date, team_a_id long, team_b_id long, team_a_won boolean, rating_a_pre double, rating_b_pre double, probability_a double, elo_delta_a double, team_a_prior long, team_b_prior long"


class Pool:
    """Ratings and counts of one pool, moved day by day; teams are numbered as they appear."""

    def __init__(self, k: float, scale: float, initial: float, last_wins: bool = False):
        self.k, self.scale, self.initial, self.last_wins = k, scale, initial, last_wins
        self.place: dict[int, int] = {}
        self.ratings, self.counts = np.zeros(0), np.zeros(0, np.int64)
        self.moves, self.games = np.zeros(0), np.zeros(0, np.int64)  # of the day that is not closed yet

    def places(self, teams: np.ndarray) -> np.ndarray:
        """Places of teams in `ratings` and `counts`; new teams start at the initial rating."""
        known, which = np.unique(teams, return_inverse=True)
        at = np.array([self.place.setdefault(t, len(self.place)) for t in known.tolist()], np.int64)
        more = len(self.place) - len(self.ratings)
        if more:
            self.ratings = np.concatenate([self.ratings, np.full(more, self.initial)])
            self.counts, self.moves, self.games = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.counts, self.moves, self.games))
        return at[which]

    def judged(self, a: np.ndarray, b: np.ndarray, won: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows (places of both teams, outcome) of the open day, in order; what they move waits for `close`."""
        ra, rb, na, nb = self.ratings[a], self.ratings[b], self.counts[a], self.counts[b]
        p, delta = judgement(ra, rb, won, self.k, self.scale)
        teams, moves = np.stack([a, b], 1).ravel(), np.stack([delta, -delta], 1).ravel()
        if self.last_wins:
            known, at = np.unique(teams[::-1], return_index=True)
            self.moves[known] = moves[::-1][at]  # of a team's rows the last stays
            self.games[known] = 1
        else:
            np.add.at(self.moves, teams, moves)
            np.add.at(self.games, teams, 1)
        return ra, rb, p, delta, na, nb

    def close(self) -> None:
        """The day is over: all its rows move the state."""
        self.ratings += self.moves
        self.counts += self.games
        self.moves[:] = 0
        self.games[:] = 0

    def day(self, a: np.ndarray, b: np.ndarray, won: np.ndarray) -> tuple[np.ndarray, ...]:
        """All rows of one date, in order; the state moves once, after all of them."""
        made = self.judged(a, b, won)
        self.close()
        return made


def judgement(ra: np.ndarray, rb: np.ndarray, won: np.ndarray, k: float | np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the first team, and what the outcome moves."""
    p = 1.0 / (1.0 + 10.0 ** ((rb - ra) / scale))
    return p, k * (won - p)


RUN_DAYS = 8  # days of the calendar that one task sorts and packs
RUN_ROWS = 8192  # rows of a packed run at most
_RUN = "pool string, day int, at long"  # a run's first day, and its place among those of its task
_PACKED = f"{_RUN}, ids binary, played binary"
_RATED = f"{_RUN}, k double, ids binary, played binary, made binary"
_IDS, _PLAYED, _MADE = ("match_id", "game"), ("day", "a", "b", "won"), ("ra", "rb", "na", "nb")


def _bytes(columns: Sequence[np.ndarray]) -> bytes:
    """Integers as differences, byte by byte, so that they compress to those bytes that change."""
    x = np.stack([np.diff(np.asarray(c, np.int64), prepend=0) for c in columns])
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)).tobytes(), 1)


def _integers(raw: bytes, n_columns: int) -> np.ndarray:
    x = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(n_columns, 8, -1)
    return np.cumsum(np.ascontiguousarray(x.transpose(0, 2, 1)).view(np.int64)[:, :, 0], axis=1)


def _packed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pool and ORDER as runs of one pool and segment each."""
    at, schema = 0, pa.schema([("pool", pa.string()), ("day", pa.int32()), ("at", pa.int64()), ("ids", pa.binary()), ("played", pa.binary())])
    for batch in batches:
        if not batch.num_rows:
            continue
        days, pools = batch["match_date"].cast(pa.int32()).to_numpy(), batch["pool"].dictionary_encode()
        codes, names = pools.indices.to_numpy(), pools.dictionary.to_pylist()
        values = {c: batch[c].cast(pa.int64()).to_numpy() for c in (*_IDS, "team_a_id", "team_b_id")}
        won = batch["team_a_won"].cast(pa.int8()).to_numpy()
        cut = (np.flatnonzero((np.diff(codes) != 0) | (np.diff(days // RUN_DAYS) != 0)) + 1).tolist()
        edges = sorted({*cut, *range(0, len(days), RUN_ROWS), len(days)})
        out: list[tuple] = []
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            ids = _bytes([values[c][s:e] for c in _IDS])
            played = _bytes([days[s:e], values["team_a_id"][s:e], values["team_b_id"][s:e], won[s:e]])
            out.append((names[codes[s]], int(days[s]), at, ids, played))
            at += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _folded(scale: float, initial: float, last_wins: bool):
    """Packed runs, sorted by pool, K and time, with the ratings before each row and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, last = None, None, None
        for batch in batches:
            pools, ks = batch["pool"].to_pylist(), batch["k"].to_pylist()
            made, size, since = [], 0, 0
            for i, (pool, k) in enumerate(zip(pools, ks, strict=True)):
                if (pool, k) != key:
                    key, last, state = (pool, k), None, Pool(k, scale, initial, last_wins)
                days, a, b, won = _integers(batch["played"][i].as_py(), len(_PLAYED))
                step = np.diff(days)
                if (step < 0).any() or (last is not None and days[0] < last):
                    raise ValueError("dates must rise inside a pool")
                at, bt, parts = state.places(a), state.places(b), []
                edges = [0, *(np.flatnonzero(step) + 1).tolist(), len(days)]
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    if last is not None and days[s] > last:
                        state.close()
                    last = days[s]  # the run's last day may go on in the next one
                    ra, rb, _, _, na, nb = state.judged(at[s:e], bt[s:e], won[s:e].astype(float))
                    parts.append((ra.view(np.int64), rb.view(np.int64), na, nb))
                made.append(np.concatenate([np.concatenate(x) for x in zip(*parts, strict=True)]).tobytes())
                size += len(made[-1])
                if size > 8_000_000 or i + 1 == len(pools):
                    yield pa.RecordBatch.from_pydict({c: batch[c].slice(since, i + 1 - since) for c in ("pool", "day", "at", "k", "ids", "played")} | {"made": pa.array(made, pa.binary())})
                    made, size, since = [], 0, i + 1

    return run


def _unpacked(scale: float):
    """HISTORY rows of rated runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pool, k, ids, played, made in zip(*(batch[c] for c in ("pool", "k", "ids", "played", "made")), strict=True):
                match_id, game = _integers(ids.as_py(), len(_IDS))
                days, a, b, won = _integers(played.as_py(), len(_PLAYED))
                ra, rb, na, nb = np.frombuffer(made.as_py(), np.int64).reshape(len(_MADE), -1)
                ra, rb = ra.view(float), rb.view(float)
                p, delta = judgement(ra, rb, won.astype(float), k.as_py(), scale)
                columns = [pa.repeat(pool, len(won)), pa.repeat(k, len(won)), match_id, game.astype(np.int32), pa.array(days.astype(np.int32)).cast(pa.date32()), a, b, won.astype(bool), ra, rb, p, delta, na, nb]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [x.split()[0] for x in HISTORY.split(", ")])

    return run


def elo_history(matches: DataFrame, k: float | Sequence[float] = 32.0, pool: str | None = None, scale: float = SCALE, initial: float = INITIAL, last_wins: bool = False) -> DataFrame:
    """Pre-match ratings, probability, delta and prior counts of every match (see HISTORY).

    matches: match_id, match_date, team_a_id, team_b_id, team_a_won, optional game.
    k: one value or several; each is a pool of its own and runs in parallel.
    pool: a column with groups of teams that never meet across groups.
    last_wins: of a team's rows of one day only the last one moves it (by match_id, game)."""
    ks = [float(x) for x in (k if isinstance(k, Sequence) else [k])]
    segment = F.floor(F.unix_date("match_date") / RUN_DAYS)
    runs = rating_rows(matches, 0.0, pool).drop("k").repartition("pool", segment).sortWithinPartitions("pool", *ORDER).mapInArrow(_packed_runs, _PACKED)
    dealt = runs.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).repartition("pool", "k").sortWithinPartitions("pool", "k", "day", "at")
    # a number of its own keeps adaptive execution from joining parts that are small only while packed
    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.mapInArrow(_folded(scale, initial, last_wins), _RATED).repartition(parts, "pool", "k", "day", "at").mapInArrow(_unpacked(scale), HISTORY)


ORDER = ("match_date", "match_id", "game")


def rating_rows(matches: DataFrame, k: float | Sequence[float], pool: str | None) -> DataFrame:
    """The columns that a rating reads, once for each K; a match without a date has no place in time."""
    ks = [float(x) for x in (k if isinstance(k, Sequence) else [k])]
    game = F.col("game") if "game" in matches.columns else F.lit(0)
    return matches.where(F.col("match_date").isNotNull()).select(
        (F.col(pool).cast("string") if pool else F.lit("all")).alias("pool"),
        F.explode(F.array(*map(F.lit, ks))).alias("k"),
        F.col("match_id").cast("long").alias("match_id"),
        game.cast("int").alias("game"),
        "match_date",
        F.col("team_a_id").cast("long").alias("team_a_id"),
        F.col("team_b_id").cast("long").alias("team_b_id"),
        "team_a_won",
    )


def meeting_pools(matches: DataFrame) -> DataFrame:
    """(team_id, pool): teams linked by any chain of matches share a pool, named by its smallest team.

    Teams of different pools never move each other, so their ratings can be folded
    in parallel. Pairs are made distinct first; nothing is collected."""
    pairs = matches.select(F.col("team_a_id").cast("long").alias("a"), F.col("team_b_id").cast("long").alias("b"))
    found = connected_components(pairs).select(F.col("node").alias("team_id"), F.col("component").cast("string").alias("pool"))
    teams = pairs.select(F.explode(F.array("a", "b")).alias("team_id")).distinct()
    return teams.join(found, "team_id", "left").select("team_id", F.coalesce("pool", F.col("team_id").cast("string")).alias("pool"))


def with_pools(matches: DataFrame, pools: DataFrame) -> DataFrame:
    """Matches with the pool of their teams (see meeting_pools)."""
    return matches.join(pools.select(F.col("team_id").alias("team_a_id"), "pool"), "team_a_id")


def with_unseen(history: DataFrame) -> DataFrame:
    return history.withColumn("any_team_unseen", (F.col("team_a_prior") == 0) | (F.col("team_b_prior") == 0))


def rating_states(history: DataFrame, last_wins: bool = False) -> DataFrame:
    """(pool, k, team_id, match_date, rating, n_prior): every team's state at the end of each of its days."""
    side = lambda s, o, sign: F.struct(F.col(f"team_{s}_id").alias("team_id"), F.col(f"rating_{s}_pre").alias("pre"), (F.col("elo_delta_a") * sign).alias("delta"), F.col(f"team_{s}_prior").alias("prior"))
    long = history.select("pool", "k", "match_date", "match_id", "game", F.explode(F.array(side("a", "b", 1.0), side("b", "a", -1.0))).alias("t"))
    moved = F.max_by("t.delta", F.struct("match_id", "game")) if last_wins else F.sum("t.delta")
    played = F.lit(1) if last_wins else F.count(F.lit(1))
    return (
        long.groupBy("pool", "k", F.col("t.team_id").alias("team_id"), "match_date")
        .agg((F.max("t.pre") + moved).alias("rating"), (F.max("t.prior") + played).cast("long").alias("n_prior"))
        .select("pool", "k", "team_id", "match_date", "rating", "n_prior")
    )


def elo_final(history: DataFrame) -> DataFrame:
    """(pool, k, team_id, rating): the last state of every team."""
    return rating_states(history).groupBy("pool", "k", "team_id").agg(F.max_by("rating", "match_date").alias("rating"))


def as_of_states(asks: DataFrame, states: DataFrame, team: str = "team_id", day: str = "as_of", span: int = SPAN) -> DataFrame:
    """Each ask with the team's state strictly before its date: rating, n_prior, last_date (defaults where there is none).

    The days that a team is asked about and those of its states are read in date order
    and the last state carried forward, in segments of `span` days (see `scans`) that hold
    at most two rows a team and calendar day, however many asks there are. Asks then find
    their team and day; many of one day are split by the join."""
    nothing = F.lit(None).cast("struct<rating:double,n_prior:bigint,last_date:date>")
    s = states.select(F.col("team_id").alias("_team"), F.col("match_date").alias("_day"), F.lit(1).alias("_order"), F.struct("rating", "n_prior", F.col("match_date").alias("last_date")).alias("_state"))
    a = asks.select(F.col(team).alias("_team"), F.col(day).alias("_day")).where("_team is not null and _day is not null").distinct().withColumns({"_order": F.lit(0), "_state": nothing})
    seen = running(s.unionByName(a), ["_team"], ["_day", "_order"], calendar("_day", span), lasts=["_state"], own=True).where("_order = 0").select("_team", "_day", F.col("run__state").alias("_seen"))
    rows = asks.select(F.col(team).alias("_team"), F.col(day).alias("_day"), F.struct("*").alias("_ask"))
    return rows.join(seen, ["_team", "_day"], "left").select("_ask.*", F.coalesce("_seen.rating", F.lit(INITIAL)).alias("rating"), F.coalesce("_seen.n_prior", F.lit(0)).cast("long").alias("n_prior"), F.col("_seen.last_date").alias("last_date"))


def rating_distribution(states: DataFrame, dates: Sequence[str]) -> DataFrame:
    """Per cut-off date: teams rated so far, mean, population deviation, range and quartiles."""
    cuts = states.sparkSession.createDataFrame([(d,) for d in dates], "cut string").select(F.to_date("cut").alias("cut"))
    last = states.join(F.broadcast(cuts), F.col("match_date") <= F.col("cut")).groupBy("cut", "team_id").agg(F.max_by("rating", "match_date").alias("rating"))
    r = F.col("rating")
    marks = exact_quantiles(last, ["cut"], "rating", [0.25, 0.5, 0.75]).groupBy("cut").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
    marks = marks.select("cut", F.col("`0.25`").alias("p25"), F.col("`0.5`").alias("median"), F.col("`0.75`").alias("p75"))
    made = last.groupBy("cut").agg(F.count(F.lit(1)).alias("n_teams"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"))
    return made.join(marks, "cut").select("cut", "n_teams", "mean", "std", "min", "p25", "median", "p75", "max")
