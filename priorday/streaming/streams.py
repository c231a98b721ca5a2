"""Streaming forms: the ledger's polling pass per micro-batch, appends alone, and day-batched ratings that apply a day once it is closed."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from priorday.operators.ledger import RECORD, as_records, ledger_append, ledger_steps
from priorday.operators.rating import HISTORY, Pool, rating_states
from priorday.sources.commits import CommittedTables
from priorday.sources.shared import forget, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ledger_stream(records: DataFrame, read: Callable[[], DataFrame], path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream of records to the Parquet ledger at `path`; a replayed batch adds nothing.

    `read` gives the ledger as it is. Of it only the ids that a batch brings again are
    looked at, so a batch that is small enough to broadcast never shuffles the ledger."""

    def apply(batch: DataFrame, _: int) -> None:
        batch.persist()
        known = read().join(batch.select("record_id").distinct(), "record_id", "left_semi")
        ledger_append(batch, known).write.mode("append").parquet(path)
        batch.unpersist()

    writer = records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 minutes")).start()


#: What polls land, by kind: a line of JSON for each row, and one with a null match_id where a poll found nothing.
POLLS = {
    "fixtures": "match_id string, team_a_id long, team_b_id long, team_a_name string, team_b_name string, scheduled_at timestamp",
    "events": "match_id string, team_a string, team_b string, start timestamp",
    "quotes": "match_id string, captured_at timestamp, start timestamp, odds_a double, odds_b double",
    "results": "match_id string, status string, forfeit boolean, winner_id long, opponent_ids array<long>",
}
_STAMP = "polled_at timestamp, sequence long"
#: The tables that a batch changes together: the ledger, the last known result of every match, and one row per pass.
POLL_TABLES = {
    "ledger": ", ".join(f"{c} {t}" for c, t in RECORD.items()),
    "results": f"{POLLS['results']}, {_STAMP}",
    "passes": "batch long, now timestamp, fixtures long, appended long",
}


def poll_feed(spark: SparkSession, home: str, files: int = 1) -> DataFrame:
    """The landed polls as one stream: a file stream for each kind, `files` files of each a batch, rows as structs by kind."""
    feeds = []
    for kind, columns in POLLS.items():
        rows = spark.readStream.schema(f"{columns}, {_STAMP}").option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).json(f"{home}/{kind}")
        others = [F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in c.split(', '))}>").alias(k) if k != kind else F.struct(*(x.split(" ")[0] for x in c.split(", "))).alias(k) for k, c in POLLS.items()]
        feeds.append(rows.select("polled_at", "sequence", "match_id", F.lit(kind).alias("kind"), *others))
    return reduce(DataFrame.unionAll, feeds)


def ledger_polls(feed: DataFrame, tables: CommittedTables, states: DataFrame, checkpoint: str, available_now: bool = True, before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """The polling loop: every micro-batch of landed polls is one pass of the ledger at the time of its last poll.

    Of each match the last listing of the batch counts, and the last result of all batches; quotes all count. Late rows
    count in the batch that brings them. A pass reads the last commit and adds rows to POLL_TABLES with one commit of
    the batch's id, so that a batch which is lost half way is done again from the same tables, and one that was
    committed before it was lost changes nothing when it is replayed. `before_commit` is called when all is staged."""
    last_of = lambda rows, kind: rows.where(F.col("kind") == kind).groupBy("match_id").agg(F.max_by(kind, F.struct("polled_at", "sequence")).alias("x")).select("x.*")

    def apply(batch: DataFrame, number: int) -> None:
        committed, at = tables.last()
        if number <= committed:
            return
        batch.persist()
        now = batch.agg(F.date_format(F.max("polled_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        if now is not None:
            rows = batch.where("match_id is not null")
            results = rows.where("kind = 'results'").select("results.*", "polled_at", "sequence")
            known = tables.read("results", at).unionByName(results).groupBy("match_id").agg(F.max_by(F.struct("status", "forfeit", "winner_id", "opponent_ids"), F.struct("polled_at", "sequence")).alias("x")).select("match_id", "x.*")
            fixtures = written(last_of(rows, "fixtures"), "fixtures")
            events = last_of(rows, "events").withColumnRenamed("match_id", "right_id")
            steps = ledger_steps(fixtures, events, rows.where("kind = 'quotes'").select("quotes.*"), known, tables.read("ledger", at), states, now)
            added = {"ledger": [tables.stage("ledger", as_records(reduce(DataFrame.unionByName, steps)))], "results": [tables.stage("results", results)]}
            counts = tables.read("ledger", added).agg(F.count(F.lit(1)).alias("appended")).crossJoin(fixtures.agg(F.count(F.lit(1)).alias("fixtures")))
            added["passes"] = [tables.stage("passes", counts.select(F.lit(number).cast("long").alias("batch"), F.to_timestamp(F.lit(now)).alias("now"), "fixtures", "appended"))]
            if before_commit:
                before_commit(number)
            tables.commit(number, added)
            for used in (fixtures, *steps):
                forget(used)
        batch.unpersist()

    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 minutes")).start()


RATED = f"{HISTORY}, late boolean"


class DayRatings(StatefulProcessor):
    """Holds a pool's open days; when the watermark passes a day's end, the day moves the ratings and is emitted.

    A row of a day that the watermark has passed when it comes is emitted as late and moves nothing. State is packed
    arrays: the rows of open days in one value, and teams with ratings and counts in blocks of a map, of which only
    those of the closed days' teams are read and written. One timer stands at the end of the first open day. Teams may
    come with an initial state."""

    DAY = 86_400_000
    BLOCKS = 4096
    OPEN = {"day": np.int64, "match_id": np.int64, "a": np.int64, "b": np.int64, "won": np.bool_}
    TEAMS = {"team": np.int64, "rating": np.float64, "n": np.int64}

    def __init__(self, k: float, scale: float, initial: float):
        self.k, self.scale, self.initial = k, scale, initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", ", ".join(f"{c} binary" for c in self.OPEN))
        self.teams = handle.getMapState("teams", "block int", ", ".join(f"{c} binary" for c in self.TEAMS))

    @staticmethod
    def _unpacked(raw: tuple | None, kinds: dict[str, type]) -> list[np.ndarray]:
        return [np.frombuffer(x, kind) for x, kind in zip(raw or [b""] * len(kinds), kinds.values(), strict=True)]

    @staticmethod
    def _packed(columns: Iterable[np.ndarray], kinds: dict[str, type]) -> tuple:
        return tuple(np.asarray(x, kind).tobytes() for x, kind in zip(columns, kinds.values(), strict=True))

    def _held(self) -> list[np.ndarray]:
        return self._unpacked(self.open.get() if self.open.exists() else None, self.OPEN)

    def _block(self, teams: np.ndarray) -> np.ndarray:
        return ((teams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64) % self.BLOCKS

    def _write(self, teams: np.ndarray, ratings: np.ndarray, counts: np.ndarray) -> None:
        """Whole blocks of teams."""
        block = self._block(teams)
        for i in np.unique(block).tolist():
            mine = block == i
            self.teams.updateValue((i,), self._packed((teams[mine], ratings[mine], counts[mine]), self.TEAMS))

    def _wait(self, days: np.ndarray) -> None:
        if len(days):
            self.handle.registerTimer((int(days.min()) + 1) * self.DAY)

    def _rows(self, key, day, match_id, a, b, won, made, late: bool) -> pd.DataFrame:
        dates = (pd.Timestamp(0) + pd.to_timedelta(day, "D")).date
        columns = (key[0], self.k, match_id, 0, dates, a, b, won, *made, late)
        return pd.DataFrame(dict(zip((x.split()[0] for x in RATED.split(", ")), columns, strict=True)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._write(*(initialState[c].to_numpy() for c in ("team_id", "rating", "n_prior")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        parts = [self._held()]
        for batch in rows:
            new = [batch[c].to_numpy() for c in ("day", "match_id", "team_a_id", "team_b_id", "team_a_won")]
            late = (new[0] + 1) * self.DAY <= passed
            if late.any():
                none = np.full(int(late.sum()), np.nan)
                yield self._rows(key, *(x[late] for x in new), (none, none, none, none, [None] * len(none), [None] * len(none)), True)
            parts.append([x[~late] for x in new])
        day, match_id, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(day):
            return
        order = np.lexsort((match_id, day))
        last = np.append((np.diff(day[order]) != 0) | (np.diff(match_id[order]) != 0), True)  # of a match sent twice the later row stays
        self.open.update(self._packed((x[order][last] for x in (day, match_id, *rest)), self.OPEN))
        self._wait(day)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())  # all closed days at once, in order
        rows = self._held()
        n = int(np.searchsorted((rows[0] + 1) * self.DAY, end, "right"))
        if n:
            day, match_id, a, b, won = (x[:n] for x in rows)
            pool = Pool(self.k, self.scale, self.initial)
            blocks = np.unique(self._block(np.concatenate([a, b])))
            stored = [self._unpacked(self.teams.getValue((i,)), self.TEAMS) for i in blocks.tolist() if self.teams.containsKey((i,))]
            if stored:
                teams, ratings, counts = (np.concatenate(x) for x in zip(*stored, strict=True))
                held = pool.places(teams)
                pool.ratings[held], pool.counts[held] = ratings, counts
            at, bt = pool.places(a), pool.places(b)
            cut = [0, *(np.flatnonzero(np.diff(day)) + 1).tolist(), n]
            made = [np.concatenate(x) for x in zip(*(pool.day(at[s:e], bt[s:e], won[s:e].astype(float)) for s, e in zip(cut[:-1], cut[1:], strict=True)), strict=True)]
            self._write(np.array(list(pool.place), np.int64), pool.ratings, pool.counts)
            self.open.update(self._packed((x[n:] for x in rows), self.OPEN))
            yield self._rows(key, day, match_id, a, b, won, made, False)
        self._wait(rows[0][n:])

    def close(self) -> None:
        pass


def rated_stream(results: DataFrame, k: float = 64.0, scale: float = 400.0, initial: float = 1500.0, delay: str = "0 seconds", states: DataFrame | None = None) -> DataFrame:
    """RATED rows of a stream of results (pool, played_at, landed_at, match_id, team_a_id, team_b_id, team_a_won).

    The watermark follows `landed_at`, when a row came in, so that Spark drops none: a day is applied when the watermark
    passes its end, and rows of days passed before are given as late, without ratings, for the late table.
    states: (pool, team_id, rating, n_prior) to start from, as `last_states` gives them."""
    marked = results.withWatermark("landed_at", delay).withColumn("day", F.unix_date(F.to_date("played_at")).cast("long"))
    start = None if states is None else states.select("pool", F.col("team_id").cast("long").alias("team_id"), "rating", F.col("n_prior").cast("long").alias("n_prior")).groupBy("pool")
    return marked.groupBy("pool").transformWithStateInPandas(DayRatings(k, scale, initial), RATED, "append", "EventTime", start)


def last_states(history: DataFrame) -> DataFrame:
    """(pool, team_id, rating, n_prior) after all rows of a history of one K, to start a stream from."""
    return rating_states(history).groupBy("pool", "team_id").agg(F.max_by("rating", "match_date").alias("rating"), F.max_by("n_prior", "match_date").alias("n_prior"))


def elo_stream(results: DataFrame, k: float = 64.0, scale: float = 400.0, initial: float = 1500.0, delay: str = "0 seconds") -> DataFrame:
    """HISTORY rows of a stream of results (pool, played_at, match_id, team_a_id, team_b_id, team_a_won).

    A row is taken to land when it was played: a day is applied when the watermark passes its end, and rows behind the
    watermark are dropped by Spark. `rated_stream` tells both times apart and keeps late rows."""
    return rated_stream(results.withColumn("landed_at", F.col("played_at")), k, scale, initial, delay).where("not late").drop("late")
