"""The ratings of `rating` for a pool that is too large for one task.

Days are joined to blocks, as many as hold at most `share` matches a team (below one
half most teams of a block then meet few others) or `block_rows` matches. In a block
only teams that some chain of its matches links move each other, so its components
are folded in parallel, many small ones in a task. A day over the limit is a block
of its own, and there nothing is folded: every row is judged by the state before it,
by two joins, and the state moves by a grouped sum. Blocks follow each other; each
reads the state table that the one before has written. So a task holds a block's
largest component at most, whatever the pool's size, and a lost executor costs one
block.

A block may hold 1/`most_blocks` of all matches in any case, since the number of jobs
grows with the number of blocks; so a large table has no more blocks than twice that,
and its tasks grow with it at that rate. Where a block has more matches than there
are teams its teams are as good as all linked, and its components are not looked for.
The driver keeps a number for each date."""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorday.functions.scalars import INITIAL, SCALE, win_probability
from priorday.sources.shared import forget, scratch, written

from .components import connected_components
from .rating import HISTORY, ORDER, Pool, rating_rows, rating_states

BLOCK_ROWS = 50_000  # matches that one task may fold
SHARE = 0.35  # matches of a block for each team
MOST_BLOCKS = 400  # a block may hold this part of all matches
GROUP_ROWS = 5_000  # matches of small components folded together
STATES = "k double, team_id long, rating double, n_prior long"


def planned_blocks(days: Iterable[tuple[date, int]], most: int) -> list[tuple[date, int, int]]:
    """(date, block, matches) in order of dates: a block's matches stay within `most` unless it is a single day."""
    out, block, held = [], 0, 0
    for day, n in sorted(days):
        if held and held + n > most:
            block, held = block + 1, 0
        out.append((day, block, n))
        held += n
    return out


def _fold(scale: float, initial: float):
    numbers = ("rating_a_pre", "rating_b_pre", "probability_a", "elo_delta_a", "team_a_prior", "team_b_prior")
    names = [x.split()[0] for x in HISTORY.split(", ")]

    def run(rows: pa.Table, states: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ORDER])
        pool = Pool(float(rows["k"][0].as_py()), scale, initial)
        held = pool.places(states["team_id"].to_numpy())
        pool.ratings[held], pool.counts[held] = states["rating"].to_numpy(), states["n_prior"].to_numpy()
        a, b = (pool.places(rows[f"team_{s}_id"].to_numpy()) for s in "ab")
        won = rows["team_a_won"].cast(pa.int8()).to_numpy().astype(float)
        edges = [0, *(np.flatnonzero(np.diff(rows["match_date"].cast(pa.int32()).to_numpy())) + 1).tolist(), len(won)]
        made = zip(*(pool.day(a[s:e], b[s:e], won[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)), strict=True)
        for name, values in zip(numbers, made, strict=True):
            rows = rows.append_column(name, pa.array(np.concatenate(values)))
        return rows.select(names)

    return run


def _folded(rows: DataFrame, states: DataFrame, n: int, scale: float, initial: float) -> DataFrame:
    """A block of several days: components in groups, each with the states of its teams."""
    groups = max(-(-n // GROUP_ROWS), 1)
    rows = rows.withColumn("part", F.pmod("component", F.lit(groups)))
    teams = rows.select("k", "part", F.explode(F.array("team_a_id", "team_b_id")).alias("team_id")).distinct()
    held = teams.join(states, ["k", "team_id"]).select(F.col("k").alias("_k"), F.col("part").alias("_part"), "team_id", "rating", "n_prior")
    return rows.groupBy("k", "part").cogroup(held.groupBy("_k", "_part")).applyInArrow(_fold(scale, initial), HISTORY)


def _joined(rows: DataFrame, states: DataFrame, scale: float, initial: float) -> DataFrame:
    """A single day: every row judged by the states before it."""
    for s in "ab":
        mine = states.select("k", F.col("team_id").alias(f"team_{s}_id"), F.col("rating").alias(f"_r{s}"), F.col("n_prior").alias(f"_n{s}"))
        rows = rows.join(mine, ["k", f"team_{s}_id"], "left").withColumns({f"rating_{s}_pre": F.coalesce(f"_r{s}", F.lit(initial)), f"team_{s}_prior": F.coalesce(f"_n{s}", F.lit(0)).cast("long")})
    rows = rows.withColumn("probability_a", win_probability(F.col("rating_a_pre"), F.col("rating_b_pre"), scale))
    rows = rows.withColumn("elo_delta_a", F.col("k") * (F.col("team_a_won").cast("int") - F.col("probability_a")))
    return rows.select(*(x.split()[0] for x in HISTORY.split(", ")))


def elo_history_in_blocks(matches: DataFrame, k: float | Sequence[float] = 32.0, scale: float = SCALE, initial: float = INITIAL, block_rows: int = BLOCK_ROWS, share: float = SHARE, most_blocks: int = MOST_BLOCKS, report: list[dict] | None = None) -> DataFrame:
    """HISTORY rows as `elo_history` gives them for one pool; see the module's text.

    `report`, if given, gets block, days, rows and seconds of every block."""
    spark = matches.sparkSession
    rows = rating_rows(matches, k, None)
    one = rating_rows(matches, 0.0, None)
    days = [(r.match_date, r.n) for r in one.groupBy("match_date").agg(F.count(F.lit(1)).alias("n")).collect()]
    teams = one.select(F.explode(F.array("team_a_id", "team_b_id")).alias("t")).agg(F.count_distinct("t")).first()[0]
    most = max(block_rows, int(share * teams), -(-sum(n for _, n in days) // most_blocks))
    plan = planned_blocks(days, most)
    home, out = scratch(spark, "blocks"), scratch(spark, "rated")
    blocks = spark.createDataFrame([(d, b) for d, b, _ in plan], "match_date date, block long")
    dealt = rows.join(F.broadcast(blocks), "match_date")
    if most > teams:
        named = dealt.withColumn("component", F.xxhash64("block"))
    else:
        # a team in a block is a node; names that collide only join components
        node = lambda s: F.xxhash64("block", f"team_{s}_id")
        pairs = one.join(F.broadcast(blocks), "match_date").select(node("a").alias("a"), node("b").alias("b"))
        named = dealt.withColumn("node", node("a")).join(connected_components(pairs), "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    named.repartition("block", F.pmod(F.xxhash64("match_id"), F.lit(4))).write.partitionBy("block").parquet(home)  # few files a block
    schema = named.drop("block").schema
    states = written(spark.createDataFrame([], STATES), "ratings")
    for block in range(plan[-1][1] + 1 if plan else 0):
        began, sizes = time.time(), [n for _, b, n in plan if b == block]
        mine = spark.read.schema(schema).parquet(f"{home}/block={block}")
        made = _folded(mine, states, sum(sizes), scale, initial) if len(sizes) > 1 or sum(sizes) <= most else _joined(mine, states, scale, initial)
        made.write.parquet(f"{out}/block={block}")
        moved = rating_states(spark.read.schema(HISTORY).parquet(f"{out}/block={block}")).groupBy("k", "team_id").agg(F.max_by("rating", "match_date").alias("rating"), F.max_by("n_prior", "match_date").alias("n_prior"))
        then = written(states.join(moved, ["k", "team_id"], "left_anti").select(*moved.columns).unionByName(moved), "ratings")
        forget(states)
        states = then
        if report is not None:
            report.append({"block": block, "days": len(sizes), "rows": sum(sizes), "seconds": time.time() - began})
    if not plan:
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).parquet(*(f"{out}/block={b}" for b in range(plan[-1][1] + 1)))
