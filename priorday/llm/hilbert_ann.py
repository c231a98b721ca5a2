"""Nearest neighbours by inner product: shifted Hilbert orderings, then pruned blocks.

1. Several random projections with random shifts turn each vector's direction into
   a cell on a Hilbert curve. Rows are range-partitioned and sorted by curve key;
   each query takes its neighbours in a window of every ordering, and the windows
   merge into the query's k best so far.
2. The k-th best score is the query's bar. Blocks of rows that are neighbours on
   the first curve are bounded by centre and radius; a query skips each block whose
   bound misses its bar and reranks the rest. No true neighbour is lost.

In the second step a row moves once, to its block; queries are sent to the blocks
and stream past the rows held there, so a task holds one block and one batch of
queries. On vectors without structure no block can be skipped and that step reads
all pairs of query and row in blocks, never as rows.

Defined results: vectors that are null, empty, all zero or hold null or non-finite
components take no part, neither do rows with a null id. Only vectors of equal
length are compared. Rows that share an id with the query are not its neighbours;
repeated rows of one id count once, by their best score. Ties go to the smaller
id. With fewer than k candidates all are returned. An empty table gives an empty
result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 20
CURVES = 4
AXES = 8
CELL_BITS = 6
WINDOW = 256  # rows on either side of a query in an ordering
BLOCK = 16384  # rows of a block
CHUNK = 2048


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer cells (rows x axes), each below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    axes, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the turns of the sub-cubes, from coarse to fine
        low = q - 1
        for i in range(axes):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, axes):  # Gray code
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_keys(vectors: np.ndarray, curve: int, axes: int = AXES, bits: int = CELL_BITS) -> np.ndarray:
    """Keys of unit directions on one shifted curve."""
    dim = vectors.shape[1]
    rng = np.random.Generator(np.random.PCG64([curve, dim]))
    basis = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : min(axes, dim)]
    shift = rng.uniform(-0.25, 0.25, basis.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = np.floor((unit @ basis * np.sqrt(dim) / 6 + 0.5 + shift / 2) * (1 << bits))
    return hilbert_index(np.clip(cells, 0, (1 << bits) - 1), bits)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fine).withColumn("dim", F.size("embedding"))


def best(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids among rows, with scores; ties to the smaller id."""
    score = (rows * query).sum(axis=1)
    order = np.lexsort((ids, -score))
    ids, score = ids[order], score[order]
    once = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[once], score[once]


FOUND = "query_id long, vec_id array<long>, score array<double>"


def _found(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], names=["query_id", "vec_id", "score"])


def keyed(rows: DataFrame, curves: int) -> DataFrame:
    """Every row once per curve, with its key."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                vectors = _matrix(part.column("embedding"))
                for c in range(curves):
                    extra = [pa.array(np.full(len(vectors), c, np.int32)), pa.array(curve_keys(vectors, c))]
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in part.schema.names), *extra], names=[*part.schema.names, "curve", "key"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", curve int, key long"
    return rows.mapInArrow(run, schema)


def window_neighbours(rows: DataFrame, k: int, curves: int, window: int) -> DataFrame:
    """The k best of each query's window in each ordering (one row per query and curve)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "dim", "key", "vec_id"]
    placed = keyed(rows, curves).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        held = None  # rows that later windows may still need; `done` of them had their own turn
        done = 0

        def turn(table: pa.Table, first: int, last: int):
            group = table["curve"].to_numpy().astype(np.int64) << 32 | table["dim"].to_numpy()
            ids, asks = table["vec_id"].to_numpy(), table["is_query"].to_numpy()
            out = []
            for i in (np.flatnonzero(asks[first:last]) + first).tolist():
                a, b = max(0, i - window), min(len(ids), i + window + 1)
                near = np.flatnonzero((group[a:b] == group[i]) & (ids[a:b] != ids[i]))
                if len(near):
                    rows = _matrix(table["embedding"].slice(a, b - a).combine_chunks()) if group[a] == group[b - 1] else None
                    rows = rows[near] if rows is not None else np.stack([np.array(table["embedding"][a + j].as_py(), float) for j in near.tolist()])
                    own = np.array(table["embedding"][i].as_py(), float)
                    found, score = best(own, ids[a:b][near], rows, k)
                    out.append((int(ids[i]), found.tolist(), score.tolist()))
            return out

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows - done < CHUNK + window:
                continue
            held = held.combine_chunks()
            last = held.num_rows - window
            out = turn(held, done, last)
            if out:
                yield _found(out)
            keep = max(0, last - window)
            held, done = held.slice(keep), last - keep
        if held is not None and held.num_rows > done:
            out = turn(held.combine_chunks(), done, held.num_rows)
            if out:
                yield _found(out)

    return placed.mapInArrow(run, FOUND)


def _reranked(k: int):
    """mapInArrow function over rows sorted by (block, dim, bar given): a block's vectors, then the queries sent to it."""

    def score(q_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, x_ids: np.ndarray, x: np.ndarray, centre: np.ndarray, radius: float) -> list[tuple]:
        out = []
        slack = 1e-9 * (1 + np.abs(bar))
        slack[np.isinf(slack)] = 0
        live = np.flatnonzero(q @ centre + np.linalg.norm(q, axis=1) * radius >= bar - slack)
        for at in range(0, len(live), 256):
            some = live[at : at + 256]
            rough = q[some] @ x.T
            for i, row in zip(some.tolist(), rough, strict=True):
                near = np.flatnonzero((row >= bar[i] - slack[i]) & (x_ids != q_ids[i]))
                if len(near) > 4 * k and np.isinf(bar[i]):
                    edge = np.partition(row[near], len(near) - k)[len(near) - k]
                    if len(np.unique(x_ids[near])) == len(near):
                        near = near[row[near] >= edge - 1e-9 * (1 + abs(edge))]
                if len(near):
                    ids, exact = best(q[i], x_ids[near], x[near], k)
                    out.append((int(q_ids[i]), ids.tolist(), exact.tolist()))
        return out

    def run(batches):
        at, ids, rows, ball = None, [], [], None  # the block held: its place, ids, vectors; centre and radius once it is whole
        for batch in batches:
            place = batch.column("block").to_numpy().astype(np.int64) << 32 | batch.column("dim").to_numpy()
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((place[1:] != place[:-1]) | (asked[1:] != asked[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if e == s:
                    continue
                if place[s] != at:
                    at, ids, rows, ball = place[s], [], [], None
                part = batch.slice(s, e - s)
                vectors, names = _matrix(part.column("embedding")), part.column("vec_id").to_numpy()
                if not asked[s]:
                    ids.append(names)
                    rows.append(vectors)
                elif rows:
                    if ball is None:
                        ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                        centre = rows[0].mean(axis=0)
                        ball = centre, float(np.sqrt(((rows[0] - centre) ** 2).sum(axis=1).max()))
                    bar = part.column("bar").to_numpy(zero_copy_only=False).astype(float)
                    out = score(names, vectors, np.where(np.isnan(bar), -np.inf, bar), ids[0], rows[0], *ball)
                    if out:
                        yield _found(out)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K, curves: int = CURVES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row that `is_query` marks, among all other rows."""
    rows = usable(vectors).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    bars = merged_bars(window_neighbours(rows, k, curves, window), k)
    n = rows.count()
    dealt = keyed(rows, 1).repartitionByRange(-(-n // block) or 1, "dim", "key", "vec_id").select("vec_id", "embedding", "dim", F.spark_partition_id().alias("block"))
    dealt = written(dealt, "vector-blocks")
    blocks = (dealt.agg(F.max("block")).first()[0] or 0) + 1
    asks = rows.where("is_query").join(bars, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "embedding", "dim", "bar")
    sent = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asked", F.lit(True))
    both = dealt.withColumns({"bar": F.lit(None).cast("double"), "asked": F.lit(False)}).unionByName(sent)
    met = both.repartitionById(blocks, "block").sortWithinPartitions("block", "dim", "asked")
    found = met.mapInArrow(_reranked(k), FOUND)
    pairs = found.select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("x")).select("query_id", "x.vec_id", "x.score").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merged_bars(found: DataFrame, k: int) -> DataFrame:
    """(query_id, bar): the k-th best score over all windows of a query; null with fewer than k."""
    pairs = found.select("query_id", F.explode(F.arrays_zip("vec_id", "score")).alias("x")).groupBy("query_id", F.col("x.vec_id").alias("vec_id")).agg(F.max("x.score").alias("score"))
    ranked = F.sort_array(F.collect_list("score"), asc=False)
    return pairs.groupBy("query_id").agg(ranked.alias("s")).select("query_id", F.when(F.size("s") >= k, F.element_at("s", k)).alias("bar"))
