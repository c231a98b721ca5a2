"""Files read by byte ranges inside executors, so that one large file is the work of many tasks.

A task opens a file where it is told to and reads on in pieces; it never holds a
file. Paths may be of any store that pyarrow reads by its address (local or
mounted folders, hdfs, s3, gs)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = 64 << 20  # bytes of a range
PIECE = 4 << 20  # bytes read at a time
TASKS = 20_000  # ranges are dealt to no more tasks than this

_QUOTE, _BREAK = 0x22, 0x0A


def _open(path: str) -> pa.NativeFile:
    """A file to read at any place, from a path as Spark lists it (not percent-encoded)."""
    scheme, _, rest = path.partition(":") if ":/" in path else ("file", "", path)
    if scheme == "file":
        return pa.fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    host, _, name = rest.lstrip("/").partition("/")
    store, base = pa.fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store.open_input_file(f"{base.rstrip('/')}/{name}")


def listing(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, length) of files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _dealt(df: DataFrame, n: int) -> DataFrame:
    """Rows dealt evenly to tasks; a stated number of partitions is not merged again however small the rows are."""
    return df.repartition(max(1, min(n, TASKS)))


def _pieces(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    file.seek(start)
    while start < stop:
        piece = file.read(min(PIECE, stop - start))
        if not piece:
            return
        start += len(piece)
        yield piece


def digests(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, length, sha256) of every file, of any size: a file streams through one task, since its digest does."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                sha = hashlib.sha256()
                with _open(name) as file:
                    for piece in _pieces(file, 0, length):
                        sha.update(piece)
                yield pa.RecordBatch.from_pydict({"path": [name], "length": [length], "sha256": [sha.hexdigest()]})

    files = listing(spark, path)
    return _dealt(files, files.count()).mapInArrow(digest, "path string, length long, sha256 string")


def _count_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        for row in batch.to_pylist():
            with _open(row["path"]) as file:
                counts.append(sum(piece.count(b'"') for piece in _pieces(file, row["start"], row["stop"])))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], ["path", "start", "stop", "length", "quotes"])


def _records(file: pa.NativeFile, start: int, stop: int, length: int, inside: bool) -> Iterator[pa.Array]:
    """The records that start in [start, stop), each with its line break, in arrays of about a piece.

    `inside`: whether `start` lies within quotes. The last record is read to its end, however far beyond `stop`."""
    owned = start == 0
    if not owned and not inside:
        file.seek(start - 1)
        owned = file.read(1) == b"\n"
    begin, kept = start, []  # where the record at hand begins, and its bytes of earlier pieces
    at = start
    for piece in _pieces(file, start, length):
        codes = np.frombuffer(piece, np.uint8)
        breaks = np.flatnonzero(codes == _BREAK)
        before = np.searchsorted(np.flatnonzero(codes == _QUOTE), breaks)
        ends = breaks[(before + inside) % 2 == 0] + 1
        inside = bool((inside + piece.count(b'"')) % 2)
        if not owned and ends.size:  # the rest of a record that an earlier range has
            owned, begin, first, ends = True, at + int(ends[0]), int(ends[0]), ends[1:]
        else:
            first = 0
        if owned:
            if begin >= stop:
                return
            done = at + ends >= stop
            last = bool(done.any())
            if last:
                ends = ends[: int(np.argmax(done)) + 1]
            if ends.size:
                whole = b"".join(kept) + piece[first : ends[-1]]
                shift = len(whole) - int(ends[-1])
                offsets = np.concatenate(([0], ends + shift)).astype(np.int32)
                yield pa.StringArray.from_buffers(ends.size, pa.py_buffer(offsets), pa.py_buffer(whole))
                if last:
                    return
                kept, first, begin = [], int(ends[-1]), at + int(ends[-1])
            kept.append(piece[first:])
        elif at + len(piece) >= stop:
            return  # the whole range lies in a record of an earlier one
        at += len(piece)
    if owned and any(kept) and begin < stop:
        yield pa.array([b"".join(kept)], pa.binary()).cast(pa.string())


def csv_records(spark: SparkSession, path: str | Sequence[str], header: bool = True, size: int = RANGE) -> DataFrame:
    """(path, record): the texts of CSV records, whose quoted fields may hold line breaks.

    Quotes are doubled inside quoted fields; records end in \\n or \\r\\n. One pass counts
    the quotes of each range of `size` bytes; their sum before a range tells whether it
    starts inside a quoted field, and with it where its records start. The second pass
    reads the records that start in each range. Blank lines are no records; with
    `header` the first record of each file is left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                skip = header and row["start"] == 0
                with _open(row["path"]) as file:
                    for texts in _records(file, row["start"], row["stop"], row["length"], row["inside"]):
                        texts = texts[1:] if skip else texts
                        skip = False
                        yield pa.RecordBatch.from_arrays([pa.array([row["path"]]).take(pa.array(np.zeros(len(texts), np.int32))), texts], ["path", "record"])

    files = listing(spark, path).where("length > 0")
    n = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 0
    starts = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    cut = starts.select("path", "start", F.least(F.col("start") + size, "length").alias("stop"), "length")
    counted = _dealt(cut, n).mapInArrow(_count_quotes, "path string, start long, stop long, length long, quotes long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select("path", "start", "stop", "length", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    found = _dealt(placed, n).mapInArrow(read, "path string, record string")
    return found.withColumn("record", F.regexp_replace("record", r"\r?\n\z", "")).where("record <> ''")


def read_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], header: bool = True, size: int = RANGE) -> DataFrame:
    """`columns` of CSV files as strings, and the `_path` of the file; fields that a record lacks are null."""
    fields = ", ".join(f"`{c}` string" for c in columns)
    parsed = F.from_csv("record", F.lit(fields), {"escape": '"', "multiLine": "true"})
    return csv_records(spark, path, header, size).select(F.col("path").alias("_path"), parsed.alias("_row")).select(*(F.col("_row")[c].alias(c) for c in columns), "_path")
