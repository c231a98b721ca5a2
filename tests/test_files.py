"""Tables in the shared folder, reports by run, and ledgers that are not there yet."""

import hashlib
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from priorday.sources import files, ranges, shared


def test_written_tables_go_when_told(spark):
    df = spark.range(5)
    one, two, kept = shared.written(df, "one"), shared.written(df, "two"), shared.written(df, "kept", keep=True)
    there = lambda t: os.path.isdir(t.written_path.removeprefix("file://"))
    assert one.count() == two.count() == 5 and there(one) and there(two)
    shared.forget(one)
    assert not there(one) and there(two)
    shared.clear(spark)
    assert not there(two) and there(kept)
    shared.forget(kept)


def test_rerun_of_a_report_leaves_other_runs(spark, tmp_path):
    path = f"file://{tmp_path}/reports"
    table = lambda *rows: spark.createDataFrame(rows, "key string, value long")
    files.write_report(table(("a", 1), ("b", 2)), path, "first")
    files.write_report(table(("a", 3)), path, "second")
    files.write_report(table(("c", 4)), path, "first")
    assert {tuple(r) for r in spark.read.parquet(path).select("run_id", "key", "value").collect()} == {("first", "c", 4), ("second", "a", 3)}


def test_missing_ledger_is_empty(spark, tmp_path):
    assert files.read_ledger(spark, f"file://{tmp_path}/none", "record_id string").count() == 0


def test_inventory_of_empty_and_filled_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,\nnan,2\n")
    (tmp_path / "b.csv").write_text("x,y\n")
    got = {os.path.basename(r.path): (r.n_rows, r.null_x, r.null_y) for r in files.file_inventory(spark, f"file://{tmp_path}/*.csv", ["x", "y"]).collect()}
    assert got["a.csv"] == (2, 0, 1) and got["b.csv"][0] == 0
    assert files.read_strings(spark, f"file://{tmp_path}/a.csv", ["x", "y"]).where(F.col("x") == "nan").count() == 1


def test_clear_deletes_scratch_and_written_tables(spark):
    from priorday.sources import shared

    kept, gone = shared.written(spark.range(3), "kept", keep=True), shared.written(spark.range(3), "gone")
    path = shared.scratch(spark, "files")
    spark.range(2).write.parquet(path)
    shared.clear(spark)
    assert shared.exists(kept) and not shared.exists(gone) and kept.count() == 3
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
    shared.forget(kept)


def test_only_the_optional_part_may_be_missing(tmp_path):
    """The entry stands without the training-data part, and says so when something else is missing."""
    root = Path(__file__).resolve().parents[1]
    for name in ("priorday", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(root / name)
    run = lambda code: subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, '.'); {code}"], cwd=tmp_path, capture_output=True, text=True)
    hide = "import importlib.abc as a; F = type('F', (a.MetaPathFinder,), {'find_spec': lambda s, n, p, t=None: (_ for _ in ()).throw(ModuleNotFoundError(n, name=n)) if n in HIDDEN else None}); sys.meta_path.insert(0, F()); "
    alone = run(f"HIDDEN = {{'priorday.llm', 'corpus_pipeline'}}; {hide}import __spark_entry__ as e; print(len(e.queries()), any(x.startswith('op1_') for x in e.queries()))")
    assert alone.returncode == 0 and alone.stdout.split()[1] == "False", alone.stderr
    broken = run(f"HIDDEN = {{'priorday.plans.market_queries'}}; {hide}import __spark_entry__")
    assert broken.returncode != 0 and "market_queries" in broken.stderr


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_csv_cut_at_any_byte(spark, tmp_path, size):
    """Quotes, doubled quotes and line breaks at the edges of ranges; blank lines; no break at the end."""
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n2,"say ""hi"", twice"\n\n3,\n,"\n\n"\n4,"""\n""\n"\n5,nan')
    (tmp_path / "b.csv").write_text("x,y\r\n6,ü€\r\n7,\"a\nb\"\r\n")
    (tmp_path / "c.csv").write_text("")
    got = ranges.read_csv(spark, f"file://{tmp_path}/*.csv", ["x", "y"], size=size).collect()
    want = [("1", "two\nlines"), ("2", 'say "hi", twice'), ("3", None), (None, "\n\n"), ("4", '"\n"\n'), ("5", "nan"), ("6", "ü€"), ("7", "a\nb")]
    assert sorted(((r.x, r.y) for r in got), key=str) == sorted(want, key=str)
    assert {os.path.basename(r._path) for r in got if r.x and int(r.x) > 5} == {"b.csv"}


def test_csv_pieces_smaller_than_records(tmp_path, monkeypatch):
    """Every range and piece length gives each record once, as the csv module reads it."""
    monkeypatch.setattr(ranges, "PIECE", 3)
    text = 'a,"b\n""c"\n\nlong field,"' + "x\n" * 9 + '"\n"",""\nlast,1'
    (tmp_path / "a.csv").write_text(text)
    want = ['a,"b\n""c"\n', "\n", 'long field,"' + "x\n" * 9 + '"\n', '"",""\n', "last,1"]
    for size in range(1, len(text) + 2):
        got = []
        for start in range(0, len(text), size):
            with ranges._open(str(tmp_path / "a.csv")) as f:
                inside = text[:start].count('"') % 2 == 1
                for part in ranges._records(f, start, min(start + size, len(text)), len(text), inside):
                    got += part.to_pylist()
        assert got == want, size


def test_one_large_csv_is_many_tasks(spark, tmp_path):
    rows = spark.range(0, 300_000, 1, 1).selectExpr("cast(id as string) x", "concat('line ', id, chr(10), 'and \"more\"') y")
    rows.write.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/one")
    read = ranges.read_csv(spark, f"file://{tmp_path}/one/*.csv", ["x", "y"], size=1 << 19)
    assert read.exceptAll(rows.withColumn("_path", F.lit(None).cast("string")).select("x", "y", "_path")).drop("_path").exceptAll(rows).count() == 0
    per_task = read.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) > 15 and max(r["count"] for r in per_task) < 300_000 / 8


def test_digest_of_a_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB; binaryFile could not hold its content."""
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(3 << 30)
    (tmp_path / "a b%20c.bin").write_bytes(b"x")
    want = hashlib.sha256()
    for _ in range(3 << 6):
        want.update(bytes(1 << 24))
    got = {os.path.basename(r.path): (r.length, r.sha256) for r in ranges.digests(spark, f"file://{tmp_path}/*.bin").collect()}
    assert got == {"big.bin": (3 << 30, want.hexdigest()), "a b%20c.bin": (1, hashlib.sha256(b"x").hexdigest())}
