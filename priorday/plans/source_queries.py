"""Queries over files: driver tables written as CSV, JSON lines and reports in the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorday.operators import resolve as J
from priorday.sources import contests as A
from priorday.sources import files
from priorday.sources.shared import scratch

from .base import query, sql


def _as_csv(rows: DataFrame, path: str, *by: str) -> str:
    rows.write.partitionBy(*by).option("header", True).option("escape", '"').csv(path)
    return path


_AWKWARD = "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'nan' WHEN c_custkey % 13 = 0 THEN 'NA' WHEN c_custkey % 17 = 0 THEN 'say \"' || c_name || '\", twice' WHEN c_custkey % 19 = 0 THEN 'two' || chr(10) || 'lines' ELSE c_name END"


@query("csv_strings", f"SELECT CAST(c_custkey AS VARCHAR) AS custkey, {_AWKWARD} AS name, c_mktsegment AS segment FROM customer")
def csv_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through CSV as strings: nulls, the texts nan and NA, quotes, commas and line breaks survive."""
    rows = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("custkey"), F.expr(_AWKWARD.replace('say "', 'say \\"').replace("'\", twice'", "'\\\", twice'")).alias("name"), F.col("c_mktsegment").alias("segment"))
    return files.read_strings(spark, _as_csv(rows, scratch(spark, "csv-strings")), rows.columns)


_SEASON = "CASE WHEN o_orderkey % 50 = 0 THEN 'friendly' ELSE CAST(year(o_orderdate) AS VARCHAR) END"


def _seasons(spark: SparkSession, sf_dir: str) -> str:
    """Orders in a folder per year, and some in one whose name is no year."""
    o = A.table(spark, sf_dir, "orders")
    season = F.when(F.col("o_orderkey") % 50 == 0, "friendly").otherwise(F.year("o_orderdate").cast("string"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("priority"), season.alias("season"))
    return _as_csv(rows.repartition("season").sortWithinPartitions("season", F.col("orderkey").cast("long")), scratch(spark, "seasons"), "season")


_ORDER_COLUMNS = ("orderkey", "status", "priority")
_ORDER_ROWS = f"(SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS priority, {_SEASON} AS season FROM orders)"


@query("yearly_folders", f"SELECT orderkey, status, priority, CAST(season AS INTEGER) AS source_partition_year FROM {_ORDER_ROWS} WHERE season <> 'friendly'")
def yearly_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_years(spark, _seasons(spark, sf_dir), "*.csv", _ORDER_COLUMNS, prefix="season=")


@query(
    "file_inventory",
    f"""SELECT season, count(*) AS n_rows, count(*) - count(orderkey) AS null_orderkey, count(*) - count(status) AS null_status, count(*) - count(priority) AS null_priority,
 sha256('orderkey,status,priority' || chr(10) || string_agg(orderkey || ',' || status || ',' || coalesce(priority, ''), chr(10) ORDER BY o_orderkey) || chr(10)) AS sha256
FROM {_ORDER_ROWS} GROUP BY season""",
)
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls per column and SHA-256 of every file; a folder holds one file."""
    made = files.file_inventory(spark, f"{_seasons(spark, sf_dir)}/*/*.csv", _ORDER_COLUMNS)
    return made.select(F.regexp_extract("path", "/season=([^/]+)/", 1).alias("season"), "n_rows", *(f"null_{c}" for c in _ORDER_COLUMNS), "sha256")


@query("typed_reload", sql("SELECT match_id, match_date, year, team_a_won FROM contests", "contests"))
def typed_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests through CSV and back to types."""
    columns = ("match_id", "match_date", "year", "team_a_won")
    rows = A.contests(spark, sf_dir).select(*columns)
    back = files.read_strings(spark, _as_csv(rows.select(*(F.col(c).cast("string") for c in columns)), scratch(spark, "typed-reload")), columns)
    return files.typed_matches(back).withColumn("match_id", F.col("match_id").cast("long"))


@query("jsonl_ledger", sql("SELECT record_id, record_type, match_id, epoch_us(recorded_at) AS recorded_us FROM ledger", "ledger"))
def jsonl_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger through JSON lines; a ledger that is not there yet adds nothing."""
    rows = A.ledger(spark, sf_dir).select("record_id", "record_type", "match_id", F.unix_micros("recorded_at").alias("recorded_us"))
    path, schema = scratch(spark, "jsonl-ledger"), "record_id string, record_type string, match_id string, recorded_us long"
    none = files.read_ledger(spark, path, schema)
    rows.write.json(path)
    return files.read_ledger(spark, path, schema).unionByName(none)


@query(
    "report_runs",
    "SELECT 'first' AS run_id, o_orderstatus AS key, count(*) AS value FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'second', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority",
)
def report_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two runs in one table; the first run is written twice and leaves the second untouched."""
    o, path = A.table(spark, sf_dir, "orders"), scratch(spark, "reports")
    report = lambda c: o.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("value"))
    files.write_report(report("o_orderpriority"), path, "first")
    files.write_report(report("o_orderpriority"), path, "second")
    files.write_report(report("o_orderstatus"), path, "first")
    return spark.read.parquet(path).select("run_id", "key", "value")


@query("checked_join", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def checked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, who must be unique."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return J.checked_join(o, c, ["o_custkey"], "left", "many_to_one")
