"""File sources and sinks: all-string CSV, yearly folders, file inventory, ledgers, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import digests, read_csv


def read_strings(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """CSV with every column a string; only the empty field is null, the text nan stays text."""
    return read_csv(spark, path, columns).drop("_path")


def read_years(spark: SparkSession, root: str, relative: str, columns: Sequence[str], prefix: str = "season_") -> DataFrame:
    """One file per `<root>/<prefix><year>/<relative>`, with the folder's year; other suffixes are skipped."""
    rows = read_csv(spark, f"{root}/{prefix}*/{relative}", columns)
    year = F.nullif(F.regexp_extract("_path", rf"/{prefix}([0-9]+)/", 1), F.lit(""))
    return rows.withColumn("source_partition_year", year.cast("int")).where("source_partition_year is not null").drop("_path")


def file_inventory(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(path, n_rows, nulls per column, sha256) per CSV file, of any size."""
    rows = read_csv(spark, path, columns).withColumnRenamed("_path", "path")
    nulls = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))
    return digests(spark, path).drop("length").join(nulls, "path", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def typed_matches(raw: DataFrame) -> DataFrame:
    """Reloaded matches with types; an outcome text other than true or false is an error."""
    won = F.lower("team_a_won")
    flag = F.when(won == "true", True).when(won == "false", False).when(won.isNull(), None).otherwise(F.raise_error(F.concat(F.lit("unreadable outcome: "), won)).cast("boolean"))
    return raw.withColumns({"team_a_won": flag, "match_date": F.to_date("match_date"), "year": F.col("year").cast("int")})


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines ledger; a missing path is an empty one."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def snapshot_hash(df: DataFrame, column: str) -> DataFrame:
    """Adds canonical (sorted compact JSON) and its SHA-256 with a trailing newline."""
    canonical = F.to_json(F.try_parse_json(F.col(column)))
    return df.withColumn("canonical", canonical).withColumn("snapshot_hash", F.sha2(F.concat("canonical", F.lit("\n")), 256))


def append_snapshots(new: DataFrame, path: str, captured_at: str) -> None:
    """Append snapshots that are not there yet, partitioned by nothing, named by time and hash; none is overwritten."""
    spark = new.sparkSession
    stamp = F.date_format(F.to_timestamp(F.lit(captured_at)), "yyyyMMdd'T'HHmmss'Z'")
    rows = new.withColumn("name", F.concat(stamp, F.lit("_"), F.substring("snapshot_hash", 1, 12), F.lit(".json"))).dropDuplicates(["snapshot_hash"])
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        rows = rows.join(spark.read.parquet(path).select("snapshot_hash"), "snapshot_hash", "left_anti")
    rows.write.mode("append").parquet(path)


def write_report(report: DataFrame, path: str, run_id: str) -> None:
    """A report or table as Parquet under its run, one folder per run."""
    report.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
