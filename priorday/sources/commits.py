"""Several tables that change together: data is written first and counts once a commit names it.

Every commit is one small JSON file named by its number, holding the folders of all
tables as they are after it. Readers take the last commit, so they see either all of
a commit's tables or none. A commit's file is put in place by renaming, which the
second of two writers of one number cannot do; data that no commit names (of a
writer that was lost) is never read. Numbers rise, and a stream's batch ids are such
numbers: a batch that is replayed finds its commit and is left alone."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

KEPT = 20  # commits whose files stay


class CommittedTables:
    """Tables under one folder of a store that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], merge_at: int = 64):
        """schemas: the columns of each table; merge_at: folders of a table from which a commit writes it anew as one."""
        self.spark, self.path, self.schemas, self.merge_at = spark, path.rstrip("/"), schemas, merge_at
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> tuple[int, dict[str, list[str]]]:
        """The last commit's number (-1 if there is none) and the folders of every table."""
        numbers = self._numbers()
        if not numbers:
            return -1, {}
        stream = self._fs.open(self._path(f"{self.path}/commits/{numbers[-1]}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return numbers[-1], json.loads(text)

    def read(self, table: str, at: dict[str, list[str]] | None = None) -> DataFrame:
        """A table as of the last commit, or of the folders given."""
        folders = (self.last()[1] if at is None else at).get(table, [])
        if not folders:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*(f"{self.path}/{x}" for x in folders))

    def stage(self, table: str, rows: DataFrame) -> str:
        """Write rows of a table; they count once a commit names the folder that is returned."""
        folder = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, number: int, added: dict[str, list[str]]) -> bool:
        """Let the staged folders count, all at once; False if the number is committed already."""
        last, tables = self.last()
        if number <= last:
            return False
        for table, folders in added.items():
            tables[table] = tables.get(table, []) + folders
            if len(tables[table]) >= self.merge_at:
                tables[table] = [self.stage(table, self.read(table, tables))]
        draft, final = self._path(f"{self.path}/commits/_{uuid.uuid4().hex}"), self._path(f"{self.path}/commits/{number}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(tables).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            return False
        for old in self._numbers()[:-KEPT]:
            self._fs.delete(self._path(f"{self.path}/commits/{old}.json"), False)
        return True
