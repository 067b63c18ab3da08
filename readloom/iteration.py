"""Iterations whose state rests as tables between passes.

Every pass writes its tables under ``pass=N`` of one folder and commits them with a row of tallies, written last. A
table that is read back knows nothing of the passes before it, neither their plans nor their estimates. Of the moving
tables two generations are kept; of the kept ones, all. An iteration that finds committed passes in its folder goes on
after the last of them, so a driver that is lost costs the pass under way.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

from .session import delete, scratch_folder

TALLIES = "tallies"


class Iteration:
    """Tables of passes. Without a folder they live as long as the driver's process; with one they stay and are resumed."""

    def __init__(self, spark: SparkSession, folder: str | None = None, name: str = "passes"):
        self.spark = spark
        self.folder = folder or scratch_folder(spark, name)
        self.resumable = folder is not None
        self._names: dict[tuple[str, int], str] = {}

    def path(self, table: str, number: int) -> str:
        return f"{self.folder}/{table}/pass={number}"

    def _store(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, number: int) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(TALLIES, number)}/tally.json")
        return self._store(target).exists(target)

    def last(self) -> int | None:
        """The last committed pass of the folder."""
        number = -1
        while self.resumable and self.committed(number + 1):
            number += 1
        return number if number >= 0 else None

    def write(self, df: DataFrame, table: str, number: int) -> DataFrame:
        """Write one table of a pass (again, if an earlier attempt left it unfinished) and read it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table, number))
        return self.read(table, number, df.schema)

    def read(self, table: str, number: int, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(table, number))

    def write_bucketed(self, df: DataFrame, table: str, number: int, key: str, buckets: int) -> DataFrame:
        """As write, with the rows in buckets by key: what is read back needs no exchange to be grouped by it."""
        path, name = self.path(table, number), self._register(table, number)
        delete(self.spark, path)
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        return self.spark.table(name)

    def read_bucketed(self, table: str, number: int, columns: str, key: str, buckets: int) -> DataFrame:
        """A bucketed table of an earlier run; columns: their names and types (an empty table has no files to tell)."""
        path, name = self.path(table, number), self._register(table, number)
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _register(self, table: str, number: int) -> str:
        name = f"readloom_{table}_{uuid.uuid4().hex}"
        self._names[table, number] = name
        return name

    def commit(self, number: int, **tallies: int | bool | str) -> None:
        """The pass is done; its tallies become a row of the table of tallies (a line of JSON, put in place at once)."""
        path, jvm = self.path(TALLIES, number), self.spark.sparkContext._jvm
        draft, final = jvm.org.apache.hadoop.fs.Path(f"{path}/_draft"), jvm.org.apache.hadoop.fs.Path(f"{path}/tally.json")
        store = self._store(final)
        out = store.create(draft, True)
        out.write(bytearray(json.dumps(tallies).encode()))
        out.close()
        store.rename(draft, final)

    def retire(self, table: str, number: int) -> None:
        """Delete a table that only passes before the last two read."""
        if number < 0:
            return
        if name := self._names.pop((table, number), None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.path(table, number))

    def tally(self, number: int) -> Row:
        """The tallies of one committed pass."""
        return self.spark.read.json(self.path(TALLIES, number)).first()

    def tallies(self) -> DataFrame:
        """pass and the tallies of every committed pass."""
        return self.spark.read.option("basePath", f"{self.folder}/{TALLIES}").json(f"{self.folder}/{TALLIES}")
