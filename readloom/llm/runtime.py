"""Session helpers shared by the operators: shared scratch tables, bounded Arrow batches."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches sent to Python workers stay under this size whatever the length of the texts.
BATCH_BYTES = "8m"
BATCH_ROWS = 2000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder
    of its own; on a cluster that is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="readloom-")
        atexit.register(shutil.rmtree, local, True)
        folder = f"file://{local}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and make this package importable on the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_readloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="readloom-zip-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / "readloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._readloom_shipped = True


class Scratch:
    """Tables written under the shared folder to cut lineage; a lost executor costs no recomputation of them.

    A table lives until its operator drops it (when a later table holds what was made of it), until the ``scope`` in
    which it was made ends, or until the driver's process ends.
    """

    _alive: dict[str, SparkSession] = {}
    _scopes: list[list[str]] = []

    @classmethod
    def table(cls, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet in the shared folder and read it back."""
        spark, schema = df.sparkSession, df.schema
        path = cls.folder(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        # The shuffle files of finished steps go once nothing refers to their plans.
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        out = spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    @classmethod
    def folder(cls, spark: SparkSession, name: str) -> str:
        """A new path in the shared folder that lives as long as a table."""
        path = f"{scratch_dir(spark)}/readloom-{name}-{uuid.uuid4().hex}"
        cls._alive[path] = spark
        if cls._scopes:
            cls._scopes[-1].append(path)
        return path

    @classmethod
    def drop(cls, *tables: DataFrame) -> None:
        """Delete tables that no plan still to be run reads."""
        for table in tables:
            cls._delete(table._scratch_path)

    @classmethod
    @contextmanager
    def scope(cls, keep: int = 0) -> Iterator[None]:
        """Delete the tables made inside at the end, but for the ``keep`` last ones: write other results inside."""
        cls._scopes.append([])
        try:
            yield
        finally:
            made = cls._scopes.pop()
            if cls._scopes and keep:
                cls._scopes[-1].extend(made[-keep:])
            for path in made[:-keep] if keep else made:
                cls._delete(path)

    @classmethod
    def _delete(cls, path: str) -> None:
        spark = cls._alive.pop(path, None)
        if spark is None:
            return
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    @classmethod
    def _at_exit(cls) -> None:
        for path in list(cls._alive):
            try:
                cls._delete(path)
            except Exception:  # noqa: BLE001  the session is gone already
                return


atexit.register(Scratch._at_exit)


def buckets_for(rows: int, least: int = 16) -> int:
    """A power of two near the square root of rows: so many buckets hold about as many rows each."""
    return max(least, 1 << max(0, round(rows**0.5) - 1).bit_length())


def free_prefix(columns: list[str], wish: str = "__own_") -> str:
    """A prefix for working columns that no column of a table starts with (in any case of letters)."""
    while any(c.lower().startswith(wish) for c in columns):
        wish = f"_{wish}"
    return wish
