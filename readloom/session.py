"""Scratch tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master (tests) gets a folder of its own where that is unset; on a cluster that
    is an error, as executors would write where the driver can't read."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="readloom-")
        atexit.register(shutil.rmtree, local, True)
        folder = f"file://{local}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors."""
    context = spark.sparkContext
    if getattr(context, "_readloom_sent", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="readloom-zip-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / "readloom-core.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._readloom_sent = True


_mine: dict[str, SparkSession] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/readloom-{name}-{uuid.uuid4().hex}"
    _mine[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written once and read back: no lineage, no plan and no size estimate of what it came from.

    A checkpoint would keep the estimate of its plan; in a loop that joins tables with what was made of them, the
    digits of that estimate double with each pass, until planning takes longer than the work.
    """
    path = scratch_folder(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at_exit() -> None:
    for path, spark in list(_mine.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone already
            return


atexit.register(_at_exit)
