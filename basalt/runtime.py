"""Makes this package importable on the executors."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors' Python workers, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="basalt-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))


_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local session, whose executors are the driver, may go without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="basalt-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once however often it is read, and not lost with an executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._basalt_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Remove the files behind frames that written() returned, once nothing reads them any more."""
    for df in frames:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._basalt_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when the driver's plans of them are collected, which a driver with
    enough memory puts off while the disks fill.  For the end of steps that shuffle whole texts or postings."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by a key: what is then counted or ranked by that key (and more columns) is so without another shuffle."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), rows._jdf.rdd().getNumPartitions()), key)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are too few for that; tables of more partitions than cores stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
