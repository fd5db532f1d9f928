"""What the operators of this subpackage share: the shared folder, cut lineage, table readers."""

from __future__ import annotations

import os
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.runtime import shared_folder, ship, spread


def tune(spark: SparkSession) -> None:
    """Send the package to the executors, and bound an Arrow batch so that Python workers hold few long texts at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return shared_folder(spark, name)


def cut(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", 0)  # one file for each task
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._basalt_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Remove the files behind frames that cut() returned, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_basalt_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and the path in it, for a URI of the shared folder (file, hdfs, s3, ...)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts, which are costly to work through, are spread over all cores where their files are too few."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def remainder(doc_id: str, n: int):
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def thinned(df: DataFrame, total: int, most: int, *by: str) -> DataFrame:
    """About `most` of df's `total` rows (and never more than twice as many), chosen by a hash of the columns `by`.

    Rows are chosen where they lie: nothing is sorted or gathered."""
    if total <= most:
        return df
    return df.where(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < int((1 << 40) * most / total)).limit(2 * most)
