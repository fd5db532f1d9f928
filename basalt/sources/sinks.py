"""Write paths: keyed upserts, mirrors, traces, artefacts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators import assets as A


def _fs(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(target).getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, target: str) -> str | None:
    """Where the table is: its folder or, if a writer stopped between its two renames, the one it had put aside last; None if there is no table."""
    path, fs = _fs(spark, target)
    if fs.exists(path(target)):
        return target
    aside = fs.globStatus(path(f"{target}.old-*")) or []
    return max(((s.getModificationTime(), s.getPath().toString()) for s in aside), default=(0, None))[1]


def _replace(spark: SparkSession, staged: str, target: str) -> None:
    """Put a staged folder in the target's place; the old one goes only when the new one is there, and comes back if it can't be."""
    path, fs = _fs(spark, target)
    old = f"{target}.old-{uuid.uuid4().hex[:8]}"
    moved = fs.exists(path(target))
    if moved and not fs.rename(path(target), path(old)):
        raise OSError(f"cannot move {target}")
    if not fs.rename(path(staged), path(target)):
        if moved:
            fs.rename(path(old), path(target))
        raise OSError(f"cannot move {staged} to {target}")
    for s in fs.globStatus(path(f"{target}.old-*")) or []:
        fs.delete(s.getPath(), True)


def existing(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table's rows, none if there is no table; a table that can't be read is an error."""
    at = current(spark, path)
    return spark.createDataFrame([], schema) if at is None else spark.read.schema(schema).parquet(at)


def upsert(new: DataFrame, path: str, key: str, created: str = "created_at") -> None:
    """Rows of new replace those of the same key and keep their creation time; staged and then renamed."""
    spark, staged = new.sparkSession, f"{path}.new-{uuid.uuid4().hex[:8]}"
    A.upsert(existing(spark, path, new.schema), new, key, created).write.parquet(staged)
    _replace(spark, staged, path)


def append_missing(new: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key isn't there yet, each key once."""
    old = existing(new.sparkSession, path, new.schema).select(key)
    new.dropDuplicates([key]).join(old, key, "left_anti").write.mode("append").parquet(path)


def delete(spark: SparkSession, path: str, key: str, value) -> None:
    """Rewrite without the rows of a key."""
    staged = f"{path}.new-{uuid.uuid4().hex[:8]}"
    spark.read.parquet(current(spark, path) or path).where(~F.col(key).eqNullSafe(F.lit(value))).write.parquet(staged)
    _replace(spark, staged, path)


def trace(rows: DataFrame, path: str) -> None:
    """One JSON line for each row, appended."""
    rows.write.mode("append").json(path)


def artefacts(assets: DataFrame, path: str) -> None:
    """A markdown text for each asset (asset, n_orders, recent), in folders by asset."""
    body = F.concat(F.lit("# Asset "), F.col("asset").cast("string"), F.lit("\n\nWork orders: "), F.col("n_orders").cast("string"), F.lit("\n\nLatest: "), F.when(F.col("recent") == "", "—").otherwise(F.col("recent")))
    assets.select("asset", body.alias("value")).repartition("asset").write.mode("overwrite").partitionBy("asset").text(path)
