"""Telemetry as a stream: event-time windows, and a bounded state for each series.

The state holds the last TREND values of a series, so after the last row its mean, slope and latest
value equal the batch analysis.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basalt.operators.telemetry import RECENT, TREND
from basalt.runtime import ship

RESULT = "user_id bigint, n bigint, recent_mean double, slope_day double, latest double"


def files(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of the Parquet files of a folder as they come, or of one file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        source, path = source.option("pathGlobFilter", place.getName()), place.getParent().toString()
    return source.parquet(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events as files() gives them; time stamps without a zone count as UTC."""
    return files(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total): counts and sums in event-time windows, late rows dropped behind the watermark."""
    w = F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(user_id, start, end, n): sessions of a user parted by gaps."""
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, ts, values = state.get if state.exists else (0, [], [])
    for f in frames:
        f = f.dropna(subset=["value"])
        n += len(f)
        both = sorted([*zip(ts, values, strict=True), *zip(f["ts"].astype("int64"), f["value"].astype(float), strict=True)])[-TREND:]
        ts, values = [int(t) for t, _ in both], [float(v) for _, v in both]
    state.update((n, ts, values))
    slope = float(np.polyfit(np.arange(len(values)), values, 1)[0]) if len(values) > 1 else 0.0
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "recent_mean": [round(float(np.mean(values[-RECENT:])), 6) if values else None], "slope_day": [round(slope * 24, 6)], "latest": [values[-1] if values else None]})


def running(events: DataFrame) -> DataFrame:
    """The latest analysis of each series that a batch touches (update mode)."""
    ship(events.sparkSession)
    return events.select("user_id", "ts", "value").groupBy("user_id").applyInPandasWithState(_update, RESULT, "n bigint, ts array<bigint>, vs array<double>", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, path: str, key: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return its result, written to path: the last batch's in complete mode, all
    batches' in append mode, and of the rows that update mode gives for a key the last batch's.  A batch that runs again replaces its rows."""
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(put).start().awaitTermination()
    if mode == "complete":
        return stream.sparkSession.read.schema(schema).parquet(f"{path}/out")
    out = stream.sparkSession.read.schema(schema.add("batch", "long")).parquet(f"{path}/out")
    if mode == "update" and key is not None:
        out = out.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch")))).where("_i = 1").drop("_i")
    return out.drop("batch")
