"""Condition monitoring: baseline, trend, remaining life, health, for all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the specification.
ALERT, DANGER, RECENT, TREND, JUMP, LEAST_SLOPE, HOT = 4.5, 7.1, 24, 72, 0.8, 1e-4, 85.0
# End of fixed values.


def analyze(series: DataFrame, key: str, ts: str, value: str, alert: float = ALERT, danger: float = DANGER, recent: int = RECENT, trend: int = TREND, jump: float = JUMP) -> DataFrame:
    """One row for each series: n, baseline, recent_mean, score, anomalous, slope_day, latest, rul_hours.

    baseline: upper median of the first half; slope: least squares over the last `trend` points by
    index; remaining life: hours until `danger` at that slope, 0 beyond it, null without a trend.
    One shuffle by series serves all windows."""
    w = Window.partitionBy(key)
    rows = series.select(F.col(key), F.col(ts), F.col(value).cast("double").alias("v")).where("v is not null")
    rows = rows.withColumn("i", F.row_number().over(w.orderBy(F.col(ts), "v")) - 1).withColumn("n", F.count("*").over(w))
    half = F.greatest(F.lit(1), F.floor(F.col("n") / 2)).cast("int")
    last = lambda k: F.col("i") >= F.col("n") - k
    out = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("i") < half, F.col("v")))).alias("first"),
        F.avg(F.when(last(recent), F.col("v"))).alias("recent_mean"),
        F.regr_slope(F.when(last(trend), F.col("v")), F.when(last(trend), F.col("i").cast("double"))).alias("slope"),
        F.max_by("v", "i").alias("latest"),
    )
    base = F.element_at("first", (F.floor(F.size("first") / 2) + 1).cast("int"))
    out = out.withColumn("baseline", base).withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("recent_mean") - F.col("baseline")) / (danger - F.col("baseline"))))
    anomalous = (F.col("recent_mean") > alert) | (F.col("recent_mean") - F.col("baseline") > jump)
    return out.select(
        key, "n", F.round("baseline", 6).alias("baseline"), F.round("recent_mean", 6).alias("recent_mean"),
        F.round(score, 4).alias("score"), anomalous.alias("anomalous"), F.round(F.col("slope") * 24, 6).alias("slope_day"), F.round("latest", 6).alias("latest"),
        F.round(remaining(F.col("latest"), F.col("slope"), danger), 4).alias("rul_hours"),
    )


def remaining(latest: Column, slope: Column, danger: float = DANGER) -> Column:
    """Hours until danger: 0 beyond it, null without an upward trend."""
    return F.when(latest >= danger, F.lit(0.0)).when(slope > LEAST_SLOPE, (danger - latest) / slope)


def tail(series: DataFrame, key: str, ts: str, tie: str, n: int = 14 * 24) -> DataFrame:
    """The last n points of each series."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return series.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def maintenance_window(rul_hours: Column) -> Column:
    """Days until maintenance should be done: remaining days (7 if unknown) less two, one at least."""
    return F.greatest(F.lit(1), (F.coalesce(rul_hours / 24, F.lit(7.0)) - 2).cast("int"))


def temperature(series: DataFrame, key: str, ts: str, value: str, limit: float = HOT) -> DataFrame:
    """(key, temp_mean, elevated) of the last RECENT points."""
    rows = tail(series, key, ts, value, RECENT)
    return rows.groupBy(key).agg(F.round(F.avg(value), 6).alias("temp_mean")).withColumn("elevated", F.col("temp_mean") > limit)


def health(recent: Column, health_score: Column, alert: float = ALERT, danger: float = DANGER) -> Column:
    """Verdict from vibration where monitored, else from the recorded health score."""
    by_score = F.when(health_score >= 80, "healthy").when(health_score >= 50, "alert").when(health_score.isNotNull(), "danger")
    return F.coalesce(F.when(recent >= danger, "danger").when(recent >= alert, "alert").when(recent.isNotNull(), "healthy"), by_score, F.lit("unknown"))
