"""Retrieval and answer metrics, roll-ups and the regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(qid, hit, rr, recall_1, recall_k, precision_k, ndcg) of every query that has a relevant document.

    ranked: (qid, doc, rank from 0); relevant: (qid, doc).  hit: all relevant documents are among the
    first k; the ideal ranking is the same hits, relevant ones first."""
    want = relevant.select("qid", "doc").distinct()
    n = want.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    rows = ranked.where(F.col("rank") < k).join(want.withColumn("rel", F.lit(1)), ["qid", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    ideal = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "rank")) - 1
    rows = rows.withColumn("ideal", ideal)
    got = rows.groupBy("qid").agg(
        F.sum("rel").alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.max(F.when(F.col("rank") == 0, F.col("rel"))).alias("top"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 2.0)).alias("dcg"), F.sum(F.col("rel") / F.log2(F.col("ideal") + 2.0)).alias("idcg"),
    )
    out = n.join(got, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "qid", (F.coalesce("found", F.lit(0)) == F.col("n_relevant")).cast("int").alias("hit"), F.round(zero(1 / (F.col("first") + 1)), 4).alias("rr"),
        F.round(zero(F.col("top") / F.col("n_relevant")), 4).alias("recall_1"), F.round(zero(F.col("found") / F.col("n_relevant")), 4).alias("recall_k"),
        F.round(zero(F.col("found") / F.lit(k)), 4).alias("precision_k"), F.round(zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))), 4).alias("ndcg"),
    )


METRICS = ["hit", "rr", "recall_1", "recall_k", "precision_k", "ndcg"]


def by_category(metrics: DataFrame, category: DataFrame) -> DataFrame:
    """Means of all metrics by category.  category: (qid, category)."""
    return metrics.join(category, "qid").groupBy("category").agg(F.count("*").alias("n"), *(F.round(F.avg(m), 4).alias(m) for m in METRICS))


def regression_gate(baseline: DataFrame, now: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(metric, before, after, fails): a metric fails if it drops by more than the tolerance.  Both: one row of METRICS."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in METRICS))).alias("x")).select("x.metric", F.col("x.v").alias(name))
    return long(baseline, "before").join(long(now, "after"), "metric").withColumn("fails", F.col("before") - F.col("after") > tolerance)


def answer_metrics(rollups: DataFrame) -> DataFrame:
    """One row: support and hallucination rates over answers (aid, n, supported, partly, insufficient)."""
    return rollups.agg(F.count("*").alias("answers"), F.round(F.avg((F.col("supported") + 0.5 * F.col("partly")) / F.col("n")), 4).alias("support"), F.round(F.avg(F.col("insufficient") / F.col("n")), 4).alias("hallucination"))
