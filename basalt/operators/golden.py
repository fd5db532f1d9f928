"""Evaluation against a golden set: cases as JSON lines, both layers' metrics, the regression gate, and the results file.

A case has id, query, expected_doc or expected_docs (parts of a document's label), expected_terms, intent, category, expect_refusal, expected_answer_terms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.operators import index as I

CASE = "id string, query string, expected_doc string, expected_docs array<string>, expected_terms array<string>, intent string, category string, expect_refusal boolean, expected_answer_terms array<string>"
# What the gate looks at, and how far it may fall.
GATED = ["hit_rate", "mrr", "term_coverage", "intent_accuracy", "precision_at_k", "recall_at_5", "ndcg"]
TOLERANCE = 0.05
# End of fixed values.
ANSWER_MEANS = ["coverage", "claim_support_rate", "hallucination_rate", "citation_alignment", "answer_term_coverage", "refusal_ok", "latency_s"]


def read_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, broken lines) of a JSON lines file; blank lines are skipped."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select("value", F.from_json("value", f"{CASE}, broken string", {"columnNameOfCorruptRecord": "broken"}).alias("c"))
    bad = F.col("c.broken").isNotNull() | F.col("c.id").isNull()
    return parsed.where(~bad).select("c.*").drop("broken"), parsed.where(bad).select(F.col("value").alias("line"))


def wanted(case_doc: Column, case_docs: Column) -> Column:
    """What a case expects, in lower case; empty for a case that only the answer layer has."""
    some = F.when(F.size(F.coalesce(case_docs, F.array().cast("array<string>"))) > 0, case_docs).when(F.coalesce(case_doc, F.lit("")) != "", F.array(case_doc)).otherwise(F.array().cast("array<string>"))
    return F.transform(some, F.lower)


def present(term: Column, text: Column) -> Column:
    """A term as whole words, case aside."""
    return F.rlike(F.lower(text), F.concat(F.lit("(?<![a-z0-9])\\Q"), F.lower(term), F.lit("\\E(?![a-z0-9])")))


def _share(terms: Column, found: Column) -> Column:
    return F.when(F.size(terms) > 0, F.size(found) / F.size(terms))


def retrieval_rows(cases: DataFrame, hits: DataFrame, intents: DataFrame) -> DataFrame:
    """One row a case that expects a document: hit (every expected one is there), rank, rr, recall_at_1, recall_at_5, precision_at_k, ndcg, term_coverage, missing_terms, intent_ok, latency_ms.

    hits: (id, place from 1, label, text), a bounded list for each case; intents: (id, intent, latency_ms).  A document is relevant if its label holds an expected part."""
    none = F.array().cast("array<string>")
    c = cases.select("id", F.coalesce("category", F.lit("core")).alias("category"), "query", wanted(F.col("expected_doc"), F.col("expected_docs")).alias("docs"), F.coalesce("expected_terms", none).alias("terms"), F.col("intent").alias("want")).where(F.size("docs") > 0)
    rows = hits.join(I.held(c.select("id", "docs", "terms")), "id").withColumn("label", F.lower("label"))
    rows = rows.withColumn("rel", F.exists("docs", lambda x: F.contains(F.col("label"), x)).cast("int")).withColumn("met", F.filter("docs", lambda x: F.contains(F.col("label"), x)))
    rows = rows.withColumn("ideal", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("rel"), "place")))
    rows = rows.withColumn("covered", F.filter("terms", lambda t: present(t, F.coalesce("text", F.lit("")))))
    gain = lambda at: F.sum(F.col("rel") / F.log2(F.col(at) + 1.0))
    got = rows.groupBy("id").agg(
        F.array_distinct(F.flatten(F.collect_set("met"))).alias("met"), F.array_distinct(F.flatten(F.collect_set("covered"))).alias("covered"), F.min(F.when(F.col("rel") == 1, F.col("place"))).alias("rank"),
        F.max(F.when(F.col("place") <= 5, F.col("rel"))).alias("five"), F.avg("rel").alias("precision"), gain("place").alias("dcg"), gain("ideal").alias("idcg"),
    )
    out = c.join(got, "id", "left").join(intents.select("id", F.col("intent").alias("detected_intent"), "latency_ms"), "id", "left")
    zero, met, covered = (lambda x: F.coalesce(x, F.lit(0.0))), F.coalesce("met", none), F.coalesce("covered", none)
    return out.select(
        "id", "category", "query", (F.size(F.array_except("docs", met)) == 0).alias("hit"), "rank", zero(1.0 / F.col("rank")).alias("rr"), (F.coalesce("rank", F.lit(0)) == 1).alias("recall_at_1"), (F.coalesce("five", F.lit(0)) == 1).alias("recall_at_5"),
        F.round(zero(F.col("precision")), 3).alias("precision_at_k"), F.round(zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))), 3).alias("ndcg"), F.coalesce(_share(F.col("terms"), F.array_intersect(F.array_distinct("terms"), covered)), F.lit(1.0)).alias("term_coverage"),
        F.array_except("terms", covered).alias("missing_terms"), F.when(F.coalesce("want", F.lit("")) != "", F.coalesce(F.col("detected_intent") == F.col("want"), F.lit(False))).alias("intent_ok"), "detected_intent", "latency_ms",
    )


def retrieval_summary(rows: DataFrame, k: int, reranker: bool = False, by: str | None = None) -> DataFrame:
    """One row of means (or one for each value of `by`): hit_rate, mrr, recall_at_1, recall_at_5, precision_at_k, ndcg, term_coverage, intent_accuracy (of the cases that name one), latency_ms_mean and _max."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 3)
    out = (rows.groupBy(by) if by else rows.groupBy()).agg(
        F.count("*").alias("cases"), mean("hit").alias("hit_rate"), mean("rr").alias("mrr"), *(mean(m).alias(m) for m in ("recall_at_1", "recall_at_5", "precision_at_k", "ndcg", "term_coverage")),
        mean("intent_ok").alias("intent_accuracy"), F.round(F.avg("latency_ms"), 1).alias("latency_ms_mean"), F.max("latency_ms").alias("latency_ms_max"),
    )
    return out.withColumn("k", F.lit(k)).withColumn("reranker", F.lit(reranker))


def answer_rows(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a case: refusal_ok, coverage, claim_support_rate, hallucination_rate, citation_alignment, answer_term_coverage, missing_answer_terms, latency_s, error.

    answers: (id, answer, verdict, coverage, claims, supported, insufficient, citation_alignment, latency_s, error); error is null where all went well."""
    none = F.array().cast("array<string>")
    rows = cases.select("id", F.coalesce("category", F.lit("core")).alias("category"), "query", F.coalesce("expect_refusal", F.lit(False)).alias("refusal_expected"), F.coalesce("expected_answer_terms", none).alias("terms")).join(answers, "id", "left")
    fine, verdict = F.col("error").isNull(), F.upper(F.coalesce("verdict", F.lit("")))
    refused = F.contains(verdict, F.lit("REFUSE")) | F.contains(verdict, F.lit("ESCALATE"))
    covered = F.filter("terms", lambda t: present(t, F.coalesce("answer", F.lit(""))))
    rate = lambda c: F.round(F.when(fine & (F.col("claims") > 0), F.col(c) / F.col("claims")), 3)
    return rows.select(
        "id", "category", "query", F.substring("verdict", 1, 40).alias("verdict"), "refusal_expected", F.when(fine, refused == F.col("refusal_expected")).alias("refusal_ok"), F.when(fine, F.col("coverage")).alias("coverage"), rate("supported").alias("claim_support_rate"),
        rate("insufficient").alias("hallucination_rate"), F.when(fine, F.col("citation_alignment")).alias("citation_alignment"), F.when(fine, _share(F.col("terms"), covered)).alias("answer_term_coverage"), F.array_except("terms", covered).alias("missing_answer_terms"), F.when(fine, F.col("latency_s")).alias("latency_s"), "error",
    )


def answer_summary(rows: DataFrame) -> DataFrame:
    """One row: cases, errors and the means of what the cases without an error have."""
    name = {"coverage": "coverage_mean", "refusal_ok": "refusal_accuracy", "latency_s": "latency_s_mean"}
    return rows.agg(F.count("*").alias("cases"), F.count("error").alias("errors"), *(F.round(F.avg(F.col(m).cast("double")), 3).alias(name.get(m, m)) for m in ANSWER_MEANS))


def gate(before: DataFrame, after: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(metric, before, after, delta, regression) of the gated metrics that both summaries (one row each) have."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in GATED if m in df.columns))).alias("x")).select("x.metric", F.col("x.v").alias(name)).where(F.col(name).isNotNull())
    rows = long(before, "before").join(long(after, "after"), "metric").withColumn("delta", F.round(F.col("after") - F.col("before"), 3))
    return rows.withColumn("regression", F.col("delta") < -tolerance)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_results(spark: SparkSession, path: str) -> dict:
    """The stored results; empty if there are none yet."""
    fs, at = _hadoop(spark, path)
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())) if fs.exists(at) else {}


def write_results(spark: SparkSession, path: str, layers: dict[str, tuple[DataFrame, DataFrame]], accept: bool = False) -> list[str]:
    """Write {layer: {summary, rows}} as one JSON file (a golden set is small), staged and renamed; returns the metrics that regressed against the file before.

    With a regression the old file stays, unless accept says that it is meant."""
    old = read_results(spark, path)
    plain = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    new = {name: {"summary": plain(summary)[0], "rows": plain(rows)} for name, (summary, rows) in layers.items()}
    base, now = ((x.get("retrieval") or {}).get("summary") or {} for x in (old, new))
    worse = [m for m in GATED if base.get(m) is not None and now.get(m) is not None and round(now[m] - base[m], 3) < -TOLERANCE]
    if worse and not accept:
        return worse
    fs, at = _hadoop(spark, path)
    staged = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(old | new, indent=2, ensure_ascii=False, default=str), "utf-8"))
    out.close()
    fs.delete(at, False)
    fs.rename(staged, at)
    return worse
