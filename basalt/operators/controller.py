"""Iterative answering of a batch: retrieve, answer, verify, and again with what failed, over a table of open questions that shrinks.

The parts are slots over DataFrames, so any retriever, generator and verifier of this library (or a model behind one) fits:

* retrieve(asked: qid, no, query) -> (qid, no, rank, chunk, text)
* answer(open: qid, text; evidence: qid, eid, chunk, text) -> (qid, answer); null where there is none
* verify(answers: qid, answer; evidence) -> ((qid, coverage), (qid, pos, claim, status))
* facets(open, evidence) -> (qid, facet, probe, covered)

Coverage is .7 claims + .3 facets.  A question ends as ANSWER or NOTE by the confidence policy; else its unsupported claims (three at most,
without citations) and the probes of two missing facets, in order of name, are the next round's queries.  It ends as INSUFFICIENT when rounds are used up or a
round brings no new evidence; CLARIFY where the question is ambiguous, before anything is retrieved.  The driver holds counts only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators import index as I
from basalt.operators import understand as U
from basalt.runtime import written

# Weights, limits and notes of the specification.
CLAIM_SHARE, FACET_SHARE = 0.7, 0.3
MOST_CLAIMS, MOST_FACETS, MAX_ROUNDS, LEAST_NEW = 3, 2, 2, 1
NOTE = "Parts of this answer are only partially supported by the documents."
INSUFFICIENT = "The available evidence is insufficient to answer this question."
# End of fixed values.


def merged(evidence: DataFrame | None, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence with the new chunks of the hits, numbered on in order of query and rank; and how many each question got (qid, added)."""
    first = hits.groupBy("qid", "chunk").agg(F.min(F.struct("no", "rank", "text")).alias("x")).select("qid", "chunk", "x.no", "x.rank", "x.text")
    if evidence is not None:
        first = first.join(evidence.select("qid", "chunk"), ["qid", "chunk"], "left_anti").join(evidence.groupBy("qid").agg(F.max("eid").alias("last")), "qid", "left")
    else:
        first = first.withColumn("last", F.lit(0))
    order = Window.partitionBy("qid").orderBy("no", "rank", "chunk")
    new = first.withColumn("eid", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("bigint")).select("qid", "eid", "chunk", "text")
    out = written(new if evidence is None else evidence.unionByName(new), "evidence")
    return out, new.groupBy("qid").agg(F.count("*").alias("added"))


def next_queries(claims: DataFrame, facets: DataFrame) -> DataFrame:
    """(qid, no, query): unsupported claims first, then probes of missing facets; each text once."""
    bare = F.trim(F.regexp_replace("claim", r"\s*\[[0-9]+\]", ""))
    c = claims.where(F.col("status").isin("INSUFFICIENT", "INSUFFICIENT_EVIDENCE")).select("qid", "pos", bare.alias("query")).where("query <> ''")
    c = c.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("i") <= MOST_CLAIMS).select("qid", "i", "query")
    f = facets.where(~F.col("covered")).withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy("facet"))).where(F.col("i") <= MOST_FACETS)
    rows = c.unionByName(f.select("qid", (F.col("i") + MOST_CLAIMS).alias("i"), F.col("probe").alias("query"))).groupBy("qid", "query").agg(F.min("i").alias("i"))
    return rows.withColumn("no", F.row_number().over(Window.partitionBy("qid").orderBy("i")).cast("int")).select("qid", "no", "query")


def run(questions: DataFrame, retrieve: Callable, answer: Callable, verify: Callable, facets: Callable, rounds: int = MAX_ROUNDS, least_new: int = LEAST_NEW) -> DataFrame:
    """(qid, status, answer, coverage, iterations, evidence, options) of questions (qid, text, subqueries array<string>, options array<string>).

    options: what an ambiguous question could mean; null or empty otherwise."""
    spark, none = questions.sparkSession, F.array().cast("array<string>")
    q = written(questions.select("qid", "text", F.coalesce("subqueries", none).alias("subqueries"), F.coalesce("options", none).alias("options")), "questions")
    kind = dict(q.dtypes)["qid"]
    schema = f"qid {kind}, status string, answer string, coverage double, iterations int"
    done = [q.where(F.size("options") > 0).select("qid", F.lit("CLARIFY").alias("status"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("double").alias("coverage"), F.lit(0).alias("iterations"))]
    open_ = q.where(F.size("options") == 0)
    asked = open_.select("qid", F.posexplode(F.concat(F.array("text"), "subqueries")).alias("no", "query"))
    evidence, _ = merged(None, retrieve(asked))
    best = spark.createDataFrame([], "qid " + kind + ", best double, kept string")
    for k in range(rounds + 1):
        told = evidence.join(I.held(open_.select("qid")), "qid", "left_semi")
        answers = written(answer(open_.select("qid", "text"), told).where("answer is not null"), "answers")
        covered, claims = verify(answers, told)
        seen = written(facets(open_.select("qid", "text"), told), "facets")
        share = seen.groupBy("qid").agg(F.round(F.avg(F.col("covered").cast("double")), 3).alias("share"))
        total = F.round(F.least(F.lit(1.0), CLAIM_SHARE * F.coalesce("coverage", F.lit(0.0)) + FACET_SHARE * F.coalesce("share", F.lit(1.0))), 3)
        now = open_.select("qid").join(answers, "qid", "left").join(covered, "qid", "left").join(share, "qid", "left").join(best, "qid", "left")
        now = now.select("qid", "answer", total.alias("now"), "best", "kept").withColumn("better", F.col("best").isNull() | (F.col("now") > F.col("best")))
        # The best answer so far stands; the policy looks at this round's.
        now = now.select("qid", F.col("answer").isNull().alias("silent"), F.col("now"), F.when(F.col("answer").isNull(), F.col("best")).when(F.col("better"), F.col("now")).otherwise(F.col("best")).alias("best"), F.when(F.col("answer").isNull(), F.col("kept")).when(F.col("better"), F.col("answer")).otherwise(F.col("kept")).alias("kept"))
        now = written(now.withColumn("action", F.when(F.col("silent"), "INSUFFICIENT").otherwise(_policy(F.col("now"), k, rounds))), "round")
        ends = F.when(F.col("action") == "NOTE", F.concat("kept", F.lit("\n\n" + NOTE))).when(F.col("action") == "ANSWER", F.col("kept")).otherwise(INSUFFICIENT)
        result = lambda rows, at: rows.select("qid", F.col("action").alias("status"), ends.alias("answer"), F.coalesce("best", F.lit(0.0)).alias("coverage"), F.lit(at).alias("iterations"))
        done.append(result(now.where("action <> 'RETRY'"), k))
        again = now.where("action = 'RETRY'")
        if again.isEmpty():
            break
        wanted = written(next_queries(claims.join(again.select("qid"), "qid", "left_semi"), seen.join(again.select("qid"), "qid", "left_semi")), "asked")
        evidence, added = merged(evidence, retrieve(wanted))
        told = written(again.join(added, "qid", "left").withColumn("on", (F.coalesce("added", F.lit(0)) >= least_new) & F.lit(k + 1 < rounds)), "again")
        done.append(result(told.where(~F.col("on")).withColumn("action", F.lit("INSUFFICIENT")), k + 1))
        best = told.where("on").select("qid", "best", "kept")
        open_ = written(open_.join(I.held(best.select("qid")), "qid", "left_semi"), "open")
        if open_.isEmpty():
            break
    out = spark.createDataFrame([], schema)
    for part in done:
        out = out.unionByName(part)
    n = evidence.groupBy("qid").agg(F.count("*").alias("evidence"))
    return out.join(n, "qid", "left").join(q.select("qid", "options"), "qid").withColumn("evidence", F.coalesce("evidence", F.lit(0)))


def _policy(coverage: Column, at: int, rounds: int) -> Column:
    sure, note, _ = U.POLICY
    return F.when(coverage > sure, "ANSWER").when(coverage >= note, "NOTE").otherwise("RETRY" if at < rounds else "INSUFFICIENT")
