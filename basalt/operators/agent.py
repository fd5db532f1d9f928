"""The knowledge agent over a batch of questions: two ways of retrieving, then the gate that decides what becomes evidence.

`document`: a first look over everything finds the document that the question is about (a named one, else one that dominates the hits), a second
look stays within it.  `asset`: each sub-question is asked by itself and their hits are dealt in turn.

retrieve is a slot: (key, query, k, docs) -> (key, place from 1, chunk, doc, score, text), docs being a list of documents or null; hybrid_retriever
makes one of the composed retrieval.  Each look is one batch for all questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import hybrid as H
from basalt.operators import index as I
from basalt.operators import rank as R
from basalt.runtime import released, written

# How many hits each look asks for, and how many the gate lets through.
FIRST, SCOPED, PER_PART, MOST_PARTS, USED_DOCUMENT, USED_ASSET = 12, 6, 4, 6, 6, 8
DOMINANT_SHARE, DOMINANT_HITS = 0.4, 2
# End of fixed values.


def focus(first: DataFrame, targets: DataFrame) -> DataFrame:
    """(qid, docs, routed_by, rejected): the documents to stay in.  Named ones (qid, doc) win; else the one with the largest sum of 1 / place,
    if that is 40 % of all and two hits or more; the other documents of the first look are then rejected."""
    named = targets.groupBy("qid").agg(F.array_sort(F.collect_set("doc")).alias("docs")).select("qid", "docs", F.lit("named entity/concept").alias("routed_by"), F.array().cast(f"array<{dict(targets.dtypes)['doc']}>").alias("rejected"))  # what one question names
    votes = first.groupBy("qid", "doc").agg(F.round(F.sum(1.0 / F.col("place")), 9).alias("votes"), F.count("*").alias("hits"))
    per = Window.partitionBy("qid")
    votes = votes.withColumn("share", F.col("votes") / F.sum("votes").over(per)).withColumn("others", F.array_sort(F.collect_set("doc").over(per)))  # documents of twelve hits
    best = votes.withColumn("i", F.row_number().over(per.orderBy(F.desc("votes"), "doc"))).where((F.col("i") == 1) & (F.round("share", 6) >= DOMINANT_SHARE) & (F.col("hits") >= DOMINANT_HITS))
    best = best.join(named.select("qid"), "qid", "left_anti")
    return named.unionByName(best.select("qid", F.array("doc").alias("docs"), F.concat(F.lit("dominant document ("), F.floor(F.round("share", 6) * 100).cast("string"), F.lit("%)")).alias("routed_by"), F.array_remove("others", F.col("doc")).alias("rejected")))


def gate_rows(hits: DataFrame, queries: DataFrame, ix: H.ChunkIndex) -> DataFrame:
    """Hits (qid, chunk, doc, score, text) with what the acceptance gate looks at.  queries: (qid, asked: the rewritten question, aspects: the sides of a comparison)."""
    words = H._terms(ix, queries.select("qid", F.explode(T.query_terms(F.col("asked"))).alias("term"))).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("judged"))  # one question's words
    size = ix.chunks.groupBy("doc").agg(F.count("*").alias("size"))
    rows = hits.join(I.held(queries.join(words, "qid", "left").select("qid", "aspects", F.coalesce("judged", F.array().cast("array<struct<term:string,idf:double>>")).alias("judged"))), "qid").join(size, "doc")
    low, ts = F.lower("text"), F.array_distinct(T.tokens(F.col("text")))
    long = F.filter("judged", lambda x: F.length(x["term"]) >= 3)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x["idf"])
    prose = F.round(T.prose_factor(F.col("text")), 6)
    cover = total(F.filter("judged", lambda x: F.array_contains(ts, x["term"]))) / total(F.col("judged"))
    support = F.round(F.when(F.size("judged") > 0, F.least(F.lit(1.0), 0.08 + 0.92 * cover * (0.30 + 0.70 * prose))).otherwise(0.5), 4)
    side = F.when(F.size("aspects") > 0, F.exists("aspects", lambda a: F.contains(low, F.lower(a))))
    return rows.select("qid", F.col("chunk").alias("doc"), "score", F.size(T.lines(F.col("text"))).alias("lines"), prose.alias("prose"), F.size(F.filter(long, lambda x: F.contains(low, x["term"]))).alias("present"), F.size(long).alias("n_terms"), side.alias("side"), support.alias("support"), F.col("doc").alias("source"), "size")


def run(questions: DataFrame, targets: DataFrame, ix: H.ChunkIndex, retrieve: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(evidence, diagnostics) of questions (qid, asked, aspects, strategy, subqueries) with named documents targets (qid, doc).

    evidence: (qid, chunk, rank, used, reason): what the gate says of every hit of the last look.  diagnostics: (qid, strategy, routed_by, rejected, retrieved, used):
    for `asset` questions routed_by is null and retrieved counts the distinct hits of all parts."""
    q = written(questions.select("qid", "asked", "aspects", "strategy", "subqueries"), "agent-questions")
    doc_type = dict(ix.chunks.dtypes)["doc"]
    one = q.where("strategy = 'document'")
    look = lambda rows, k, docs: rows.select(F.col("qid").alias("key"), F.col("asked").alias("query"), F.lit(k).alias("k"), docs.cast(f"array<{doc_type}>").alias("docs"))
    first = written(retrieve(look(one, FIRST, F.lit(None))).withColumnRenamed("key", "qid"), "agent-first")
    at = written(focus(first, targets.join(one.select("qid"), "qid", "left_semi")), "agent-focus")
    scoped = written(retrieve(look(one.join(at, "qid"), SCOPED, F.col("docs"))).withColumnRenamed("key", "qid"), "agent-scoped")
    some = scoped.select("qid").distinct()
    hits = scoped.unionByName(first.join(some, "qid", "left_anti"))
    used = R.accept(gate_rows(hits.select("qid", "chunk", "doc", "score", "text"), q, ix), USED_DOCUMENT)
    # Sub-questions: one batch; each part's hits are dealt in turn, a chunk keeps its first place.
    parts = q.where("strategy = 'asset'").select("qid", F.posexplode(F.slice("subqueries", 1, MOST_PARTS)).alias("sub", "query"))
    keyed = written(parts.withColumn("key", F.col("qid") * MOST_PARTS + F.col("sub")), "agent-parts")
    found = retrieve(keyed.select("key", "query", F.lit(PER_PART).alias("k"), F.lit(None).cast(f"array<{doc_type}>").alias("docs"))).where(F.col("place") <= PER_PART)
    found = written(found.join(keyed.select("key", "qid", "sub"), "key"), "agent-found")
    dealt = R.round_robin(found.select("qid", "sub", F.col("chunk").alias("doc"), F.col("place").alias("rank")))
    merged = dealt.select("qid", F.col("doc").alias("chunk")).join(found.groupBy("qid", "chunk").agg(F.min(F.struct("place", "sub", "doc", "score", "text")).alias("x")).select("qid", "chunk", "x.doc", "x.score", "x.text"), ["qid", "chunk"])
    asset = R.accept(gate_rows(merged, q, ix), USED_ASSET)
    evidence = used.unionByName(asset).withColumnRenamed("doc", "chunk")
    seen = first.select("qid", "chunk").unionByName(found.select("qid", "chunk")).distinct().groupBy("qid").agg(F.count("*").alias("retrieved"))
    n = evidence.groupBy("qid").agg(F.count_if("used").alias("used"))
    diagnostics = q.select("qid", "strategy").join(at.select("qid", "routed_by", "rejected"), "qid", "left").join(seen, "qid", "left").join(n, "qid", "left")
    return evidence, diagnostics.select("qid", "strategy", "routed_by", "rejected", F.coalesce("retrieved", F.lit(0)).alias("retrieved"), F.coalesce("used", F.lit(0)).alias("used"))


def hybrid_retriever(ix: H.ChunkIndex, plans: DataFrame, scorer: H.Scorer | None = None) -> Callable[[DataFrame], DataFrame]:
    """The composed retrieval as the agent's slot; plans: what is known of each question (its columns as hybrid.retrieve asks for them) by key, with empty lists for sub-questions."""
    def retrieve(asked: DataFrame) -> DataFrame:
        known = plans.drop("query", "k", "docs")
        rows = asked.join(known.withColumnRenamed("qid", "key"), "key", "left")
        none = F.array().cast("array<string>")
        lists = [F.coalesce(c, none).alias(c) for c in ("entities", "aspects", "boost_sections", "boost_entities", "graph_entities")]
        got = H.retrieve(ix, rows.select(F.col("key").alias("qid"), "query", F.coalesce("judge", "query").alias("judge"), F.coalesce("intent", F.lit("general")).alias("intent"), *lists, "k", "docs"), scorer)
        return got.select(F.col("qid").alias("key"), "place", "chunk", "doc", "score", "text")

    return retrieve


def lexical_retriever(ix: H.ChunkIndex) -> Callable[[DataFrame], DataFrame]:
    """BM25 alone as the agent's slot.  Limits to documents hold where a chunk is scored: the chunks of a question's documents are nowhere listed."""
    def retrieve(asked: DataFrame) -> DataFrame:
        asked = written(asked, "agent-asked-of")
        limits = asked.where("docs is not null").select(F.col("key").alias("qid"), F.col("docs").alias("homes"))
        bound = limits.limit(1).count() > 0
        facts = ix.chunks.select(F.col("chunk").alias("doc"), F.lit(1.0).alias("bm25"), F.col("doc").alias("home")) if bound else None
        terms = H.asked_terms(ix, asked.select(F.col("key").alias("qid"), "query"))
        scores = I.legs(H.lexical_rows(ix).drop("dense"), terms, ["bm25"], FIRST, facts, limits if bound else None)
        rows = scores.withColumnRenamed("doc", "chunk").join(I.held(asked.select(F.col("key").alias("qid"), "k")), "qid")
        top = I.ranked(rows.select("qid", "chunk", "score", "k"), FIRST, key="chunk").where("rank < k")
        top = written(top, "agent-top")
        released(top.sparkSession)
        return ix.chunks.select("chunk", "doc", "text").join(I.held(top), "chunk").select(F.col("qid").alias("key"), (F.col("rank") + 1).alias("place"), "chunk", "doc", "score", "text")

    return retrieve
