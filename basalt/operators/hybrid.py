"""Composed retrieval of a batch of questions, all eleven stages, with limits that differ by question.

legs (one pass over the batch's postings) - document filter - rank fusion - metadata boost - candidate pool - relevance by a scorer,
or by lexical support where it collapses - entity-aware fusion - acceptance gate - best documents - diversity - repair of missing
aspects - near copies, neighbours that belong together, short context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import index as I
from basalt.operators import rank as R
from basalt.operators.store import field_stream
from basalt.runtime import released, ship, written

# Section fragments by intent, limits and weights of the specification.
INTENT_SECTIONS = {
    "author": ["title", "author", "abstract"],
    "summary": ["abstract", "introduction", "overview", "conclusion"],
    "implementation": ["implementation", "example", "code", "tutorial", "usage", "getting started"],
    "methodology": ["method", "approach", "architecture", "algorithm", "pipeline", "workflow"],
    "comparison": ["comparison", "versus", "results", "evaluation", "discussion", "trade-off"],
    "definition": ["abstract", "introduction", "overview", "glossary", "definition", "terminology"],
    "reasoning": ["discussion", "analysis", "why", "rationale"],
    "results": ["results", "evaluation", "experiments", "benchmark"],
    "limitations": ["limitation", "discussion", "future work", "drawback"],
    "conclusion": ["conclusion", "summary", "takeaway"],
    "equation": ["equation", "formula", "proof", "derivation", "math"],
    "figure": ["figure", "table", "diagram", "chart"],
    "debugging": ["troubleshoot", "debug", "error", "faq", "pitfall", "common mistake"],
    "optimization": ["optimiz", "performance", "tuning", "efficiency", "scaling"],
    "architecture": ["architecture", "design", "component", "overview", "structure"],
}
LEGS, DEPTH, RRF_K = {"dense": 1.0, "bm25": 1.0, "graph": 0.5}, 40, 60
SCORED_TEXT = 1500
SMALL_DOCUMENT = 12
PER_DOCUMENT, PER_SECTION = 4, 2
MERGED, SHORT = 2600, 1200
# End of fixed values.

#: (questions, evidence texts) to relevance in 0 .. 1, a batch at a time.
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


@dataclass
class ChunkIndex:
    """text: index of the chunks' fields, its doc being the chunk; chunks (chunk, doc, pos, section, text, summary, keywords, concepts, entities), written."""

    text: I.TextIndex
    chunks: DataFrame


def prepare(chunks: DataFrame) -> ChunkIndex:
    """Index of chunks with these fields: summary, keywords, concepts and text are searched as one stream."""
    kept = written(chunks.select("chunk", "doc", "pos", "section", "text", "summary", "keywords", "concepts", "entities"), "chunks")
    released(kept.sparkSession)
    stream = field_stream(F.col("summary"), F.array_join("keywords", " "), F.array_join("concepts", " "), F.col("text"))
    return ChunkIndex(I.build(kept.select("chunk", stream.alias("stream")), "chunk", "stream"), kept)


def _idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1


def _terms(ix: ChunkIndex, rows: DataFrame) -> DataFrame:
    """rows (with a column term) and the idf of each term; unknown ones have df 0."""
    known = ix.text.terms.join(I.held(rows.select("term").distinct()), "term")
    return rows.join(I.held(known), "term", "left").crossJoin(F.broadcast(ix.text.stats)).withColumn("idf", _idf(F.col("n_docs"), F.col("df")))  # one row of statistics


def asked_terms(ix: ChunkIndex, queries: DataFrame) -> DataFrame:
    """(qid, term, dense, bm25): what a term that the index knows weighs in each leg of a query (qid, query); written."""
    asked = _terms(ix, I.queries_of(queries, "qid", "query")).withColumn("w", (1 + F.log("qtf")) * F.col("idf"))
    norm = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qnorm"))
    bidf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return written(asked.join(norm, "qid").where("df is not null").select("qid", "term", (F.col("w") / F.col("qnorm") * F.col("idf")).alias("dense"), (F.col("qtf") * bidf).alias("bm25")), "asked")


def lexical_rows(ix: ChunkIndex, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc, term, dense, bm25): what each posting weighs; dense still has to be divided by the chunk's vector length."""
    tf = F.col("tf")
    bm25 = (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return ix.text.postings.crossJoin(F.broadcast(ix.text.stats)).select("doc", "term", (1 + F.log("tf")).alias("dense"), bm25.alias("bm25"))  # one row of statistics


def lexical_scores(ix: ChunkIndex, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, chunk, dense, bm25) of pairs (qid, chunk) that share a term: chunks are cut to the pairs, then their terms to the query's."""
    wanted = pairs.select("qid", F.col("chunk").alias("doc")).distinct()
    found = lexical_rows(ix).join(I.held(wanted), "doc").join(I.held(asked.select("qid", "term", F.col("dense").alias("d"), F.col("bm25").alias("b"))), ["qid", "term"])
    norms = I.held(I.near(ix.text.norms(), wanted))
    total = [F.round(F.sum(x), 6).alias(leg) for leg, x in (("dense", F.col("d") * (F.col("dense") / F.col("norm"))), ("bm25", F.col("b") * F.col("bm25")))]
    return found.join(norms, "doc").groupBy("qid", F.col("doc").alias("chunk")).agg(*total)


def graph_names(ix: ChunkIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, term, graph) of the chunks' entities and (qid, term, graph) of the queries' expanded graph entities; each counts 1."""
    mine = queries.select("qid", F.explode("graph_entities").alias("term")).distinct().withColumn("graph", F.lit(1.0))
    return ix.chunks.select(F.col("chunk").alias("doc"), F.explode("entities").alias("term")).withColumn("graph", F.lit(1.0)), mine


def fused(ix: ChunkIndex, queries: DataFrame) -> DataFrame:
    """(qid, chunk, rrf, dense, bm25, graph) of what the legs' first DEPTH hits elect, within the documents that a query is limited to (docs; null: all).

    A document's legs are summed where its postings are shuffled to, and only each task's best of a query leave it; hits are nowhere listed.
    The scores of the elected in the other legs come from a second look at their chunks."""
    asked = asked_terms(ix, queries)
    limits = queries.where("docs is not null").select("qid", F.col("docs").alias("homes"))
    home = ix.chunks.select(F.col("chunk").alias("doc"), F.col("doc").alias("home"))
    facts = ix.text.norms().select("doc", F.col("norm").alias("dense"), F.lit(1.0).alias("bm25"))
    of, mine = graph_names(ix, queries)
    bound = limits.limit(1).count() > 0
    limits = limits if bound else None
    homes = (lambda rows: rows.join(home, "doc")) if bound else (lambda rows: rows.withColumn("home", F.lit(None).cast(home.schema["home"].dataType)))
    found = I.legs(lexical_rows(ix), asked, ["dense", "bm25"], DEPTH, homes(facts), limits)
    found = found.unionByName(I.legs(of, mine, ["graph"], DEPTH, home.withColumn("graph", F.lit(1.0)) if bound else None, limits))
    top = written(found.withColumn("place", F.row_number().over(Window.partitionBy("qid", "leg").orderBy(F.desc("score"), "doc"))).where(F.col("place") <= DEPTH), "leg-tops")
    released(top.sparkSession)
    weight = F.create_map(*(F.lit(x) for pair in LEGS.items() for x in pair))
    rrf = written(top.groupBy("qid", F.col("doc").alias("chunk")).agg(F.round(F.sum(weight[F.col("leg")] / (RRF_K + F.col("place") - 1)), 8).alias("rrf")), "elected")
    pairs = I.held(rrf.select("qid", F.col("chunk").alias("doc")))
    named = of.join(pairs, "doc").join(I.held(mine.drop("graph")), ["qid", "term"]).groupBy("qid", F.col("doc").alias("chunk")).agg(F.sum("graph").alias("graph"))
    for hits in (lexical_scores(ix, asked, rrf), named):
        rrf = rrf.join(hits, ["qid", "chunk"], "left")
    return rrf.select("qid", "chunk", "rrf", *(F.coalesce(leg, F.lit(0.0)).alias(leg) for leg in LEGS))


def boost(q: str = "judge") -> Column:
    """Bounded boost from section, entities, keywords and asked-for sections of a candidate."""
    table = F.create_map(*(x for k, v in INTENT_SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    section = F.lower(F.coalesce("section", F.lit("")))
    holds = lambda xs: F.exists(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.contains(section, F.lower(x)))
    both = F.size(F.array_intersect("entities", "boost_entities"))
    return R.metadata_boost(holds(F.try_element_at(table, F.col("intent"))), both, F.size(F.array_intersect(T.tokens(F.col(q)), F.col("keywords"))), holds(F.col("boost_sections")) & (section != ""))


def entity_terms(names: Column) -> Column:
    """Names in lower case and singular, three characters or more, distinct."""
    low = F.transform(names, lambda n: F.array_join(F.transform(F.filter(F.split(F.lower(F.trim(n)), r"[ \t\n]+"), lambda w: w != ""), T.singular), " "))
    return F.array_distinct(F.filter(low, lambda t: F.length(t) >= 3))


def stands_in(term: Column, hay: Column) -> Column:
    """Whether a term stands in a text as whole words, hyphens aside."""
    at = lambda t, h: F.rlike(h, F.concat(F.lit("(?<![a-z0-9])\\Q"), t, F.lit("\\E(?![a-z0-9])")))
    return at(term, hay) | at(F.replace(term, F.lit("-"), F.lit("")), F.replace(hay, F.lit("-"), F.lit("")))


def with_weights(ix: ChunkIndex, queries: DataFrame) -> DataFrame:
    """queries with judged (term, idf of each informative word of the clean question) and named (term, w of each entity: the idf of its rarest token)."""
    words = _terms(ix, queries.select("qid", F.explode(T.query_terms(F.col("judge"))).alias("term")))
    judged = words.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("judged"))  # one question's words
    names = queries.select("qid", F.explode(entity_terms(F.concat("entities", "aspects"))).alias("name"))
    toks = _terms(ix, names.select("qid", "name", F.explode_outer(T.tokens(F.col("name"))).alias("term")))
    weight = toks.groupBy("qid", "name").agg(F.coalesce(F.max(F.when(F.col("term").isNotNull(), F.col("idf"))), F.lit(1.0)).alias("w"))
    named = weight.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("term"), "w"))).alias("named"))  # one question's names
    none = lambda c, w: F.coalesce(c, F.array().cast(f"array<struct<term:string,{w}:double>>")).alias(c)
    return queries.join(judged, "qid", "left").join(named, "qid", "left").select(*queries.columns, none("judged", "idf"), none("named", "w"))


def _total(xs: Column, field: str) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x[field])


def select_diverse(rows: DataFrame) -> DataFrame:
    """(qid, chunk, position): greedy maximal marginal relevance with each query's own k and per_doc.
    rows: (qid, chunk, doc, section, score, k, per_doc, terms, weights); a query's rows are a bounded pool."""
    ship(rows.sparkSession)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["score", "chunk"], ascending=[False, True]).reset_index(drop=True)
        vectors = [dict(zip(t, w, strict=True)) for t, w in zip(rows["terms"], rows["weights"], strict=True)]
        k, per_doc, top = int(rows["k"][0]), int(rows["per_doc"][0]), rows["score"].max() or 1.0
        docs, sections = rows["doc"].tolist(), list(zip(rows["doc"], rows["section"], strict=True))
        near = [0.0] * len(rows)  # the largest similarity to what is chosen
        chosen: list[int] = []
        while len(chosen) < k:
            best = None
            for i in range(len(rows)):
                if i in chosen or sum(docs[j] == docs[i] for j in chosen) >= per_doc or sum(sections[j] == sections[i] for j in chosen) >= PER_SECTION:
                    continue
                value = round(R.MMR_LAMBDA * rows["score"][i] / top - (1 - R.MMR_LAMBDA) * near[i], 9)
                if best is None or value > best[0]:
                    best = (value, i)
            if best is None or len(chosen) >= min(R.MMR_LEAST, k) and near[best[1]] > R.MMR_SATURATED:
                break
            chosen.append(best[1])
            near = [max(n, round(sum(w * vectors[best[1]].get(t, 0.0) for t, w in v.items()), 9)) for n, v in zip(near, vectors, strict=True)]
        return pd.DataFrame({"qid": rows["qid"][chosen], "chunk": rows["chunk"][chosen], "position": range(len(chosen))})

    return rows.groupBy("qid").applyInPandas(choose, "qid bigint, chunk bigint, position bigint")


def covered_aspects(rows: DataFrame) -> DataFrame:
    """(qid, doc, pos, total): which aspects a candidate covers, as a phrase or by all of its informative words; rows: (qid, chunk, aspects, hay)."""
    aspects = F.filter(F.transform("aspects", lambda a: F.lower(F.trim(a))), lambda a: F.length(a) >= 3)
    each = rows.select("qid", F.col("chunk").alias("doc"), "hay", F.size(aspects).alias("total"), F.posexplode(aspects).alias("pos", "aspect"))
    words = T.query_terms(F.col("aspect"))
    return each.where(stands_in(F.col("aspect"), F.col("hay")) | ((F.size(words) > 0) & F.forall(words, lambda w: stands_in(w, F.col("hay"))))).select("qid", "doc", "pos", "total")


def merge_runs(rows: DataFrame) -> DataFrame:
    """Rows (qid, doc, pos, chunk, section, score, text) with chunks that follow each other in a section joined, as long as both
    together are shorter than MERGED: an order-dependent fold over the few rows of a query, as each join makes the text longer.

    Returns (qid, chunk, doc, pos, section, score, text, chunks): the first chunk's id, the last one's place, the best score."""
    kind = "array<struct<chunk:bigint,doc:bigint,pos:bigint,section:string,score:double,text:string,chunks:array<bigint>>>"
    rows = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("doc", "pos", "chunk", "section", "score", "text"))).alias("xs"))

    def take(acc: Column, x: Column) -> Column:
        p = F.try_element_at(acc, F.lit(-1))
        joins = (p["doc"] == x["doc"]) & (p["pos"] + 1 == x["pos"]) & p["section"].eqNullSafe(x["section"]) & (F.length(p["text"]) + F.length(x["text"]) < MERGED)
        text = F.concat(F.regexp_replace(p["text"], r"\s+$", ""), F.lit("\n\n"), F.regexp_replace(x["text"], r"^\s+", ""))
        one = lambda *cols: F.array(F.struct(*(c.alias(n) for c, n in zip(cols, ("chunk", "doc", "pos", "section", "score", "text", "chunks"), strict=True))))
        new = one(x["chunk"], x["doc"], x["pos"], x["section"], x["score"], x["text"], F.array(x["chunk"]))
        longer = one(p["chunk"], p["doc"], x["pos"], p["section"], F.greatest(p["score"], x["score"]), text, F.concat(p["chunks"], F.array(x["chunk"])))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)).otherwise(F.concat(acc, new))

    return rows.select("qid", F.explode(F.aggregate("xs", F.array().cast(kind), take)).alias("x")).select("qid", "x.*")


def expand(ix: ChunkIndex, rows: DataFrame) -> DataFrame:
    """rows (qid, doc, pos, section, text, ...) whose text is short take in the chunks before and behind of the same section that are not chosen themselves; MERGED characters at most.

    Of a joined block the last chunk counts as chosen, as specified: a short block takes in the chunk before that one once more."""
    rows = written(rows, "merged")
    short = rows.where(F.length("text") <= SHORT).select("qid", F.col("doc"), F.col("pos").alias("home"), "section", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    want = short.withColumn("pos", F.col("home") + F.col("side")).join(rows.select("qid", "doc", "pos"), ["qid", "doc", "pos"], "left_anti")
    near = ix.chunks.select("doc", "pos", F.col("section").alias("own"), F.col("text").alias("beside")).join(I.held(want), ["doc", "pos"]).where(F.col("own").eqNullSafe(F.col("section")))
    sides = near.groupBy("qid", "doc", "home").agg(F.max(F.when(F.col("side") == -1, F.col("beside"))).alias("before"), F.max(F.when(F.col("side") == 1, F.col("beside"))).alias("behind")).withColumnRenamed("home", "pos")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    whole = F.concat_ws("\n\n", filled("before"), filled("text"), filled("behind"))
    return rows.join(sides, ["qid", "doc", "pos"], "left").withColumn("text", F.when(F.length("text") <= SHORT, F.substring(whole, 1, MERGED)).otherwise(F.col("text"))).drop("before", "behind")


def relevance(rows: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Adds rerank: what the scorer says of question and evidence (summary, keywords, concepts and the beginning of the text, as the specification limits it); null without one."""
    if scorer is None:
        return rows.withColumn("rerank", F.lit(None).cast("double"))
    ship(rows.sparkSession)
    call = F.pandas_udf(lambda q, e: scorer(q, e).astype("float64"), "double")
    evidence = F.concat_ws(" ", "summary", F.array_join("keywords", " "), F.array_join("concepts", " "), F.substring("text", 1, SCORED_TEXT))
    return rows.withColumn("rerank", call(F.col("judge"), evidence))


def candidates(ix: ChunkIndex, queries: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Stages 1 to 8: the ranked candidates of each query that pass the gate and stand in one of its best documents, with every signal.

    queries: (qid, query, judge, intent, entities, aspects, boost_sections, boost_entities, graph_entities, k, docs); query widens recall,
    judge is the clean question.  k may be null; it is never below what the question's own complexity asks for."""
    own, pool = R.adaptive_k(F.col("query"))
    q = queries.withColumn("k", F.greatest(F.coalesce("k", F.lit(0)), own)).withColumn("pool", F.least(F.lit(40), F.greatest(pool, 3 * F.col("k"))))
    q = written(with_weights(ix, q).drop("entities"), "queries")  # chunks have a column of that name
    top = written(fused(ix, q), "fused")
    rows = ix.chunks.join(I.held(top), "chunk").join(I.held(q.drop("graph_entities")), "qid").withColumn("meta", F.round(boost(), 6))
    order = lambda score: Window.partitionBy("qid").orderBy(F.desc(score), "chunk")
    rows = rows.withColumn("boosted", F.round(F.col("rrf") * F.col("meta"), 10)).withColumn("place", F.row_number().over(order("boosted"))).where("place <= pool")
    # Relevance: the clean question against the chunk's own words.
    ts = F.array_distinct(T.tokens(F.col("text")))
    rows = rows.withColumn("ts", ts).withColumn("hay", F.array_join(T.tokens(F.concat_ws(" ", "text", "summary", F.array_join("keywords", " "), F.array_join("entities", " "))), " "))
    cover = _total(F.filter("judged", lambda x: F.array_contains("ts", x["term"])), "idf") / _total(F.col("judged"), "idf")
    support = F.round(F.least(F.lit(1.0), 0.08 + 0.92 * cover * (0.30 + 0.70 * T.prose_factor(F.col("text")))), 4)
    rows = R.collapse(relevance(rows.withColumn("support", F.when(F.size("judged") > 0, support).otherwise(0.5)), scorer))
    met = F.filter("named", lambda x: stands_in(x["term"], F.col("hay")))
    rows = rows.withColumn("matched", F.transform(met, lambda x: x["term"])).withColumn("entity", F.when(F.size("named") > 0, F.round(_total(met, "w") / _total(F.col("named"), "w"), 4)).otherwise(0.0))
    rows = rows.withColumn("score", F.round(F.when(F.size("named") > 0, R.fuse(F.col("relevance"), F.col("entity"), F.col("meta"))).otherwise(F.col("relevance")), 6)).withColumn("rank", F.row_number().over(order("score")) - 1)
    w, unit = R.GATE_WEIGHTS, lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    near = F.least(F.lit(1.0), F.col("graph") / R.GRAPH_SATURATION)
    signal = w["support"] * unit(F.col("relevance")) + w["dense"] * F.least(F.lit(1.0), F.col("dense")) + w["bm25"] * F.col("bm25") / (F.col("bm25") + R.BM25_SATURATION) + (w["graph"] + w["entity"]) * near + w["meta"] * unit((F.col("meta") - 1) / 0.5)
    small = ix.chunks.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") <= SMALL_DOCUMENT)
    relaxed = q.where(F.size("docs") == 1).select("qid", F.element_at("docs", 1).alias("doc")).join(small, "doc").select("qid", F.lit(0.0).alias("bar"))
    gated = rows.withColumn("accept_score", F.round(signal, 4)).join(I.held(relaxed), "qid", "left").where((F.col("rank") == 0) | (F.col("accept_score") >= F.coalesce("bar", F.lit(R.ACCEPT)))).drop("bar")
    # A document counts by its two best chunks; the best few documents stay.
    mine = Window.partitionBy("qid", "doc").orderBy(F.desc("score"), "chunk")
    gated = gated.withColumn("i", F.row_number().over(mine)).withColumn("weight", F.round(F.sum(F.when(F.col("i") <= 2, F.col("score"))).over(Window.partitionBy("qid", "doc")), 6))
    gated = gated.withColumn("doc_rank", F.dense_rank().over(Window.partitionBy("qid").orderBy(F.desc("weight"), "doc")))
    return gated.where(F.col("doc_rank") <= F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("k") / 2)))).drop("i", "weight", "judged", "place", "boosted", "pool")


def retrieve(ix: ChunkIndex, queries: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """(qid, place, chunk, chunks, doc, pos, section, text, score and the signals of the first chunk): what each question gets, best first."""
    pool = written(candidates(ix, queries, scorer), "pool")
    vectors = R.vectors_of(ix.text, pool.select(F.col("chunk").alias("doc"))).withColumnRenamed("doc", "chunk")
    per_doc = F.when(F.size("docs") == 1, F.col("k")).otherwise(F.least(F.lit(PER_DOCUMENT), F.col("k")))
    chosen = select_diverse(pool.select("qid", "chunk", "doc", "section", "score", "k", per_doc.alias("per_doc")).join(vectors, "chunk"))
    first = written(pool.select("qid", F.col("chunk").alias("doc"), "score").join(chosen.withColumnRenamed("chunk", "doc"), ["qid", "doc"]), "selected")
    repaired = R.cover_aspects(first.select("qid", "doc", "score"), pool.select("qid", F.col("chunk").alias("doc"), "score"), covered_aspects(pool))
    # Without aspects the order of choice stands, with them that of scores.
    told = pool.select("qid", F.exists("aspects", lambda a: F.length(F.trim(a)) >= 3).alias("told")).distinct()
    order = Window.partitionBy("qid").orderBy(F.when(F.col("told") | F.col("position").isNull(), F.lit(0)).otherwise(F.col("position")), F.desc("score"), "doc")
    listed = repaired.join(first.select("qid", "doc", "position"), ["qid", "doc"], "left").join(told, "qid").withColumn("rank", F.row_number().over(order) - 1)
    single = R.drop_contained(listed.select("qid", "doc", "rank").join(pool.select("qid", F.col("chunk").alias("doc"), "ts"), ["qid", "doc"])).select("qid", F.col("doc").alias("chunk"))
    joined = expand(ix, merge_runs(single.join(pool.select("qid", "chunk", "doc", "pos", "section", "score", "text"), ["qid", "chunk"])))
    signals = pool.select("qid", "chunk", "rrf", "dense", "bm25", "graph", "relevance", "entity", "meta", "accept_score", "collapsed", "matched")
    method = F.concat_ws(" + ", F.when(F.col("dense") > 0, "Dense"), F.when(F.col("bm25") > 0, "BM25"), F.when(F.col("graph") > 0, "Graph"))
    why = F.concat_ws("; ", F.when(F.col("dense") > 0.60, "High semantic similarity"), F.when(F.col("bm25") > 3, "Strong keyword overlap"), F.when(F.col("graph") > 0, "Matched graph neighborhood"), F.when(F.size("matched") > 0, F.concat(F.lit("Covers query entities: "), F.array_join(F.slice("matched", 1, 4), ", "))))
    out = joined.join(signals, ["qid", "chunk"]).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc", "pos")))
    return out.withColumn("method", F.when(method == "", "RRF").otherwise(method)).withColumn("why", F.when(why == "", "elected by rank fusion and relevance").otherwise(why))
