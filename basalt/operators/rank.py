"""Ranking: boosts, gates, fusion, document choice, diversity, neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from basalt.functions import text as T
from basalt.operators import index as I
from basalt.runtime import ship

# Weights and thresholds of the specification.
GATE_WEIGHTS = {"support": 0.45, "dense": 0.15, "bm25": 0.15, "graph": 0.10, "meta": 0.05, "entity": 0.10}
ACCEPT, BM25_SATURATION, GRAPH_SATURATION, COLLAPSE = 0.15, 4.0, 3.0, 0.20
FUSION = (0.60, 0.20, 0.20)
MMR_LAMBDA, MMR_SATURATED, MMR_LEAST = 0.72, 0.90, 3
MULTIPART = [" and ", " compare", " versus ", " vs ", " difference", " both ", " all ", " list ", " steps", " explain", " summarize"]
# End of fixed values.


def _terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return queries.select(F.col(id_col).alias("qid"), F.explode(T.query_terms(F.col(text_col))).alias("term"))


def _weighed(terms: DataFrame, index: I.TextIndex) -> DataFrame:
    """terms with idf = ln((N + 1) / (df + 1)) + 1; a term that the corpus lacks has df 0."""
    idf = F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    return terms.join(index.terms, "term", "left").crossJoin(F.broadcast(index.stats)).withColumn("idf", idf).drop("df", "n_docs", "avg_dl")  # one row of statistics


def _met(candidates: DataFrame, terms: DataFrame, index: I.TextIndex) -> DataFrame:
    """(qid, doc, met): the idf of the terms (qid, term, idf) that each candidate holds; postings are cut to the terms, then to the candidates, before anything is summed."""
    found = index.postings.select("doc", "term").join(I.held(terms.select("term").distinct()), "term")
    pairs = I.held(candidates.select("qid", "doc").distinct())
    return found.join(pairs, "doc").join(I.held(terms), ["qid", "term"]).groupBy("qid", "doc").agg(F.sum("idf").alias("met"))


def lexical_support(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, index: I.TextIndex, q_id: str = "item_id", q_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(qid, doc, support) of candidate pairs: min(1, .08 + .92 * coverage * (.30 + .70 * prose)).

    Coverage is the share of the query terms' idf that the chunk holds."""
    terms = _weighed(_terms(queries, q_id, q_text), index)
    total = terms.groupBy("qid").agg(F.sum("idf").alias("total"))
    met = _met(candidates, terms, index)
    prose = I.near(chunks.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), candidates).select("doc", T.prose_factor(F.col("text")).alias("prose"))  # of candidates only
    rows = candidates.select("qid", "doc").join(met, ["qid", "doc"], "left").join(total, "qid", "left").join(prose, "doc")
    cover = F.coalesce(F.col("met"), F.lit(0.0)) / F.col("total")
    support = F.least(F.lit(1.0), 0.08 + 0.92 * cover * (0.30 + 0.70 * F.col("prose")))
    return rows.select("qid", "doc", F.round(F.when(F.coalesce("total", F.lit(0.0)) > 0, support).otherwise(0.5), 4).alias("support"))


def entity_coverage(candidates: DataFrame, queries: DataFrame, index: I.TextIndex, q_id: str = "item_id", q_text: str = "text") -> DataFrame:
    """(qid, doc, entity): share of the query's entities that the chunk holds as a token, weighed by idf; 0 without any.

    Entities are the query's capitalised words of four letters or more, in singular."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(q_text), F.lit("")), F.lit("[A-Z][A-Za-z]{3,}"), F.lit(0)), lambda w: T.singular(F.lower(w))))
    terms = _weighed(queries.select(F.col(q_id).alias("qid"), F.explode(found).alias("term")), index)
    total = terms.groupBy("qid").agg(F.sum("idf").alias("all"))
    met = _met(candidates, terms, index)
    rows = candidates.select("qid", "doc").join(met, ["qid", "doc"], "left").join(total, "qid", "left")
    return rows.select("qid", "doc", F.round(F.coalesce(F.col("met") / F.col("all"), F.lit(0.0)), 4).alias("entity"))


def metadata_boost(section_hit: Column, entities: Column, keywords: Column, explicit: Column) -> Column:
    """1 + min(.5, .20 section + min(.20, .10 each entity) + min(.16, .08 each keyword) + .15 explicit section)."""
    raw = F.when(section_hit, 0.20).otherwise(0.0) + F.least(F.lit(0.20), 0.10 * entities) + F.least(F.lit(0.16), 0.08 * keywords) + F.when(explicit, 0.15).otherwise(0.0)
    return 1 + F.least(F.lit(0.5), raw)


def fuse(relevance: Column, entity: Column, meta: Column) -> Column:
    """.60 relevance + .20 entity + .20 normalised boost."""
    a, b, c = FUSION
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return a * unit(relevance) + b * entity + c * unit((meta - 1) / 0.5)


def gate(rows: DataFrame, threshold: float = ACCEPT) -> DataFrame:
    """Adds accept_score, accepted and reason; rows: (qid, rank, support, dense, bm25, graph, meta, entity).

    The first row of a query always stays.  Where the best support of a query is below COLLAPSE the
    reranker has collapsed and the reason says so."""
    w = GATE_WEIGHTS
    score = w["support"] * F.col("support") + w["dense"] * F.col("dense") + w["bm25"] * F.col("bm25") / (F.col("bm25") + BM25_SATURATION)
    score = score + w["graph"] * F.least(F.lit(1.0), F.col("graph") / GRAPH_SATURATION) + w["meta"] * (F.col("meta") - 1) / 0.5 + w["entity"] * F.col("entity")
    best = F.max("support").over(Window.partitionBy("qid"))
    out = rows.withColumn("accept_score", F.round(score, 4)).withColumn("accepted", (F.col("rank") == 0) | (F.col("accept_score") >= threshold))
    reason = F.when(F.col("rank") == 0, "top").when(best < COLLAPSE, "fallback").when(F.col("accepted"), "accepted").otherwise("below threshold")
    return out.withColumn("reason", reason)


def document_scores(hits: DataFrame, doc_of: str, top: int = 2) -> DataFrame:
    """(qid, document, score, doc_rank): sum of each document's `top` best chunk scores, ranked."""
    order = Window.partitionBy("qid", doc_of).orderBy(F.desc("score"), "doc")
    best = hits.withColumn("i", F.row_number().over(order)).where(F.col("i") <= top).groupBy("qid", doc_of).agg(F.round(F.sum("score"), 6).alias("score"))
    return best.withColumn("doc_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), doc_of)))


def document_rerank(hits: DataFrame, doc_of: str, k: int) -> DataFrame:
    """Hits of the best min(3, max(1, k / 2)) documents only."""
    docs = document_scores(hits, doc_of).where(F.col("doc_rank") <= min(3, max(1, k // 2)))
    return hits.join(docs.select("qid", doc_of, "doc_rank"), ["qid", doc_of])


def dominant(hits: DataFrame, doc_of: str) -> DataFrame:
    """(qid, document, votes, share, hits): the document with the largest sum of 1 / (1 + rank), if it holds 40 % and two hits."""
    votes = hits.groupBy("qid", doc_of).agg(F.sum(1 / (1 + F.col("rank"))).alias("votes"), F.count("*").alias("hits"))
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy("qid"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("votes", 6)), doc_of)
    best = votes.withColumn("share", F.round(share, 4)).withColumn("i", F.row_number().over(order)).where("i = 1")
    return best.where("share >= 0.4 and hits >= 2").select("qid", doc_of, F.round("votes", 6).alias("votes"), "share", "hits")


def grounding(queries: DataFrame, index: I.TextIndex, q_id: str = "item_id", q_text: str = "text") -> DataFrame:
    """(qid, n_terms, coverage, rarest_term, rarest_known): how much of a query the corpus knows."""
    rows = _terms(queries, q_id, q_text).join(index.terms, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return rows.groupBy("qid").agg(F.count("*").alias("n_terms"), F.round(F.avg((F.col("df") > 0).cast("double")), 4).alias("coverage"), F.min(F.struct("df", "term")).alias("r")).select("qid", "n_terms", "coverage", F.col("r.term").alias("rarest_term"), (F.col("r.df") > 0).alias("rarest_known"))


def adaptive_k(text: Column) -> tuple[Column, Column]:
    """How many results (3 to 10) and candidates (16 to 40) a query should get, from its length, parts and question marks."""
    n = F.size(F.filter(T.tokens(text), lambda w: ~w.isin(T.QUERY_STOP)))
    low = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    parts = F.greatest(*(F.contains(low, F.lit(m)) for m in MULTIPART))
    add = lambda cond, k: F.when(cond, k).otherwise(0)
    k = 4 + add(n > 6, 2) + add(n > 12, 2) + add(parts, 2) + add(F.regexp_count(text, F.lit(r"\?")) > 1, 1)
    k = F.least(F.lit(10), F.greatest(F.lit(3), k))
    pool = F.greatest(20 + add(n > 6, 6) + add(n > 12, 6) + add(parts, 8), 3 * k)
    return k.cast("int"), F.least(F.lit(40), F.greatest(F.lit(16), pool)).cast("int")


def mmr(candidates: DataFrame, k: int, per_doc: int = 4, per_section: int = 2) -> DataFrame:
    """Greedy maximal marginal relevance per query; candidates: (qid, doc, section, score, terms array<string>, weights array<double>).

    A query's candidates are a bounded pool (40 at most), so each group fits a task.  Similarity is the cosine of the
    TF-IDF weights (unit length); once MMR_LEAST are chosen, it ends where even the best candidate is nearly one of them."""

    ship(candidates.sparkSession)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["score", "doc"], ascending=[False, True]).reset_index(drop=True)
        vectors, top = [dict(zip(t, w, strict=True)) for t, w in zip(rows["terms"], rows["weights"], strict=True)], rows["score"].max() or 1.0
        like = lambda i, j: round(sum(w * vectors[j].get(t, 0.0) for t, w in vectors[i].items()), 9)
        chosen: list[int] = []
        while len(chosen) < k:
            best = None
            for i in range(len(rows)):
                if i in chosen or sum(rows["doc"][j] == rows["doc"][i] for j in chosen) >= per_doc or sum(rows["section"][j] == rows["section"][i] for j in chosen) >= per_section:
                    continue
                near = max((like(i, j) for j in chosen), default=0.0)
                value = round(MMR_LAMBDA * rows["score"][i] / top - (1 - MMR_LAMBDA) * near, 9)
                if best is None or value > best[0]:
                    best = (value, i, near)
            if best is None or len(chosen) >= min(MMR_LEAST, k) and best[2] > MMR_SATURATED:
                break
            chosen.append(best[1])
        out = rows.loc[chosen, ["qid", "doc", "section", "score"]].copy()
        out["position"] = range(len(out))
        return out

    schema = candidates.select("qid", "doc", "section", "score").schema.add("position", "long")
    return candidates.select("qid", "doc", "section", "score", "terms", "weights").groupBy("qid").applyInPandas(choose, schema)


def vectors_of(index: I.TextIndex, docs: DataFrame) -> DataFrame:
    """(doc, terms, weights): unit TF-IDF vectors of some documents (column doc), as arrays."""
    some = index.postings.select("doc", "term", "tf").join(I.held(docs.select("doc").distinct()), "doc")
    w = (1 + F.log("tf")) * (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)
    rows = some.join(index.terms, "term").join(index.norms(), "doc").crossJoin(F.broadcast(index.stats)).select("doc", F.struct("term", (w / F.col("norm")).alias("w")).alias("x"))  # one row of statistics
    return rows.groupBy("doc").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("doc", F.col("xs.term").alias("terms"), F.col("xs.w").alias("weights"))  # one document's terms


def collapse(rows: DataFrame, support: str = "support", rerank: str = "rerank") -> DataFrame:
    """Adds relevance and collapsed: the reranker's score, or where a query's best one is below COLLAPSE, lexical support in its place."""
    best = F.max(rerank).over(Window.partitionBy("qid"))
    gone = F.coalesce(best < COLLAPSE, F.lit(True))
    return rows.withColumn("collapsed", gone).withColumn("relevance", F.when(gone, F.col(support)).otherwise(F.col(rerank)))


def cover_aspects(selected: DataFrame, pool: DataFrame, aspects: DataFrame) -> DataFrame:
    """(qid, doc, score) after repair: every aspect of a comparison that the pool covers should be covered by the selection.

    For an aspect that no selected row covers, the pool's best row that does takes the place of the weakest selected row
    whose own aspects others cover.  selected, pool: (qid, doc, score); aspects: (qid, doc, pos, total): which rows cover aspect number pos.
    A query's pool is bounded, so each group fits a task."""
    ship(selected.sparkSession)
    marks = aspects.groupBy("qid", "doc").agg(F.collect_set("pos").alias("covers"))
    total = aspects.groupBy("qid").agg(F.max("total").alias("total"))
    rows = pool.join(selected.select("qid", "doc", F.lit(True).alias("chosen")), ["qid", "doc"], "left").join(marks, ["qid", "doc"], "left").join(total, "qid", "left")
    rows = rows.select("qid", "doc", "score", F.coalesce("chosen", F.lit(False)).alias("chosen"), F.coalesce("covers", F.array().cast("array<int>")).alias("covers"), F.coalesce("total", F.lit(0)).alias("total"))

    def repair(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["score", "doc"], ascending=[False, True]).reset_index(drop=True)
        covers = [set(c) for c in rows["covers"]]
        chosen = [i for i in range(len(rows)) if rows["chosen"][i]]
        for aspect in range(int(rows["total"].max())):
            if not chosen or any(aspect in covers[i] for i in chosen):
                continue
            new = next((i for i in range(len(rows)) if i not in chosen and aspect in covers[i]), None)
            spare = next((i for i in reversed(chosen) if covers[i] <= set().union(*(covers[j] for j in chosen if j != i))), None)
            if new is not None and spare is not None:
                chosen = sorted([*(i for i in chosen if i != spare), new])
        return rows.loc[chosen, ["qid", "doc", "score"]]

    return rows.groupBy("qid").applyInPandas(repair, selected.select("qid", "doc", "score").schema)


def drop_contained(hits: DataFrame, most: float = 0.85) -> DataFrame:
    """(qid, doc, rank) without near copies: in order of rank a row goes if its tokens, or those of a kept one, lie almost whole in the other.
    hits: (qid, doc, rank, ts array of distinct tokens); a query's hits are a bounded list."""
    each = F.struct("rank", "doc", "ts")
    start = F.array().cast("array<struct<rank:bigint,doc:bigint,ts:array<string>>>")

    def take(acc: Column, x: Column) -> Column:
        both = lambda y: F.size(F.array_intersect(x["ts"], y["ts"]))
        twin = F.exists(acc, lambda y: (both(y) > 0) & (both(y) / F.greatest(F.lit(1), F.least(F.size(x["ts"]), F.size(y["ts"]))) > most))
        return F.when(twin, acc).otherwise(F.concat(acc, F.array(F.struct(x["rank"].cast("bigint").alias("rank"), x["doc"].cast("bigint").alias("doc"), x["ts"].alias("ts")))))

    kept = hits.groupBy("qid").agg(F.array_sort(F.collect_list(each)).alias("hs")).select("qid", F.explode(F.aggregate("hs", start, take)).alias("h"))
    return kept.select("qid", F.col("h.doc").alias("doc"), F.col("h.rank").alias("rank"))


def accept(hits: DataFrame, k: int = 6, semantic: bool = False) -> DataFrame:
    """Adds rank, used and reason: which hits become evidence.  hits: (qid, doc, score, lines, prose, present, n_terms, side, support, source, size).

    Outlines go first (over three lines, hardly any prose).  The best of the rest anchors the answer; the others need 45 % of its score,
    enough of the query's terms, a side of a comparison (side: null if there is none to name) and real support, or prose where all
    hits are of one source; small single sources (size: their chunks) keep everything.  `k` rows are used at most."""
    outline = (F.col("lines") > 3) & (F.col("prose") < 0.15)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    rows = hits.withColumn("outline", outline)
    solid = rows.where(~F.col("outline")).withColumn("rank", F.row_number().over(order) - 1)
    per = Window.partitionBy("qid")
    top, one = F.max("score").over(per), F.min("source").over(per) == F.max("source").over(per)
    need = F.lit(1) if semantic else F.least(F.lit(2), F.col("n_terms"))
    bar = 0.12 if semantic else 0.35
    fault = (
        F.when((F.col("rank") == 0) | (F.col("one") & (F.col("size") <= 12)), F.lit(None).cast("string"))
        .when(F.col("score") < 0.45 * F.col("top"), "below relevance bar").when(F.col("present") < need, "insufficient query-term support")
        .when(F.coalesce(~F.col("side"), F.lit(False)), "mentions neither side of the comparison")
        .when((F.col("support") < bar) & ~(F.col("one") & (F.col("prose") >= 0.20)), "weak content support")
    )
    solid = solid.withColumn("top", F.when(top == 0, 1.0).otherwise(top)).withColumn("one", one).withColumn("fault", fault)
    run = F.sum(F.col("fault").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    solid = solid.withColumn("before", F.coalesce(run, F.lit(0)))
    reason = F.when(F.col("before") >= k, "evidence budget reached").otherwise(F.col("fault"))
    out = solid.select("qid", "doc", F.col("rank").cast("bigint").alias("rank"), (reason.isNull()).alias("used"), reason.alias("reason"))
    return out.unionByName(rows.where("outline").select("qid", "doc", F.lit(None).cast("bigint").alias("rank"), F.lit(False).alias("used"), F.lit("outline").alias("reason")))


def containment(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds containment: shared tokens over the smaller token set."""
    both = F.size(F.array_intersect(left, right))
    return pairs.withColumn("containment", F.round(both / F.greatest(F.lit(1), F.least(F.size(left), F.size(right))), 4))


def expand_neighbours(chunks: DataFrame, selected: DataFrame, short: int = 1200, limit: int = 2600) -> DataFrame:
    """(doc, pos, text) of selected chunks; short ones take in the chunk before and behind of the same section
    unless that is selected itself.  chunks: (doc, pos, section, text); selected: (doc, pos)."""
    w = Window.partitionBy("doc").orderBy("pos")
    mine = selected.select("doc", "pos").withColumn("chosen", F.lit(True))
    rows = chunks.join(mine, ["doc", "pos"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    near = lambda f: F.when((f("section").over(w) == F.col("section")) & ~f("chosen").over(w), f("text").over(w))
    before, behind = near(F.lag), near(F.lead)
    whole = F.when(F.length("text") <= short, F.concat_ws("\n", before, "text", behind)).otherwise(F.col("text"))
    return rows.withColumn("expanded", F.substring(whole, 1, limit)).where("chosen").select("doc", "pos", F.col("expanded").alias("text"))


def merge_adjacent(selected: DataFrame) -> DataFrame:
    """(doc, section, first_pos, last_pos, n, score): runs of selected chunks at consecutive positions of a section.
    selected: (doc, pos, section, score)."""
    w = Window.partitionBy("doc", "section").orderBy("pos")
    runs = selected.withColumn("island", F.col("pos") - F.row_number().over(w))
    return runs.groupBy("doc", "section", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"), F.max("score").alias("score")).drop("island")


def round_robin(ranked: DataFrame) -> DataFrame:
    """(qid, doc, place): sub-queries' rankings interleaved rank by rank, a chunk at its first place.
    ranked: (qid, sub, doc, rank)."""
    first = ranked.groupBy("qid", "doc").agg(F.min(F.struct("rank", "sub")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at.rank", "at.sub", "doc")
    return first.withColumn("place", F.row_number().over(order)).select("qid", "doc", "place")


def organise(evidence: DataFrame) -> DataFrame:
    """(qid, doc, section, text, score, place): duplicates (section and first 200 characters) dropped, two chunks a
    section, sections and documents by their best score.  evidence: (qid, doc, section, text, score)."""
    same = Window.partitionBy("qid", "doc", "section", F.substring("text", 1, 200)).orderBy(F.desc("score"), "text")
    rows = evidence.withColumn("i", F.row_number().over(same)).where("i = 1").drop("i")
    per = Window.partitionBy("qid", "doc", "section").orderBy(F.desc("score"), "text")
    rows = rows.withColumn("i", F.row_number().over(per)).where("i <= 2")
    rows = rows.withColumn("by_section", F.max("score").over(Window.partitionBy("qid", "doc", "section"))).withColumn("by_doc", F.max("score").over(Window.partitionBy("qid", "doc")))
    order = Window.partitionBy("qid").orderBy(F.desc("by_doc"), "doc", F.desc("by_section"), "section", "i")
    return rows.withColumn("place", F.row_number().over(order)).select("qid", "doc", "section", "text", "score", "place")


QUERY_BLOCK, VECTOR_BLOCK = 1000, 20_000


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(qid, doc, score, rank): the k most similar vectors of each query by cosine, ties by doc; exact.  Vectors that are null or zero, hold null or have
    another length have no score and come last.

    Blocks of about QUERY_BLOCK queries meet blocks of about VECTOR_BLOCK vectors, each pair of blocks in a task that multiplies them and leaves k rows of a
    query.  Every pair is compared: the work is queries times vectors, memory is bounded by the blocks."""
    spark = vectors.sparkSession
    ship(spark)
    n, m = vectors.count(), queries.count()
    parts, blocks = max(spark.sparkContext.defaultParallelism, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    whole = F.when(~F.exists(vec_col, lambda x: x.isNull()), F.col(vec_col).cast("array<double>"))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    q = queries.select(F.col(id_col).alias("qid"), whole.alias("v")).select("qid", "v", deal("qid", blocks).alias("b"), every(parts).alias("p"))
    d = vectors.select(F.col(id_col).alias("doc"), whole.alias("v")).select("doc", "v", deal("doc", parts).alias("p"), every(blocks).alias("b"))
    out = StructType([StructField("qid", q.schema["qid"].dataType), StructField("doc", d.schema["doc"].dataType), StructField("score", DoubleType()), StructField("kind", StringType())])
    best = q.groupBy("p", "b").cogroup(d.groupBy("p", "b")).applyInPandas(lambda a, b: _nearest(a, b, k), out)
    score = F.when(F.col("kind") == "score", F.col("score")).when(F.col("kind") == "nan", F.lit(float("nan")))
    return I.ranked(best.select("qid", "doc", score.alias("score")), k)


def _nearest(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best vectors (doc, v) of each query (qid, v) with score and kind: score, nan (first) or null (last)."""
    vectors = vectors.sort_values("doc")
    docs, size = vectors["doc"].to_numpy(), lambda col: np.array([-1 if v is None else len(v) for v in col])
    of, asked, found = size(vectors["v"]), size(queries["v"]), [pd.DataFrame({"qid": queries["qid"][:0], "doc": vectors["doc"][:0], "score": [], "kind": pd.Series([], dtype=object)})]
    for length in np.unique(asked) if len(docs) else []:
        some = queries[asked == length]
        for lo in range(0, len(some), 100):
            part = some[lo : lo + 100]
            score, like = np.full((len(part), len(docs)), -2.0), np.flatnonzero(of == length)  # -2: no score
            if length > 0 and len(like):
                a, b = np.stack(part["v"].to_list()), np.stack([vectors["v"].iloc[i] for i in like])
                na, nb = np.sqrt((a * a).sum(1))[:, None], np.sqrt((b * b).sum(1))
                with np.errstate(all="ignore"):
                    cosine = np.round(a @ b.T / (na * nb), 6)
                score[:, like] = np.where((na == 0) | (nb == 0), -2.0, np.where(np.isnan(cosine), np.inf, cosine))
            score[part["qid"].to_numpy()[:, None] == docs] = -np.inf  # itself
            bar = np.partition(score, len(docs) - min(k, len(docs)), axis=1)[:, len(docs) - min(k, len(docs))]
            i, j = np.nonzero((score >= bar[:, None]) & (score > -np.inf))
            s = score[i, j]
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, s = i[first], j[first], s[first]
            kind = np.where(s == np.inf, "nan", np.where(s == -2.0, "null", "score"))
            found.append(pd.DataFrame({"qid": part["qid"].to_numpy()[i], "doc": docs[j], "score": np.where(np.isinf(s), 0.0, s), "kind": kind}))
    return pd.concat(found[1:] or found)
