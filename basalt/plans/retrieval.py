"""Queries over retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import index as I
from basalt.operators import rank as R
from basalt.plans.common import INDEX_SQL, RANK_SQL, longs, query_terms_sql, sing_sql, table, tokens_sql, wc_sql, words_sql
from basalt.plans.text import PROSE_SQL
from basalt.runtime import written

Q, O = {}, {}


def corpus(spark, d):
    docs, asked = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), table(spark, d, "benchmark")
    return docs, asked, I.build(docs)


Q["term_stats"] = lambda spark, d: I.build(table(spark, d, "documents")).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
O["term_stats"] = f"WITH {INDEX_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term"


def bm25_topk(spark, d):
    docs, asked, index = corpus(spark, d)
    return longs(I.ranked(I.bm25(index, asked, depth=10), 10))


Q["bm25_topk"] = bm25_topk
O["bm25_topk"] = f"WITH {INDEX_SQL}, r AS (SELECT qid, doc, score, {RANK_SQL} AS rank FROM bm25) SELECT * FROM r WHERE rank < 10"

DENSE_SQL = """
dw AS (SELECT doc, term, (1 + ln(tf)) * (ln((n_docs + 1) / (df + 1)) + 1) AS w FROM postings JOIN terms USING (term) CROSS JOIN st),
dn AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc),
qw AS (SELECT qid, term, (1 + ln(qtf)) * (ln((n_docs + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM q LEFT JOIN terms USING (term) CROSS JOIN st),
qn AS (SELECT qid, sqrt(sum(w * w)) AS norm FROM qw GROUP BY qid),
dense AS (SELECT qid, doc, round(sum((qw.w / qn.norm) * (dw.w / dn.norm)), 6) AS score FROM dw JOIN qw USING (term) JOIN dn USING (doc) JOIN qn USING (qid) GROUP BY qid, doc)"""

Q["tfidf_topk"] = lambda spark, d: (lambda docs, asked, index: longs(I.ranked(I.dense(index, asked, depth=10), 10)))(*corpus(spark, d))
O["tfidf_topk"] = f"WITH {INDEX_SQL}, {DENSE_SQL}, r AS (SELECT qid, doc, score, {RANK_SQL} AS rank FROM dense) SELECT * FROM r WHERE rank < 10"

GRAPH_SQL = """
de AS (SELECT doc_id AS doc, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][A-Za-z]{3,}'))) AS e FROM documents),
qe AS (SELECT item_id AS qid, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Z][A-Za-z]{3,}'))) AS e FROM benchmark),
graph AS (SELECT qid, doc, CAST(count(*) AS DOUBLE) AS score FROM de JOIN qe USING (e) GROUP BY qid, doc)"""

Q["graph_leg"] = lambda spark, d: longs(I.ranked(I.graph_leg(table(spark, d, "documents"), table(spark, d, "benchmark"), depth=10), 10))
O["graph_leg"] = f"WITH {GRAPH_SQL}, r AS (SELECT qid, doc, score, {RANK_SQL} AS rank FROM graph) SELECT * FROM r WHERE rank < 10"


LEG_DEPTH = 40


def legs(spark, d):
    """The legs fused; of each leg only the hits that fusion reads leave a task."""
    docs, asked, index = corpus(spark, d)
    dense, bm25, graph = I.dense(index, asked, depth=LEG_DEPTH), I.bm25(index, asked, depth=LEG_DEPTH), I.graph_leg(docs, asked, depth=LEG_DEPTH)
    return docs, asked, index, I.rrf({"dense": (dense, 1.0), "bm25": (bm25, 1.0), "graph": (graph, 0.5)}, LEG_DEPTH)


def with_legs(rows, top, docs, asked, index):
    """rows (qid, doc, ...) with the legs' scores of the candidates `top`, 0 where a leg has none."""
    near = {"dense": I.dense(index, asked, pairs=top), "bm25": I.bm25(index, asked, pairs=top), "graph": I.graph_leg(docs, asked, pairs=top)}
    for name, leg in near.items():
        rows = rows.join(leg.withColumnRenamed("score", name), ["qid", "doc"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return rows


RRF_SQL = f"""
rrf AS (SELECT qid, doc, round(sum(part), 8) AS score FROM (
  SELECT qid, doc, 1.0::DOUBLE / (60 + rank) AS part FROM (SELECT qid, doc, {RANK_SQL} AS rank FROM dense) WHERE rank < 40
  UNION ALL SELECT qid, doc, 1.0::DOUBLE / (60 + rank) FROM (SELECT qid, doc, {RANK_SQL} AS rank FROM bm25) WHERE rank < 40
  UNION ALL SELECT qid, doc, 0.5::DOUBLE / (60 + rank) FROM (SELECT qid, doc, {RANK_SQL} AS rank FROM graph) WHERE rank < 40) GROUP BY qid, doc)"""
ALL_SQL = f"{INDEX_SQL}, {DENSE_SQL}, {GRAPH_SQL}, {RRF_SQL}"

Q["rrf_fusion"] = lambda spark, d: longs(I.ranked(legs(spark, d)[-1], 10))
O["rrf_fusion"] = f"WITH {ALL_SQL}, r AS (SELECT qid, doc, score, {RANK_SQL} AS rank FROM rrf) SELECT * FROM r WHERE rank < 10"

SUPPORT_SQL = f"""
cand AS (SELECT qid, doc, score, {RANK_SQL} AS rank FROM rrf),
qterms AS (SELECT item_id AS qid, unnest({query_terms_sql('text')}) AS term FROM benchmark),
qidf AS (SELECT qid, term, ln((n_docs + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM qterms LEFT JOIN terms USING (term) CROSS JOIN st),
qtotal AS (SELECT qid, sum(idf) AS total FROM qidf GROUP BY qid),
met AS (SELECT qid, doc, sum(idf) AS met FROM qidf JOIN postings USING (term) GROUP BY qid, doc), {PROSE_SQL},
support AS (SELECT qid, doc, rank, score, round(CASE WHEN coalesce(total, 0.0) > 0 THEN least(1.0, 0.08 + 0.92 * (coalesce(met, 0.0) / total) * (0.30 + 0.70 * prose)) ELSE 0.5 END, 4) AS support
  FROM cand LEFT JOIN met USING (qid, doc) LEFT JOIN qtotal USING (qid) JOIN prose ON prose.doc_id = doc WHERE rank < 10),
ent AS (SELECT DISTINCT qid, {sing_sql('w')} AS term FROM (SELECT item_id AS qid, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][A-Za-z]{{3,}}'))) AS w FROM benchmark)),
eidf AS (SELECT qid, term, ln((n_docs + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM ent LEFT JOIN terms USING (term) CROSS JOIN st), eall AS (SELECT qid, sum(idf) AS total FROM eidf GROUP BY qid),
emet AS (SELECT qid, doc, sum(idf) AS met FROM eidf JOIN postings USING (term) GROUP BY qid, doc),
entity AS (SELECT s.qid, s.doc, round(CAST(coalesce(emet.met / eall.total, 0.0) AS DOUBLE), 4) AS entity FROM support s LEFT JOIN emet USING (qid, doc) LEFT JOIN eall USING (qid))"""


def candidates(spark, d):
    docs, asked, index, fused = legs(spark, d)
    top = written(I.ranked(fused, 10), "candidates")
    return docs, asked, index, top


Q["lexical_support"] = lambda spark, d: (lambda docs, asked, index, top: R.lexical_support(top, docs, asked, index))(*candidates(spark, d))
O["lexical_support"] = f"WITH {ALL_SQL}, {SUPPORT_SQL} SELECT qid, doc, CAST(support AS DOUBLE) AS support FROM support"


def fused_rank(spark, d):
    docs, asked, index, top = candidates(spark, d)
    rows = R.lexical_support(top, docs, asked, index).join(R.entity_coverage(top, asked, index), ["qid", "doc"])
    rows = rows.withColumn("score", F.round(R.fuse(F.col("support"), F.col("entity"), F.lit(1.0)), 4))
    return longs(I.ranked(rows, 10).select("qid", "doc", "score", "rank"))


Q["fused_rank"] = fused_rank
O["fused_rank"] = f"WITH {ALL_SQL}, {SUPPORT_SQL}, f AS (SELECT qid, doc, round(CAST(0.60 * support + 0.20 * entity AS DOUBLE), 4) AS score FROM support JOIN entity USING (qid, doc)) SELECT qid, doc, score, {RANK_SQL} AS rank FROM f"


def acceptance(spark, d):
    docs, asked, index, top = candidates(spark, d)
    rows = top.select("qid", "doc", "rank").join(R.lexical_support(top, docs, asked, index), ["qid", "doc"]).join(R.entity_coverage(top, asked, index), ["qid", "doc"])
    rows = with_legs(rows, top, docs, asked, index)
    return R.gate(rows.withColumn("meta", F.lit(1.0))).select("qid", "doc", "accept_score", "accepted", "reason")


Q["acceptance_gate"] = acceptance
O["acceptance_gate"] = f"""WITH {ALL_SQL}, {SUPPORT_SQL},
g AS (SELECT s.qid, s.doc, s.rank, s.support, round(CAST(0.45 * s.support + 0.15 * coalesce(dense.score, 0.0) + 0.15 * coalesce(bm25.score, 0.0) / (coalesce(bm25.score, 0.0) + 4.0) + 0.10 * least(1.0, coalesce(graph.score, 0.0) / 3.0) + 0.10 * entity AS DOUBLE), 4) AS accept_score,
  max(s.support) OVER (PARTITION BY s.qid) AS best FROM support s JOIN entity USING (qid, doc) LEFT JOIN dense USING (qid, doc) LEFT JOIN bm25 USING (qid, doc) LEFT JOIN graph USING (qid, doc))
SELECT qid, doc, accept_score, rank = 0 OR accept_score >= 0.15 AS accepted, CASE WHEN rank = 0 THEN 'top' WHEN best < 0.20 THEN 'fallback' WHEN accept_score >= 0.15 THEN 'accepted' ELSE 'below threshold' END AS reason FROM g"""


def by_source(spark, d, depth=20):
    docs, asked, index = corpus(spark, d)
    return written(I.ranked(I.bm25(index, asked, depth=depth), depth), "hits").join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")


SOURCE_SQL = f"h AS (SELECT qid, doc, score, rank, source FROM (SELECT qid, doc, score, {RANK_SQL} AS rank FROM bm25) JOIN documents ON doc_id = doc WHERE rank < 20)"

Q["doc_rerank"] = lambda spark, d: longs(R.document_rerank(by_source(spark, d), "source", 6).select("qid", "doc", "source", "doc_rank"))
O["doc_rerank"] = f"""WITH {INDEX_SQL}, {SOURCE_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, doc) AS i FROM h),
s AS (SELECT qid, source, round(sum(score), 6) AS score FROM t WHERE i <= 2 GROUP BY qid, source), r AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source) AS doc_rank FROM s)
SELECT qid, doc, source, doc_rank FROM h JOIN r USING (qid, source) WHERE doc_rank <= 3"""

Q["dominant_source"] = lambda spark, d: R.dominant(by_source(spark, d, 6), "source")
O["dominant_source"] = f"""WITH {INDEX_SQL}, {SOURCE_SQL}, v AS (SELECT qid, source, sum(1.0::DOUBLE / (1 + rank)) AS votes, count(*) AS hits FROM h WHERE rank < 6 GROUP BY qid, source),
w AS (SELECT qid, source, round(votes, 6) AS votes, round(votes / sum(votes) OVER (PARTITION BY qid), 4) AS share, hits, row_number() OVER (PARTITION BY qid ORDER BY round(votes, 6) DESC, source) AS i FROM v)
SELECT qid, source, votes, share, hits FROM w WHERE i = 1 AND share >= 0.4 AND hits >= 2"""

Q["grounding"] = lambda spark, d: (lambda docs, asked, index: longs(R.grounding(asked, index)))(*corpus(spark, d))
O["grounding"] = f"""WITH {INDEX_SQL}, t AS (SELECT item_id AS qid, unnest({query_terms_sql('text')}) AS term FROM benchmark), g AS (SELECT qid, term, coalesce(df, 0) AS df FROM t LEFT JOIN terms USING (term))
SELECT qid, count(*) AS n_terms, round(avg(CASE WHEN df > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS coverage, arg_min(term, (df, term)) AS rarest_term, min(df) > 0 AS rarest_known FROM g GROUP BY qid"""


def filtered(spark, d):
    """BM25 within one source only: the filter comes before ranks are given."""
    docs, asked, index = corpus(spark, d)
    some = table(spark, d, "documents").where("source = 'src3'").select(F.col("doc_id").alias("doc"))
    return longs(I.ranked(I.bm25(index, asked).join(some, "doc", "left_semi"), 5))


Q["doc_filter"] = filtered
O["doc_filter"] = f"WITH {INDEX_SQL}, s AS (SELECT bm25.* FROM bm25 JOIN documents ON doc_id = doc WHERE source = 'src3'), r AS (SELECT qid, doc, score, {RANK_SQL} AS rank FROM s) SELECT * FROM r WHERE rank < 5"


def adaptive(spark, d):
    k, pool = R.adaptive_k(F.col("text"))
    return longs(table(spark, d, "benchmark").select("item_id", k.alias("k"), pool.alias("pool")))


Q["adaptive_k"] = adaptive
_N = f"len(list_filter({tokens_sql('text')}, lambda w: w NOT IN ({words_sql(T.QUERY_STOP)})))"
_PARTS = " OR ".join(f"contains(' ' || lower(text) || ' ', '{m}')" for m in R.MULTIPART)
O["adaptive_k"] = f"""WITH a AS (SELECT item_id, {_N} AS n, {_PARTS} AS parts, len(regexp_extract_all(text, '\\?')) AS marks FROM benchmark),
k AS (SELECT *, CAST(least(10, greatest(3, 4 + CASE WHEN n > 6 THEN 2 ELSE 0 END + CASE WHEN n > 12 THEN 2 ELSE 0 END + CASE WHEN parts THEN 2 ELSE 0 END + CASE WHEN marks > 1 THEN 1 ELSE 0 END)) AS BIGINT) AS k FROM a)
SELECT item_id, k, CAST(least(40, greatest(16, 20 + CASE WHEN n > 6 THEN 6 ELSE 0 END + CASE WHEN n > 12 THEN 6 ELSE 0 END + CASE WHEN parts THEN 8 ELSE 0 END, 3 * k)) AS BIGINT) AS pool FROM k"""


def mmr(spark, d):
    docs, asked, index = corpus(spark, d)
    top = written(I.ranked(I.bm25(index, asked, depth=20), 20), "hits").join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("section")), "doc")
    return R.mmr(top.join(R.vectors_of(index, top), "doc"), 6)


Q["mmr_select"] = lambda spark, d: longs(mmr(spark, d))
# Six rounds, each taking the best of what is left; sims: cosines of all pairs of a query's pool.
_round = lambda k: f"""v{k} AS (SELECT p.qid, p.doc, p.section, p.score, coalesce(max(s.sim), 0.0) AS near, round(0.72 * p.score / m.top - 0.28 * coalesce(max(s.sim), 0.0), 9) AS value FROM pool p JOIN mt m USING (qid) LEFT JOIN c{k} c ON c.qid = p.qid LEFT JOIN sims s ON s.qid = p.qid AND s.a = p.doc AND s.b = c.doc
  WHERE NOT EXISTS (SELECT 1 FROM c{k} x WHERE x.qid = p.qid AND x.doc = p.doc) AND (SELECT count(*) FROM c{k} x WHERE x.qid = p.qid AND x.section = p.section) < 2 AND (SELECT count(*) FROM c{k} x WHERE x.qid = p.qid) = {k} GROUP BY p.qid, p.doc, p.section, p.score, m.top),
b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value DESC, score DESC, doc) AS i FROM v{k}) WHERE i = 1{' AND NOT near > 0.90' if k >= 3 else ''}),
c{k + 1} AS MATERIALIZED (SELECT * FROM c{k} UNION ALL SELECT qid, doc, section, score, {k} AS position FROM b{k})"""  # noqa: E731
O["mmr_select"] = f"""WITH {INDEX_SQL}, {DENSE_SQL}, pool AS MATERIALIZED (SELECT qid, doc, score, source AS section FROM (SELECT qid, doc, score, {RANK_SQL} AS rank FROM bm25) JOIN documents ON doc_id = doc WHERE rank < 20), mt AS (SELECT qid, max(score) AS top FROM pool GROUP BY qid),
u AS MATERIALIZED (SELECT doc, term, dw.w / dn.norm AS w FROM dw JOIN dn USING (doc) WHERE doc IN (SELECT doc FROM pool)),
sims AS MATERIALIZED (SELECT x.qid, x.doc AS a, y.doc AS b, round(sum(l.w * r.w), 9) AS sim FROM pool x JOIN pool y ON x.qid = y.qid AND x.doc <> y.doc JOIN u l ON l.doc = x.doc JOIN u r ON r.doc = y.doc AND r.term = l.term GROUP BY 1, 2, 3),
c0 AS (SELECT qid, doc, section, score, 0 AS position FROM pool WHERE false), {', '.join(_round(k) for k in range(6))} SELECT qid, doc, section, score, CAST(position AS BIGINT) AS position FROM c6"""


def containment(spark, d):
    """Near copies among each query's hits: later hits whose tokens lie almost whole in an earlier one."""
    docs, asked, index = corpus(spark, d)
    top = written(I.ranked(I.bm25(index, asked, depth=10), 10), "hits").join(docs.select(F.col("doc_id").alias("doc"), F.array_distinct(T.tokens(F.col("text"))).alias("ts")), "doc")
    x, y = top.select("qid", F.col("doc").alias("a"), F.col("rank").alias("ra"), F.col("ts").alias("ta")), top.select("qid", F.col("doc").alias("b"), F.col("rank").alias("rb"), F.col("ts").alias("tb"))
    return R.containment(x.join(y, "qid").where("ra < rb"), "ta", "tb").where("containment > 0.85").select("qid", "a", "b", "containment")


Q["neardup_containment"] = containment
O["neardup_containment"] = f"""WITH {INDEX_SQL}, r AS (SELECT qid, doc, {RANK_SQL} AS rank FROM bm25), t AS (SELECT qid, doc, rank, list_distinct({tokens_sql('text')}) AS ts FROM r JOIN documents ON doc_id = doc WHERE rank < 10)
SELECT * FROM (SELECT x.qid, x.doc AS a, y.doc AS b, round(len(list_intersect(x.ts, y.ts)) / greatest(1, least(len(x.ts), len(y.ts))), 4) AS containment FROM t x JOIN t y ON x.qid = y.qid AND x.rank < y.rank) WHERE containment > 0.85"""


def line_chunks(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(T.lines(F.col("text"))).alias("pos", "text"))
    return rows.withColumn("section", F.floor(F.col("pos") / 5).cast("bigint")).withColumn("pos", F.col("pos").cast("bigint"))


_CHUNKS = "c AS (SELECT doc_id AS doc, CAST(i - 1 AS BIGINT) AS pos, (i - 1) // 5 AS section, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM ls))"
_CHOSEN = f"{wc_sql('text')} >= 12"


def neighbour_expand(spark, d):
    c = line_chunks(spark, d)
    out = R.expand_neighbours(c, c.where(T.word_count(F.col("text")) >= 12).select("doc", "pos"))
    return out.select("doc", "pos", F.char_length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


Q["neighbor_expand"] = neighbour_expand
O["neighbor_expand"] = f"""WITH {PROSE_SQL}, {_CHUNKS}, w AS (SELECT *, {_CHOSEN} AS chosen,
  CASE WHEN lag(section) OVER o = section AND NOT lag({_CHOSEN}) OVER o THEN lag(text) OVER o END AS b, CASE WHEN lead(section) OVER o = section AND NOT lead({_CHOSEN}) OVER o THEN lead(text) OVER o END AS f FROM c WINDOW o AS (PARTITION BY doc ORDER BY pos)),
e AS (SELECT doc, pos, left(CASE WHEN length(text) <= 1200 THEN concat_ws(chr(10), b, text, f) ELSE text END, 2600) AS t FROM w WHERE chosen)
SELECT doc, pos, length(t) AS n_chars, md5(t) AS text_md5 FROM e"""

Q["adjacent_merge"] = lambda spark, d: longs(R.merge_adjacent(line_chunks(spark, d).where(T.word_count(F.col("text")) >= 5).withColumn("score", (F.pmod(F.col("pos") * 31 + F.col("doc"), F.lit(100)) / 100.0))))
O["adjacent_merge"] = f"""WITH {PROSE_SQL}, {_CHUNKS}, s AS (SELECT doc, pos, section, ((pos * 31 + doc) % 100) / 100.0 AS score, pos - row_number() OVER (PARTITION BY doc, section ORDER BY pos) AS island FROM c WHERE {wc_sql('text')} >= 5)
SELECT doc, section, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n, CAST(max(score) AS DOUBLE) AS score FROM s GROUP BY doc, section, island"""


def interleave(spark, d):
    docs, asked, index = corpus(spark, d)
    ranked = I.ranked(I.bm25(index, asked, depth=5), 5).select((F.col("qid") / 4).cast("bigint").alias("q"), F.pmod("qid", F.lit(4)).cast("bigint").alias("sub"), "doc", "rank")
    return longs(R.round_robin(ranked.withColumnRenamed("q", "qid")))


Q["round_robin"] = interleave
O["round_robin"] = f"WITH {INDEX_SQL}, r AS (SELECT qid // 4 AS qid, qid % 4 AS sub, doc, rank FROM (SELECT qid, doc, {RANK_SQL} AS rank FROM bm25) WHERE rank < 5), m AS (SELECT qid, doc, min((rank, sub)) AS a FROM r GROUP BY qid, doc) SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY a, doc) AS place FROM m"


def subquery_merge(spark, d):
    docs, asked, index = corpus(spark, d)
    rows = I.ranked(I.bm25(index, asked, depth=10), 10).withColumn("qid", (F.col("qid") / 4).cast("bigint"))
    return rows.groupBy("qid", "doc").agg(F.round(F.sum("score"), 6).alias("score"), F.round(F.sum(1.0 / (60 + F.col("rank"))), 8).alias("rrf"), F.count("*").alias("hits"))


Q["subquery_merge"] = subquery_merge
O["subquery_merge"] = f"WITH {INDEX_SQL} SELECT qid // 4 AS qid, doc, round(sum(score), 6) AS score, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf, count(*) AS hits FROM (SELECT qid, doc, score, {RANK_SQL} AS rank FROM bm25) WHERE rank < 10 GROUP BY 1, 2"


def organise(spark, d):
    ev = written(by_source(spark, d, 12), "hits").join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", "lang"), "doc")
    out = R.organise(ev.select("qid", F.col("source").alias("doc"), F.col("lang").alias("section"), "text", "score"))
    return longs(out.select("qid", "doc", "section", F.md5("text").alias("text_md5"), "score", "place"))


Q["evidence_organizer"] = organise
O["evidence_organizer"] = f"""WITH {INDEX_SQL}, e AS (SELECT qid, source AS doc, lang AS section, text, score FROM (SELECT qid, doc AS d, score, {RANK_SQL} AS rank FROM bm25) JOIN documents ON doc_id = d WHERE rank < 12),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc, section, left(text, 200) ORDER BY score DESC, text) AS i FROM e) WHERE i = 1),
p AS (SELECT * FROM (SELECT qid, doc, section, text, score, row_number() OVER (PARTITION BY qid, doc, section ORDER BY score DESC, text) AS i FROM u) WHERE i <= 2),
b AS (SELECT *, max(score) OVER (PARTITION BY qid, doc, section) AS bs, max(score) OVER (PARTITION BY qid, doc) AS bd FROM p)
SELECT qid, doc, section, md5(text) AS text_md5, score, row_number() OVER (PARTITION BY qid ORDER BY bd DESC, doc, bs DESC, section, i) AS place FROM b"""

Q["document_map"] = lambda spark, d: longs(line_chunks(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("doc"))).withColumn("bucket", F.floor(F.col("pos") / F.ceil(F.col("n") / 15))).groupBy("doc", "bucket").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum(F.char_length("text").cast("bigint")).alias("n_chars")))
O["document_map"] = f"WITH {PROSE_SQL}, {_CHUNKS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM c) SELECT doc, CAST(floor(pos / ceil(n / 15)) AS BIGINT) AS bucket, min(pos) AS first_pos, max(pos) AS last_pos, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM n GROUP BY 1, 2"


def boosted(spark, d):
    """Fusion scores times a boost from the query's keywords and entities that the document holds."""
    docs, asked, index, fused = legs(spark, d)
    top = written(I.ranked(fused, 10), "candidates")
    ent = I.graph_leg(docs, asked, pairs=top).withColumnRenamed("score", "entities")
    kw = I.near(index.postings, top).join(asked.select(F.col("item_id").alias("qid"), F.explode(F.slice(F.array_sort(T.query_terms(F.col("text"))), 1, 3)).alias("term")), "term").groupBy("qid", "doc").agg(F.count("*").alias("kw"))
    rows = top.join(ent, ["qid", "doc"], "left").join(kw, ["qid", "doc"], "left")
    meta = R.metadata_boost(F.pmod("doc", F.lit(3)) == 0, F.coalesce("entities", F.lit(0.0)), F.coalesce("kw", F.lit(0)), F.lit(False))
    return rows.select("qid", "doc", F.round(meta, 4).alias("boost"), F.round(F.col("score") * meta, 7).alias("score"))


Q["metadata_boost"] = boosted
O["metadata_boost"] = f"""WITH {ALL_SQL}, t AS (SELECT qid, doc, score FROM (SELECT qid, doc, score, {RANK_SQL} AS rank FROM rrf) WHERE rank < 10),
qk AS (SELECT item_id AS qid, unnest(list_sort({query_terms_sql('text')})[1:3]) AS term FROM benchmark), kw AS (SELECT qid, doc, count(*) AS kw FROM postings JOIN qk USING (term) GROUP BY qid, doc),
b AS (SELECT qid, doc, t.score, 1 + least(0.5, CASE WHEN doc % 3 = 0 THEN 0.20 ELSE 0.0 END + least(0.20, 0.10 * coalesce(graph.score, 0.0)) + least(0.16, 0.08 * coalesce(kw, 0))) AS m FROM t LEFT JOIN graph USING (qid, doc) LEFT JOIN kw USING (qid, doc))
SELECT qid, doc, round(CAST(m AS DOUBLE), 4) AS boost, round(CAST(score * m AS DOUBLE), 7) AS score FROM b"""


def embedding_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return longs(R.cosine_topk(e, e.where("vec_id % 100 = 0"), 5))


Q["embedding_topk"] = embedding_topk
O["embedding_topk"] = f"""WITH s AS (SELECT x.vec_id AS qid, y.vec_id AS doc, round(list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))), 6) AS score
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) x JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) y ON x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id), r AS (SELECT *, {RANK_SQL} AS rank FROM s) SELECT * FROM r WHERE rank < 5"""


def aspect_words(asked):
    """(qid, pos, word, total): the two rarest-looking sides of each question: its first and its last long word."""
    words = F.filter(T.query_terms(F.col("text")), lambda w: F.length(w) >= 5)
    rows = asked.select(F.col("item_id").alias("qid"), F.posexplode(F.array_distinct(F.array(F.array_min(words), F.array_max(words)))).alias("pos", "word"))
    return rows.where("word is not null").withColumn("total", F.lit(2))


def repaired(spark, d):
    docs, asked, index = corpus(spark, d)
    pool = written(I.ranked(I.bm25(index, asked, depth=20), 20), "pool")
    covers = index.postings.select("doc", "term").join(I.held(aspect_words(asked).withColumnRenamed("word", "term")), "term").join(I.held(pool.select("qid", "doc")), ["qid", "doc"]).select("qid", "doc", "pos", "total")
    return R.cover_aspects(pool.where("rank < 4").select("qid", "doc", "score"), pool.select("qid", "doc", "score"), covers).select("qid", "doc")


Q["aspect_repair"] = repaired


def _mended(n):
    """Repair of aspect n: the best of the pool that covers it for the weakest chosen one whose aspects others cover."""
    return f"""n{n} AS (SELECT DISTINCT qid FROM r{n} JOIN aw USING (qid) WHERE aw.pos = {n} AND qid NOT IN (SELECT s.qid FROM r{n} s JOIN cov USING (qid, doc) WHERE cov.pos = {n})),
g{n} AS (SELECT p.qid, arg_min(p.doc, (-p.score, p.doc)) AS doc FROM pool p JOIN cov USING (qid, doc) JOIN n{n} USING (qid) WHERE cov.pos = {n} AND (p.qid, p.doc) NOT IN (SELECT qid, doc FROM r{n}) GROUP BY p.qid),
f{n} AS (SELECT s.qid, arg_max(s.doc, (-s.score, s.doc)) AS doc FROM r{n} s JOIN g{n} USING (qid) WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.qid = s.qid AND c.doc = s.doc AND NOT EXISTS (SELECT 1 FROM cov o JOIN r{n} x ON x.qid = o.qid AND x.doc = o.doc WHERE o.qid = c.qid AND o.pos = c.pos AND x.doc <> s.doc)) GROUP BY s.qid),
r{n + 1} AS MATERIALIZED (SELECT s.qid, s.doc, s.score FROM r{n} s LEFT JOIN f{n} f USING (qid) WHERE f.doc IS NULL OR f.doc <> s.doc UNION ALL SELECT g.qid, g.doc, p.score FROM g{n} g JOIN f{n} USING (qid) JOIN pool p ON p.qid = g.qid AND p.doc = g.doc)"""


_long = f"list_filter({query_terms_sql('text')}, lambda w: length(w) >= 5)"
O["aspect_repair"] = f"""WITH {INDEX_SQL}, pool AS MATERIALIZED (SELECT * FROM (SELECT qid, doc, score, {RANK_SQL} AS rank FROM bm25) WHERE rank < 20),
al AS (SELECT item_id AS qid, list_min({_long}) AS a, list_max({_long}) AS b FROM benchmark), aw AS (SELECT qid, 0 AS pos, a AS word FROM al WHERE a IS NOT NULL UNION ALL SELECT qid, 1, b FROM al WHERE b <> a),
cov AS MATERIALIZED (SELECT DISTINCT p.qid, p.doc, pos FROM pool p JOIN aw USING (qid) JOIN postings o ON o.doc = p.doc AND o.term = word), r0 AS (SELECT qid, doc, score FROM pool WHERE rank < 4), {_mended(0)}, {_mended(1)} SELECT qid, doc FROM r2"""


def unique_hits(spark, d):
    docs, asked, index = corpus(spark, d)
    top = written(I.ranked(I.bm25(index, asked, depth=10), 10), "hits").join(docs.select(F.col("doc_id").alias("doc"), F.array_distinct(T.tokens(F.col("text"))).alias("ts")), "doc")
    return longs(R.drop_contained(top))


Q["dedup_hits"] = unique_hits
O["dedup_hits"] = f"""WITH RECURSIVE {INDEX_SQL}, h AS (SELECT qid, doc, rank, list_distinct({tokens_sql('text')}) AS ts FROM (SELECT qid, doc, {RANK_SQL} AS rank FROM bm25) JOIN documents ON doc_id = doc WHERE rank < 10),
k(qid, rank, kept) AS (SELECT qid, CAST(-1 AS BIGINT), []::STRUCT(doc BIGINT, rank BIGINT, ts VARCHAR[])[] FROM h GROUP BY qid
  UNION ALL SELECT k.qid, h.rank, CASE WHEN len(list_filter(kept, lambda y: len(list_intersect(y.ts, h.ts)) > 0 AND len(list_intersect(y.ts, h.ts)) / greatest(1, least(len(y.ts), len(h.ts))) > 0.85)) > 0 THEN kept ELSE list_append(kept, {{'doc': h.doc, 'rank': h.rank, 'ts': h.ts}}) END FROM k JOIN h ON h.qid = k.qid AND h.rank = k.rank + 1),
z AS (SELECT qid, arg_max(kept, rank) AS kept FROM k GROUP BY qid), e AS (SELECT qid, unnest(kept) AS x FROM z) SELECT qid, x.doc AS doc, x.rank AS rank FROM e"""


def evidence_gate(spark, d):
    """Which of twenty hits become evidence; a source counts as the document."""
    docs, asked, index = corpus(spark, d)
    full = table(spark, d, "documents")
    top = written(I.ranked(I.bm25(index, asked, depth=20), 20), "hits")
    terms = asked.select(F.col("item_id").alias("qid"), F.filter(T.query_terms(F.col("text")), lambda t: F.length(t) >= 3).alias("terms"))
    support = R.lexical_support(top, docs, asked, index)
    size = full.groupBy("source").agg(F.count("*").alias("size"))
    rows = top.join(full.select(F.col("doc_id").alias("doc"), "source", F.coalesce("text", F.lit("")).alias("text")), "doc").join(terms, "qid").join(support, ["qid", "doc"]).join(F.broadcast(size), "source")  # one row a source
    low = F.lower("text")
    rows = rows.select("qid", "doc", "score", "source", "size", "support", F.size(T.lines(F.col("text"))).alias("lines"), F.round(T.prose_factor(F.col("text")), 6).alias("prose"), F.size(F.filter("terms", lambda t: F.contains(low, t))).alias("present"), F.size("terms").alias("n_terms"), F.when(F.pmod("qid", F.lit(2)) == 0, F.contains(low, F.array_min("terms"))).alias("side"))
    return R.accept(rows)


Q["evidence_accept"] = evidence_gate
_QT = f"list_filter({query_terms_sql('text')}, lambda t: length(t) >= 3)"
O["evidence_accept"] = f"""WITH {INDEX_SQL}, {PROSE_SQL}, tt AS (SELECT item_id AS qid, {_QT} AS terms FROM benchmark),
qterms AS (SELECT item_id AS qid, unnest({query_terms_sql('text')}) AS term FROM benchmark), qidf AS (SELECT qid, term, ln((n_docs + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM qterms LEFT JOIN terms USING (term) CROSS JOIN st), qtotal AS (SELECT qid, sum(idf) AS total FROM qidf GROUP BY qid),
met AS (SELECT qid, doc, sum(idf) AS met FROM qidf JOIN postings USING (term) GROUP BY qid, doc), sz AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
h AS (SELECT r.qid, r.doc, score, source, size, lower(coalesce(text, '')) AS low, round(CAST(prose AS DOUBLE), 6) AS prose, len(ls) AS lines, tt.terms, round(CASE WHEN coalesce(total, 0.0) > 0 THEN least(1.0, 0.08 + 0.92 * (coalesce(met, 0.0) / total) * (0.30 + 0.70 * prose)) ELSE 0.5 END, 4) AS support
  FROM (SELECT qid, doc, score, {RANK_SQL} AS rank FROM bm25) r JOIN documents ON documents.doc_id = r.doc JOIN prose ON prose.doc_id = r.doc JOIN ls ON ls.doc_id = r.doc JOIN sz USING (source) JOIN tt ON tt.qid = r.qid LEFT JOIN met ON met.qid = r.qid AND met.doc = r.doc LEFT JOIN qtotal ON qtotal.qid = r.qid WHERE rank < 20),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1 AS rank, max(score) OVER (PARTITION BY qid) AS top, min(source) OVER (PARTITION BY qid) = max(source) OVER (PARTITION BY qid) AS one FROM h WHERE NOT (lines > 3 AND prose < 0.15)),
f AS (SELECT *, CASE WHEN rank = 0 OR (one AND size <= 12) THEN NULL WHEN score < 0.45 * CASE WHEN top = 0 THEN 1.0 ELSE top END THEN 'below relevance bar' WHEN len(list_filter(terms, lambda t: contains(low, t))) < least(2, len(terms)) THEN 'insufficient query-term support'
  WHEN qid % 2 = 0 AND NOT contains(low, list_min(terms)) THEN 'mentions neither side of the comparison' WHEN support < 0.35 AND NOT (one AND prose >= 0.20) THEN 'weak content support' END AS fault FROM s),
g AS (SELECT *, coalesce(sum(CASE WHEN fault IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY score DESC, doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f), z AS (SELECT qid, doc, rank, CASE WHEN before >= 6 THEN 'evidence budget reached' ELSE fault END AS reason FROM g)
SELECT qid, doc, rank, reason IS NULL AS used, reason FROM z UNION ALL SELECT qid, doc, NULL, false, 'outline' FROM h WHERE lines > 3 AND prose < 0.15"""


def result_rows(spark, d):
    """The composed retrieval of a batch: legs, fusion, pool, support in the reranker's place, entities, gate, documents; one row with its diagnostics for each that stays."""
    docs, asked, index, top = candidates(spark, d)
    rows = top.select("qid", "doc", F.col("score").alias("rrf"), F.col("rank").alias("rrf_rank")).join(R.lexical_support(top, docs, asked, index), ["qid", "doc"]).join(R.entity_coverage(top, asked, index), ["qid", "doc"])
    rows = with_legs(rows, top, docs, asked, index)
    rows = R.collapse(rows.withColumn("rerank", F.lit(None).cast("double"))).withColumn("meta", 1 + F.least(F.lit(0.20), 0.10 * F.col("graph")))
    rows = rows.withColumn("score", F.round(R.fuse(F.col("relevance"), F.col("entity"), F.col("meta")), 4))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    gated = R.gate(rows.withColumn("rank", F.row_number().over(order) - 1).withColumn("support", F.col("relevance"))).where("accepted")
    kept = R.document_rerank(gated.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc"), "source", 6)
    method = F.concat_ws(" + ", F.when(F.col("dense") > 0, "Dense"), F.when(F.col("bm25") > 0, "BM25"), F.when(F.col("graph") > 0, "Graph"))
    why = F.concat_ws("; ", F.when(F.col("dense") > 0.60, "High semantic similarity"), F.when(F.col("bm25") > 3, "Strong keyword overlap"), F.when(F.col("graph") > 0, "Matched graph neighborhood"))
    return longs(kept.select("qid", "doc", "rank", "score", F.round("rrf", 4).alias("rrf"), F.round("dense", 4).alias("dense"), F.round("bm25", 4).alias("bm25"), "graph", "entity", F.round("meta", 2).alias("meta"), "accept_score", "doc_rank", F.when(method == "", "RRF").otherwise(method).alias("method"), F.when(why == "", "elected by rank fusion").otherwise(why).alias("why")))


Q["retrieve_lines"] = result_rows
O["retrieve_lines"] = f"""WITH {ALL_SQL}, {SUPPORT_SQL},
x AS (SELECT s.qid, s.doc, s.score AS rrf, s.support, entity, coalesce(dense.score, 0.0) AS dense, coalesce(bm25.score, 0.0) AS bm25, coalesce(graph.score, 0.0) AS graph, 1 + least(0.20, 0.10 * coalesce(graph.score, 0.0)) AS meta FROM support s JOIN entity USING (qid, doc) LEFT JOIN dense USING (qid, doc) LEFT JOIN bm25 USING (qid, doc) LEFT JOIN graph USING (qid, doc)),
f AS (SELECT *, round(CAST(0.60 * support + 0.20 * entity + 0.20 * least(1.0, (meta - 1) / 0.5) AS DOUBLE), 4) AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1 AS rank, round(CAST(0.45 * support + 0.15 * dense + 0.15 * bm25 / (bm25 + 4.0) + 0.10 * least(1.0, graph / 3.0) + 0.05 * (meta - 1) / 0.5 + 0.10 * entity AS DOUBLE), 4) AS accept_score FROM f),
g AS (SELECT r.*, source FROM r JOIN documents ON doc_id = doc WHERE rank = 0 OR accept_score >= 0.15), t AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, doc) AS i FROM g),
ds AS (SELECT qid, source, round(sum(score), 6) AS s FROM t WHERE i <= 2 GROUP BY qid, source), dr AS (SELECT qid, source, row_number() OVER (PARTITION BY qid ORDER BY s DESC, source) AS doc_rank FROM ds),
m AS (SELECT g.*, doc_rank, concat_ws(' + ', CASE WHEN dense > 0 THEN 'Dense' END, CASE WHEN bm25 > 0 THEN 'BM25' END, CASE WHEN graph > 0 THEN 'Graph' END) AS method, concat_ws('; ', CASE WHEN dense > 0.60 THEN 'High semantic similarity' END, CASE WHEN bm25 > 3 THEN 'Strong keyword overlap' END, CASE WHEN graph > 0 THEN 'Matched graph neighborhood' END) AS why FROM g JOIN dr USING (qid, source) WHERE doc_rank <= 3)
SELECT qid, doc, rank, score, round(rrf, 4) AS rrf, round(dense, 4) AS dense, round(bm25, 4) AS bm25, graph, entity, round(CAST(meta AS DOUBLE), 2) AS meta, accept_score, doc_rank, CASE WHEN method = '' THEN 'RRF' ELSE method END AS method, CASE WHEN why = '' THEN 'elected by rank fusion' ELSE why END AS why FROM m"""


def compared(spark, d):
    """The plain baseline, six best by cosine alone, beside the composed retrieval: how many hits they share."""
    docs, asked, index = corpus(spark, d)
    plain = I.ranked(I.dense(index, asked, depth=6), 6).select("qid", "doc")
    full = result_rows(spark, d).select("qid", "doc", F.lit(1).alias("both"))
    return plain.join(full, ["qid", "doc"], "left").groupBy("qid").agg(F.count("*").alias("plain"), F.count("both").alias("shared"))


Q["baseline_compare"] = compared
O["baseline_compare"] = f"WITH full_ AS ({O['retrieve_lines']}), p AS (SELECT qid, doc FROM ({O['tfidf_topk']}) WHERE rank < 6) SELECT qid, count(*) AS plain, count(full_.doc) AS shared FROM p LEFT JOIN full_ USING (qid, doc) GROUP BY qid"
