"""Queries over the kept index of fields and the composed retrieval; benchmark passages in question templates are the batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import concepts as C
from basalt.operators import hybrid as H
from basalt.operators import index as I
from basalt.operators import query as G
from basalt.operators import rank as R
from basalt.operators import store as S
from basalt.operators import understand as U
from basalt.plans.answers import ASPECTS_SQL, CONCEPTS_SQL, INTENT_SQL, SPACED_SQL
from basalt.plans.common import INDEX_SQL, RANK_SQL, lines_sql, longs, query_terms_sql, sing_sql, table, tokens_sql, words_sql
from basalt.plans.retrieval import DENSE_SQL, RRF_SQL
from basalt.plans.text import KEYWORDS_SQL, LINES_SQL, PROSE_SQL, _edges, concepts, keyword_rows, pack_lines
from basalt.plans.text import O as TEXT_SQL
from basalt.plans.understanding import GAZETTEER_SQL
from basalt.runtime import dealt, shared_folder, written

Q, O = {}, {}


# ---- the index of fields, kept: segments, deletions, merges


def fields(spark, d):
    """(doc_id, source, lang, stream): summary, keywords, concepts and text of each document as one stream; worked out once."""
    docs = table(spark, d, "documents")
    words = keyword_rows(docs, 12).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "keyword"))), lambda x: x["keyword"]), " ").alias("kw"))  # 12 at most
    names = concepts(spark, d).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("concept")), " ").alias("names"))  # 12 at most
    return written(docs.join(words, "doc_id", "left").join(names, "doc_id", "left").select("doc_id", "source", "lang", S.field_stream(T.summary(F.col("text")), F.col("kw"), F.col("names"), F.col("text")).alias("stream")), "fields")


def kept_index(spark, d):
    return S.IndexStore(spark, shared_folder(spark, "kept-index"))


def index_build(spark, d):
    """Terms of the index of fields."""
    store = kept_index(spark, d)
    store.add(fields(spark, d), text_col="stream")
    return store.open().postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def asked_of(store, spark, d):
    asked = table(spark, d, "benchmark")
    return longs(I.ranked(I.bm25(store.open(S.batch_terms(asked)), asked, depth=10), 10))


def index_add(spark, d):
    """The index after three additions that together hold every document, the last one replacing some."""
    store, rows = kept_index(spark, d), fields(spark, d)
    store.add(rows.where("lang <> 'en' or lang is null").withColumn("stream", F.concat_ws(" ", F.lit("stale words"), "stream")), text_col="stream")
    store.add(rows.where("lang = 'en'"), text_col="stream")
    store.add(rows.where("lang <> 'en' or lang is null"), text_col="stream")
    return asked_of(store, spark, d)


def index_delete(spark, d):
    """The index after all documents of one language are deleted, segments merged, and those of another deleted from the merged one."""
    store, rows = kept_index(spark, d), fields(spark, d)
    store.add(rows, text_col="stream")
    store.delete(rows.where("lang = 'de'").select("doc_id"))
    store.merge()
    store.delete(rows.where("lang = 'es'").select("doc_id"))
    return asked_of(store, spark, d)


Q["index_build"], Q["index_add"], Q["index_delete"] = index_build, index_add, index_delete
_DL = f"dl AS (SELECT doc_id AS doc, len({tokens_sql('text')}) AS dl FROM documents)"
FIELD_SQL = (
    INDEX_SQL.replace("FROM documents),\npostings", "FROM fields),\npostings").replace(_DL, _DL.replace("FROM documents", "FROM fields")),
    f"""{KEYWORDS_SQL}, kj AS (SELECT doc_id, string_agg(keyword, ' ' ORDER BY place) AS kw FROM kt WHERE place <= 12 GROUP BY doc_id), cj AS (SELECT doc_id, string_agg(concept, ' ' ORDER BY concept) AS names FROM ({TEXT_SQL['concept_df']}) GROUP BY doc_id),
su AS (SELECT doc_id, summary FROM ({TEXT_SQL['summary_line']})), fields AS MATERIALIZED (SELECT d.doc_id, concat_ws(' ', summary, kw, names, d.text) AS text FROM documents d LEFT JOIN kj USING (doc_id) LEFT JOIN cj USING (doc_id) JOIN su USING (doc_id) WHERE %s)""",
)
assert "FROM fields),\npostings" in FIELD_SQL[0] and FIELD_SQL[0].count("FROM fields") == 2
O["index_build"] = f"WITH {FIELD_SQL[1] % 'true'}, {FIELD_SQL[0]} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term"
_TOP = f"r AS (SELECT qid, doc, score, {RANK_SQL} AS rank FROM bm25) SELECT * FROM r WHERE rank < 10"
O["index_add"] = f"WITH {FIELD_SQL[1] % 'true'}, {FIELD_SQL[0]}, {_TOP}"
_OTHERS = "coalesce(lang, '') NOT IN ('de', 'es')"
O["index_delete"] = f"WITH {FIELD_SQL[1] % _OTHERS}, {FIELD_SQL[0]}, {_TOP}"

# ---- composed retrieval over packed chunks

QUESTIONS = ["What is {}?", "Compare {} and memory", "Why is {} needed because of load", "How do I fix the error in {}?", "Steps to change {} and then test", "Summarize {} in short", "Who proposed {}?", "difference between {} and vectors?", "{} vs graphs", "how is {} different from batch?"]
HEADING = "^[^A-Za-z]*([A-Z][a-z]*[^A-Za-z]+)*([A-Z][a-z]*)?[^A-Za-z]*$"


def chunk_fields(spark, d):
    """Packed chunks of all documents with their fields; a chunk's section is the last heading that begins a chunk up to it."""
    packed = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode_outer(pack_lines(F.col("text"))).alias("pos", "text")).where("pos is not null")
    first = F.substring_index("text", "\n", 1)
    heading = F.when((F.length(first) < 80) & first.rlike(HEADING), first)
    rows = packed.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos")), F.lit("Page 1")))
    rows = written(rows.withColumn("pos", F.col("pos").cast("bigint")).withColumn("chunk", F.col("doc") * 100_000 + F.col("pos")), "packed")
    kw = dealt(rows.select("chunk", "text"), "chunk").select("chunk", F.posexplode_outer(T.keyword_words(F.col("text"))).alias("at", "w")).where(F.col("w").isNotNull() & T.is_keyword(F.col("w"))).groupBy("chunk", "w").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    kw = kw.withColumn("place", F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("n"), "at"))).where("place <= 12")
    kw = kw.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]).alias("keywords"))  # 12 at most
    present = C.presence(rows.select("doc", "pos", "text"), C.extract(rows)).groupBy("doc", "pos").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))  # 12 at most
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    rows = rows.join(kw, "chunk", "left").join(present, ["doc", "pos"], "left").select("chunk", "doc", "pos", "section", "text", T.summary(F.col("text")).alias("summary"), none("keywords"), none("concepts"))
    return rows.withColumn("entities", F.array_sort(F.array_union(T.tags(F.col("text")), F.col("concepts"))))


def planned(spark, d, chunks):
    """The batch: intent, names, sides and wished-for sections of each question, and its names' neighbours: concepts that share a chunk with them."""
    k = (F.pmod("item_id", F.lit(len(QUESTIONS))) + 1).cast("int")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.replace(F.element_at(F.array(*map(F.lit, QUESTIONS)), k), F.lit("{}"), F.coalesce("text", F.lit(""))).alias("judge"))
    names = chunks.select(F.explode("concepts").alias("name")).distinct()
    named = G.gazetteer(asked.select("qid", F.col("judge").alias("text")), names)
    pairs = named.select("qid", F.explode("entities").alias("own"))
    near = chunks.select(F.explode("concepts").alias("own"), F.col("concepts").alias("all")).join(I.held(pairs), "own").select("qid", F.explode("all").alias("e"))
    graph = near.unionByName(pairs.select("qid", F.col("own").alias("e"))).groupBy("qid").agg(F.array_sort(F.collect_set("e")).alias("graph_entities"))  # neighbours of a question's names
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    intent = U.intent(F.col("judge"))
    rows = asked.join(named, "qid", "left").join(graph, "qid", "left")
    return rows.select("qid", G.rewrite(F.col("judge")).alias("query"), "judge", intent.alias("intent"), none("entities"), U.aspects(F.col("judge")).alias("aspects"), G.hint_sections(intent).alias("boost_sections"), none("entities").alias("boost_entities"), none("graph_entities"), F.lit(6).alias("k"), F.lit(None).cast("array<bigint>").alias("docs"))


def composed(spark, d):
    ix = H.prepare(chunk_fields(spark, d))
    return ix, written(planned(spark, d, ix.chunks), "planned")


def shown(rows):
    return longs(rows.select("qid", "place", "chunk", F.array_join("chunks", ",").alias("chunks"), "section", F.round("score", 4).alias("score"), F.round("rrf", 6).alias("rrf"), "dense", "bm25", "graph", "relevance", F.round("entity", 3).alias("entity"), F.round("meta", 4).alias("meta"), F.round("accept_score", 3).alias("accept_score"), "method", "why", F.md5("text").alias("text_md5")))


Q["retrieve"] = lambda spark, d: shown(H.retrieve(*composed(spark, d)))
_lit = lambda s: "'" + s.replace("'", "''") + "'"
_QT = ", ".join(_lit(t) for t in QUESTIONS)
_arr = "[]::VARCHAR[]"
PACKED_SQL = f"""l0 AS (SELECT doc_id, {lines_sql('text')} AS ls FROM documents),
pk(doc_id, i, pos, n) AS (SELECT doc_id, CAST(1 AS BIGINT), CAST(0 AS BIGINT), length(ls[1]) FROM l0 WHERE len(ls) > 0
  UNION ALL SELECT pk.doc_id, i + 1, CASE WHEN n + length(ls[i + 1]) <= 1200 THEN pos ELSE pos + 1 END, CASE WHEN n + length(ls[i + 1]) <= 1200 THEN n + 1 + length(ls[i + 1]) ELSE length(ls[i + 1]) END FROM pk JOIN l0 USING (doc_id) WHERE i < len(ls)),
p0 AS (SELECT doc_id, pos, string_agg(ls[i], chr(10) ORDER BY i) AS text FROM pk JOIN l0 USING (doc_id) GROUP BY doc_id, pos),
p1 AS (SELECT *, split_part(text, chr(10), 1) AS first FROM p0),
ch AS MATERIALIZED (SELECT doc_id * 100000 + pos AS chunk, doc_id AS doc, pos, text, coalesce(last_value(CASE WHEN length(first) < 80 AND regexp_matches(first, '{HEADING}') THEN first END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'Page 1') AS section FROM p1)"""
_CK = TEXT_SQL["concept_df"].replace("WITH " + LINES_SQL, "WITH l AS (SELECT doc AS doc_id, pos, text AS line FROM ch)", 1)
_KW = KEYWORDS_SQL.replace("FROM documents", "FROM (SELECT chunk AS doc_id, text FROM ch)")
CHUNK_SQL = f"""{PACKED_SQL}, ck AS MATERIALIZED ({_CK}), {_KW}, kl AS (SELECT doc_id AS chunk, list(keyword ORDER BY place) AS kw FROM kt WHERE place <= 12 GROUP BY doc_id),
cl AS (SELECT chunk, list(concept ORDER BY concept) AS cs FROM (SELECT DISTINCT chunk, concept FROM ch JOIN ck ON ck.doc_id = ch.doc AND contains(lower(text), lower(concept)) WHERE regexp_matches(lower(text), {_edges('concept')})) GROUP BY chunk),
cf AS MATERIALIZED (SELECT ch.*, CASE WHEN length(l1) > 250 THEN left(l1, 250) || '...' ELSE l1 END AS summary, coalesce(kw, {_arr}) AS kw, coalesce(cs, {_arr}) AS cs, list_sort(list_distinct(list_concat(regexp_extract_all(text, '{T.TAG}'), coalesce(cs, {_arr})))) AS es
  FROM (SELECT *, {lines_sql('text')}[1] AS l1 FROM ch) ch LEFT JOIN kl USING (chunk) LEFT JOIN cl USING (chunk))"""
_GZ = GAZETTEER_SQL.replace(f"SELECT DISTINCT concept AS name FROM ({CONCEPTS_SQL})", "SELECT DISTINCT unnest(cs) AS name FROM cf")
_rw = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(spaced), {_lit(x)})" for x in p) + f" THEN '{' '.join(t)}' END" for p, t in G.REWRITES)
_SPQ = SPACED_SQL.replace("coalesce(text, '')", "text")
_hint = "CASE intent " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(_lit, v))}]" for k, v in G.HINT_SECTIONS.items()) + f" ELSE {_arr} END"
_sect = "CASE intent " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(_lit, v))}]" for k, v in H.INTENT_SECTIONS.items()) + f" ELSE {_arr} END"
_NQ = f"len(list_filter({tokens_sql('query')}, lambda w: w NOT IN ({words_sql(T.QUERY_STOP)})))"
_MP = " OR ".join(f"contains(' ' || lower(query) || ' ', '{m}')" for m in R.MULTIPART)
PLAN_SQL = f"""qs AS (SELECT item_id AS qid, replace(([{_QT}])[1 + item_id % {len(QUESTIONS)}], '{{}}', coalesce(text, '')) AS text FROM benchmark), {_GZ},
q0 AS (SELECT qs.qid, text AS judge, {INTENT_SQL} AS intent, list_concat(names, tags) AS entities, {ASPECTS_SQL} AS aspects, {_SPQ} AS spaced FROM (SELECT *, lower(trim(text)) AS t FROM qs) qs JOIN ge USING (qid)),
q1 AS (SELECT *, concat_ws(' ', spaced, {_rw}) AS query, {_hint} AS sections, {_sect} AS fragments FROM q0),
q2 AS (SELECT *, {_NQ} AS n, {_MP} AS parts, len(regexp_extract_all(query, '\\?')) AS marks FROM q1),
q3 AS (SELECT *, greatest(6, least(10, greatest(3, 4 + CASE WHEN n > 6 THEN 2 ELSE 0 END + CASE WHEN n > 12 THEN 2 ELSE 0 END + CASE WHEN parts THEN 2 ELSE 0 END + CASE WHEN marks > 1 THEN 1 ELSE 0 END))) AS k FROM q2),
qp AS MATERIALIZED (SELECT *, least(40, greatest(16, 20 + CASE WHEN n > 6 THEN 6 ELSE 0 END + CASE WHEN n > 12 THEN 6 ELSE 0 END + CASE WHEN parts THEN 8 ELSE 0 END, 3 * k)) AS pool FROM q3),
qe AS (SELECT qid, unnest(entities) AS own FROM qp), gx AS MATERIALIZED (SELECT qid, own AS e FROM qe UNION SELECT qid, unnest(cs) FROM cf JOIN qe ON list_contains(cs, own)),
-- the index of the fields
tok AS (SELECT chunk AS doc, unnest({tokens_sql("concat_ws(' ', summary, array_to_string(kw, ' '), array_to_string(cs, ' '), text)")}) AS term FROM cf),
postings AS MATERIALIZED (SELECT doc, term, count(*) AS tf FROM tok GROUP BY doc, term), dl AS (SELECT doc, sum(tf) AS dl FROM postings GROUP BY doc),
terms AS MATERIALIZED (SELECT term, count(*) AS df FROM postings GROUP BY term), st AS (SELECT (SELECT count(*) FROM cf) AS n_docs, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM cf) AS avg_dl),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens_sql('query')}) AS term FROM qp) GROUP BY qid, term),
bm25 AS MATERIALIZED (SELECT qid, doc, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score FROM q JOIN postings USING (term) JOIN terms USING (term) JOIN dl USING (doc) CROSS JOIN st GROUP BY qid, doc),
{DENSE_SQL}, graph AS (SELECT qid, chunk AS doc, CAST(count(*) AS DOUBLE) AS score FROM (SELECT chunk, unnest(es) AS e FROM cf) JOIN gx USING (e) GROUP BY qid, chunk), {RRF_SQL}"""
_hitf = lambda t, h: f"(regexp_matches({h}, '(^|[^a-z0-9])' || regexp_escape({t}) || '($|[^a-z0-9])') OR regexp_matches(replace({h}, '-', ''), '(^|[^a-z0-9])' || regexp_escape(replace({t}, '-', '')) || '($|[^a-z0-9])'))"
CAND_SQL = f"""idf AS (SELECT term, ln((n_docs + 1) / (df + 1)) + 1 AS idf FROM terms, st),
jw AS (SELECT qid, term, coalesce(idf, ln(n_docs + 1) + 1) AS idf FROM (SELECT qid, unnest({query_terms_sql('judge')}) AS term FROM qp) LEFT JOIN idf USING (term) CROSS JOIN st), jt AS (SELECT qid, sum(idf) AS total FROM jw GROUP BY qid),
nm AS (SELECT DISTINCT qid, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(trim(x)), '[ \\t\\n]+'), lambda w: w <> ''), lambda w: {sing_sql('w')}), ' ') AS name FROM (SELECT qid, unnest(list_concat(entities, aspects)) AS x FROM qp)),
nw AS (SELECT qid, name, coalesce(max(CASE WHEN t IS NULL THEN NULL ELSE coalesce(idf, ln(n_docs + 1) + 1) END), 1.0) AS w FROM (SELECT qid, name, unnest(CASE WHEN len({tokens_sql('name')}) = 0 THEN [NULL] ELSE {tokens_sql('name')} END) AS t FROM nm WHERE length(name) >= 3) LEFT JOIN idf ON term = t CROSS JOIN st GROUP BY qid, name),
nt AS (SELECT qid, sum(w) AS total FROM nw GROUP BY qid),
a0 AS (SELECT r.qid, c.*, r.score AS rrf, coalesce(d.score, 0.0) AS dense, coalesce(b.score, 0.0) AS bm25, coalesce(g.score, 0.0) AS graph, qp.* EXCLUDE (qid) FROM rrf r JOIN cf c ON c.chunk = r.doc JOIN qp USING (qid) LEFT JOIN dense d ON d.qid = r.qid AND d.doc = r.doc LEFT JOIN bm25 b ON b.qid = r.qid AND b.doc = r.doc LEFT JOIN graph g ON g.qid = r.qid AND g.doc = r.doc),
a1 AS (SELECT *, round(CAST(1 + least(0.5, CASE WHEN len(list_filter(fragments, lambda x: contains(lower(section), x))) > 0 THEN 0.20 ELSE 0.0 END + least(0.20, 0.10 * len(list_intersect(es, entities))) + least(0.16, 0.08 * len(list_intersect({tokens_sql('judge')}, kw)))
  + CASE WHEN section <> '' AND len(list_filter(sections, lambda x: contains(lower(section), lower(x)))) > 0 THEN 0.15 ELSE 0.0 END) AS DOUBLE), 6) AS meta FROM a0),
a2 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf * meta, 10) DESC, chunk) AS place FROM a1) WHERE place <= pool),
ts AS MATERIALIZED (SELECT chunk, list_distinct({tokens_sql('text')}) AS ts, array_to_string({tokens_sql("concat_ws(' ', text, summary, array_to_string(kw, ' '), array_to_string(es, ' '))")}, ' ') AS hay, {{prose}} AS prose FROM (SELECT *, {lines_sql('text')} AS ls FROM cf WHERE chunk IN (SELECT chunk FROM a2))),
mw AS (SELECT a2.qid, a2.chunk, sum(idf) AS met FROM a2 JOIN ts USING (chunk) JOIN jw ON jw.qid = a2.qid AND list_contains(ts, term) GROUP BY 1, 2),
me AS (SELECT a2.qid, a2.chunk, sum(w) AS met, list(name ORDER BY name) AS matched FROM a2 JOIN ts USING (chunk) JOIN nw ON nw.qid = a2.qid WHERE {_hitf('name', 'hay')} GROUP BY 1, 2),
a3 AS (SELECT a2.*, ts, hay, coalesce(matched, []) AS matched, round(CAST(CASE WHEN jt.total IS NULL THEN 0.5 ELSE least(1.0, 0.08 + 0.92 * (coalesce(mw.met, 0.0) / jt.total) * (0.30 + 0.70 * prose)) END AS DOUBLE), 4) AS relevance, round(CAST(CASE WHEN nt.total IS NULL THEN 0.0 ELSE coalesce(me.met, 0.0) / nt.total END AS DOUBLE), 4) AS entity, nt.total IS NOT NULL AS has_names
  FROM a2 JOIN ts USING (chunk) LEFT JOIN jt USING (qid) LEFT JOIN nt USING (qid) LEFT JOIN mw ON mw.qid = a2.qid AND mw.chunk = a2.chunk LEFT JOIN me ON me.qid = a2.qid AND me.chunk = a2.chunk),
a4 AS (SELECT *, round(CAST(CASE WHEN has_names THEN 0.60 * least(1.0, relevance) + 0.20 * entity + 0.20 * least(1.0, (meta - 1) / 0.5) ELSE relevance END AS DOUBLE), 6) AS score,
  round(CAST(0.45 * least(1.0, relevance) + 0.15 * least(1.0, dense) + 0.15 * bm25 / (bm25 + 4.0) + 0.20 * least(1.0, graph / 3.0) + 0.05 * least(1.0, (meta - 1) / 0.5) AS DOUBLE), 4) AS accept_score FROM a3),
a5 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk) - 1 AS rank FROM a4), a6 AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, chunk) AS i FROM a5 WHERE rank = 0 OR accept_score >= 0.15),
a7 AS (SELECT *, round(sum(CASE WHEN i <= 2 THEN score END) OVER (PARTITION BY qid, doc), 6) AS weight FROM a6), cand AS MATERIALIZED (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY weight DESC, doc) AS dr FROM a7) WHERE dr <= least(3, greatest(1, k // 2)))"""
_PROSE = PROSE_SQL[PROSE_SQL.index("CASE WHEN len(ls) = 0") : PROSE_SQL.rindex(" AS prose FROM ls")]
CAND_SQL = CAND_SQL.replace("{prose}", _PROSE)


def _mmr_round(k):
    return f"""v{k} AS (SELECT p.qid, p.chunk, p.doc, p.section, p.score, p.k, coalesce(max(s.sim), 0.0) AS near, round(0.72 * p.score / m.top - 0.28 * coalesce(max(s.sim), 0.0), 9) AS value FROM cand p JOIN mt m USING (qid) LEFT JOIN c{k} c ON c.qid = p.qid LEFT JOIN sims s ON s.qid = p.qid AND s.a = p.chunk AND s.b = c.chunk
  WHERE p.k > {k} AND NOT EXISTS (SELECT 1 FROM c{k} x WHERE x.qid = p.qid AND x.chunk = p.chunk) AND (SELECT count(*) FROM c{k} x WHERE x.qid = p.qid AND x.doc = p.doc) < least(4, p.k) AND (SELECT count(*) FROM c{k} x WHERE x.qid = p.qid AND x.doc = p.doc AND x.section = p.section) < 2 AND (SELECT count(*) FROM c{k} x WHERE x.qid = p.qid) = {k} GROUP BY p.qid, p.chunk, p.doc, p.section, p.score, p.k, m.top),
b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY value DESC, score DESC, chunk) AS i FROM v{k}) WHERE i = 1{' AND NOT near > 0.90' if k >= 3 else ''}),
c{k + 1} AS MATERIALIZED (SELECT * FROM c{k} UNION ALL SELECT qid, chunk, doc, section, score, {k} AS position FROM b{k})"""


def _repair(n):
    """Repair of aspect n over the selection r{n}: the best of the pool that covers it for the weakest whose aspects others cover."""
    return f"""n{n} AS (SELECT qid FROM asp WHERE pos = {n + 1} AND qid NOT IN (SELECT s.qid FROM r{n} s JOIN cov USING (qid, chunk) WHERE cov.pos = {n + 1})),
g{n} AS (SELECT qid, arg_min(chunk, (-score, chunk)) AS chunk FROM cand JOIN cov USING (qid, chunk) JOIN n{n} USING (qid) WHERE cov.pos = {n + 1} AND (qid, chunk) NOT IN (SELECT qid, chunk FROM r{n}) GROUP BY qid),
f{n} AS (SELECT s.qid, arg_max(s.chunk, (-s.score, s.chunk)) AS chunk FROM r{n} s JOIN g{n} USING (qid) WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.qid = s.qid AND c.chunk = s.chunk AND NOT EXISTS (SELECT 1 FROM cov o JOIN r{n} x ON x.qid = o.qid AND x.chunk = o.chunk WHERE o.qid = c.qid AND o.pos = c.pos AND x.chunk <> s.chunk)) GROUP BY s.qid),
r{n + 1} AS MATERIALIZED (SELECT s.qid, s.chunk, s.score, s.position FROM r{n} s LEFT JOIN f{n} USING (qid) WHERE f{n}.chunk IS NULL OR f{n}.chunk <> s.chunk UNION ALL SELECT g.qid, g.chunk, c.score, NULL FROM g{n} g JOIN f{n} USING (qid) JOIN cand c ON c.qid = g.qid AND c.chunk = g.chunk)"""


_al = "list_filter(list_transform(aspects, lambda a: lower(trim(a))), lambda a: length(a) >= 3)"
_aw = query_terms_sql("a")
LAST_SQL = f"""mt AS (SELECT qid, CASE WHEN max(score) = 0 THEN 1.0 ELSE max(score) END AS top FROM cand GROUP BY qid), u AS MATERIALIZED (SELECT doc AS chunk, term, dw.w / dn.norm AS w FROM dw JOIN dn USING (doc) WHERE doc IN (SELECT chunk FROM cand)),
sims AS MATERIALIZED (SELECT x.qid, x.chunk AS a, y.chunk AS b, round(sum(l.w * r.w), 9) AS sim FROM cand x JOIN cand y ON x.qid = y.qid AND x.chunk <> y.chunk JOIN u l ON l.chunk = x.chunk JOIN u r ON r.chunk = y.chunk AND r.term = l.term GROUP BY 1, 2, 3),
c0 AS (SELECT qid, chunk, doc, section, score, 0 AS position FROM cand WHERE false), {', '.join(_mmr_round(k) for k in range(10))},
asp AS (SELECT DISTINCT qid, unnest({_al}) AS a, unnest(range(1, len({_al}) + 1)) AS pos FROM qp), told AS (SELECT DISTINCT qid FROM asp),
cov AS MATERIALIZED (SELECT c.qid, c.chunk, asp.pos FROM cand c JOIN asp USING (qid) WHERE {_hitf('a', 'hay')} OR (len({_aw}) > 0 AND len(list_filter({_aw}, lambda w: {_hitf('w', 'hay')})) = len({_aw}))),
r0 AS (SELECT qid, chunk, score, position FROM c10), {_repair(0)}, {_repair(1)},
ho AS (SELECT r.qid, r.chunk, row_number() OVER (PARTITION BY r.qid ORDER BY CASE WHEN told.qid IS NOT NULL OR position IS NULL THEN 0 ELSE position END, r.score DESC, r.chunk) - 1 AS rank FROM r2 r LEFT JOIN told USING (qid)),
h AS (SELECT ho.*, ts FROM ho JOIN cand USING (qid, chunk)),
dd(qid, rank, kept) AS (SELECT qid, CAST(-1 AS BIGINT), []::STRUCT(chunk BIGINT, ts VARCHAR[])[] FROM h GROUP BY qid
  UNION ALL SELECT dd.qid, h.rank, CASE WHEN len(list_filter(kept, lambda y: len(list_intersect(y.ts, h.ts)) > 0 AND len(list_intersect(y.ts, h.ts)) / greatest(1, least(len(y.ts), len(h.ts))) > 0.85)) > 0 THEN kept ELSE list_append(kept, {{'chunk': h.chunk, 'ts': h.ts}}) END FROM dd JOIN h ON h.qid = dd.qid AND h.rank = dd.rank + 1),
dz AS (SELECT qid, arg_max(kept, rank) AS kept FROM dd GROUP BY qid), single AS (SELECT qid, x.chunk AS chunk FROM (SELECT qid, unnest(kept) AS x FROM dz)),
so AS (SELECT s.qid, c.doc, c.pos, c.chunk, c.section, c.score, c.text, row_number() OVER (PARTITION BY s.qid ORDER BY c.doc, c.pos) AS i FROM single s JOIN cand c USING (qid, chunk)),
-- an open block for each row of a query's list, in order of place
mg(qid, i, block, doc, pos, section, text, chunks, score, chunk) AS (SELECT qid, i, CAST(1 AS BIGINT), doc, pos, section, text, [chunk], score, chunk FROM so WHERE i = 1
  UNION ALL SELECT so.qid, so.i, CASE WHEN j THEN block ELSE block + 1 END, so.doc, so.pos, CASE WHEN j THEN m.section ELSE so.section END, CASE WHEN j THEN regexp_replace(m.text, '\\s+$', '') || chr(10) || chr(10) || regexp_replace(so.text, '^\\s+', '') ELSE so.text END, CASE WHEN j THEN list_append(m.chunks, so.chunk) ELSE [so.chunk] END, CASE WHEN j THEN greatest(m.score, so.score) ELSE so.score END, CASE WHEN j THEN m.chunk ELSE so.chunk END
  FROM (SELECT m.*, m.i + 1 AS nxt FROM mg m) m JOIN so ON so.qid = m.qid AND so.i = m.nxt, LATERAL (SELECT m.doc = so.doc AND m.pos + 1 = so.pos AND m.section = so.section AND length(m.text) + length(so.text) < 2600 AS j)),
bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, block ORDER BY i DESC) AS z FROM mg) WHERE z = 1),
nb AS (SELECT b.qid, b.block, max(CASE WHEN c.pos = b.pos - 1 THEN c.text END) AS before, max(CASE WHEN c.pos = b.pos + 1 THEN c.text END) AS behind FROM bl b JOIN ch c ON c.doc = b.doc AND c.pos IN (b.pos - 1, b.pos + 1) AND c.section = b.section WHERE NOT EXISTS (SELECT 1 FROM bl o WHERE o.qid = b.qid AND o.doc = c.doc AND o.pos = c.pos) GROUP BY 1, 2),
fin AS (SELECT b.qid, b.chunk, b.chunks, b.doc, b.pos, b.section, b.score, CASE WHEN length(text) <= 1200 THEN left(concat_ws(chr(10) || chr(10), nullif(before, ''), nullif(text, ''), nullif(behind, '')), 2600) ELSE text END AS text FROM bl b LEFT JOIN nb USING (qid, block)),
res AS (SELECT f.qid, row_number() OVER (PARTITION BY f.qid ORDER BY f.score DESC, f.doc, f.pos) AS place, f.chunk, array_to_string(f.chunks, ',') AS chunks, f.section, round(f.score, 4) AS score, round(rrf, 6) AS rrf, dense, bm25, graph, relevance, round(entity, 3) AS entity, round(meta, 4) AS meta, round(accept_score, 3) AS accept_score, matched, md5(f.text) AS text_md5 FROM fin f JOIN cand c ON c.qid = f.qid AND c.chunk = f.chunk)"""
_method = "concat_ws(' + ', CASE WHEN dense > 0 THEN 'Dense' END, CASE WHEN bm25 > 0 THEN 'BM25' END, CASE WHEN graph > 0 THEN 'Graph' END)"
_why = "concat_ws('; ', CASE WHEN dense > 0.60 THEN 'High semantic similarity' END, CASE WHEN bm25 > 3 THEN 'Strong keyword overlap' END, CASE WHEN graph > 0 THEN 'Matched graph neighborhood' END, CASE WHEN len(matched) > 0 THEN 'Covers query entities: ' || array_to_string(matched[1:4], ', ') END)"
O["retrieve"] = f"""WITH RECURSIVE {CHUNK_SQL}, {PLAN_SQL}, {CAND_SQL}, {LAST_SQL}
SELECT * EXCLUDE (matched), coalesce(nullif({_method}, ''), 'RRF') AS method, coalesce(nullif({_why}, ''), 'elected by rank fusion and relevance') AS why FROM res"""
