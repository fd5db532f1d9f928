"""Queries over the iterative controller and the knowledge agent."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import agent as A
from basalt.operators import controller as K
from basalt.operators import golden as E
from basalt.operators import hybrid as H
from basalt.operators import index as I
from basalt.operators import query as G
from basalt.operators import understand as U
from basalt.operators import verify as V
from basalt.plans.answers import ASPECTS_SQL, CLASS_SQL, FACETS_SQL, INTENT_SQL, SPACED_SQL, _S, _ct, relevant
from basalt.plans.common import INDEX_SQL, lines_sql, longs, query_terms_sql, table, tokens_sql, wc_sql
from basalt.plans.text import PROSE_SQL
from basalt.runtime import written

Q, O = {}, {}
PER_QUERY = 3


def passages_checked(spark, d):
    """Are the benchmark's passages supported by the documents?  The answer is the passage itself, its claims are verified against the
    documents that BM25 finds for it; claims without support, and missing facets, are looked up in a second round."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    index = I.build(docs, "doc")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))

    def retrieve(rows):
        keyed = rows.select((F.col("qid") * 100 + F.col("no")).alias("key"), "query")
        top = written(I.ranked(I.bm25(index, keyed, "key", "query", depth=PER_QUERY), PER_QUERY), "found")
        found = docs.join(I.held(top.select("doc").distinct()), "doc")
        return top.join(found, "doc").select((F.col("qid") / 100).cast("bigint").alias("qid"), F.pmod("qid", F.lit(100)).cast("int").alias("no"), "rank", F.col("doc").alias("chunk"), "text")

    def verify(answers, told):
        claims = V.claims(answers, "qid", "answer")
        scores = written(V.support(claims, told.select(F.col("qid").alias("aid"), "eid", "text")), "claim-scores")
        covered = V.rollup(scores).select(F.col("aid").alias("qid"), F.col("claim_score").alias("coverage"))
        return covered, claims.join(scores.select("aid", "pos", "status"), ["aid", "pos"]).select(F.col("aid").alias("qid"), "pos", "claim", "status")

    def facets(open_, told):
        label, _ = U.classify(F.col("text"))
        names = G.entities(F.col("text"))
        rows = open_.select("qid", label.alias("label"), F.try_element_at(names, F.lit(1)).alias("a"), F.try_element_at(names, F.lit(2)).alias("b"))
        found = U.facets(rows, told.select("qid", "text"))
        return found.join(rows.select("qid", "a"), "qid").select("qid", "facet", F.trim(F.concat_ws(" ", "facet", "a")).alias("probe"), "covered")

    out = K.run(asked.select("qid", "text", F.lit(None).cast("array<string>").alias("subqueries"), F.lit(None).cast("array<string>").alias("options")), retrieve, lambda open_, told: open_.select("qid", F.col("text").alias("answer")), verify, facets)
    return longs(out.select("qid", "status", F.md5("answer").alias("answer_md5"), "coverage", "iterations", "evidence"))


Q["iterative_check"] = passages_checked


_TOKENS = f"list_filter(regexp_extract_all(lower(facet), '[a-z0-9][a-z0-9\\-]+'), lambda t: t NOT IN ({', '.join(repr(w) for w in G.PLAN_STOP)}))"


def _bm25(name, src):
    """CTEs that find the PER_QUERY best documents of each (key, query) of src."""
    return f"""{name}q AS (SELECT key, term, count(*) AS qtf FROM (SELECT key, unnest({tokens_sql('query')}) AS term FROM {src}) GROUP BY key, term),
{name}s AS (SELECT key, doc, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score FROM {name}q JOIN postings USING (term) JOIN terms USING (term) JOIN dl USING (doc) CROSS JOIN st GROUP BY key, doc),
{name} AS MATERIALIZED (SELECT key // 100 AS qid, key % 100 AS no, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc) - 1 AS rank FROM {name}s) WHERE rank < {PER_QUERY})"""


def _verified(k):
    """Claims and facets of round k against the evidence ev{k} (qid, eid, doc)."""
    fa = FACETS_SQL.split(",\nfc AS")[0] if k == 0 else ""
    terms = f"CASE WHEN len(terms) > 0 THEN terms ELSE {_TOKENS} END"
    return (f"{fa},\n" if fa else "") + f"""tx{k} AS (SELECT qid, eid, coalesce(d.text, '') AS text, {_ct('d.text')} AS et FROM ev{k} JOIN documents d ON d.doc_id = ev{k}.doc),
su{k} AS MATERIALIZED (SELECT cc.qid, claim, any_value(pos) AS pos, round(CAST(max(CASE WHEN eid IS NOT NULL THEN least(CASE WHEN len(list_filter(nums, lambda x: NOT contains(text, x))) > 0 THEN 0.65 ELSE 1.0 END, len(list_intersect(ct, et)) / greatest(1, len(ct))) END) AS DOUBLE), 4) AS score FROM cc JOIN op{k} USING (qid) LEFT JOIN tx{k} USING (qid) GROUP BY cc.qid, claim),
cv{k} AS (SELECT qid, round((count(*) FILTER (score >= 0.70) + 0.5::DOUBLE * count(*) FILTER (score >= 0.45 AND score < 0.70)) / count(*), 4) AS coverage FROM su{k} GROUP BY qid),
fc{k} AS MATERIALIZED (SELECT ft.qid, facet, trim(concat_ws(' ', facet, nullif(a, ''))) AS probe, coalesce(bool_or(len(list_filter({terms}, lambda w: regexp_matches(lower(t.text), '(^|[^a-z0-9])' || regexp_escape(lower(w)) || '([^a-z0-9]|$)'))) > 0), false) AS covered FROM ft JOIN op{k} USING (qid) JOIN ab USING (qid) LEFT JOIN tx{k} t ON t.qid = ft.qid GROUP BY ft.qid, facet, a),
fr{k} AS (SELECT qid, round(avg(CAST(covered AS DOUBLE)), 3) AS share FROM fc{k} GROUP BY qid),
rd{k} AS MATERIALIZED (SELECT qid, round(CAST(least(1.0, 0.7 * coalesce(coverage, 0.0) + 0.3 * coalesce(share, 1.0)) AS DOUBLE), 3) AS total FROM op{k} LEFT JOIN cv{k} USING (qid) LEFT JOIN fr{k} USING (qid))"""


_ends = lambda t, k, note: f"CASE WHEN {t} > 0.9 THEN 'ANSWER' WHEN {t} >= 0.7 THEN 'NOTE' ELSE '{note}' END"
_say = lambda s: f"md5(CASE {s} WHEN 'ANSWER' THEN text WHEN 'NOTE' THEN text || chr(10) || chr(10) || '{K.NOTE}' ELSE '{K.INSUFFICIENT}' END)"
O["iterative_check"] = f"""WITH {INDEX_SQL}, qs AS (SELECT item_id AS qid, coalesce(text, '') AS text FROM benchmark), {CLASS_SQL},
cs AS (SELECT qid, ss, unnest(range(1, len(ss) + 1)) AS pos FROM (SELECT qid, list_transform({_S.format(t='text')}, lambda s: trim(regexp_replace(s, '^([-*+] |[0-9]+[.)] |#+ )', ''))) AS ss FROM qs)),
cc AS MATERIALIZED (SELECT qid, claim, min(pos) AS pos, any_value({_ct('claim')}) AS ct, any_value(list_distinct(regexp_extract_all(claim, '[0-9]+(?:\\.[0-9]+)?'))) AS nums FROM (SELECT qid, ss[pos] AS claim, pos FROM cs) WHERE {wc_sql('claim')} >= 5 AND NOT regexp_matches(claim, '\\?$|\\|') GROUP BY qid, claim),
a0 AS (SELECT qid * 100 AS key, text AS query FROM qs), {_bm25('h0', 'a0')},
op0 AS (SELECT qid FROM qs), ev0 AS MATERIALIZED (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY no, rank, doc) AS eid, doc FROM h0), {_verified(0)},
uc AS (SELECT qid, i, claim AS query FROM (SELECT qid, trim(regexp_replace(claim, '\\s*\\[[0-9]+\\]', '', 'g')) AS claim, row_number() OVER (PARTITION BY qid ORDER BY pos) AS i FROM su0 WHERE score < 0.45) WHERE i <= 3
  UNION ALL SELECT qid, i + 3, probe FROM (SELECT qid, probe, row_number() OVER (PARTITION BY qid ORDER BY facet) AS i FROM fc0 WHERE NOT covered) WHERE i <= 2),
a1 AS (SELECT qid * 100 + row_number() OVER (PARTITION BY qid ORDER BY i) AS key, query FROM (SELECT qid, query, min(i) AS i FROM uc JOIN rd0 USING (qid) WHERE total < 0.7 GROUP BY qid, query)), {_bm25('h1', 'a1')},
nw AS (SELECT qid, doc, min((no, rank)) AS x FROM h1 WHERE (qid, doc) NOT IN (SELECT qid, doc FROM ev0) GROUP BY qid, doc), ad AS (SELECT qid, count(*) AS added FROM nw GROUP BY qid),
op1 AS (SELECT qid FROM rd0 JOIN ad USING (qid) WHERE total < 0.7), ev1 AS MATERIALIZED (SELECT qid, eid, doc FROM ev0 UNION ALL SELECT qid, (SELECT count(*) FROM ev0 WHERE ev0.qid = nw.qid) + row_number() OVER (PARTITION BY qid ORDER BY x, doc), doc FROM nw), {_verified(1)},
-- what the second round asks for at its end: it still counts as evidence
uc2 AS (SELECT qid, i, claim AS query FROM (SELECT qid, trim(regexp_replace(claim, '\\s*\\[[0-9]+\\]', '', 'g')) AS claim, row_number() OVER (PARTITION BY qid ORDER BY pos) AS i FROM su1 WHERE score < 0.45) WHERE i <= 3
  UNION ALL SELECT qid, i + 3, probe FROM (SELECT qid, probe, row_number() OVER (PARTITION BY qid ORDER BY facet) AS i FROM fc1 WHERE NOT covered) WHERE i <= 2),
a2 AS (SELECT qid * 100 + row_number() OVER (PARTITION BY qid ORDER BY i) AS key, query FROM (SELECT qid, query, min(i) AS i FROM uc2 JOIN rd1 USING (qid) WHERE total < 0.7 GROUP BY qid, query)), {_bm25('h2', 'a2')},
n2 AS (SELECT qid, count(DISTINCT doc) AS n FROM h2 WHERE (qid, doc) NOT IN (SELECT qid, doc FROM ev1) GROUP BY qid), n1 AS (SELECT qid, count(*) AS n FROM ev1 GROUP BY qid),
fo AS (SELECT qs.qid, text, rd0.total AS t0, rd1.total AS t1, coalesce(n1.n, 0) + coalesce(n2.n, 0) AS evidence FROM qs JOIN rd0 USING (qid) LEFT JOIN rd1 USING (qid) LEFT JOIN n1 USING (qid) LEFT JOIN n2 USING (qid)),
z AS (SELECT *, CASE WHEN t0 >= 0.7 OR t1 IS NULL THEN {_ends('t0', 0, 'INSUFFICIENT')} ELSE {_ends('t1', 1, 'INSUFFICIENT')} END AS status FROM fo)
SELECT qid, status, {_say('status')} AS answer_md5, greatest(t0, coalesce(t1, t0)) AS coverage, CAST(CASE WHEN t0 >= 0.7 THEN 0 WHEN t1 IS NULL THEN 1 WHEN t1 >= 0.7 THEN 1 ELSE 2 END AS BIGINT) AS iterations, evidence FROM z"""


# ---- the knowledge agent, with sources as documents and documents as their chunks

QUESTIONS = ["What is {}?", "Compare {} and memory", "Steps to change {} and then test", "difference between {} and vectors?", "{} vs graphs", "Summarize {} in short"]


def agent_parts(spark, d):
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk"), F.col("source").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))  # read where they lie: no copy
    ix = H.ChunkIndex(I.build(chunks, "chunk"), chunks)
    k = (F.pmod("item_id", F.lit(len(QUESTIONS))) + 1).cast("int")
    judge = F.replace(F.element_at(F.array(*map(F.lit, QUESTIONS)), k), F.lit("{}"), F.coalesce("text", F.lit("")))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), judge.alias("judge")).withColumn("aspects", U.aspects(F.col("judge")))
    two = F.size("aspects") == 2
    side = lambda i: F.concat(F.lit("What is "), F.try_element_at("aspects", F.lit(i)), F.lit("?"))
    asked = asked.select("qid", G.rewrite(F.col("judge")).alias("asked"), "aspects", F.when(two, "asset").otherwise("document").alias("strategy"), F.when(two, F.array(F.col("judge"), side(1), side(2))).alias("subqueries"))
    # Named documents: the sources of those that hold the whole passage.
    named = docs.select(F.col("doc_id").alias("chunk"), F.col("source").alias("doc")).join(I.held(relevant(spark, d).withColumnRenamed("doc", "chunk")), "chunk").select("qid", "doc").distinct()
    return written(asked, "agent-asked"), named, ix


def agent(spark, d):
    asked, named, ix = agent_parts(spark, d)
    return A.run(asked, written(named, "agent-named"), ix, A.lexical_retriever(ix))


Q["knowledge_agent"] = lambda spark, d: longs(agent(spark, d)[0])
Q["agent_diagnostics"] = lambda spark, d: longs(agent(spark, d)[1].withColumn("rejected", F.array_join("rejected", ",")))
_QT = ", ".join("'" + t.replace("'", "''") + "'" for t in QUESTIONS)
_rw = ", ".join("CASE WHEN " + " OR ".join("contains(lower(spaced), '" + x.replace("'", "''") + "')" for x in p) + f" THEN '{' '.join(t)}' END" for p, t in G.REWRITES)
_sp = SPACED_SQL.replace("coalesce(text, '')", "text")


def _look(name, src):
    """The best documents of each (key, query, k, docs) of src by BM25, within its sources if it names some."""
    return f"""{name}q AS (SELECT key, term, count(*) AS qtf FROM (SELECT key, unnest({tokens_sql('query')}) AS term FROM {src}) GROUP BY key, term),
{name}s AS (SELECT key, doc, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score FROM {name}q JOIN postings USING (term) JOIN terms USING (term) JOIN dl USING (doc) CROSS JOIN st GROUP BY key, doc),
{name} AS MATERIALIZED (SELECT key, place, doc AS chunk, source AS doc, score FROM (SELECT s.key, s.doc, source, score, k, row_number() OVER (PARTITION BY s.key ORDER BY score DESC, s.doc) AS place FROM {name}s s JOIN documents ON doc_id = s.doc JOIN {src} USING (key) WHERE docs IS NULL OR list_contains(docs, source)) WHERE place <= k)"""


def _gate(name, src, k):
    """What the gate says of the hits (qid, chunk, doc, score) of src."""
    return f"""{name}m AS (SELECT h.qid, h.chunk, sum(idf) AS met FROM {src} h JOIN ar USING (chunk) JOIN qw ON qw.qid = h.qid AND list_contains(ts, term) GROUP BY 1, 2),
{name}h AS (SELECT h.qid, h.chunk AS doc, h.score, h.doc AS source, size, low, prose, nl AS lines, ag.terms, aspects, round(CAST(CASE WHEN total IS NULL THEN 0.5 ELSE least(1.0, 0.08 + 0.92 * (coalesce(met, 0.0) / total) * (0.30 + 0.70 * prose)) END AS DOUBLE), 4) AS support
  FROM {src} h JOIN ar USING (chunk) JOIN sz ON sz.source = h.doc JOIN ag ON ag.qid = h.qid LEFT JOIN qt ON qt.qid = h.qid LEFT JOIN {name}m m ON m.qid = h.qid AND m.chunk = h.chunk),
{name}s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1 AS rank, max(score) OVER (PARTITION BY qid) AS top, min(source) OVER (PARTITION BY qid) = max(source) OVER (PARTITION BY qid) AS one FROM {name}h WHERE NOT (lines > 3 AND prose < 0.15)),
{name}f AS (SELECT *, CASE WHEN rank = 0 OR (one AND size <= 12) THEN NULL WHEN score < 0.45 * CASE WHEN top = 0 THEN 1.0 ELSE top END THEN 'below relevance bar' WHEN len(list_filter(terms, lambda t: contains(low, t))) < least(2, len(terms)) THEN 'insufficient query-term support'
  WHEN len(aspects) > 0 AND len(list_filter(aspects, lambda a: contains(low, lower(a)))) = 0 THEN 'mentions neither side of the comparison' WHEN support < 0.35 AND NOT (one AND prose >= 0.20) THEN 'weak content support' END AS fault FROM {name}s),
{name}g AS (SELECT *, coalesce(sum(CASE WHEN fault IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY score DESC, doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}f),
{name} AS (SELECT qid, doc AS chunk, rank, CASE WHEN before >= {k} THEN 'evidence budget reached' ELSE fault END AS reason, false AS outline FROM {name}g UNION ALL SELECT qid, doc, NULL, 'outline', true FROM {name}h WHERE lines > 3 AND prose < 0.15)"""


_prose = PROSE_SQL[PROSE_SQL.index("CASE WHEN len(ls) = 0") : PROSE_SQL.rindex(" AS prose FROM ls")]
AGENT_SQL = f"""{INDEX_SQL}, b0 AS (SELECT item_id AS qid, text AS passage, replace(([{_QT}])[1 + item_id % {len(QUESTIONS)}], '{{}}', coalesce(text, '')) AS text FROM benchmark),
b1 AS (SELECT qid, passage, text AS judge, {ASPECTS_SQL} AS aspects, {_sp} AS spaced FROM b0), ag AS MATERIALIZED (SELECT *, {query_terms_sql('asked')} AS ws, list_filter({query_terms_sql('asked')}, lambda t: length(t) >= 3) AS terms FROM (SELECT *, concat_ws(' ', spaced, {_rw}) AS asked FROM b1)),
qw AS (SELECT qid, term, ln((n_docs + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT qid, unnest(ws) AS term FROM ag) LEFT JOIN terms USING (term) CROSS JOIN st), qt AS (SELECT qid, sum(idf) AS total FROM qw GROUP BY qid), sz AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
ar AS (SELECT doc_id AS chunk, lower(coalesce(text, '')) AS low, list_distinct({tokens_sql('text')}) AS ts, len(ls) AS nl, round(CAST({_prose} AS DOUBLE), 6) AS prose FROM (SELECT *, {lines_sql('text')} AS ls FROM documents)),
tg AS (SELECT DISTINCT qid, source FROM ag JOIN documents ON contains(documents.text, passage) WHERE len(aspects) <> 2),
k1 AS (SELECT qid AS key, asked AS query, 12 AS k, NULL::VARCHAR[] AS docs FROM ag WHERE len(aspects) <> 2), {_look('f1', 'k1')},
vo AS (SELECT key AS qid, doc, round(sum(1.0::DOUBLE / place), 9) AS votes, count(*) AS hits FROM f1 GROUP BY key, doc), vs AS (SELECT *, round(votes / sum(votes) OVER (PARTITION BY qid), 6) AS share, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, doc) AS i FROM vo),
fo AS (SELECT qid, list(source ORDER BY source) AS docs, 'named entity/concept' AS routed_by, []::VARCHAR[] AS rejected FROM tg GROUP BY qid UNION ALL SELECT qid, [doc], 'dominant document (' || CAST(floor(share * 100) AS BIGINT) || '%)', (SELECT list(o.doc ORDER BY o.doc) FROM vo o WHERE o.qid = vs.qid AND o.doc <> vs.doc) FROM vs WHERE i = 1 AND share >= 0.4 AND hits >= 2 AND qid NOT IN (SELECT qid FROM tg)),
k2 AS (SELECT qid AS key, asked AS query, 6 AS k, docs FROM ag JOIN fo USING (qid)), {_look('f2', 'k2')},
dh AS (SELECT key AS qid, chunk, doc, score FROM f2 UNION ALL SELECT key, chunk, doc, score FROM f1 WHERE key NOT IN (SELECT key FROM f2)), {_gate('dg', 'dh', 6)},
k3 AS (SELECT qid * 6 + i - 1 AS key, ([judge, 'What is ' || aspects[1] || '?', 'What is ' || aspects[2] || '?'])[i] AS query, 4 AS k, NULL::VARCHAR[] AS docs FROM ag, (SELECT unnest([1, 2, 3]) AS i) WHERE len(aspects) = 2), {_look('f3', 'k3')},
ah AS (SELECT qid, chunk, arg_min(doc, (place, key)) AS doc, arg_min(score, (place, key)) AS score FROM (SELECT key // 6 AS qid, * FROM f3) GROUP BY qid, chunk), {_gate('gg', 'ah', 8)},
ev AS (SELECT * FROM dg UNION ALL SELECT * FROM gg)"""
O["knowledge_agent"] = f"WITH {AGENT_SQL} SELECT qid, chunk, rank, reason IS NULL AS used, reason FROM ev"
O["agent_diagnostics"] = f"""WITH {AGENT_SQL}, rt AS (SELECT qid, count(DISTINCT chunk) AS retrieved FROM (SELECT key AS qid, chunk FROM f1 UNION ALL SELECT key // 6, chunk FROM f3) GROUP BY qid), us AS (SELECT qid, count(*) FILTER (reason IS NULL) AS used FROM ev GROUP BY qid)
SELECT qid, CASE WHEN len(aspects) = 2 THEN 'asset' ELSE 'document' END AS strategy, routed_by, array_to_string(rejected, ',') AS rejected, coalesce(retrieved, 0) AS retrieved, coalesce(used, 0) AS used FROM ag LEFT JOIN fo USING (qid) LEFT JOIN rt USING (qid) LEFT JOIN us USING (qid)"""


# ---- the golden set: benchmark passages in templates of a known intent; expected are the documents that hold the passage, and its longest words

GOLDEN = [("What is the meaning of {}", "definition"), ("Compare {} with others", "comparison"), ("Summarize {}", "summary"), ("{}", None)]


def golden(spark, d):
    k = (F.pmod("item_id", F.lit(len(GOLDEN))) + 1).cast("int")
    pick = lambda i, kind: F.element_at(F.array(*(F.lit(g[i]).cast(kind) for g in GOLDEN)), k)
    words = T.query_terms(F.col("text"))
    longest = F.transform(F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 3), lambda x: x["w"])
    cases = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "item_id", F.replace(pick(0, "string"), F.lit("{}"), "text").alias("query"), longest.alias("expected_terms"), pick(1, "string").alias("intent"), F.concat(F.lit("c"), k).alias("category"))
    held = relevant(spark, d).groupBy(F.col("qid").cast("string").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("doc-"), "doc", F.lit(".")))).alias("expected_docs"))  # copies of one passage
    cases = written(cases.join(held, "id").withColumn("expected_doc", F.lit(None).cast("string")), "golden")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    top = written(I.ranked(I.bm25(I.build(docs, "doc"), cases.select("item_id", F.col("query").alias("text")), depth=6), 6), "golden-top")
    hits = docs.join(I.held(top), "doc").select(F.col("qid").cast("string").alias("id"), (F.col("rank") + 1).alias("place"), F.concat(F.lit("doc-"), "doc", F.lit(".")).alias("label"), "text")
    return E.retrieval_rows(cases, hits, cases.select("id", U.intent(F.col("query")).alias("intent"), F.lit(None).cast("double").alias("latency_ms")))


Q["golden_retrieval"] = lambda spark, d: longs(golden(spark, d).drop("latency_ms").withColumn("missing_terms", F.array_join("missing_terms", ",")).withColumn("rr", F.round("rr", 4)).withColumn("term_coverage", F.round("term_coverage", 4)).withColumn("intent_ok", F.col("intent_ok").cast("bigint")))
Q["golden_summary"] = lambda spark, d: longs(E.retrieval_summary(golden(spark, d), 6, by="category").drop("latency_ms_mean", "latency_ms_max"))
_g = lambda i: "([" + ", ".join("NULL" if g[i] is None else "'" + g[i] + "'" for g in GOLDEN) + f"])[1 + item_id % {len(GOLDEN)}]"
GOLDEN_SQL = f"""gc AS (SELECT item_id, text AS passage, replace({_g(0)}, '{{}}', text) AS query, {_g(1)} AS want, 'c' || (1 + item_id % {len(GOLDEN)}) AS category, list_transform(list_sort(list_transform({query_terms_sql('text')}, lambda w: {{'n': -length(w), 'w': w}}))[1:3], lambda x: x.w) AS terms FROM benchmark),
gd AS (SELECT item_id, list('doc-' || doc_id || '.' ORDER BY 'doc-' || doc_id || '.') AS docs FROM gc JOIN documents ON contains(documents.text, passage) GROUP BY item_id), cases AS MATERIALIZED (SELECT * FROM gc JOIN gd USING (item_id)),
gq AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({tokens_sql('query')}) AS term FROM cases) GROUP BY 1, 2),
gs AS (SELECT qid, doc, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score FROM gq JOIN postings USING (term) JOIN terms USING (term) JOIN dl USING (doc) CROSS JOIN st GROUP BY qid, doc),
gh AS (SELECT qid, 'doc-' || doc || '.' AS label, doc, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS place FROM gs) WHERE place <= 6),
gr AS (SELECT gh.*, CAST(list_contains(docs, label) AS INT) AS rel, list_filter(terms, lambda t: regexp_matches(lower(coalesce(d.text, '')), '(^|[^a-z0-9])' || regexp_escape(lower(t)) || '([^a-z0-9]|$)')) AS covered FROM gh JOIN cases ON item_id = qid JOIN documents d ON d.doc_id = gh.doc),
gi AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, place) AS ideal FROM gr),
ga AS (SELECT qid, list(label) AS labels, list_distinct(flatten(list(covered))) AS covered, min(place) FILTER (rel = 1) AS rank, max(rel) FILTER (place <= 5) AS five, avg(rel) AS prec, sum(rel / log2(place + 1)) AS dcg, sum(rel / log2(ideal + 1)) AS idcg FROM gi GROUP BY qid),
gg AS (SELECT CAST(item_id AS VARCHAR) AS id, category, query, len(list_filter(docs, lambda x: NOT list_contains(coalesce(labels, []), x))) = 0 AS hit, rank, coalesce(1.0::DOUBLE / rank, 0.0) AS rr, coalesce(rank, 0) = 1 AS recall_at_1, coalesce(five, 0) = 1 AS recall_at_5, round(coalesce(prec, 0.0), 3) AS precision_at_k,
  round(CAST(coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0.0) AS DOUBLE), 3) AS ndcg, CASE WHEN len(terms) = 0 THEN 1.0 ELSE len(list_intersect(terms, coalesce(covered, []))) / len(terms) END AS term_coverage, list_filter(terms, lambda t: NOT list_contains(coalesce(covered, []), t)) AS missing, CASE WHEN want IS NOT NULL THEN CAST(intent = want AS BIGINT) END AS intent_ok, intent AS detected_intent
  FROM (SELECT *, {INTENT_SQL} AS intent FROM (SELECT *, lower(trim(query)) AS t FROM cases)) LEFT JOIN ga ON qid = item_id)"""
O["golden_retrieval"] = f"WITH {INDEX_SQL}, {GOLDEN_SQL} SELECT * EXCLUDE (missing, rr, term_coverage), array_to_string(missing, ',') AS missing_terms, round(rr, 4) AS rr, round(term_coverage, 4) AS term_coverage FROM gg"
_mean = lambda c, n: f"round(avg(CAST({c} AS DOUBLE)), 3) AS {n}"
O["golden_summary"] = f"WITH {INDEX_SQL}, {GOLDEN_SQL} SELECT category, count(*) AS cases, {_mean('hit', 'hit_rate')}, {_mean('rr', 'mrr')}, " + ", ".join(_mean(m, m) for m in ("recall_at_1", "recall_at_5", "precision_at_k", "ndcg", "term_coverage")) + f", {_mean('intent_ok', 'intent_accuracy')}, CAST(6 AS BIGINT) AS k, false AS reranker FROM gg GROUP BY category"
