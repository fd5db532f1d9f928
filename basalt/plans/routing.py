"""Queries from questions to graph nodes and documents; benchmark passages stand for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import index as I
from basalt.operators import query as G
from basalt.operators import routing as W
from basalt.plans.common import INDEX_SQL, RANK_SQL, table, words_sql
from basalt.plans.text import O as TEXT_SQL
from basalt.plans.text import _edges, chunk_rows, concepts
from basalt.runtime import written

Q, O = {}, {}
CONCEPTS_SQL = TEXT_SQL["concept_df"]


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def nodes(spark, d):
    """Graph nodes: concepts, and parts by their tag."""
    named = concepts(spark, d).select(F.col("concept").alias("id"), F.lit("Concept").alias("type"))
    parts = table(spark, d, "part").select(F.concat(F.lit("P-"), "p_partkey").alias("id"), F.lit("Part").alias("type"))
    return written(named.unionByName(parts).distinct(), "nodes")


def entities(spark, d):
    """Tags of the questions; each question also asks for the part of its number."""
    tags = F.array_union(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(G.ENTITY_TAG), F.lit(0)), F.array(F.concat(F.lit("P-"), "qid")))
    return asked(spark, d).select("qid", F.explode(tags).alias("entity"))


Q["graph_seeds"] = lambda spark, d: W.graph_seeds(asked(spark, d), entities(spark, d), nodes(spark, d))
_sq = lambda x: f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"
_ws = lambda x, p: f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '{p}'))"
_keys = lambda x: f"list_distinct(flatten(list_transform({_ws(x, '[a-z0-9]{3,}')}, lambda w: [w, w || 's'])))"
HITS_SQL = f"""cn AS (SELECT DISTINCT concept AS name FROM ({CONCEPTS_SQL}) WHERE length(concept) >= 4), qs AS (SELECT item_id AS qid, coalesce(text, '') AS text FROM benchmark),
qk AS (SELECT qid, unnest({_keys('text')}) AS k FROM qs), nk AS (SELECT name, unnest({_keys('name')}) AS k FROM cn),
hits AS (SELECT qid, name, 'phrase' AS rule FROM qs JOIN cn ON contains(lower(text), lower(name)) WHERE regexp_matches(lower(text), {_edges('name')})
  UNION SELECT qid, name, 'squeezed' FROM qs JOIN cn ON length({_sq('name')}) >= 5 AND contains({_sq('text')}, {_sq('name')})
  UNION SELECT qid, name, 'word' FROM qk JOIN nk USING (k))"""
ENTITY_SQL = f"en AS (SELECT DISTINCT qid, unnest(list_append(regexp_extract_all(text, '{G.ENTITY_TAG}'), 'P-' || qid)) AS entity FROM qs)"
O["graph_seeds"] = f"""WITH {HITS_SQL}, {ENTITY_SQL}, nd AS (SELECT name AS id FROM cn UNION SELECT DISTINCT concept FROM ({CONCEPTS_SQL}) UNION SELECT 'P-' || p_partkey FROM part), qw AS (SELECT qid, unnest({_ws('text', '[a-z][a-z0-9]{4,}')}) AS w FROM qs),
s AS (SELECT qid, name AS seed, rule FROM hits UNION SELECT qid, name, 'inside' FROM qw JOIN cn ON contains(lower(name), w) UNION SELECT qid, entity, 'entity' FROM en WHERE entity IN (SELECT id FROM nd))
SELECT qid, seed, string_agg(rule, '+' ORDER BY rule) AS rules FROM s GROUP BY qid, seed"""


def routed(spark, d):
    """Documents of the questions: titles are the documents' first lines, cut to 60 characters."""
    docs = table(spark, d, "documents")
    titled = docs.select(F.col("doc_id").alias("doc"), F.concat(F.lit("doc-"), "doc_id").alias("name"), T.title_from(F.element_at(F.concat(T.lines(F.col("text")), F.array(F.lit(""))), 1)).alias("title"))
    tags = chunk_rows(spark, d).select("doc", F.explode(T.tags(F.col("text"))).alias("entity")).distinct()
    questions = asked(spark, d)
    index = I.build(docs)
    lexical = written(I.ranked(I.bm25(index, questions, id_col="qid", depth=W.VETO_HITS), W.VETO_HITS), "lexical")
    known = written(concepts(spark, d).select("concept", F.col("doc_id").alias("doc")), "concept-docs")
    return W.route(questions, entities(spark, d), tags, titled, known, lexical)


Q["document_routing"] = routed
_title = "CASE WHEN t0 = '' THEN 'New conversation' ELSE upper(left(t0, 1)) || substr(t0, 2) END"
TITLE_SQL = f"""t1 AS (SELECT doc_id AS doc, array_to_string(list_filter(regexp_split_to_array(coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], ''), '[ \\t\\n]+'), lambda w: w <> ''), ' ') AS line FROM documents),
t2 AS (SELECT doc, CASE WHEN trim(regexp_replace(line, '(?i)^(please|hey|hi|hello|can you|could you|tell me) +', '')) = '' THEN line ELSE trim(regexp_replace(line, '(?i)^(please|hey|hi|hello|can you|could you|tell me) +', '')) END AS line FROM t1),
t3 AS (SELECT doc, CASE WHEN length(line) > 60 THEN regexp_replace(left(line, 60), '(.) [^ ]*$', '\\1') || '…' ELSE line END AS t0 FROM t2), ti AS (SELECT doc, 'doc-' || doc AS name, {_title} AS title FROM t3)"""
_tt = lambda x: f"list_filter({_ws(x, '[a-z0-9]{2,}')}, lambda t: t NOT IN ({words_sql(W.TITLE_STOP)}) AND NOT regexp_full_match(t, '[0-9]+'))"
O["document_routing"] = f"""WITH {HITS_SQL}, {ENTITY_SQL}, {TITLE_SQL}, {INDEX_SQL}, bare AS (SELECT doc, name, regexp_replace(lower(title), '\\.pdf', '', 'g') AS title FROM ti),
ce AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(coalesce(text, ''), '{T.TAG}')) AS entity FROM documents),
te AS (SELECT doc, list_distinct(list_concat({_tt('name')}, {_tt('title')})) AS terms FROM bare), tw AS (SELECT qid, {_ws('text', '[a-z0-9]{3,}')} AS ws FROM qs), tm AS (SELECT doc, len(terms) AS n, unnest(terms) AS term FROM te WHERE len(terms) > 0),
tq AS (SELECT qid, unnest(ws) AS term FROM tw), mt AS (SELECT qid, doc, n, count(*) AS met FROM tm JOIN tq USING (term) GROUP BY qid, doc, n),
st_ AS (SELECT qid, doc, 'entity' AS rule, 0 AS o FROM ce JOIN en USING (entity) UNION SELECT qid, doc, 'title', 1 FROM mt WHERE met >= least(2, n)
  UNION SELECT qid, doc, 'identifier', 2 FROM qs JOIN bare ON (length({_sq('name')}) >= 4 AND contains({_sq('text')}, {_sq('name')})) OR (length({_sq('title')}) >= 4 AND contains({_sq('text')}, {_sq('title')}))),
strong AS (SELECT qid, doc, arg_min(rule, o) AS rule FROM st_ GROUP BY qid, doc),
weak AS (SELECT DISTINCT h.qid, k.doc_id AS doc FROM hits h JOIN ({CONCEPTS_SQL}) k ON k.concept = h.name WHERE h.qid NOT IN (SELECT qid FROM strong)),
top AS (SELECT * FROM (SELECT qid, doc, score, {RANK_SQL} AS rank FROM bm25) WHERE rank < 5),
said AS (SELECT qid, max(score) AS best, count(weak.doc) AS inside FROM top LEFT JOIN weak USING (qid, doc) GROUP BY qid)
SELECT qid, doc, rule FROM strong UNION ALL SELECT qid, doc, 'concept' FROM weak WHERE qid NOT IN (SELECT qid FROM said WHERE best >= 4.0 AND inside = 0)"""
