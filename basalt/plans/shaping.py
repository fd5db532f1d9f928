"""Queries over answer shaping and gating."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.operators import answering as W
from basalt.operators import index as I
from basalt.operators import rank as R
from basalt.operators import understand as U
from basalt.operators import verify as V
from basalt.plans.answers import QUESTIONS_SQL, SUPPORT_SQL, questions, supported
from basalt.plans.answers import O as ANSWER_SQL
from basalt.plans.common import INDEX_SQL, RANK_SQL, longs, query_terms_sql, table, tokens_sql, wc_sql
from basalt.plans.retrieval import DENSE_SQL

Q, O = {}, {}
STYLES = ["in bullet points for a beginner", "as a table, brief", "as json for an expert", "walkthrough as an auditor", "page 3 summary", "explain the whole document in detail", "with an example as a teacher", "transformer and rag", "using langchain code", "over time, for managers"]


def styled(spark, d):
    k = (F.pmod("qid", F.lit(len(STYLES))) + 1).cast("int")
    return questions(spark, d).select("qid", F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, STYLES)), k)).alias("text"))


_L = ", ".join(f"'{s}'" for s in STYLES)
STYLED_SQL = f"{QUESTIONS_SQL}, sq AS (SELECT qid, text || ' ' || ([{_L}])[1 + qid % {len(STYLES)}] AS text FROM qs)"
_q = lambda p: p.replace("'", "''")
_first = lambda rules: "CASE " + " ".join(f"WHEN regexp_matches(t, '{_q(p)}') THEN '{n}'" for n, p in rules) + " END"

Q["response_profile"] = lambda spark, d: styled(spark, d).select("qid", W.profile(F.col("text")).alias("p")).select("qid", "p.*")
O["response_profile"] = f"WITH {STYLED_SQL} SELECT qid, CASE WHEN ok THEN concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(t, '{_q(p)}') THEN '{n}' END" for n, p in W.FORMATS) + f") ELSE '' END AS formats, CASE WHEN ok THEN {_first(W.LEVELS)} END AS level, CASE WHEN ok THEN {_first(W.LENGTHS)} END AS length, CASE WHEN ok THEN {_first(W.PERSONAS)} END AS persona FROM (SELECT qid, lower(text) AS t, length(text) BETWEEN 1 AND {W.LONGEST} AS ok FROM sq)"

Q["query_expand"] = lambda spark, d: styled(spark, d).select("qid", W.expand(F.col("text"), U.intent(F.col("text"))).alias("expanded"))
_terms = lambda k: "' " + " ".join(W.DOMAIN_TERMS[k]) + "'"
O["query_expand"] = "WITH " + STYLED_SQL.replace("qs AS", "qs0 AS").replace("FROM qs)", "FROM qs0)") + ", i AS (SELECT qid, intent FROM (" + ANSWER_SQL["intent_detect"].replace(f"WITH {QUESTIONS_SQL} ", "").replace("FROM qs)", "FROM sq)") + ")) SELECT qid, text" + "".join(f" || CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){k}([^a-z0-9]|$)')" + (" AND intent IN ('implementation', 'methodology')" if k in W.GATED else "") + f" THEN {_terms(k)} ELSE '' END" for k in W.DOMAIN_TERMS) + " AS expanded FROM sq JOIN i USING (qid)"

Q["document_request"] = lambda spark, d: styled(spark, d).select("qid", W.document_request(F.col("text")).alias("r")).select("qid", "r.*")
O["document_request"] = f"WITH {STYLED_SQL}, r AS (SELECT qid, lower(text) AS t, CAST(nullif(regexp_extract(lower(text), '\\bpage\\s+([0-9]{{1,4}})\\b', 1), '') AS BIGINT) AS pg FROM sq), m AS (SELECT qid, pg, CASE WHEN regexp_matches(t, '{W.REQUEST_VERB}') AND pg IS NOT NULL THEN 'page' WHEN regexp_matches(t, '{W.REQUEST_VERB}') AND regexp_matches(t, '{W.REQUEST_WHOLE}') THEN 'whole' ELSE 'none' END AS mode FROM r) SELECT qid, mode, CASE WHEN mode = 'page' THEN pg END AS page FROM m"


def refuse(spark, d):
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    index = I.build(docs)
    best = I.ranked(I.dense(index, asked, depth=1), 1).select("qid", F.col("score").alias("relevance"))
    rows = R.grounding(asked, index).join(best, "qid", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    ok = W.grounded(F.lit(False), F.col("relevance") > 0, F.lit(False), F.col("rarest_known"), F.col("coverage"), F.col("relevance"))
    return rows.select("qid", ok.alias("grounded"), "coverage", "relevance")


Q["grounded_or_refuse"] = refuse
O["grounded_or_refuse"] = f"""WITH {INDEX_SQL}, {DENSE_SQL}, t AS (SELECT item_id AS qid, unnest({query_terms_sql('text')}) AS term FROM benchmark), g AS (SELECT qid, term, coalesce(df, 0) AS df FROM t LEFT JOIN terms USING (term)),
c AS (SELECT qid, round(avg(CASE WHEN df > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS coverage, min(df) > 0 AS known FROM g GROUP BY qid), b AS (SELECT qid, max(score) AS relevance FROM dense GROUP BY qid)
SELECT qid, coalesce(relevance, 0.0) > 0 AND ((known AND coverage >= 0.6) OR coalesce(relevance, 0.0) >= 0.2) AS grounded, coverage, coalesce(relevance, 0.0) AS relevance FROM c LEFT JOIN b USING (qid)"""


def critic(spark, d):
    rows = V.rollup(supported(spark, d))
    share = lambda c: F.col(c) / F.col("n")
    score, band = W.confidence(F.col("claim_score"), share("supported"), share("partly"), 1 - share("insufficient"), F.when(F.pmod("aid", F.lit(2)) == 0, share("supported")))
    gone = W.suppressed(F.lit(False), F.col("claim_score"), F.col("n"), F.col("supported"), F.col("insufficient"))
    return rows.select("aid", score.alias("confidence"), band.alias("band"), gone.alias("suppressed"))


Q["critic_confidence"] = critic
O["critic_confidence"] = f"""WITH {SUPPORT_SQL}, r AS (SELECT aid, count(*) AS n, count(*) FILTER (status = 'SUPPORTED') AS s, count(*) FILTER (status = 'PARTIALLY_SUPPORTED') AS p, count(*) FILTER (status = 'INSUFFICIENT') AS i FROM st2 GROUP BY aid),
c AS (SELECT *, round((s + 0.5::DOUBLE * p) / n, 4) AS cs FROM r), f AS (SELECT *, 0.30 * cs + 0.25 * (s / n) + 0.20 * (p / n) + 0.15 * (1 - i / n) AS base FROM c),
g AS (SELECT aid, round(CAST(CASE WHEN aid % 2 <> 0 THEN base / 0.9 ELSE base + 0.10 * (s / n) END AS DOUBLE), 4) AS confidence, (cs < 0.35 AND i > s) OR (n >= 2 AND i / n >= 0.5 AND i >= s) AS suppressed FROM f)
SELECT aid, confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS band, suppressed FROM g"""


def topic(spark, d):
    conv = table(spark, d, "conversations")
    part = lambda pattern, kind: conv.select(F.col("conv_id").alias("conv"), F.explode(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0)), F.lower)).alias("topic"), F.lit(kind).alias("kind"))
    return longs(W.topics(part("[A-Z][a-z]{3,}", "entity").unionByName(part("[A-Za-z]{6,}", "keyword"))))


Q["conversation_topic"] = topic
O["conversation_topic"] = "WITH e AS (SELECT conv_id AS conv, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{3,}'))) AS topic, 3 AS w FROM conversations UNION ALL SELECT conv_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{6,}'))), 1 FROM conversations), s AS (SELECT conv, topic, CAST(sum(w) AS BIGINT) AS score FROM e GROUP BY conv, topic) SELECT conv, topic, score FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY score DESC, length(topic) DESC, topic) AS i FROM s) WHERE i = 1"


def panel(spark, d):
    ranked = I.ranked(I.bm25(I.build(table(spark, d, "documents")), table(spark, d, "benchmark"), depth=12), 12)
    return W.diagnostics(ranked.select("qid", "doc", "score"), ranked.where("rank < 6"))


Q["diagnostics_panel"] = panel
O["diagnostics_panel"] = f"WITH {INDEX_SQL}, r AS (SELECT * FROM (SELECT qid, doc, score, {RANK_SQL} AS rank FROM bm25) WHERE rank < 12) SELECT qid, doc, round(CAST(CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE 0.0 END AS DOUBLE), 4) AS relevance, rank < 6 AS used FROM r"


def extracted(spark, d):
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    top = I.ranked(I.bm25(I.build(docs), asked, depth=3), 3).join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")
    out = W.extract(top.select("qid", F.col("rank").alias("place"), "text"), asked.select(F.col("item_id").alias("qid"), "text"))
    return longs(out.select("qid", F.md5("sentence").alias("sentence_md5"), "score", "place"))


Q["extractive_answer"] = extracted
O["extractive_answer"] = f"""WITH {INDEX_SQL}, r AS (SELECT qid, rank, text FROM (SELECT qid, doc, {RANK_SQL} AS rank FROM bm25) JOIN documents ON doc_id = doc WHERE rank < 3),
l AS (SELECT qid, rank, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t]+|\\n+', '\\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM r),
s AS (SELECT qid, rank, i AS pos, ss[i] AS sentence FROM (SELECT qid, rank, ss, unnest(range(1, len(ss) + 1)) AS i FROM l)), f AS (SELECT * FROM s WHERE {wc_sql('sentence')} BETWEEN 6 AND 45 AND length(sentence) <= 320),
q2 AS (SELECT item_id AS qid, {query_terms_sql('text')} AS qt FROM benchmark), c AS (SELECT f.*, len(list_intersect(list_distinct({tokens_sql('sentence')}), qt)) AS score FROM f JOIN q2 USING (qid)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, left(sentence, 50) ORDER BY score DESC, rank, pos) AS i FROM c WHERE score > 0) WHERE i = 1)
SELECT qid, md5(sentence) AS sentence_md5, score, place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, pos) AS place FROM u) WHERE place <= 6"""
