"""Queries over understanding, checking, evaluation and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import evaluate as E
from basalt.operators import index as I
from basalt.operators import memory as C
from basalt.operators import query as G
from basalt.operators import understand as U
from basalt.operators import verify as V
from basalt.plans.common import INDEX_SQL, RANK_SQL, longs, query_terms_sql, table, wc_sql, words_sql
from basalt.plans.text import O as TEXT_SQL
from basalt.plans.text import concepts

Q, O = {}, {}
CONCEPTS_SQL = TEXT_SQL["concept_df"]

#: Questions: whole turns in templates, so that each rule meets some of them.
TEMPLATES = ["What is {}?", "Compare {} and memory", "Why is {} needed because of load", "How do I fix the error in {}?", "Steps to change {} and then test", "Summarize {} in short", "Who proposed {}?", "difference between {} and vectors?", "calculate {} for the table", "{} vs graphs", "how is {} different from batch?", "explain it in simple words: {}"]


def questions(spark, d):
    """(qid, text): every whole turn as a question; white space runs are one space."""
    turn = G.spaced(F.col("text"))
    k = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(TEMPLATES)))
    text = F.replace(F.element_at(F.array(*map(F.lit, TEMPLATES)), (k + 1).cast("int")), F.lit("{}"), F.when(turn == "", "transformer").otherwise(turn))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), text.alias("text"))


_T = ", ".join("'" + t.replace("'", "''") + "'" for t in TEMPLATES)
SPACED_SQL = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
QUESTIONS_SQL = f"qs AS (SELECT conv_id * 1000 + turn AS qid, replace(([{_T}])[1 + (conv_id + turn) % {len(TEMPLATES)}], '{{}}', coalesce(nullif({SPACED_SQL}, ''), 'transformer')) AS text FROM conversations)"

Q["intent_detect"] = lambda spark, d: questions(spark, d).select("qid", U.intent(F.col("text")).alias("intent"))
_has = lambda words: " OR ".join("contains(t, '" + w.replace("'", "''") + "')" for w in words)
O["intent_detect"] = f"WITH {QUESTIONS_SQL} SELECT qid, CASE WHEN {_has(U.COMPARISON_PHRASES)} THEN 'comparison' " + " ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in [*U.INTENT_GROUPS, *U.INTENT_RULES]) + " ELSE 'general' END AS intent FROM (SELECT qid, lower(trim(text)) AS t FROM qs)"


def classified(spark, d):
    label, conf = U.classify(F.col("text"))
    rows = questions(spark, d).select("qid", label.alias("label"), conf.alias("confidence")).withColumn("plan", U.plan(F.col("label")))
    return longs(rows.select("qid", "label", "confidence", "plan.*"))


_rx = lambda p: "regexp_matches(t, '" + p.replace("'", "''") + "')"
_n = {name: " + ".join(f"CAST({_rx(p)} AS INT)" for p in ps) for name, ps in U.CLASS_RULES}
CLASS_SQL = "cl AS (SELECT qid, CASE " + " ".join(f"WHEN ({e}) > 0 THEN '{n}'" for n, e in _n.items()) + f" ELSE '{U.DEFAULT_CLASS}' END AS label, round(CAST(CASE " + " ".join(f"WHEN ({e}) > 0 THEN least(0.95, 0.75 + 0.1 * (({e}) - 1))" for e in _n.values()) + " ELSE 0.4 END AS DOUBLE), 2) AS confidence FROM (SELECT qid, lower(text) AS t FROM qs))"
_p = {**U.PLANS}
_pick = lambda i: "CASE label " + " ".join(f"WHEN '{n}' THEN {repr(p[i]) if isinstance(p[i], str) else p[i]}" for n, p in _p.items()) + f" ELSE {repr(U.DEFAULT_PLAN[i]) if isinstance(U.DEFAULT_PLAN[i], str) else U.DEFAULT_PLAN[i]} END"
Q["classify_plan"] = classified
O["classify_plan"] = f"WITH {QUESTIONS_SQL}, {CLASS_SQL} SELECT qid, label, confidence, {_pick(0)} AS legs, CAST({_pick(1)} AS BIGINT) AS k, {_pick(2)} AS decompose, {_pick(3)} AS strategy FROM cl"

Q["comparison_aspects"] = lambda spark, d: questions(spark, d).select("qid", F.array_join(U.aspects(F.col("text")), "|").alias("aspects"))
_bare = lambda p, g: f"trim(regexp_replace(trim(regexp_extract(trim(text), '(?i){p}', {g})), '(?i)^(the|a|an)\\s+', ''))"
ASPECTS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(trim(text), '(?i){p}') THEN [{_bare(p, 1)}, {_bare(p, 2)}]" for p in U.ASPECTS) + " ELSE [] END"
INTENT_SQL = f"CASE WHEN {_has(U.COMPARISON_PHRASES)} THEN 'comparison' " + " ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in [*U.INTENT_GROUPS, *U.INTENT_RULES]) + " ELSE 'general' END"
O["comparison_aspects"] = f"WITH {QUESTIONS_SQL} SELECT qid, array_to_string({ASPECTS_SQL}, '|') AS aspects FROM qs"

Q["decompose"] = lambda spark, d: longs(questions(spark, d).select("qid", F.posexplode(U.decompose(F.col("text"))).alias("pos", "part")).groupBy("qid").agg(F.count("*").alias("parts"), F.max("part").alias("last_part")))
_long = lambda e: f"list_filter(list_transform({e}, lambda x: trim(x)), lambda x: length(x) > 4)"
_more = ", ".join("replace(replace('" + t + "', '{A}', sides[1]), '{B}', sides[2])" for t in U.ASPECT_QUERIES)
O["decompose"] = f"""WITH {QUESTIONS_SQL}, a AS (SELECT qid, text, lower(text) AS low, {INTENT_SQL} AS intent, {ASPECTS_SQL} AS sides FROM (SELECT *, lower(trim(text)) AS t FROM qs)),
f AS (SELECT qid, sides, list_distinct(list_concat([text], CASE WHEN intent = 'comparison' THEN {_long("string_split(regexp_replace(low, '\\b(compare|vs|versus|and)\\b', chr(31) || '\\1' || chr(31), 'g'), chr(31))")} ELSE [] END,
  CASE WHEN contains(low, ' and ') THEN {_long("string_split(low, ' and ')")} ELSE [] END, CASE WHEN contains(low, ' because ') THEN {_long("string_split(low, ' because ')")} ELSE [] END)) AS first FROM a),
p AS (SELECT qid, unnest(list_concat(first, CASE WHEN len(sides) = 2 THEN list_filter(list_distinct([{_more}]), lambda x: NOT list_contains(list_transform(first, lambda y: lower(y)), lower(x))) ELSE [] END)) AS part FROM f)
SELECT qid, count(*) AS parts, max(part) AS last_part FROM p GROUP BY qid"""

Q["confidence_policy"] = lambda spark, d: table(spark, d, "events").select("event_id", U.policy(F.pmod("event_id", F.lit(100)) / 100, F.pmod("event_id", F.lit(4))).alias("action"))
O["confidence_policy"] = "SELECT event_id, CASE WHEN (event_id % 100) / 100 > 0.9 THEN 'ANSWER' WHEN (event_id % 100) / 100 >= 0.7 THEN 'NOTE' WHEN event_id % 4 < 2 THEN 'RETRY' ELSE 'INSUFFICIENT' END AS action FROM events"


def facet_rows(spark, d):
    """Facets of each question, its first two names bound, against the turn itself."""
    label, _ = U.classify(F.col("text"))
    names = G.entities(F.col("text"))
    asked = questions(spark, d).select("qid", label.alias("label"), F.try_element_at(names, F.lit(1)).alias("a"), F.try_element_at(names, F.lit(2)).alias("b"))
    return U.facets(asked, table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text"))


def entities_sql(x):
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9_.+-]+'), lambda t: regexp_replace(t, '^[.,]+|[.,]+$', '', 'g')), lambda t: length(t) >= 3 AND lower(t) NOT IN ({words_sql(G.STOP)})))"


# list_distinct keeps no order: the first two names are found by their places.
FIRST_TWO_SQL = f"nm AS (SELECT qid, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.+-]+'), lambda t: regexp_replace(t, '^[.,]+|[.,]+$', '', 'g')), lambda t: length(t) >= 3 AND lower(t) NOT IN ({words_sql(G.STOP)})) AS ns FROM qs), ab AS (SELECT qid, coalesce(ns[1], '') AS a, coalesce(list_filter(ns, lambda t: t <> ns[1])[1], '') AS b FROM nm)"
_F = ", ".join(f"('{label}', '{name}', [{', '.join(chr(39) + t + chr(39) for t in terms)}]::VARCHAR[])" for label, items in U.FACETS.items() for name, terms in items)
_tokens = f"list_filter(regexp_extract_all(lower(facet), '[a-z0-9][a-z0-9\\-]+'), lambda t: t NOT IN ({words_sql(G.PLAN_STOP)}))"
_bind = lambda x: f"CASE WHEN {x} <> '' AND contains(lower(facet), lower({x})) THEN [{x}] ELSE []::VARCHAR[] END"
FACETS_SQL = f"""{FIRST_TWO_SQL}, f(lab, name, terms) AS (VALUES {_F}),
fa AS (SELECT qid, a, b, replace(replace(name, '{{A}}', a), '{{B}}', b) AS facet, terms FROM cl JOIN ab USING (qid) JOIN f ON lab = CASE WHEN label IN ({words_sql(list(U.FACETS))}) THEN label ELSE 'default' END WHERE NOT (contains(name, '{{A}}') AND a = '') AND NOT (contains(name, '{{B}}') AND b = '')),
ft AS (SELECT qid, facet, list_concat(terms, {_bind('a')}, {_bind('b')}) AS terms FROM fa),
fc AS (SELECT ft.qid, facet, bool_or(len(list_filter(CASE WHEN len(terms) > 0 THEN terms ELSE {_tokens} END, lambda w: regexp_matches(lower(coalesce(c.text, '')), '(^|[^a-z0-9])' || regexp_escape(lower(w)) || '([^a-z0-9]|$)'))) > 0) AS covered FROM ft JOIN conversations c ON c.conv_id * 1000 + c.turn = ft.qid GROUP BY ft.qid, facet)"""
Q["evidence_facets"] = facet_rows
O["evidence_facets"] = f"WITH {QUESTIONS_SQL}, {CLASS_SQL}, {FACETS_SQL} SELECT qid, facet, covered FROM fc"
Q["facet_ratio"] = lambda spark, d: U.facet_ratio(facet_rows(spark, d))
O["facet_ratio"] = f"WITH {QUESTIONS_SQL}, {CLASS_SQL}, {FACETS_SQL} SELECT qid, count(*) AS facets, round(avg(CAST(covered AS DOUBLE)), 3) AS ratio FROM fc GROUP BY qid"


def ambiguity(spark, d):
    names = concepts(spark, d).select("concept").distinct()
    words = names.select(F.explode(F.split(F.lower("concept"), " ")).alias("text")).distinct()
    return U.ambiguous(words.select(F.col("text").alias("qid"), "text"), names)


Q["ambiguity"] = ambiguity

O["ambiguity"] = f"""WITH names AS (SELECT DISTINCT concept FROM ({CONCEPTS_SQL})), w AS (SELECT concept, unnest(list_distinct(string_split(lower(concept), ' '))) AS token FROM names WHERE contains(concept, ' ')),
asked AS (SELECT DISTINCT unnest(string_split(lower(concept), ' ')) AS qid FROM names), t AS (SELECT qid, unnest({query_terms_sql('qid')}) AS token FROM asked WHERE len({query_terms_sql('qid')}) <= 3),
r AS (SELECT qid, token, concept, row_number() OVER (PARTITION BY qid, token ORDER BY concept) AS i FROM t JOIN w USING (token) WHERE NOT contains(lower(qid), lower(concept)))
SELECT qid, token, string_agg(concept, '|' ORDER BY concept) FILTER (i <= 6) AS options FROM r GROUP BY qid, token HAVING count(*) >= 3"""

def spell_tables(spark, d):
    """Misspelled words (of each vocabulary word the last two letters swapped, and of long ones the third and fifth gone) and a vocabulary with frequencies."""
    vocab = table(spark, d, "conversations").select(F.explode(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower)).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    n, t = F.length("term"), F.col("term")
    swapped = F.concat(F.substring(t, F.lit(1), n - 2), F.substring(t, n, F.lit(1)), F.substring(t, n - 1, F.lit(1)))
    gone = F.concat(F.substring(t, 1, 2), F.substring(t, 4, 1), F.substring(t, F.lit(6), n))
    return vocab.select(swapped.alias("word")).unionByName(vocab.where(n >= 8).select(gone.alias("word"))), vocab


_less = lambda w: f"list_transform(range(1, length({w}) + 1), lambda i: left({w}, CAST(i - 1 AS BIGINT)) || substr({w}, CAST(i + 1 AS BIGINT)))"
_less2 = lambda w: f"flatten(list_transform({_less(w)}, lambda x: list_transform(range(1, length(x) + 1), lambda j: left(x, CAST(j - 1 AS BIGINT)) || substr(x, CAST(j + 1 AS BIGINT)))))"
_forms = lambda w: f"unnest(list_distinct(list_concat([{w}], {_less(w)}, CASE WHEN length({w}) >= {U.SPELL['long']} THEN {_less2(w)} ELSE [] END)))"
SPELL_SQL = f"""v AS (SELECT term, count(*) AS freq FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}'))) AS term FROM conversations) GROUP BY term),
w AS (SELECT left(term, length(term) - 2) || right(term, 1) || substr(term, length(term) - 1, 1) AS word FROM v UNION SELECT left(term, 2) || substr(term, 4, 1) || substr(term, 6) FROM v WHERE length(term) >= 8),
a AS (SELECT word, {_forms('word')} AS form FROM w), k AS (SELECT term, freq, {_forms('term')} AS form FROM v), sc AS (SELECT DISTINCT word, term, freq FROM a JOIN k USING (form))"""
O["spell_candidates"] = f"WITH {SPELL_SQL} SELECT word, count(*) AS terms, max(term) AS last_term FROM sc GROUP BY word"
Q["spell_candidates"] = lambda spark, d: U.spell_candidates(*spell_tables(spark, d)).groupBy("word").agg(F.count("*").alias("terms"), F.max("term").alias("last_term"))
Q["spell_correct"] = lambda spark, d: U.corrections(*spell_tables(spark, d))
O["spell_correct"] = f"""WITH {SPELL_SQL}, top AS (SELECT max(freq) AS top FROM v),
c AS (SELECT word, term, freq, damerau_levenshtein(word, term) AS distance FROM sc WHERE word NOT IN (SELECT term FROM v) AND length(word) >= 4 AND levenshtein(word, term) <= CASE WHEN length(word) >= 6 THEN 4 ELSE 2 END),
-- Optimal string alignment: no edit within swapped letters, so a swap parts both words into a head and a tail.
s AS (SELECT * FROM c WHERE distance < 2 OR levenshtein(word, term) <= 2 OR len(list_filter(range(1, length(word)), lambda i: len(list_filter([i - 1, i, i + 1], lambda j: j >= 1 AND substr(word, i, 1) = substr(term, j + 1, 1) AND substr(word, i + 1, 1) = substr(term, j, 1)
  AND damerau_levenshtein(left(word, i - 1), left(term, j - 1)) + 1 + damerau_levenshtein(substr(word, i + 2), substr(term, j + 2)) <= 2)) > 0)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance + CASE WHEN left(word, 1) = left(term, 1) THEN 0.0 ELSE 0.5 END, freq DESC, term) AS i FROM s WHERE distance > 0 AND distance <= CASE WHEN length(word) >= 6 THEN 2 ELSE 1 END)
SELECT word, term, distance, confidence FROM (SELECT word, term, distance, round(0.75 * (1 - distance / length(word)) + 0.25 * ln(1 + freq) / ln(1 + top), 3) AS confidence FROM r, top WHERE i = 1) WHERE confidence >= 0.6"""

Q["meta_query"] = lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", C.is_meta(F.concat(F.expr("CASE WHEN turn % 3 = 0 THEN 'What did I just ask about ' ELSE '' END"), F.coalesce("text", F.lit("")))).alias("meta"))
O["meta_query"] = f"SELECT conv_id, turn, regexp_matches(regexp_replace(lower(CASE WHEN turn % 3 = 0 THEN 'What did I just ask about ' ELSE '' END || coalesce(text, '')), '[ \\t\\n]+', ' ', 'g'), '{'|'.join(C.META)}') AS meta FROM conversations"

# ---- answers: assistant turns; evidence: the earlier turns of the conversation


def answer_rows(spark, d):
    conv = table(spark, d, "conversations")
    ev = conv.where("role = 'user'").select(F.col("conv_id").alias("c"), F.col("turn").alias("eid"), "text")
    ans = conv.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("aid"), "conv_id", "turn", "text")
    evidence = ans.select("aid", "conv_id", "turn").join(ev, (F.col("c") == F.col("conv_id")) & (F.col("eid") < F.col("turn"))).select("aid", "eid", "text")
    return ans, evidence


Q["claim_extract"] = lambda spark, d: longs(V.claims(answer_rows(spark, d)[0], "aid", "text").groupBy("aid").agg(F.count("*").alias("claims"), F.sum(F.char_length("claim").cast("bigint")).alias("n_chars")))
_S = "list_filter(list_transform(string_split(regexp_replace(coalesce({t}, ''), '([.!?])[ \\t]+|\\n+', '\\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '')"
CLAIM_SQL = f"""ans AS (SELECT conv_id * 1000 + turn AS aid, conv_id, turn, text FROM conversations WHERE role = 'assistant'),
cs AS (SELECT aid, unnest(list_distinct(list_transform({_S.format(t='text')}, lambda s: trim(regexp_replace(s, '^([-*+] |[0-9]+[.)] |#+ )', ''))))) AS claim FROM ans),
claims AS (SELECT aid, claim FROM cs WHERE {wc_sql('claim')} >= 5 AND NOT regexp_matches(claim, '\\?$|\\|'))"""
O["claim_extract"] = f"WITH {CLAIM_SQL} SELECT aid, count(*) AS claims, CAST(sum(length(claim)) AS BIGINT) AS n_chars FROM claims GROUP BY aid"


def supported(spark, d):
    ans, evidence = answer_rows(spark, d)
    return V.support(V.claims(ans, "aid", "text"), evidence)


_ct = lambda t: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9][a-z0-9_\\-]*'), lambda w: length(w) > 2 AND w NOT IN ({words_sql(T.KEYWORD_STOP)})))"
SUPPORT_SQL = f"""{CLAIM_SQL}, ev AS (SELECT a.aid, c.turn AS eid, c.text, {_ct('c.text')} AS et FROM ans a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn < a.turn AND c.role = 'user'),
ct AS (SELECT aid, claim, {_ct('claim')} AS ct, list_distinct(regexp_extract_all(claim, '[0-9]+(?:\\.[0-9]+)?')) AS nums FROM claims),
raw AS (SELECT ct.aid, claim, CASE WHEN eid IS NOT NULL THEN least(CASE WHEN len(list_filter(nums, lambda x: NOT contains(coalesce(text, ''), x))) > 0 THEN 0.65 ELSE 1.0 END, len(list_intersect(ct, et)) / greatest(1, len(ct))) END AS s FROM ct LEFT JOIN ev USING (aid)),
sup AS (SELECT aid, claim, round(CAST(max(s) AS DOUBLE), 4) AS score FROM raw GROUP BY aid, claim),
st2 AS (SELECT aid, claim, score, CASE WHEN score IS NULL THEN 'UNVERIFIABLE' WHEN score >= 0.70 THEN 'SUPPORTED' WHEN score >= 0.45 THEN 'PARTIALLY_SUPPORTED' ELSE 'INSUFFICIENT' END AS status FROM sup)"""
Q["claim_support"] = lambda spark, d: supported(spark, d).groupBy("aid", "status").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score"))
O["claim_support"] = f"WITH {SUPPORT_SQL} SELECT aid, status, count(*) AS n, round(sum(score), 4) AS score FROM st2 GROUP BY aid, status"
Q["coverage_rollup"] = lambda spark, d: V.rollup(supported(spark, d)).withColumn("coverage", F.round(V.coverage(F.col("claim_score"), F.lit(0.0), F.col("insufficient")), 4)).withColumn("level", V.grounding_level(F.col("claim_score")))
O["coverage_rollup"] = f"""WITH {SUPPORT_SQL}, r AS (SELECT aid, count(*) AS n, count(*) FILTER (status = 'SUPPORTED') AS supported, count(*) FILTER (status = 'PARTIALLY_SUPPORTED') AS partly, count(*) FILTER (status = 'INSUFFICIENT') AS insufficient FROM st2 GROUP BY aid),
s AS (SELECT *, round((supported + 0.5::DOUBLE * partly) / n, 4) AS claim_score FROM r)
SELECT *, CASE WHEN supported = n THEN 'SUPPORTED' WHEN supported + partly > 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'INSUFFICIENT' END AS verdict, round(CAST(0.65 * claim_score + 0.10 * greatest(0.0, 1 - 0.15 * insufficient) AS DOUBLE), 4) AS coverage,
CASE WHEN claim_score >= 0.8 THEN 'Strong' WHEN claim_score >= 0.6 THEN 'Moderate' WHEN claim_score >= 0.4 THEN 'Weak' ELSE 'Unsupported' END AS level FROM s"""


SECTIONED = "## Direct Answer\n{}\n## Limitations\nNothing is known about it here.\n### More\nand more\n## Summary\nThat is the end of it.\n## Suggested Follow-up Questions\n- Why?\n## Sources\n[1] a"
Q["grounded_text"] = lambda spark, d: conv(spark, d).select("conv_id", "turn", F.md5(V.grounded_text(F.replace(F.lit(SECTIONED), F.lit("{}"), F.coalesce("text", F.lit(""))))).alias("text_md5"))
_tailless = "replace('" + SECTIONED.replace("\n", "' || chr(10) || '") + "', '{}', coalesce(text, ''))"
for _tail in V.TAILS:
    _tailless = f"regexp_replace({_tailless}, '(?is){_tail}.*$', '')"
O["grounded_text"] = f"SELECT conv_id, turn, md5(trim(array_to_string(list_filter(string_split(regexp_replace({_tailless}, '(?m)^(##?\\s+\\S)', chr(31) || '\\1', 'g'), chr(31)), lambda x: NOT regexp_matches(x, '(?i){V.DROPPED_SECTIONS}')), ''))) AS text_md5 FROM conversations"

Q["claim_scores"] = lambda spark, d: longs((lambda ans, ev: V.scored_claims(V.claims(ans, "aid", "text"), ev).groupBy("aid", "mode", "status").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score")))(*answer_rows(spark, d)))
SCORED_SQL = f"""{SUPPORT_SQL}, cx AS (SELECT ct.aid, claim, eid, text, ct, nums, list_intersect(ct, et) AS hit, len(list_intersect(ct, et)) / greatest(1, len(ct)) AS lex FROM ct JOIN ev USING (aid)),
cy AS (SELECT *, round(0.70 * lex + 0.30 * lex, 6) AS s, row_number() OVER o AS i, CASE WHEN lex >= 0.25 THEN 1 ELSE 0 END AS rel, sum(CASE WHEN lex >= 0.25 THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING) AS place FROM cx WINDOW o AS (PARTITION BY aid, claim ORDER BY round(0.70 * lex + 0.30 * lex, 6) DESC, eid)),
cz AS (SELECT aid, claim, any_value(ct) AS ct, any_value(nums) AS nums, max(eid) FILTER (i = 1) AS best, max(s) FILTER (i = 1) AS s, max(lex) FILTER (i = 1) AS lex, max(text) FILTER (i = 1) AS btext, count(*) FILTER (rel = 1 AND place <= 3) AS n, list_distinct(coalesce(flatten(list(hit) FILTER (rel = 1 AND place <= 3)), [])) AS together, coalesce(string_agg(text, chr(10) ORDER BY text) FILTER (rel = 1 AND place <= 3), '') AS blob FROM cy GROUP BY aid, claim),
cw AS (SELECT *, n > 1 AND round(len(together) / greatest(1, len(ct)), 6) > round(lex + 0.10, 6) AS multi, len(together) / greatest(1, len(ct)) AS both_ FROM cz),
sc AS (SELECT aid, claim, best, CASE WHEN multi THEN 'MULTI_EVIDENCE_SYNTHESIS' ELSE 'SINGLE_EVIDENCE' END AS mode, round(CAST(least(CASE WHEN multi THEN greatest(s, 0.70 * lex + 0.30 * both_) ELSE s END, CASE WHEN len(list_filter(nums, lambda x: NOT contains(CASE WHEN n > 0 THEN blob ELSE coalesce(btext, '') END, x))) > 0 THEN 0.65 ELSE 1.0 END) AS DOUBLE), 4) AS score FROM cw)"""
O["claim_scores"] = f"WITH {SCORED_SQL} SELECT aid, mode, CASE WHEN score >= 0.70 THEN 'SUPPORTED' WHEN score >= 0.45 THEN 'PARTIALLY_SUPPORTED' ELSE 'INSUFFICIENT' END AS status, count(*) AS n, round(sum(score), 4) AS score FROM sc GROUP BY ALL"


def checked(spark, d):
    """Claims, scores and alignments of all answers; each claim cites the turn before its answer, or every third none."""
    ans, ev = answer_rows(spark, d)
    claims = V.claims(ans, "aid", "text")
    cited = claims.where("pos % 3 <> 2").join(ans.select("aid", F.col("turn")), "aid").select("aid", "pos", (F.col("turn") - 1).alias("eid")).join(ev.select("aid", "eid"), ["aid", "eid"], "left_semi").select("aid", "pos", "eid")
    return claims, V.scored_claims(claims, ev), V.aligned(claims, cited, ev)


def validated(spark, d):
    """Coverage of each answer from its claims, its citations and its form; valid or not; and whether a rewrite that adds the missing citations would count."""
    claims, scores, al = checked(spark, d)
    rows = V.rollup(scores).join(V.alignment_rollup(al), "aid").withColumn("coverage", F.round(V.coverage(F.col("claim_score"), F.col("citation_score"), F.col("mismatched")), 4))
    fixed = rows.select("aid", F.round(V.coverage(F.col("claim_score"), F.lit(1.0), F.lit(0)), 4).alias("coverage"))
    return rows.select("aid", "claim_score", "citation_score", "coverage", V.valid(F.col("coverage"), F.lit(0), F.col("mismatched")).alias("valid")).join(V.better(rows, fixed), "aid")


Q["answer_validation"] = validated
Q["citation_repair"] = lambda spark, d: (lambda claims, scores, al: V.repaired(claims, scores, al).groupBy("aid").agg(F.count("*").alias("claims"), F.count_if(F.col("claim").rlike(r"\[[0-9]+\][.!?]*$")).alias("cited")))(*checked(spark, d))
# Claims at their places; each cites the turn before its answer, or every third none, and is scored against what it cites alone.
CHECKED_SQL = f"""{SCORED_SQL}, cp AS (SELECT aid, claim, row_number() OVER (PARTITION BY aid ORDER BY i) - 1 AS pos FROM (SELECT aid, ss[i] AS claim, min(i) AS i FROM (SELECT aid, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT aid, list_transform({_S.format(t='text')}, lambda s: trim(regexp_replace(s, '^([-*+] |[0-9]+[.)] |#+ )', ''))) AS ss FROM ans)) GROUP BY aid, ss[i])),
cl_ AS (SELECT cp.aid, claim, pos FROM cp JOIN claims USING (aid, claim)),
ci AS (SELECT c.aid, c.claim, e.text, len(list_intersect(ct, et)) / greatest(1, len(ct)) AS lex, nums FROM cl_ c JOIN ans ON ans.aid = c.aid JOIN ev e ON e.aid = c.aid AND e.eid = ans.turn - 1 JOIN ct ON ct.aid = c.aid AND ct.claim = c.claim WHERE pos % 3 <> 2),
cn AS (SELECT aid, claim, round(CAST(least(round(0.70 * lex + 0.30 * lex, 6), CASE WHEN len(list_filter(nums, lambda x: NOT contains(coalesce(text, ''), x))) > 0 THEN 0.65 ELSE 1.0 END) AS DOUBLE), 4) AS score FROM ci),
al AS (SELECT cl_.aid, cl_.claim, CASE WHEN cn.score IS NULL THEN 'UNCITED' WHEN cn.score >= 0.70 THEN 'ALIGNED' WHEN cn.score >= 0.45 THEN 'WEAKLY_ALIGNED' ELSE 'MISMATCHED' END AS alignment FROM cl_ LEFT JOIN cn USING (aid, claim))"""
O["citation_repair"] = f"""WITH {CHECKED_SQL} SELECT aid, count(*) AS claims, count(*) FILTER ((coalesce(sc.score, 0.0) >= {V.REPAIR_LEAST} AND alignment IN ('UNCITED', 'MISMATCHED')) OR regexp_matches(claim, '\\[[0-9]+\\][.!?]*$')) AS cited FROM al LEFT JOIN sc USING (aid, claim) GROUP BY aid"""
_cover = lambda claim, cite, bad: f"round(CAST(0.65 * {claim} + 0.25 * {cite} + 0.10 * greatest(0.0, 1 - 0.15 * {bad}) AS DOUBLE), 4)"
O["answer_validation"] = f"""WITH {CHECKED_SQL}, ro AS (SELECT aid, round((count(*) FILTER (score >= 0.70) + 0.5::DOUBLE * count(*) FILTER (score >= 0.45 AND score < 0.70)) / count(*), 4) AS claim_score FROM sc GROUP BY aid),
ar AS (SELECT aid, count(*) FILTER (alignment = 'ALIGNED') AS a, count(*) FILTER (alignment = 'WEAKLY_ALIGNED') AS w, count(*) FILTER (alignment = 'MISMATCHED') AS m FROM al GROUP BY aid),
cs_ AS (SELECT aid, m, round(CASE WHEN a + w + m > 0 THEN (a + 0.5::DOUBLE * w) / (a + w + m) ELSE 0.0 END, 4) AS citation_score FROM ar),
co AS (SELECT aid, claim_score, citation_score, m, {_cover('claim_score', 'citation_score', 'm')} AS coverage, {_cover('claim_score', '1.0', '0')} AS fixed FROM ro JOIN cs_ USING (aid))
SELECT aid, claim_score, citation_score, coverage, coverage >= {V.VALID} AND m = 0 AS valid, fixed > coverage AS accepted FROM co"""
Q["dangling_citations"] = lambda spark, d: V.dangling(V.citations(answer_rows(spark, d)[0].select("aid", F.concat(F.lit("see ["), F.col("turn") - 1, F.lit("] and ["), F.col("turn") + 5, F.lit("]")).alias("text")), "aid", "text"), answer_rows(spark, d)[1])
O["dangling_citations"] = f"WITH {SUPPORT_SQL}, c AS (SELECT aid, turn - 1 AS eid FROM ans UNION SELECT aid, turn + 5 FROM ans) SELECT aid, eid FROM c WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.aid = c.aid AND ev.eid = c.eid)"

Q["aspect_strength"] = lambda spark, d: longs(V.aspect_strength(answer_rows(spark, d)[0].select("aid", F.explode(F.array(F.lit("th"), F.lit("tion"))).alias("aspect")), answer_rows(spark, d)[1]))
O["aspect_strength"] = f"""WITH {SUPPORT_SQL}, a AS (SELECT aid, unnest(['th', 'tion']) AS aspect FROM ans), s AS (SELECT aid, eid, unnest({_S.format(t='text')}) AS s FROM ev),
g AS (SELECT a.aid, aspect, count(DISTINCT eid) FILTER (contains(lower(s), aspect)) AS mentions, count(DISTINCT eid) FILTER (contains(lower(s), aspect) AND {wc_sql('s')} >= 8) AS substantive FROM a LEFT JOIN s USING (aid) GROUP BY a.aid, aspect)
SELECT *, CASE WHEN substantive >= 2 THEN 'STRONG' WHEN substantive = 1 THEN 'PARTIAL' WHEN mentions > 0 THEN 'MENTION_ONLY' ELSE 'MISSING' END AS strength FROM g"""


def relevant(spark, d):
    """A document is relevant to a benchmark passage if it holds the whole passage.

    Both meet by the longest word inside the passage (its neighbours are in the passage too, so it is a whole word of the
    document); then the texts are compared.  Passages are a query set; texts stay where they are as long as the pairs that meet are few."""
    words = lambda c: F.split(c, r"[ \t\n]+")
    inner = F.slice(words(F.col("needle")), F.lit(2), F.greatest(F.lit(0), F.size(words(F.col("needle"))) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("needle")).withColumn("word", longest).where("word is not null")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    met = docs.select("doc", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(I.held(b.select("qid", "needle", "word")), "word").select("doc", "qid", "needle")
    return docs.join(I.held(met), "doc").where(F.contains(F.col("text"), F.col("needle"))).select("qid", "doc")


def metrics(spark, d, k=6):
    index = I.build(table(spark, d, "documents"))
    return E.retrieval_metrics(I.ranked(I.bm25(index, table(spark, d, "benchmark"), depth=k), k), relevant(spark, d), k)


METRIC_SQL = f"""{INDEX_SQL}, rel AS (SELECT DISTINCT item_id AS qid, doc_id AS doc FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
rk AS (SELECT * FROM (SELECT qid, doc, {RANK_SQL} AS rank FROM bm25) WHERE rank < 6), j AS (SELECT rk.*, CASE WHEN rel.doc IS NULL THEN 0 ELSE 1 END AS rel FROM rk LEFT JOIN rel USING (qid, doc)),
i AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) - 1 AS ideal FROM j), nr AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
g AS (SELECT qid, sum(rel) AS found, min(rank) FILTER (rel = 1) AS first, max(rel) FILTER (rank = 0) AS top, sum(rel / log2(rank + 2)) AS dcg, sum(rel / log2(ideal + 2)) AS idcg FROM i GROUP BY qid),
met AS (SELECT qid, CAST(coalesce(found, 0) = n AS BIGINT) AS hit, round(coalesce(1.0::DOUBLE / (first + 1), 0.0), 4) AS rr, round(coalesce(top / n, 0.0), 4) AS recall_1, round(coalesce(found / n, 0.0), 4) AS recall_k, round(coalesce(found / 6, 0.0), 4) AS precision_k, round(coalesce(CASE WHEN idcg > 0 THEN dcg / idcg END, 0.0), 4) AS ndcg FROM nr LEFT JOIN g USING (qid))"""
Q["retrieval_metrics"] = lambda spark, d: longs(metrics(spark, d))
O["retrieval_metrics"] = f"WITH {METRIC_SQL} SELECT * FROM met"
Q["metric_by_category"] = lambda spark, d: E.by_category(metrics(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("c"), F.pmod("item_id", F.lit(3))).alias("category")))
O["metric_by_category"] = f"WITH {METRIC_SQL} SELECT 'c' || (qid % 3) AS category, count(*) AS n, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in E.METRICS) + " FROM met GROUP BY 1"


def gate(spark, d):
    mean = lambda df: df.agg(*(F.round(F.avg(m), 4).alias(m) for m in E.METRICS))
    rows = metrics(spark, d)
    return E.regression_gate(mean(rows.where("qid % 2 = 0")), mean(rows.where("qid % 2 = 1")))


Q["regression_gate"] = gate
O["regression_gate"] = f"WITH {METRIC_SQL}, rg AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}) FILTER (qid % 2 = 0), 4) AS before, round(avg({m}) FILTER (qid % 2 = 1), 4) AS after FROM met" for m in E.METRICS) + ") SELECT *, before - after > 0.05 AS fails FROM rg"

# ---- conversations


def conv(spark, d):
    return table(spark, d, "conversations")


Q["conv_list"] = lambda spark, d: longs(C.listing(conv(spark, d)).select("conv_id", "preview", "messages"))
O["conv_list"] = "SELECT conv_id, left(coalesce(arg_max(text, turn) FILTER (role = 'user'), ''), 120) AS preview, count(*) AS messages FROM conversations GROUP BY conv_id"
_BACK = "b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)"
_MT = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_.-]{{1,}}'), lambda w: w NOT IN ({words_sql(C.STOP)})))"
Q["relevant_turns"] = lambda spark, d: longs(C.relevant_turns(conv(spark, d), 2, 2, 2))
O["relevant_turns"] = f"WITH {_BACK}, t AS (SELECT conv_id, turn, role, back, {_MT} AS ts FROM b), q AS (SELECT conv_id, arg_max(ts, turn) AS q FROM t WHERE role = 'user' GROUP BY conv_id), o AS (SELECT conv_id, turn, len(list_intersect(ts, q)) AS overlap FROM t JOIN q USING (conv_id) WHERE back > 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn) AS place FROM o WHERE overlap >= 2) WHERE place <= 2"
Q["older_summary"] = lambda spark, d: C.older_summary(conv(spark, d), 2)
_LINE = "array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''), ' ')"
_topic = lambda n: f"left({_LINE}, {n}) || CASE WHEN length({_LINE}) > {n} THEN '…' ELSE '' END"
_numbered = lambda src, n: f"SELECT conv_id, count(*) AS n, string_agg(k || '. ' || t, chr(10) ORDER BY k) AS ls FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {_topic(n)} AS t FROM {src} WHERE role = 'user' AND trim(coalesce(text, '')) <> '') GROUP BY conv_id"
OLDER_SQL = f"{_BACK}, ob AS (SELECT * FROM b WHERE back > 2), os AS ({_numbered('ob', 110)})"
O["older_summary"] = f"WITH {OLDER_SQL} SELECT conv_id, '{C.SUMMARY_HEAD}' || chr(10) || ls AS summary FROM os"
Q["transcript"] = lambda spark, d: C.transcript(conv(spark, d), 4, 100)
O["transcript"] = f"WITH {_BACK} SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || left({_LINE}, 100), chr(10) || chr(10) ORDER BY turn) AS transcript FROM b WHERE back <= 4 AND trim(coalesce(text, '')) <> '' GROUP BY conv_id"
Q["curate"] = lambda spark, d: longs(C.curate(conv(spark, d), 2, 4).select("conv_id", "place", "role", F.md5("text").alias("text_md5")))
_turns = O["relevant_turns"].removeprefix("WITH ").replace(" SELECT * FROM (SELECT *, row_number()", ", rt AS (SELECT * FROM (SELECT *, row_number()", 1)
_said = f"left({_LINE}, 500) || CASE WHEN length({_LINE}) > 500 THEN '…' ELSE '' END"
O["curate"] = f"""WITH {_turns}), {OLDER_SQL.removeprefix(_BACK + ', ')},
cu AS (SELECT conv_id, 2 AS kind, turn AS pl, role, text FROM b WHERE back <= 2 UNION ALL SELECT conv_id, 0, 0, 'assistant', '{C.SUMMARY_HEAD}' || chr(10) || ls FROM os
  UNION ALL SELECT conv_id, 1, rt.place, 'assistant', '[Recalled from earlier in this conversation — ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ' said] ' || {_said} FROM rt JOIN conversations USING (conv_id, turn)),
cv AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY kind, pl) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM cu) SELECT conv_id, place, role, md5(text) AS text_md5 FROM cv WHERE place > n - 4"""
Q["conversation_answer"] = lambda spark, d: C.conversation_answer(conv(spark, d), conv(spark, d).where("turn = 0").select("conv_id", F.element_at(F.array(F.lit("What was my first question"), F.lit("and the last one?"), F.lit("so far")), (F.pmod("conv_id", F.lit(3)) + 1).cast("int")).alias("query"))).select("conv_id", F.md5("answer").alias("answer_md5"))
_last = lambda f: f"(SELECT {f}(text, turn) FROM conversations x WHERE x.conv_id = q.conv_id AND role = 'user' AND trim(coalesce(text, '')) <> '') AS text"
O["conversation_answer"] = f"""WITH q AS (SELECT conv_id, conv_id % 3 AS k FROM conversations WHERE turn = 0), nb AS ({_numbered('conversations', 160)}), fi AS (SELECT conv_id, {_topic(200)} AS t FROM (SELECT conv_id, {_last('arg_min')} FROM q)), la AS (SELECT conv_id, {_topic(200)} AS t FROM (SELECT conv_id, {_last('arg_max')} FROM q))
SELECT q.conv_id, md5(coalesce('## Conversation so far' || chr(10) || 'You have asked ' || n || ' question(s) in this chat:' || chr(10) || '- ' || replace(ls, chr(10), chr(10) || '- ') || CASE k WHEN 0 THEN chr(10) || chr(10) || 'Your first question was: “' || fi.t || '”' WHEN 1 THEN chr(10) || chr(10) || 'Your most recent question was: “' || la.t || '”' ELSE '' END, 'This conversation has no earlier questions yet — this is the first one.')) AS answer_md5 FROM q LEFT JOIN nb USING (conv_id) JOIN fi USING (conv_id) JOIN la USING (conv_id)"""
ENDINGS = ["\n## Suggested Follow-up Questions\n- Why so?\n2) How does it go on from here\n* no\n\n- What then?\n- And after that?\n- Never reached?", "\nNothing suggested.", ""]


def suggested(spark, d):
    end = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    rows = conv(spark, d).where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("aid"), F.concat(F.coalesce("text", F.lit("")), end).alias("text"), F.when(F.pmod("conv_id", F.lit(2)) == 0, F.concat(F.lit("P-"), "conv_id")).alias("subject"))
    return longs(C.followups(rows))


Q["followups"] = suggested
O["followups"] = """WITH a AS (SELECT conv_id * 1000 + turn AS aid, turn % 3 AS k, CASE WHEN conv_id % 2 = 0 THEN 'P-' || conv_id END AS s FROM conversations WHERE role = 'assistant')
SELECT aid, CAST(p AS BIGINT) AS pos, q AS question FROM (SELECT aid, unnest([0, 1, 2, 3]) AS p, unnest(['Why so?', 'How does it go on from here', 'What then?', 'And after that?']) AS q FROM a WHERE k = 0
UNION ALL SELECT aid, unnest([0, 1, 2]), unnest(['What causes issues with ' || s || '?', 'Show the maintenance history for ' || s || '.', 'Which documents reference ' || s || '?']) FROM a WHERE k <> 0 AND s IS NOT NULL)"""
Q["conv_search"] = lambda spark, d: C.search(conv(spark, d), "The tion", 20).unionByName(C.search(conv(spark, d), "in the", 20)).groupBy("conv_id").agg(F.sum("hits").alias("hits"))
O["conv_search"] = f"WITH {_BACK} SELECT conv_id, CAST(sum(CAST(contains(lower(text), 'the tion') AS INT) + CAST(contains(lower(text), 'in the') AS INT)) AS BIGINT) AS hits FROM b WHERE back <= 20 GROUP BY conv_id HAVING hits > 0"
Q["gap_priority"] = lambda spark, d: longs(C.gaps(questions(spark, d).select(F.col("text").alias("query"), (F.pmod("qid", F.lit(10)) / 10).alias("confidence"), F.col("qid").alias("at"))))
O["gap_priority"] = f"WITH {QUESTIONS_SQL}, r AS (SELECT trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS key, (qid % 10) / 10 AS c, qid AS asked FROM qs), g AS (SELECT key, count(*) AS ask_count, min(asked) AS first_asked, max(asked) AS last_asked, min(c) AS c FROM r WHERE key <> '' GROUP BY key), p AS (SELECT key, ask_count, first_asked, last_asked, CASE WHEN c < 0.2 THEN 'HIGH' WHEN c < 0.5 AND ask_count >= 3 THEN 'HIGH' WHEN c < 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM g) SELECT *, CAST(CASE priority WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS BIGINT) AS rank FROM p"
EXPERTS = [(0, "Ada", "error, fix, table"), (1, "Ben", "memory,graphs"), (2, "Cy", "vectors, proposed, steps")]
Q["sme_suggest"] = lambda spark, d: C.suggest_expert(questions(spark, d), spark.createDataFrame(EXPERTS, "pos int, name string, topics string"))
_E = ", ".join(f"({p}, '{n}', '{t.strip()}')" for p, n, ts in EXPERTS for t in ts.split(","))
O["sme_suggest"] = f"WITH {QUESTIONS_SQL}, x(pos, name, topic) AS (VALUES {_E}), h AS (SELECT qid, pos, name, count(*) AS hits FROM qs JOIN x ON contains(lower(text), topic) GROUP BY ALL) SELECT qid, name, hits FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, pos) AS i FROM h) WHERE i = 1"
Q["evidence_budget"] = lambda spark, d: longs(V.budget(conv(spark, d).select(F.col("conv_id").alias("qid"), F.col("turn").alias("place"), F.coalesce("text", F.lit("")).alias("text")), 1500, 400).select("qid", "place", "used"))
O["evidence_budget"] = "SELECT conv_id AS qid, turn AS place, used FROM (SELECT conv_id, turn, CAST(sum(least(length(coalesce(text, '')), 400)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 1500"
Q["evidence_sufficiency"] = lambda spark, d: longs(V.sufficiency(conv(spark, d).select(F.col("conv_id").alias("qid"), F.col("role").alias("doc"), F.pmod("turn", F.lit(3)).alias("section"), (F.pmod(F.col("conv_id") + F.col("turn") * 7, F.lit(10)) / 10).alias("score"))))
O["evidence_sufficiency"] = "WITH e AS (SELECT conv_id AS qid, count(*) FILTER (((conv_id + turn * 7) % 10) / 10 >= 0.35) AS strong, count(DISTINCT (role, turn % 3)) AS sections FROM conversations GROUP BY conv_id) SELECT qid, strong, sections, round(CAST(0.6 * least(strong / 4, 1.0) + 0.4 * least(sections / 3, 1.0) AS DOUBLE), 4) AS score, strong >= 3 AND sections >= 2 AS sufficient FROM e"
