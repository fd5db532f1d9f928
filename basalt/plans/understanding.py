"""Queries over the understanding of questions and the shape of their answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import answering as W
from basalt.operators import index as I
from basalt.operators import query as G
from basalt.operators import understand as U
from basalt.plans.answers import ASPECTS_SQL, CLASS_SQL, CONCEPTS_SQL, FACETS_SQL, INTENT_SQL, QUESTIONS_SQL, SPACED_SQL, _pick, entities_sql, facet_rows, questions
from basalt.plans.common import INDEX_SQL, RANK_SQL, longs, table, words_sql
from basalt.plans.shaping import O as SHAPING_SQL
from basalt.plans.shaping import STYLED_SQL, styled
from basalt.plans.text import concepts

Q, O = {}, {}
_lit = lambda s: "'" + s.replace("'", "''") + "'"
_list = lambda xs: "[" + ", ".join(map(_lit, xs)) + "]"


def turns(spark, d):
    return table(spark, d, "conversations")


Q["unicode_normalize"] = lambda spark, d: turns(spark, d).select("conv_id", "turn", F.md5(G.normalise(F.concat(F.lit("“"), F.coalesce("text", F.lit("")), F.lit("” – ‘x’\t")), spark)).alias("text_md5"))
_fold = "nfc_normalize('“' || coalesce(text, '') || '” – ‘x’' || chr(9))"
for _a, _b in G.FOLDED.items():
    _fold = f"replace({_fold}, {_lit(_a)}, {_lit(_b)})"
O["unicode_normalize"] = f"SELECT conv_id, turn, md5({SPACED_SQL.replace('coalesce(text, ' + chr(39) * 2 + ')', _fold)}) AS text_md5 FROM conversations"

Q["canonical_terms"] = lambda spark, d: turns(spark, d).select("conv_id", "turn", F.md5(G.canonical(F.concat_ws(" ", F.lit("langraph and LCEL"), "text"))).alias("text_md5"))
_canon = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.CANONICAL.items()) + " ELSE w END"
O["canonical_terms"] = f"SELECT conv_id, turn, md5(array_to_string(list_transform(string_split({SPACED_SQL.replace('coalesce(text, ' + chr(39) * 2 + ')', 'concat_ws(' + _lit(' ') + ', ' + _lit('langraph and LCEL') + ', text)')}, ' '), lambda w: {_canon}), ' ')) AS text_md5 FROM conversations"

Q["query_rewrite"] = lambda spark, d: questions(spark, d).select("qid", G.rewrite(F.col("text")).alias("rewritten"))
_met = lambda xs: " OR ".join(f"contains(lower(text), {_lit(x)})" for x in xs)
O["query_rewrite"] = f"WITH {QUESTIONS_SQL} SELECT qid, concat_ws(' ', text, " + ", ".join(f"CASE WHEN {_met(p)} THEN '{' '.join(t)}' END" for p, t in G.REWRITES) + ") AS rewritten FROM qs"


def hints(spark, d):
    return questions(spark, d).select("qid", F.array_join(G.hint_sections(U.intent(F.col("text"))), ",").alias("sections"), F.array_join(F.array_sort(G.entities(F.col("text"))), ",").alias("entities"), F.array_join(F.array_sort(G.search_words(F.col("text"))), ",").alias("keywords"))


Q["retrieval_hints"] = hints
_words = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({words_sql(G.STOP)})))"
_sect = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in G.HINT_SECTIONS.items()) + " ELSE '' END"
O["retrieval_hints"] = f"WITH {QUESTIONS_SQL}, i AS (SELECT qid, text, {INTENT_SQL} AS intent FROM (SELECT *, lower(trim(text)) AS t FROM qs)) SELECT qid, {_sect} AS sections, array_to_string(list_sort({entities_sql('text')}), ',') AS entities, array_to_string(list_sort({_words}), ',') AS keywords FROM i"


def named(spark, d):
    return G.gazetteer(questions(spark, d), concepts(spark, d).select(F.col("concept").alias("name")))


Q["gazetteer_entities"] = lambda spark, d: named(spark, d).select("qid", F.size("entities").cast("bigint").alias("n"), F.array_join("entities", "|").alias("entities"))
_W = "\\p{L}\\p{N}"
_place = f"'(?s)^(.*?(?:^|[^{_W}]))' || regexp_escape(lower(name)) || '(?:[^{_W}]|$)'"
# The longest name that clashes with none taken before, one in each round.
GAZETTEER_SQL = f"""names AS (SELECT DISTINCT concept AS name FROM ({CONCEPTS_SQL})),
m AS (SELECT qid, name, length(regexp_extract(lower(text), {_place}, 1)) AS lo FROM qs JOIN names ON contains(lower(text), lower(name)) WHERE regexp_matches(lower(text), {_place})),
r AS (SELECT qid, name, lo, lo + length(name) AS hi, row_number() OVER (PARTITION BY qid ORDER BY length(name) DESC, name) AS i FROM m),
t(qid, i, taken) AS (SELECT qid, 0, []::STRUCT(name VARCHAR, lo BIGINT, hi BIGINT)[] FROM r GROUP BY qid
  UNION ALL SELECT t.qid, r.i, CASE WHEN len(list_filter(taken, lambda y: y.lo < r.hi AND r.lo < y.hi)) > 0 THEN taken ELSE list_append(taken, {{'name': r.name, 'lo': r.lo, 'hi': r.hi}}) END FROM t JOIN r ON r.qid = t.qid AND r.i = t.i + 1),
z AS (SELECT qid, arg_max(taken, i) AS taken FROM t GROUP BY qid), tg AS (SELECT qid, regexp_extract_all(text, '{G.ENTITY_TAG}') AS tags FROM qs),
ge AS (SELECT qid, list_transform(coalesce(taken, []), lambda x: x.name) AS names, list_filter(tags, lambda x, i: list_position(tags, x) = i AND NOT list_contains(list_transform(coalesce(taken, []), lambda y: y.name), x)) AS tags FROM tg LEFT JOIN z USING (qid))"""
O["gazetteer_entities"] = f"WITH RECURSIVE {QUESTIONS_SQL}, {GAZETTEER_SQL} SELECT qid, len(names) + len(tags) AS n, array_to_string(list_concat(names, tags), '|') AS entities FROM ge WHERE len(names) + len(tags) > 0"

Q["pattern_subqueries"] = lambda spark, d: questions(spark, d).select("qid", F.array_join(G.subqueries(F.col("text"), G.entities(F.col("text"))), "|").alias("subqueries"))
_p1, _p2 = "(?i)\\bbetween\\s+(.+?)\\s+and\\s+(.+?)(?:\\?|$)", "(?i)^(.+?)\\s+(?:vs\\.?|versus)\\s+(.+?)(?:\\?|$)"
_both = lambda p: f"[trim(regexp_extract(text, '{p}', 1)), trim(regexp_extract(text, '{p}', 2))]"
SIDES_SQL = f"sd AS (SELECT qid, CASE WHEN regexp_matches(text, '{_p1}') THEN {_both(_p1)} WHEN regexp_matches(text, '{_p2}') THEN {_both(_p2)} WHEN a <> '' AND b <> '' THEN [a, b] ELSE [] END AS s FROM qs JOIN ab USING (qid))"
_AB = FACETS_SQL.split(", f(lab")[0]
O["pattern_subqueries"] = f"WITH {QUESTIONS_SQL}, {_AB}, {SIDES_SQL} SELECT qid, CASE WHEN len(s) = 2 THEN 'What is ' || s[1] || '?|What is ' || s[2] || '?|' || s[1] || ' ' || s[2] || ' difference comparison' ELSE '' END AS subqueries FROM sd"


def understood(spark, d):
    """All stages for each question: label, plan, names, sub-queries where the plan asks for them, facets."""
    label, conf = U.classify(F.col("text"))
    rows = questions(spark, d).select("qid", "text", G.entities(F.col("text")).alias("names"), label.alias("label"), conf.alias("confidence")).withColumn("plan", U.plan(F.col("label")))
    subs = F.when(F.col("plan.decompose"), F.size(G.subqueries(F.col("text"), F.col("names")))).otherwise(0)
    ratio = U.facet_ratio(facet_rows(spark, d))
    return longs(rows.join(ratio, "qid", "left").select("qid", "label", "confidence", "plan.strategy", F.size("names").alias("names"), subs.alias("subqueries"), F.coalesce("facets", F.lit(0)).cast("bigint").alias("facets"), "ratio"))


Q["understanding"] = understood
O["understanding"] = f"""WITH {QUESTIONS_SQL}, {CLASS_SQL}, {FACETS_SQL}, {SIDES_SQL}, r AS (SELECT qid, count(*) AS facets, round(avg(CAST(covered AS DOUBLE)), 3) AS ratio FROM fc GROUP BY qid)
SELECT qid, label, confidence, {_pick(3)} AS strategy, len({entities_sql('text')}) AS names, CASE WHEN {_pick(2)} AND len(s) = 2 THEN 3 ELSE 0 END AS subqueries, coalesce(facets, 0) AS facets, ratio FROM cl JOIN qs USING (qid) JOIN sd USING (qid) LEFT JOIN r USING (qid)"""

Q["style_strip"] = lambda spark, d: styled(spark, d).select("qid", G.strip_style(F.col("text")).alias("stripped"))
_tidy = lambda e: f"regexp_replace(regexp_replace({e}, '\\s{{2,}}', ' ', 'g'), '^[ .,;?-]+|[ .,;?-]+$', '', 'g')"
# One step a rule: nested in one expression they would be parsed too deeply.
_steps, _at = [], "sq"
for _k, (_, _p) in enumerate([*W.FORMATS, *W.LEVELS, *W.LENGTHS, *W.PERSONAS]):
    _steps.append(f"st{_k} AS (SELECT qid, text, regexp_replace({'text' if _k == 0 else 'x'}, {_lit('(?i)' + G.STYLE_LEAD + _p)}, ' ', 'g') AS x FROM {_at})")
    _at = f"st{_k}"
_steps.append(f"sf0 AS (SELECT qid, text, {_tidy('regexp_replace(x, ' + _lit('(?i)' + G.STYLE_FILLER) + ', ' + _lit(' ') + ', ' + _lit('g') + ')')} AS x FROM {_at})")
for _k in range(G.TRIMS):
    _steps.append(f"sf{_k + 1} AS (SELECT qid, text, {_tidy('regexp_replace(x, ' + _lit('(?i)' + G.DANGLING) + ', ' + _lit(' ') + ', ' + _lit('g') + ')')} AS x FROM sf{_k})")
O["style_strip"] = f"WITH {STYLED_SQL}, {', '.join(_steps)} SELECT qid, CASE WHEN length(text) > {W.LONGEST} OR trim(x) = '' THEN text ELSE x END AS stripped FROM sf{G.TRIMS}"

Q["answer_sections"] = lambda spark, d: styled(spark, d).select("qid", F.array_join(G.answer_sections(U.intent(F.col("text")), W.profile(F.col("text"))), "|").alias("sections"))
_base = "CASE WHEN length = 'short' THEN ['Direct Answer'] ELSE CASE intent " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in G.INTENT_SECTIONS.items()) + f" ELSE {_list(G.OTHER_SECTIONS)} END END"
_fmt = "list_transform(string_split(formats, ','), lambda f: CASE f " + " ".join(f"WHEN '{k}' THEN {_lit(v)}" for k, v in G.FORMAT_SECTIONS.items()) + " END)"
_deep = "CASE WHEN length IN ('detailed', 'walkthrough', 'research') THEN ['Detailed Explanation'] ELSE [] END, CASE WHEN length IN ('walkthrough', 'research') THEN ['Executive Summary', 'Key Takeaways'] ELSE [] END, CASE WHEN persona = 'teacher' AND coalesce(length, '') <> 'short' THEN ['Real-World Example'] ELSE [] END"
_PROFILE = SHAPING_SQL["response_profile"].replace(f"WITH {STYLED_SQL} ", "")
_SQI = f"si AS (SELECT qid, {INTENT_SQL} AS intent FROM (SELECT qid, lower(trim(text)) AS t FROM sq))"
O["answer_sections"] = f"WITH {STYLED_SQL}, pr AS ({_PROFILE}), {_SQI}, c AS (SELECT qid, list_concat({_base}, {_fmt}, {_deep}) AS chosen FROM pr JOIN si USING (qid)) SELECT qid, array_to_string(list_concat(list_filter({_list(G.SECTION_ORDER)}, lambda s: list_contains(chosen, s)), {_list(G.CLOSING)}), '|') AS sections FROM c"

Q["answer_outline"] = lambda spark, d: styled(spark, d).select("qid", F.array_join(G.outline(U.intent(F.col("text"))), "|").alias("outline"))
O["answer_outline"] = f"WITH {STYLED_SQL}, {_SQI} SELECT qid, CASE intent " + " ".join(f"WHEN '{k}' THEN {_lit('|'.join([*G.OUTLINE[:n], x, *G.OUTLINE[n:]]))}" for k, (n, x) in G.OUTLINE_EXTRA.items()) + f" ELSE {_lit('|'.join(G.OUTLINE))} END AS outline FROM si"

DIRECTIVE_TEXTS = ["Use bullet points. Keep it short.", "Present a markdown table and bullet points", "Write a thorough, step-by-step answer", "Stay under roughly 120 words", ""]
Q["legacy_profile"] = lambda spark, d: turns(spark, d).select("conv_id", "turn", G.legacy_profile(F.concat_ws(" ", "text", F.element_at(F.array(*map(F.lit, DIRECTIVE_TEXTS)), (F.pmod("turn", F.lit(5)) + 1).cast("int")))).alias("p")).select("conv_id", "turn", "p.*")
O["legacy_profile"] = f"SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(j, 'bullet points') THEN 'bullets' END, CASE WHEN contains(j, 'markdown table') THEN 'table' END) AS formats, CASE WHEN contains(j, 'under roughly 120 words') OR contains(j, 'short') THEN 'short' WHEN contains(j, 'thorough, step-by-step') THEN 'detailed' END AS length FROM (SELECT conv_id, turn, lower(concat_ws(' ', text, ({_list(DIRECTIVE_TEXTS)})[1 + turn % 5])) AS j FROM conversations)"


def resolved(spark, d):
    """Each short question about the word before: the conversation's first long word is its topic."""
    word = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]{6,}", 0), F.lit(""))
    topic = turns(spark, d).groupBy("conv_id").agg(F.min_by(word, F.when(word.isNotNull(), F.col("turn"))).alias("topic"))
    asked = turns(spark, d).select("conv_id", "turn", F.concat(F.element_at(F.array(*map(F.lit, FOLLOWUPS)), (F.pmod("turn", F.lit(len(FOLLOWUPS))) + 1).cast("int")), F.lit(" "), F.array_join(F.slice(F.split(G.spaced(F.col("text")), " "), 1, 9), " ")).alias("text"))
    return asked.join(topic, "conv_id").select("conv_id", "turn", G.resolve(F.col("text"), F.col("topic")).alias("text"))


FOLLOWUPS = ["explain it in", "how does", "compare", "what about these", "tell me"]
Q["context_resolve"] = resolved
_pron = "|".join(G.PRONOUNS)
O["context_resolve"] = f"""WITH t AS (SELECT conv_id, arg_min(w, turn) FILTER (w IS NOT NULL) AS topic FROM (SELECT *, nullif(regexp_extract(coalesce(text, ''), '[A-Za-z]{{6,}}'), '') AS w FROM conversations) GROUP BY conv_id),
q AS (SELECT conv_id, turn, ({_list(FOLLOWUPS)})[1 + turn % {len(FOLLOWUPS)}] || ' ' || array_to_string(string_split({SPACED_SQL}, ' ')[1:9], ' ') AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN topic IS NULL OR topic = '' OR contains(lower(text), lower(topic)) OR len(list_filter(regexp_split_to_array(text, '[ \\t\\n]+'), lambda w: w <> '')) > {G.MOST_FOLLOWUP_WORDS} THEN text
  WHEN regexp_matches(text, '(?i)\\b(?:{_pron})\\b') THEN regexp_replace(text, '(?i)\\b(?:{_pron})\\b', topic)
  WHEN {' OR '.join(f"starts_with(lower(text), '{o}')" for o in G.OPENERS)} THEN topic || ' ' || text ELSE text END AS text FROM q JOIN t USING (conv_id)"""


def included(spark, d):
    items = turns(spark, d).select(F.col("conv_id").alias("qid"), F.explode(T.keywords(F.col("text"))).alias("item"))
    asked = turns(spark, d).where("turn = 1").select(F.col("conv_id").alias("qid"), "text")
    return G.must_include(asked, items).select("qid", F.size("items").cast("bigint").alias("n"), F.md5(F.array_join("items", ",")).alias("items_md5"))


Q["must_include"] = included
from basalt.plans.common import keywords_sql  # noqa: E402

O["must_include"] = f"""WITH i AS (SELECT DISTINCT conv_id AS qid, unnest({keywords_sql('text')}) AS item FROM conversations), q AS (SELECT conv_id AS qid, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_.-]+')) AS ts FROM conversations WHERE turn = 1),
m AS (SELECT DISTINCT qid, item FROM i JOIN q USING (qid) WHERE len(list_filter(ts, lambda t: contains(lower(item), t) OR contains(t, lower(item)))) > 0)
SELECT qid, count(*) AS n, md5(string_agg(item, ',' ORDER BY item)) AS items_md5 FROM m GROUP BY qid"""

TAGS = r"\b(?:N|S|C|R)[0-9]{1,4}\b"


def tagged(spark, d):
    """Questions that name suppliers, nations and customers, known and unknown ones."""
    return turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.concat_ws(" ", F.when(F.pmod("turn", F.lit(3)) != 0, F.concat(F.lit("S"), F.pmod("conv_id", F.lit(150)), F.lit(" n"), F.pmod("turn", F.lit(40)))), "text").alias("text"))


TAGGED_SQL = "tq AS (SELECT conv_id * 1000 + turn AS qid, concat_ws(' ', CASE WHEN turn % 3 <> 0 THEN 'S' || (conv_id % 150) || ' n' || (turn % 40) END, text) AS text FROM conversations)"


def anchors(spark, d):
    from basalt.plans.graph import plant_trees

    return G.anchor(tagged(spark, d), plant_trees(spark, d)[0], U._boundaries(TAGS), ("tion|heat", "N3"))


from basalt.plans.graph import GRAPH_SQL  # noqa: E402

Q["query_anchor"] = anchors
ANCHOR_SQL = f"{TAGGED_SQL}, tg AS (SELECT qid, unnest(regexp_extract_all(upper(coalesce(text, '')), '{TAGS}')) AS id FROM tq), tn AS (SELECT qid, min(id) AS named FROM tg WHERE id IN (SELECT id FROM n) GROUP BY qid), an AS (SELECT tq.qid, tq.text, coalesce(named, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)tion|heat') THEN 'N3' END) AS anchor FROM tq LEFT JOIN tn USING (qid))"
O["query_anchor"] = f"WITH {GRAPH_SQL}, {ANCHOR_SQL} SELECT qid, anchor FROM an"

ASPECT_TEMPLATES = ["{} isolation requirements", "{} failure history", "{} spare parts"]


def planned(spark, d):
    from basalt.plans.graph import plant_trees

    n, e = plant_trees(spark, d)
    asked = tagged(spark, d).join(anchors(spark, d), "qid")
    titles = e.where("rel = 'GOVERNS'").join(n.select(F.col("id").alias("src"), F.col("label").alias("title")), "src").select(F.col("dst").alias("anchor"), "title")
    return longs(G.planner_queries(asked, titles, ASPECT_TEMPLATES).groupBy("qid").agg(F.count("*").alias("n"), F.max_by("query", "pos").alias("last_query")))


Q["planner_queries"] = planned
O["planner_queries"] = f"""WITH {GRAPH_SQL}, {ANCHOR_SQL}, u AS (SELECT qid, text AS query, 0 AS kind, '' AS b FROM an UNION ALL SELECT qid, label, 1, label FROM an JOIN e ON dst = anchor AND rel = 'GOVERNS' JOIN n ON n.id = src
  UNION ALL SELECT qid, replace(t.x, '{{}}', anchor), 2, lpad(CAST(t.k AS VARCHAR), 4, '0') FROM an, (SELECT unnest({_list(ASPECT_TEMPLATES)}) AS x, unnest([0, 1, 2]) AS k) t WHERE anchor IS NOT NULL),
f AS (SELECT qid, query, min((kind, b)) AS place FROM u GROUP BY qid, query), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, query) AS pos FROM f)
SELECT qid, count(*) AS n, arg_max(query, pos) AS last_query FROM r WHERE pos <= 6 GROUP BY qid"""


def shifted(spark, d):
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    hits = I.ranked(I.bm25(I.build(docs), asked, depth=40), 40)
    inherited = docs.where("source = 'src0'").select(F.col("doc_id").alias("doc"))
    return G.topic_shift(hits, hits.join(inherited, "doc", "left_semi").select("qid", "doc"))


Q["topic_shift"] = shifted
O["topic_shift"] = f"""WITH {INDEX_SQL}, h AS (SELECT qid, doc, score, rank, coalesce(source = 'src0', false) AS inside FROM (SELECT qid, doc, score, {RANK_SQL} AS rank FROM bm25) JOIN documents ON doc_id = doc WHERE rank < 40)
SELECT qid, max(score) >= 4.0 AND NOT max(inside) FILTER (rank = 0) AND coalesce(max(score) FILTER (inside), 0.0) < 0.8 * max(score) AS shifted FROM h GROUP BY qid"""

VOCABULARY_LEAST = 3
Q["spell_texts"] = lambda spark, d: U.correct_texts(*broken(spark, d), {"teh": "the"}).select("qid", F.md5("corrected").alias("corrected_md5"), "changes")


def broken(spark, d):
    """Turns whose words of eight letters have the last two swapped, and the words that stand there three times."""
    vocab = turns(spark, d).select(F.explode(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)), lambda w: F.lower(w))).alias("term")).groupBy("term").agg(F.count("*").alias("freq")).where(F.col("freq") >= VOCABULARY_LEAST)
    return turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.regexp_replace(F.concat(F.lit("teh P-101 "), F.coalesce("text", F.lit(""))), "(?<![A-Za-z])([A-Za-z]{6})([a-z])([a-z])(?![A-Za-z])", "$1$3$2").alias("text")), vocab
