"""Shaping and gating of answers: response profile, expansion, document requests, refusal, confidence, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T

# Patterns of the response profile, in order, and terms that a trigger adds.
FORMATS = [
    ("bullets", r"\b(?:bullet points?|as bullets|bulleted|point[- ]?wise|in points?|as points|in (?:a )?(?:numbered|bulleted) list|numbered (?:list|points)|list (?:it|them) out|(?:\d{1,2}|one|two|three|four|five|six|seven|eight|nine|ten|a few|couple(?:\s+of)?|several)(?:\s*[-–to]{1,2}\s*\d{1,2})?\s+(?:points?|bullets?))\b"),
    ("comparison", r"\b(?:compare|comparison|comparison table|comparison matrix|versus|vs\.?|difference between|pros and cons|trade[- ]?offs?)\b"),
    ("table", r"\b(?:as a table|in a table|tabular|table format|in table form)\b"),
    ("checklist", r"\b(?:checklist|check[- ]?list|to[- ]?do list|action items|as (?:a )?tasks?)\b"),
    ("interview", r"\b(?:interview (?:notes|questions|prep|preparation|perspective)|q ?& ?a|question and answer|viva|revision notes)\b"),
    ("json", r"\b(?:as json|in json|json format|json output|return json)\b"),
    ("csv", r"\b(?:as csv|in csv|csv format|comma[- ]separated)\b"),
    ("timeline", r"\b(?:timeline|chronolog(?:y|ical)|history of|sequence of events|over time)\b"),
    ("flowchart", r"\b(?:flow ?chart|flow diagram|as a diagram|process (?:flow|diagram)|mermaid)\b"),
    ("page_wise", r"\b(?:page[- ]wise|page by page|per page|page[- ]by[- ]page)\b"),
    ("exec_summary", r"\b(?:executive summary|exec summary|management summary|bl[uo]f|bottom line up front)\b"),
    ("example", r"\b(?:with an example|give (?:an|me an) example|real[- ]world (?:example|use case)|use case|concrete example|worked example)\b"),
    ("analogy", r"\b(?:analogy|analogies|like i'?m explaining to|metaphor|intuitively|intuition behind)\b"),
    ("markdown", r"\b(?:in markdown|as markdown|markdown format|structured (?:report|document))\b"),
]
LEVELS = [
    ("beginner", r"\b(?:simple (?:words|terms|language)|in simple|eli5|explain like i'?m (?:5|five|a beginner)|layman'?s?|non[- ]technical|for (?:a )?beginners?|plain english)\b"),
    ("student", r"\b(?:for (?:a )?students?|study notes|exam(?:s)? (?:prep|notes|revision)|for (?:my )?(?:class|course|homework))\b"),
    ("manager", r"\b(?:for (?:a )?managers?|for (?:an )?executives?|business (?:audience|perspective|terms)|for leadership|for (?:a )?non[- ]technical audience)\b"),
    ("expert", r"\b(?:for (?:an )?experts?|expert[- ]level|advanced|deeply technical|for (?:a )?(?:phd|researcher|specialist)|rigorous)\b"),
    ("engineer", r"\b(?:for (?:an )?engineers?|technical detail|engineering (?:detail|perspective)|implementation detail)\b"),
]
LENGTHS = [
    ("short", r"\b(?:short|brief|briefly|concise|quick|tl;?dr|in (?:one|a) (?:line|sentence|paragraph)|one[- ]liner|in a nutshell)\b"),
    ("research", r"\b(?:research[- ]level|research report|comprehensive report|deep dive|exhaustive|in[- ]depth report|literature review)\b"),
    ("walkthrough", r"\b(?:walk[- ]?through|complete walkthrough|comprehensive walkthrough|whole document|entire document|full document|section by section)\b"),
    ("detailed", r"\b(?:detailed|in[- ]depth|comprehensive|thorough|elaborate|step[- ]by[- ]step|(?:in|with|more)\s+(?:more\s+)?detail(?:s)?|in\s+full)\b"),
]
PERSONAS = [
    ("teacher", r"\b(?:as (?:a )?teacher|like (?:a )?teacher|teach me|as (?:a )?tutor|explain like a (?:professor|teacher))\b"),
    ("researcher", r"\b(?:as (?:a )?researcher|like (?:a )?researcher|academic (?:tone|perspective)|as (?:a )?scientist)\b"),
    ("auditor", r"\b(?:as (?:an )?auditor|audit perspective|compliance perspective|for (?:an )?audit)\b"),
    ("manager", r"\b(?:as (?:a )?manager|like (?:a )?manager|as (?:a )?pm|as (?:a )?project manager|managerial perspective)\b"),
    ("technician", r"\b(?:as (?:a )?technician|like (?:a )?technician|as (?:a )?(?:maintenance|field) engineer|hands[- ]on perspective)\b"),
    ("interviewer", r"\b(?:as (?:an )?interviewer|interviewer perspective|interview me|mock interview)\b"),
    ("engineer", r"\b(?:as (?:an )?engineer|like (?:an )?engineer|engineer'?s perspective)\b"),
]
LONGEST = 400
DOMAIN_TERMS = {
    "bitnet": ["BitNet", "BitNet b1.58", "1-bit LLM", "ternary weights", "quantization", "low-bit inference"],
    "transformer": ["Transformer", "self-attention", "encoder", "decoder", "Attention Is All You Need"],
    "rag": ["Retrieval Augmented Generation", "GraphRAG", "hybrid retrieval", "vector search", "BM25"],
    "langchain": ["LCEL", "RunnableSequence", "RunnableParallel", "RunnableLambda"],
}
GATED = {"langchain": ["implementation", "methodology"]}
REQUEST_VERB = r"\b(?:summari[sz]e|summary|explain|describe|overview|walk\s*through|walkthrough|go\s+through|review)\b"
REQUEST_WHOLE = r"\b(?:whole|entire|complete|full|every\s+page|all\s+pages|page\s*(?:-|\s)?by\s*(?:-|\s)?page|page[- ]wise|start\s+to\s+(?:finish|end))\b"
CRITIC = (0.30, 0.25, 0.20, 0.15, 0.10)
# End of fixed values.


def profile(q: Column) -> Column:
    """struct(formats, level, length, persona): all formats, else the first of each kind; nothing for over-long questions."""
    t = F.lower(q)
    first = lambda rules: F.coalesce(*(F.when(t.rlike(p), n) for n, p in rules))
    ok = (F.length(q) > 0) & (F.length(q) <= LONGEST)
    formats = F.when(ok, F.array_join(F.array_compact(F.array(*(F.when(t.rlike(p), n) for n, p in FORMATS))), ",")).otherwise("")
    return F.struct(formats.alias("formats"), F.when(ok, first(LEVELS)).alias("level"), F.when(ok, first(LENGTHS)).alias("length"), F.when(ok, first(PERSONAS)).alias("persona"))


def expand(q: Column, intent: Column) -> Column:
    """The query and, distinct and in order, the terms that its trigger words add."""
    t, parts = F.lower(q), [F.array(q)]
    for trigger, terms in DOMAIN_TERMS.items():
        hit = t.rlike(f"(^|[^a-z0-9]){trigger}([^a-z0-9]|$)")
        if trigger in GATED:
            hit = hit & intent.isin(GATED[trigger])
        parts.append(F.when(hit, F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.array_distinct(F.concat(*parts)), " ")


def document_request(q: Column) -> Column:
    """struct(mode, page): a page, the whole document, or none."""
    t = F.lower(F.coalesce(q, F.lit("")))
    page = F.nullif(F.regexp_extract(t, r"\bpage\s+([0-9]{1,4})\b", 1), F.lit("")).cast("bigint")
    mode = F.when(t.rlike(REQUEST_VERB) & page.isNotNull(), "page").when(t.rlike(REQUEST_VERB) & t.rlike(REQUEST_WHOLE), "whole").otherwise("none")
    return F.struct(mode.alias("mode"), F.when(mode == "page", page).alias("page"))


def grounded(anchor: Column, evidence: Column, known: Column, rarest: Column, coverage: Column, relevance: Column) -> Column:
    """Answer, or refuse: an anchor is ground enough; else evidence with a known entity, the rarest term and coverage .6, or relevance .2."""
    return anchor | (evidence & (known | (rarest & (coverage >= 0.6)) | (relevance >= 0.2)))


def confidence(grounding: Column, completeness: Column, coverage: Column, citation: Column, graph: Column) -> tuple[Column, Column]:
    """(score, band): weighted mean of the factors; without a graph factor the other weights are scaled up.  Bands .75 and .55."""
    a, b, c, d, e = CRITIC
    base = a * grounding + b * completeness + c * coverage + d * citation
    score = F.round(F.when(graph.isNull(), base / (a + b + c + d)).otherwise(base + e * graph), 4)
    return score, F.when(score >= 0.75, "high").when(score >= 0.55, "medium").otherwise("low")


def suppressed(valid: Column, coverage: Column, claims: Column, grounded_claims: Column, fabricated: Column) -> Column:
    """The floor: an answer that is not valid goes if its coverage is under .35 and more claims are made up than grounded, or half of two or more are."""
    low = (coverage < 0.35) & (fabricated > grounded_claims)
    half = (claims >= 2) & (fabricated / F.greatest(F.lit(1), claims) >= 0.5) & (fabricated >= grounded_claims)
    return ~valid & (low | half)


def topics(evidence: DataFrame) -> DataFrame:
    """(conv, topic, score): the topic of a conversation; entities count 3, concepts 2, keywords 1.  evidence: (conv, topic, kind)."""
    weight = F.when(F.col("kind") == "entity", 3).when(F.col("kind") == "concept", 2).otherwise(1)
    scored = evidence.groupBy("conv", "topic").agg(F.sum(weight).alias("score"))
    order = Window.partitionBy("conv").orderBy(F.desc("score"), F.desc(F.length("topic")), "topic")
    return scored.withColumn("i", F.row_number().over(order)).where("i = 1").select("conv", "topic", "score")


def diagnostics(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """(qid, doc, relevance, used): relevance scaled by the query's best.  candidates: (qid, doc, score); used: (qid, doc)."""
    best = F.max("score").over(Window.partitionBy("qid"))
    rows = candidates.withColumn("relevance", F.round(F.when(best > 0, F.col("score") / best).otherwise(0.0), 4))
    return rows.join(used.select("qid", "doc", F.lit(True).alias("used")), ["qid", "doc"], "left").select("qid", "doc", "relevance", F.coalesce("used", F.lit(False)).alias("used"))


def extract(evidence: DataFrame, queries: DataFrame, top: int = 6) -> DataFrame:
    """(qid, sentence, score, place): the sentences of 6 to 45 words (320 characters) with most query terms, distinct by 50 characters.
    evidence: (qid, place, text); queries: (qid, text)."""
    s = evidence.select("qid", F.col("place").alias("at"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    n = T.word_count(F.col("sentence"))
    s = s.where((n >= 6) & (n <= 45) & (F.length("sentence") <= 320))
    q = queries.select("qid", T.query_terms(F.col("text")).alias("q"))
    rows = s.join(q, "qid").withColumn("score", F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("sentence"))), "q"))).where("score > 0")
    same = Window.partitionBy("qid", F.substring("sentence", 1, 50)).orderBy(F.desc("score"), "at", "pos")
    rows = rows.withColumn("i", F.row_number().over(same)).where("i = 1")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "at", "pos")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("qid", "sentence", "score", "place")
