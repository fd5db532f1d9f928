"""Query understanding beyond classification: normal form, helper terms, hints, entities, sub-queries, facets, style, sections, context."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators import answering as S
from basalt.operators.concepts import mentions
from basalt.operators.understand import _boundaries
from basalt.runtime import ship

# Word lists, phrase groups and section tables of the specification.
FOLDED = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "}
CANONICAL = {"langraph": "LangGraph", "langgraph": "LangGraph", "langchain": "LangChain", "lcel": "LCEL"}
STOP = (
    "the a an of to for is are was were what who why how does do did explain describe tell about please in on at with using and or "
    "key difference differences between compare comparison versus vs define definition meaning overview summary different differs differ from than unlike "
    "detail details depth detailed give answer answers one two three four five six seven eight nine ten first second third couple few several many "
    "point points project projects thing things more most less much lot bit brief briefly simple words short long full complete whole entire again "
    "write list provide show name mention outline summarize summarise create generate make state find get need want"
).split()
REWRITES = [
    (["what is", "what are", "what're", "what's", "define", "meaning", "explain"], ["definition", "overview"]),
    (["author", "authors", "contributor", "contributors", "who wrote", "who proposed"], ["authors", "contributors", "paper"]),
    (["compare", "difference", "versus", "vs"], ["comparison"]),
    (["how", "algorithm", "method", "approach", "architecture", "pipeline"], ["method", "architecture", "implementation"]),
    (["result", "performance", "accuracy", "evaluation", "experiment"], ["results", "evaluation", "performance"]),
    (["limitation", "drawback", "future work", "weakness"], ["limitations", "future work"]),
]
HINT_SECTIONS = {
    "definition": ["Abstract", "Introduction", "Overview"], "author": ["Authors", "Title", "Abstract"], "comparison": ["Results", "Discussion", "Evaluation"],
    "methodology": ["Method", "Approach", "Architecture", "Pipeline"], "results": ["Results", "Evaluation", "Experiments"],
    "limitations": ["Discussion", "Limitations", "Future Work"], "implementation": ["Implementation", "Algorithm", "Code"], "citation": ["References", "Bibliography"],
}
PLAN_STOP = "the a an of to for is are was were in on at and or what how why explain describe tell me about please need do does did which".split()
ENTITY_TAG = r"\b[A-Z]{1,4}-\d+\b"
PRONOUNS = ["it", "its", "they", "them", "these", "this", "those"]
OPENERS = ["how", "why", "who", "when", "where", "compare", "difference", "advantages", "limitations", "examples", "implementation"]
MOST_FOLLOWUP_WORDS = 14
SECTION_ORDER = [
    "Table", "Executive Summary", "Direct Answer", "Comparison", "Steps", "Flowchart", "Timeline", "Checklist", "Detailed Explanation", "Real-World Example",
    "Analogy", "Interview Notes", "Key Takeaways", "JSON", "CSV", "Limitations", "General Knowledge (Not from Retrieved Documents)",
]
CLOSING = ["Sources", "Suggested Follow-up Questions"]
FORMAT_SECTIONS = {
    "comparison": "Comparison", "table": "Table", "checklist": "Checklist", "timeline": "Timeline", "flowchart": "Flowchart", "interview": "Interview Notes",
    "json": "JSON", "csv": "CSV", "example": "Real-World Example", "analogy": "Analogy", "exec_summary": "Executive Summary",
}
INTENT_SECTIONS = {
    "definition": ["Direct Answer", "Detailed Explanation"], "comparison": ["Executive Summary", "Comparison"], "procedure": ["Steps"],
    "implementation": ["Direct Answer", "Detailed Explanation"], "methodology": ["Direct Answer", "Detailed Explanation"], "reasoning": ["Executive Summary", "Detailed Explanation"],
    "results": ["Direct Answer", "Detailed Explanation"], "citation": ["Direct Answer"], "author": ["Direct Answer"], "figure": ["Direct Answer"],
    "equation": ["Direct Answer", "Detailed Explanation"], "conclusion": ["Executive Summary", "Direct Answer"], "summary": ["Executive Summary", "Detailed Explanation"],
    "limitations": ["Direct Answer", "Limitations"],
}
OTHER_SECTIONS = ["Executive Summary", "Direct Answer", "Detailed Explanation"]
OUTLINE = ["Executive Summary", "Direct Answer", "Detailed Explanation", "Real-World Example", "Evidence from Uploaded Documents", "Limitations", "Sources", "Suggested Follow-up Questions"]
OUTLINE_EXTRA = {"comparison": (2, "Comparison Table"), "author": (1, "Authors"), "results": (2, "Experimental Results"), "limitations": (3, "Limitations")}
DIRECTIVES = [("bullet points", "bullets"), ("markdown table", "table")]
STYLE_LEAD = r"[.,;]?\s*(?:please\s+)?(?:(?:give|answer|respond|reply|explain|present|show|keep|make|write|format)\s+(?:me\s+)?(?:the\s+)?(?:answers?|it|this|them)?\s*)?(?:in|as|with|for|like)?\s*"
STYLE_FILLER = r"\b(?:in\s+(?:a\s+|an\s+)?)?(?:manner|fashion|format|formatted|form|style)\b"
DANGLING = r"^(?:and|or|in|as|with|for|the|a|an|of|to|me|please)\b[\s,]*|[\s,]*\b(?:and|or|in|as|with|for|the|a|an|of|to)\s*$"
# End of fixed values.
#: How often ends are trimmed: more dangling words than that in a row are left.
TRIMS = 6


def spaced(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def normalise(text: Column, spark=None) -> Column:
    """NFKC, quotes and dashes folded, white space collapsed.  Texts of ASCII alone never leave the engine."""
    if spark is not None:
        ship(spark)

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    t = F.coalesce(text, F.lit(""))
    return spaced(F.translate(compose(t), "".join(FOLDED), "".join(FOLDED.values())))


def any_phrase(low: Column, phrases: list[str]) -> Column:
    hits = [F.contains(low, F.lit(p)) for p in phrases]
    return F.greatest(*hits) if len(hits) > 1 else hits[0]


def canonical(text: Column) -> Column:
    """Words with a canonical spelling in it, all others as they stand."""
    table = F.create_map(*(F.lit(x) for pair in CANONICAL.items() for x in pair))
    return F.array_join(F.transform(F.split(spaced(text), " "), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " ")


def rewrite(text: Column) -> Column:
    """The query and the helper terms of all phrase groups it meets, in order."""
    q = spaced(text)
    low, parts = F.lower(q), [q]
    for phrases, terms in REWRITES:
        parts.append(F.when(any_phrase(low, phrases), " ".join(terms)))
    return F.concat_ws(" ", *parts)


def entities(text: Column) -> Column:
    """Names of a query: tokens of three characters or more that are no scaffolding, in order and distinct."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_.+-]+"), F.lit(0)), lambda t: F.regexp_replace(t, r"^[.,]+|[.,]+$", ""))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(STOP)))


def search_words(text: Column) -> Column:
    """Keywords of a query in lower case, in order and distinct."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-Z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(STOP)))


def hint_sections(intent: Column) -> Column:
    table = F.create_map(*(x for k, v in HINT_SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.try_element_at(table, intent), F.array().cast("array<string>"))


def plan_tokens(text: Column) -> Column:
    """Words of two characters or more without function words, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9\-]+"), F.lit(0)), lambda t: ~t.isin(PLAN_STOP))


def gazetteer(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, entities): of the names (column name) in each query (qid, text) the longest first, none over another, each at its first place; then the query's tags.

    All names are looked up in one pass; a name that begins with a sign is left out."""
    found = mentions(queries.select("qid", "text"), names, letters=r"\p{L}\p{N}", open_end=True)
    first = found.groupBy("qid", "name").agg(F.min(F.struct("at", "span")).alias("x")).select("qid", F.struct((-F.length("name")).alias("long"), "name", F.col("x.at").alias("lo"), (F.col("x.at") + F.col("x.span")).alias("hi")).alias("x"))
    lists = first.groupBy("qid").agg(F.array_sort(F.collect_set("x")).alias("found"))  # names in one query
    start = F.array().cast("array<struct<name:string,lo:bigint,hi:bigint>>")

    def take(acc, x):
        clash = F.exists(acc, lambda y: (y["lo"] < x["hi"]) & (x["lo"] < y["hi"]))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(F.struct(x["name"].alias("name"), x["lo"].alias("lo"), x["hi"].alias("hi")))))

    named = lists.select("qid", F.transform(F.aggregate("found", start, take), lambda x: x["name"]).alias("names"))
    tags = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ENTITY_TAG), F.lit(0))
    rows = queries.select("qid", tags.alias("tags")).join(named, "qid", "left")
    return rows.select("qid", F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")), "tags")).alias("entities")).where(F.size("entities") > 0)


def sides(text: Column, names: Column) -> Column:
    """The two things that `between A and B` or `A vs B` name, else the first two of the names; empty otherwise."""
    pair = None
    for p in (r"(?i)\bbetween\s+(.+?)\s+and\s+(.+?)(?:\?|$)", r"(?i)^(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\?|$)"):
        p = _boundaries(p)
        both = F.array(F.trim(F.regexp_extract(text, p, 1)), F.trim(F.regexp_extract(text, p, 2)))
        pair = F.when(text.rlike(p), both) if pair is None else pair.when(text.rlike(p), both)
    return pair.when(F.size(names) >= 2, F.slice(names, 1, 2)).otherwise(F.array().cast("array<string>"))


def subqueries(text: Column, names: Column) -> Column:
    """Three sub-queries of a query with two sides."""
    s = sides(text, names)
    a, b = F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(2))
    return F.when(F.size(s) == 2, F.array(F.concat(F.lit("What is "), a, F.lit("?")), F.concat(F.lit("What is "), b, F.lit("?")), F.concat(a, F.lit(" "), b, F.lit(" difference comparison")))).otherwise(F.array().cast("array<string>"))


def strip_style(text: Column) -> Column:
    """The query without phrases on the answer's style; the query itself if nothing else is left or it is over-long."""
    out = text
    for _, pattern in [*S.FORMATS, *S.LEVELS, *S.LENGTHS, *S.PERSONAS]:
        out = F.regexp_replace(out, _boundaries(f"(?i){STYLE_LEAD}{pattern}"), " ")
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), r"^[ .,;?-]+|[ .,;?-]+$", "")
    out = tidy(F.regexp_replace(out, _boundaries(f"(?i){STYLE_FILLER}"), " "))
    for _ in range(TRIMS):
        out = tidy(F.regexp_replace(out, _boundaries(f"(?i){DANGLING}"), " "))
    return F.when(F.length(text) > S.LONGEST, text).when(F.trim(out) == "", text).otherwise(out)


def answer_sections(intent: Column, profile: Column) -> Column:
    """The sections of an answer in order; profile: struct(formats, level, length, persona) of answering.profile."""
    table = F.create_map(*(x for k, v in INTENT_SECTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    short = F.coalesce(profile["length"] == "short", F.lit(False))
    deep, walk = F.coalesce(profile["length"].isin("detailed", "walkthrough", "research"), F.lit(False)), F.coalesce(profile["length"].isin("walkthrough", "research"), F.lit(False))
    base = F.when(short, F.array(F.lit("Direct Answer"))).otherwise(F.coalesce(F.try_element_at(table, F.lower(F.coalesce(intent, F.lit("")))), F.array(*map(F.lit, OTHER_SECTIONS))))
    formats = F.transform(F.split(profile["formats"], ","), lambda f: F.try_element_at(F.create_map(*(F.lit(x) for p in FORMAT_SECTIONS.items() for x in p)), f))
    more = F.array(F.when(deep, "Detailed Explanation"), F.when(walk, "Executive Summary"), F.when(walk, "Key Takeaways"), F.when(F.coalesce(profile["persona"] == "teacher", F.lit(False)) & ~short, "Real-World Example"))
    chosen = F.array_compact(F.concat(base, formats, more))
    return F.concat(F.filter(F.array(*map(F.lit, SECTION_ORDER)), lambda s: F.array_contains(chosen, s)), F.array(*map(F.lit, CLOSING)))


def legacy_profile(directives: Column) -> Column:
    """struct(formats, length) of directive sentences."""
    low = F.lower(F.coalesce(directives, F.lit("")))
    formats = F.array_join(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(p)), f) for p, f in DIRECTIVES))), ",")
    length = F.when(F.contains(low, F.lit("under roughly 120 words")) | F.contains(low, F.lit("short")), "short").when(F.contains(low, F.lit("thorough, step-by-step")), "detailed")
    return F.struct(formats.alias("formats"), length.alias("length"))


def resolve(query: Column, topic: Column) -> Column:
    """A short follow-up with the running topic in place of its first pronoun, or before an opener without a subject."""
    low = F.lower(query)
    first = _boundaries(r"(?is)^(.*?)\b(?:" + "|".join(PRONOUNS) + r")\b(.*)$")
    swapped = F.concat(F.regexp_extract(query, first, 1), topic, F.regexp_extract(query, first, 2))
    opens = F.greatest(*(F.startswith(low, F.lit(o)) for o in OPENERS))
    words = F.size(F.filter(F.split(query, r"[ \t\n]+"), lambda w: w != ""))
    same = topic.isNull() | (topic == "") | F.contains(low, F.lower(topic)) | (words > MOST_FOLLOWUP_WORDS)
    return F.when(same, query).when(query.rlike(first), swapped).when(opens, F.concat(topic, F.lit(" "), query)).otherwise(query)


def outline(intent: Column) -> Column:
    """Sections that an answer should cover, with the intent's own at its place."""
    out = F.array(*map(F.lit, OUTLINE))
    for name, (at, section) in OUTLINE_EXTRA.items():
        out = F.when(intent == name, F.array(*map(F.lit, [*OUTLINE[:at], section, *OUTLINE[at:]]))).otherwise(out)
    return out


def must_include(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, items): names in the evidence that hold a term of the query, or lie in one; sorted.
    queries: (qid, text); items: (qid, item)."""
    terms = queries.select("qid", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_.-]+"), F.lit(0))).alias("ts"))
    low = F.lower(F.col("item"))
    rows = items.distinct().join(terms, "qid").where(F.exists("ts", lambda t: F.contains(low, t) | F.contains(t, low)))
    return rows.groupBy("qid").agg(F.array_sort(F.collect_set("item")).alias("items"))


def anchor(queries: DataFrame, nodes: DataFrame, tag: str, fallback: tuple[str, str]) -> DataFrame:
    """(qid, anchor): the first tag, in order of names, that is a node (column id); else the fallback's node where its pattern matches; else null.
    fallback: (pattern, node)."""
    pattern, default = fallback
    rows = queries.select("qid", "text")
    found = rows.select("qid", F.explode(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce("text", F.lit(""))), F.lit(tag), F.lit(0)))).alias("id"))
    named = found.join(nodes.select("id").distinct(), "id", "left_semi").groupBy("qid").agg(F.min("id").alias("named"))
    other = F.when(F.coalesce(F.col("text"), F.lit("")).rlike(f"(?i){pattern}"), default)
    return rows.join(named, "qid", "left").select("qid", F.coalesce("named", other).alias("anchor"))


def planner_queries(asked: DataFrame, titles: DataFrame, templates: list[str], most: int = 6) -> DataFrame:
    """(qid, pos, query): the query, titles of documents that govern its anchor, then templates with {} for the anchor; distinct, `most` at most.
    asked: (qid, text, anchor); titles: (anchor, title)."""
    rows = asked.select("qid", F.col("text").alias("query"), F.lit(0).alias("kind"), F.lit("").alias("by"))
    governed = asked.join(titles.distinct(), "anchor").select("qid", F.col("title").alias("query"), F.lit(1).alias("kind"), F.col("title").alias("by"))
    aspects = asked.where("anchor is not null").select("qid", F.posexplode(F.array(*(F.replace(F.lit(t), F.lit("{}"), F.col("anchor")) for t in templates))).alias("pos", "query"))
    rows = rows.unionByName(governed).unionByName(aspects.select("qid", "query", F.lit(2).alias("kind"), F.lpad(F.col("pos").cast("string"), 4, "0").alias("by")))
    first = rows.groupBy("qid", "query").agg(F.min(F.struct("kind", "by")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at.kind", "at.by", "query")
    return first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most).select("qid", "pos", "query")


def topic_shift(hits: DataFrame, inherited: DataFrame, least: float = 4.0, margin: float = 0.8) -> DataFrame:
    """(qid, shifted): the best hit lies outside the documents inherited from the conversation and clearly beats all inside.
    hits: (qid, doc, score, rank); inherited: (qid, doc)."""
    rows = hits.join(inherited.select("qid", "doc", F.lit(True).alias("inside")), ["qid", "doc"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    best = rows.groupBy("qid").agg(F.max("score").alias("best"), F.max(F.when(F.col("rank") == 0, F.col("inside"))).alias("top_inside"), F.coalesce(F.max(F.when(F.col("inside"), F.col("score"))), F.lit(0.0)).alias("inner_best"))
    return best.select("qid", ((F.col("best") >= least) & ~F.col("top_inside") & (F.col("inner_best") < margin * F.col("best"))).alias("shifted"))
