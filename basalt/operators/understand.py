"""Query understanding: intent, class, plan, profile, decomposition, rewriting, spelling, ambiguity, facets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.runtime import ship, written

# Ordered rules of the specification.
CLASS_RULES = [
    ("comparison", [r"\bdifference between\b", r"\bcompare\b", r"\bversus\b", r"\bvs\.?\b", r"\bbetter than\b"]),
    ("debugging", [r"\berror\b", r"\bexception\b", r"\bfix\b", r"\bnot working\b", r"\btraceback\b", r"\bdebug\b"]),
    ("sql", [r"\bsql\b", r"\bselect\s+.*\bfrom\b", r"\bjoin\b.*\btable\b"]),
    ("coding", [r"\bcode\b", r"\bimplement\b", r"\bwrite a\b.*\b(function|class|script)\b", r"\bsnippet\b"]),
    ("mathematics", [r"\bderiv(e|ation)\b", r"\bproof\b", r"\bequation\b", r"\bformula\b", r"\btheorem\b"]),
    ("calculation", [r"\bcalculate\b", r"\bhow (much|many)\b", r"\bcompute\b"]),
    ("architecture", [r"\barchitecture\b", r"\bdesign of\b", r"\bcomponents? of\b", r"\bhow .* structured\b"]),
    ("summarization", [r"\bsummar(y|ize|ise)\b", r"\btl;?dr\b", r"\bin short\b"]),
    ("multi_hop", [r"\band (then|also)\b.*\?.*\?", r"\bfirst\b.*\bthen\b.*\?"]),
    ("reasoning", [r"^why\b", r"\bwhy (was|is|are|did|does)\b", r"\breason for\b", r"\bneed (of|for)\b", r"\bmotivation\b"]),
    ("procedure", [r"^how (do|to|can)\b", r"\bsteps? to\b", r"\bprocedure\b", r"\bguide\b"]),
    ("fact_lookup", [r"^(who|when|where)\b", r"\bwhat year\b", r"\bhow old\b"]),
    ("definition", [r"^what (is|are)\b", r"\bdefine\b", r"\bmeaning of\b", r"\bdefinition\b"]),
    ("research", [r"\bstate of the art\b", r"\bliterature\b", r"\bsurvey\b", r"\bpapers?\b"]),
    ("documentation", [r"\bdocs?\b", r"\bdocumentation\b", r"\bapi reference\b"]),
    ("interview", [r"\binterview\b", r"\bquestions? for\b.*\binterview\b"]),
    ("case_study", [r"\bcase study\b", r"\breal[- ]world example\b"]),
]
DEFAULT_CLASS = "explanation"
PLANS = {
    "comparison": ("dense,bm25,graph", 8, True, "hybrid+aspects"), "reasoning": ("dense,bm25,graph", 8, True, "hybrid+facets"),
    "multi_hop": ("dense,bm25,graph", 10, True, "iterative"), "fact_lookup": ("bm25,dense", 4, False, "precise"), "coding": ("bm25,dense", 6, False, "exact-symbol"),
    "debugging": ("bm25,dense", 8, False, "troubleshooting"), "summarization": ("dense", 10, False, "broad"),
}
DEFAULT_PLAN = ("dense,bm25", 6, False, "hybrid")
COMPARISON_PHRASES = ["difference between", "differences between", "compare", "comparison", " versus ", " vs ", "better than", "different from", "similarities between"]
INTENT_GROUPS = [
    ("reasoning", ["why", "reason", "because", "cause"]),
    ("results", ["result", "results", "performance", "accuracy", "evaluation", "benchmark", "experiment"]),
    ("methodology", ["method", "approach", "pipeline", "workflow", "architecture", "algorithm"]),
    ("limitations", ["future", "limitation", "limitations", "drawback", "weakness", "challenge"]),
    ("conclusion", ["conclusion", "summary", "takeaway"]),
    ("citation", ["citation", "reference", "bibliography"]),
    ("figure", ["figure", "table", "chart", "diagram"]),
    ("equation", ["equation", "formula", "proof", "theorem"]),
    ("implementation", ["code", "implementation", "example", "sample"]),
]
INTENT_RULES = [
    ("definition", ["what is", "what are", "what're", "what's", "define", "meaning", "explain"]),
    ("author", ["author", "authors", "contributor", "contributors", "who proposed", "who wrote", "who developed"]),
    ("comparison", ["compare", "difference", "versus", "vs"]),
    ("methodology", ["method", "approach", "architecture", "pipeline", "algorithm", "workflow"]),
    ("results", ["result", "results", "performance", "accuracy", "evaluation", "benchmark"]),
    ("limitations", ["limitation", "limitations", "drawback", "weakness", "future work"]),
    ("implementation", ["implementation", "code", "example"]),
    ("summary", ["summary", "overview"]),
    ("citation", ["citation", "reference", "bibliography"]),
    ("figure", ["figure", "table", "diagram", "chart"]),
]
FACETS = {
    "reasoning": [
        ("problem or need", ["problem", "need", "challenge", "motivation", "limitation"]),
        ("prior approaches and limits", ["previous", "prior", "before", "traditional", "rnn", "drawback", "limitation"]),
        ("proposed solution", ["solution", "propose", "introduce", "approach", "instead"]),
        ("advantages", ["advantage", "benefit", "improve", "faster", "better", "enable"]),
    ],
    "comparison": [("definition of {A}", []), ("definition of {B}", []), ("differences", ["difference", "unlike", "whereas", "contrast", "compared"])],
    "procedure": [("steps", ["step", "first", "then", "next", "finally", "procedure"]), ("prerequisites", ["require", "prerequisite", "before", "must", "ensure"])],
    "definition": [("definition", ["is a", "refers to", "defined", "means"]), ("purpose or example", ["used for", "purpose", "example", "allows", "enables"])],
    "default": [("direct evidence", [])],
}
POLICY = (0.90, 0.70, 2)
ASPECTS = [
    r"\bbetween\s+(.+?)\s+and\s+(.+?)(?:\?|$)",
    r"\bcompare\s+(.+?)\s+(?:with|and|to)\s+(.+?)(?:\?|$)",
    r"^(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\?|$)",
    r"\bdifference\s+(?:between\s+)?(.+?)\s+and\s+(.+?)(?:\?|$)",
    r"\bhow\s+(?:is|are|do|does)\s+(.+?)\s+differ(?:ent)?\s+from\s+(.+?)(?:\?|$)",
    r"\b(\S+(?:\s+\S+)?)\s+(?:is|are)?\s*differ(?:s|ent)?\s+from\s+(.+?)(?:\?|$)",
]
ASPECT_QUERIES = ["{A}", "{B}", "{A} definition purpose architecture", "{B} definition purpose architecture", "{A} {B} comparison difference"]
SPELL = {"long": 6, "shortest": 4, "least": 0.60, "other_first_letter": 0.5, "distance_weight": 0.75, "frequency_weight": 0.25}
PROTECTED = [
    r"https?://\S+|www\.\S+", r"\"[^\"]*\"|'[^']*'|`[^`]*`", r"\b\S+\.(?:py|md|pdf|json|yaml|yml|txt|csv|js|ts|ipynb)\b", r"\b[A-Z]{1,4}-\d+\b",
    r"\b\w+(?:_\w+)+\b|\b[a-z]+(?:[A-Z]\w+)+\b|\b[A-Z][a-z0-9]+(?:[A-Z]\w+)+\b|\b\w+\.\w+(?:\.\w+)*\(?", r"\b[A-Z]{2,6}s?\b", r"\b\d[\w.\-]*\b",
]
# End of fixed values.


_boundaries = T.ascii_boundaries


def intent(q: Column) -> Column:
    """First rule group with a phrase in the query; comparison phrases come before all."""
    t = F.lower(F.trim(F.coalesce(q, F.lit(""))))
    any_of = lambda words: F.greatest(*(F.contains(t, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(t, F.lit(words[0]))
    out = F.when(any_of(COMPARISON_PHRASES), "comparison")
    for name, words in [*INTENT_GROUPS, *INTENT_RULES]:
        out = out.when(any_of(words), name)
    return out.otherwise("general")


def classify(q: Column) -> tuple[Column, Column]:
    """(label, confidence): the first rule with a matching pattern; .75 and .1 for each further one, .95 at most; else .4.

    The text is brought into shape once and every pattern is tried once: both are bound before label and confidence are read from the rules' counts."""
    t = F.lower(F.array_join(F.filter(F.split(F.coalesce(q, F.lit("")), r"[ \t\n]+"), lambda w: w != ""), " "))
    names = F.array(*(F.lit(name) for name, _ in CLASS_RULES))

    def counts(x: Column) -> Column:
        return F.array(*(sum((x.rlike(_boundaries(p)).cast("int") for p in patterns), F.lit(0)) for _, patterns in CLASS_RULES))

    def judged(ns: Column) -> Column:
        first = F.array_position(F.transform(ns, lambda n: n > 0), True).cast("int")
        sure = F.least(F.lit(0.95), 0.75 + 0.1 * (F.element_at(ns, F.greatest(first, F.lit(1))) - 1))
        return F.struct(F.when(first > 0, F.element_at(names, F.greatest(first, F.lit(1)))).otherwise(DEFAULT_CLASS).alias("label"), F.round(F.when(first > 0, sure).otherwise(0.4), 2).alias("confidence"))

    out = F.element_at(F.transform(F.transform(F.array(t), counts), judged), 1)
    return out["label"], out["confidence"]


def plan(label: Column) -> Column:
    """struct(legs, k, decompose, strategy) of a class."""
    entry = lambda p: F.struct(F.lit(p[0]).alias("legs"), F.lit(p[1]).alias("k"), F.lit(p[2]).alias("decompose"), F.lit(p[3]).alias("strategy"))
    out = None
    for name, p in PLANS.items():
        out = F.when(label == name, entry(p)) if out is None else out.when(label == name, entry(p))
    return out.otherwise(entry(DEFAULT_PLAN))


def aspects(q: Column) -> Column:
    """Both sides of a comparison, without articles; empty if it is none."""
    t = F.trim(F.coalesce(q, F.lit("")))
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), r"(?i)^(the|a|an)\s+", ""))
    out = None
    for p in ASPECTS:
        p = "(?i)" + _boundaries(p)
        pair = F.array(bare(F.regexp_extract(t, p, 1)), bare(F.regexp_extract(t, p, 2)))
        out = F.when(t.rlike(p), pair) if out is None else out.when(t.rlike(p), pair)
    return out.otherwise(F.array().cast("array<string>"))


def decompose(q: Column) -> Column:
    """The query, its parts around comparing words (if it compares), `and` and `because`, over four characters, then a query
    for each aspect of a comparison; in order and distinct."""
    low, none = F.lower(q), F.array().cast("array<string>")
    long = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: F.length(p) > 4)
    # The comparing words themselves count as parts.
    marked = F.split(F.regexp_replace(low, _boundaries(r"\b(compare|vs|versus|and)\b"), "\u001f$1\u001f"), "\u001f")
    compared = F.when(intent(q) == "comparison", long(marked)).otherwise(none)
    split = lambda word: F.when(F.contains(low, F.lit(word)), long(F.split(low, word))).otherwise(none)
    both = aspects(q)
    a, b = F.try_element_at(both, F.lit(1)), F.try_element_at(both, F.lit(2))
    more = F.when(F.size(both) == 2, F.array(*(F.replace(F.replace(F.lit(t), F.lit("{A}"), a), F.lit("{B}"), b) for t in ASPECT_QUERIES))).otherwise(none)
    first = F.array_distinct(F.concat(F.array(q), compared, split(" and "), split(" because ")))
    known = F.transform(first, F.lower)
    return F.concat(first, F.filter(F.array_distinct(more), lambda x: ~F.array_contains(known, F.lower(x))))


def policy(coverage: Column, iteration: Column) -> Column:
    """ANSWER, NOTE, RETRY or INSUFFICIENT."""
    sure, note, retries = POLICY
    return F.when(coverage > sure, "ANSWER").when(coverage >= note, "NOTE").when(iteration < retries, "RETRY").otherwise("INSUFFICIENT")


def facets(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, facet, covered) for queries (qid, label, a, b) and evidence (qid, text).

    {A} and {B} stand for the query's first two names (a, b); a facet whose name is missing is left out.  A facet
    is covered if one of its terms, or a name bound into it, stands in the evidence; without terms its own words count."""
    from basalt.operators.query import plan_tokens

    rows = [(label, name, terms) for label, items in FACETS.items() for name, terms in items]
    table = queries.sparkSession.createDataFrame(rows, "label string, name string, terms array<string>")
    a, b = F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))
    asked = queries.withColumn("label", F.when(F.col("label").isin(list(FACETS)), F.col("label")).otherwise("default")).join(F.broadcast(table), "label")  # a few fixed rows
    asked = asked.where(~(F.contains("name", F.lit("{A}")) & (a == "")) & ~(F.contains("name", F.lit("{B}")) & (b == "")))
    asked = asked.withColumn("facet", F.replace(F.replace("name", F.lit("{A}"), a), F.lit("{B}"), b))
    bound = lambda x: F.when((x != "") & F.contains(F.lower("facet"), F.lower(x)), F.array(x)).otherwise(F.array().cast("array<string>"))
    terms = F.concat("terms", bound(a), bound(b))
    asked = asked.withColumn("terms", F.when(F.size(terms) > 0, terms).otherwise(plan_tokens(F.col("facet"))))
    told = evidence.select("qid", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    hit = F.exists("terms", lambda w: F.regexp_like(F.col("t"), F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.lower(w), F.lit(r"\E([^a-z0-9]|$)"))))
    return asked.join(told, "qid", "left").groupBy("qid", "facet").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("covered"))


def facet_ratio(covered: DataFrame) -> DataFrame:
    """(qid, facets, ratio): share of the facets that are covered."""
    return covered.groupBy("qid").agg(F.count("*").alias("facets"), F.round(F.avg(F.col("covered").cast("double")), 3).alias("ratio"))


def ambiguous(queries: DataFrame, concepts: DataFrame, most_tokens: int = 3, least: int = 3, most: int = 6) -> DataFrame:
    """(qid, token, options) of short queries with a word that many concepts of several words share, of which the query names none.
    queries: (qid, text); concepts: (concept)."""
    words = concepts.distinct().select("concept", F.explode(F.array_distinct(F.split(F.lower("concept"), " "))).alias("token")).where(F.contains("concept", F.lit(" ")))
    asked = queries.select("qid", F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.array_distinct(T.query_terms(F.col("text"))).alias("ts")).where(F.size("ts") <= most_tokens)
    rows = asked.select("qid", "low", F.explode("ts").alias("token")).join(words, "token").where(~F.contains(F.col("low"), F.lower("concept")))
    order = Window.partitionBy("qid", "token").orderBy("concept")
    shown = F.array_join(F.array_sort(F.collect_list(F.when(F.col("i") <= most, F.col("concept")))), "|")
    return rows.withColumn("i", F.row_number().over(order)).groupBy("qid", "token").agg(F.count("*").alias("n"), shown.alias("options")).where(F.col("n") >= least).select("qid", "token", "options")


def deletions(word: Column, depth: int = 2) -> Column:
    """The word and its forms with one letter taken out, and with two where it is long and depth is 2."""

    def less(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, made).otherwise(F.array().cast("array<string>"))

    one = less(word)
    if depth == 1:
        return F.array_distinct(F.concat(F.array(word), one))
    two = F.when(F.length(word) >= SPELL["long"], F.flatten(F.transform(one, less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def osa(a: str, b: str) -> int:
    """Edits, insertions, deletions and swaps of neighbours between two words (optimal string alignment)."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


def spell_candidates(words: DataFrame, vocabulary: DataFrame, depth: int = 2) -> DataFrame:
    """(word, term, freq) that share a deletion form: an equi-join, no pairs of all words.
    words: (word); vocabulary: (term, freq)."""
    return _sharing(words, vocabulary, depth).select("word", "term", "freq").distinct()


def _sharing(words: DataFrame, vocabulary: DataFrame, depth: int) -> DataFrame:
    known = vocabulary.select("term", "freq", F.explode(deletions(F.col("term"), depth)).alias("form"))
    return words.select("word").distinct().select("word", F.explode(deletions(F.col("word"), depth)).alias("form")).join(known, "form")


def corrections(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, term, distance, confidence): the best spelling of each word of four letters or more that the vocabulary lacks.

    Distance by `osa`, at most 1, or 2 for long words; the nearest wins (half more if the first letter differs), ties by
    frequency and then by term; confidence .75 (1 - d / length) + .25 of the logarithmic share of the frequency."""
    ship(vocabulary.sparkSession)
    total = vocabulary.agg(F.max("freq").alias("top"))
    lone = words.select("word").distinct().join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti").where(F.length("word") >= SPELL["shortest"])
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    same = letters(F.col("word")) == letters(F.col("term"))
    swap = lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.lit(1)), F.substring("word", i, F.lit(1)), F.substring("word", i + 2, F.length("word")))
    swapped = (F.length("word") == F.length("term")) & same & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - 1)), lambda i: swap(i) == F.col("term"))

    def measured(rows: DataFrame, most: int) -> DataFrame:
        return rows.withColumn("edits", F.levenshtein("word", "term", most)).where("edits > 0")

    # One edit first: whatever lies nearer wins, so words that have such a spelling need no others.
    one = measured(_sharing(lone, vocabulary, 1), 2).where((F.col("edits") == 1) | swapped).select("word", "term", "freq", F.lit(1).alias("distance")).distinct()
    one = written(one, "spell-near")
    rest = lone.where(F.length("word") >= SPELL["long"]).join(one.select("word").distinct(), "word", "left_anti")

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    # Two edits; beyond two plain ones only with swaps, whose letters are nearly the same: few pairs ever leave the engine.
    far = measured(_sharing(rest, vocabulary, 2), 4).where((F.col("edits") <= 2) | (F.levenshtein(letters(F.col("word")), letters(F.col("term"))) <= 2)).select("word", "term", "freq", "edits").distinct()
    two = far.where("edits <= 2").select("word", "term", "freq", F.lit(2).alias("distance")).unionByName(far.where("edits > 2").withColumn("distance", distance("word", "term")).where("distance = 2").select("word", "term", "freq", "distance"))
    rows = one.unionByName(two)
    adjusted = F.col("distance") + F.when(F.substring("word", 1, 1) == F.substring("term", 1, 1), 0.0).otherwise(SPELL["other_first_letter"])
    order = Window.partitionBy("word").orderBy(adjusted, F.desc("freq"), "term")
    best = rows.withColumn("i", F.row_number().over(order)).where("i = 1").crossJoin(F.broadcast(total))  # one row
    conf = SPELL["distance_weight"] * (1 - F.col("distance") / F.length("word")) + SPELL["frequency_weight"] * F.log(1 + F.col("freq")) / F.log(1 + F.col("top"))
    return best.withColumn("confidence", F.round(conf, 3)).where(F.col("confidence") >= SPELL["least"]).select("word", "term", F.col("distance").cast("bigint").alias("distance"), "confidence")


def pieces(text: Column) -> Column:
    """A text cut into protected spans (addresses, quotations, file names, ids, code, acronyms, numbers), words and all else; joined they give the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)(?:" + "|".join(PROTECTED) + r")|[A-Za-z]+|[^A-Za-z]"), F.lit(0))


def correct_texts(texts: DataFrame, vocabulary: DataFrame, own: dict[str, str] | None = None) -> DataFrame:
    """(qid, corrected, changes): texts (qid, text) with misspelled words put right; own: a user's dictionary, which goes first.

    Words of the vocabulary, short words and protected spans stay; a capital first letter is kept."""
    rows = texts.select("qid", F.posexplode_outer(pieces(F.col("text"))).alias("pos", "piece")).withColumn("word", F.when(F.col("piece").rlike("^[A-Za-z]+$") & ~F.col("piece").rlike("^(?:" + "|".join(PROTECTED) + ")$"), F.lower("piece")))
    own = own or {}
    fixed = corrections(rows.where("word is not null").select("word").distinct().where(~F.col("word").isin(list(own) or [""])), vocabulary).select("word", "term")
    table = F.create_map(*(F.lit(x) for pair in own.items() for x in pair)) if own else F.create_map().cast("map<string,string>")
    mine = F.try_element_at(table, F.col("word"))
    cased = F.when(F.col("piece").rlike("^[A-Z]"), F.initcap("term")).otherwise(F.col("term"))
    rows = rows.join(fixed, "word", "left").withColumn("new", F.coalesce(mine, cased, F.col("piece"))).withColumn("changed", F.col("term").isNotNull() & mine.isNull())
    out = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("ps"), F.count_if("changed").alias("changes"))  # one text's pieces
    return out.select("qid", F.array_join(F.transform("ps", lambda x: x["new"]), "").alias("corrected"), "changes")
