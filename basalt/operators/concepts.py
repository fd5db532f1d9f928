"""Concepts of documents: found by their form, kept by how many chunks hold them, and looked up in texts, all of them in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators import index as I
from basalt.runtime import written

# Forms of concept names and words that are none.
WORD = r"[A-Za-z][A-Za-z0-9+.#-]*"
ACRONYM = r"^[A-Z]{2,6}s?$"
PASCAL = r"^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+$"
CAMEL = r"^[a-z]{2,}(?:[A-Z][a-z0-9]+)+$"
CODE = r"^[A-Za-z][A-Za-z0-9]*\.[A-Za-z][A-Za-z0-9.]*$"
TITLE = r"^[A-Z][a-z]{2,}$"
SITES = [".com", ".org", ".net", ".io"]
NO_CONCEPT = [
    "the", "and", "for", "with", "this", "that", "these", "those", "from", "when", "where", "which", "what", "how", "why", "you", "your", "our", "they", "their",
    "his", "her", "but", "such", "each", "any", "all", "some", "more", "most", "other", "one", "two", "use", "used", "using", "via", "per", "also", "here", "there",
    "see", "new", "like", "etc", "get", "set", "let", "however", "every", "true", "false", "real", "build", "building", "code", "project", "practical", "yourself",
    "larger", "worked", "going", "deeper", "deep", "key", "common", "takeaways", "pitfall", "pitfalls", "practice", "exercise", "interview", "questions", "question",
    "design", "overview", "summary", "introduction", "conclusion", "contents", "appendix", "guide", "book", "plan", "basics", "basic", "advanced", "chapter", "section",
    "part", "step", "page", "figure", "table", "example", "note", "first", "second", "next", "before", "after", "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december", "because", "therefore", "thus", "hence", "while", "since", "although", "whereas", "moreover",
    "furthermore", "additionally", "finally", "given", "unlike", "instead", "meanwhile",
]
TOP = 12
# End of fixed values.
#: Words of lower-case letters alone, with what stands between them and behind; bounded, as Java's repeats of groups are nested calls.
RUN = r"(?:[a-z]++(?![A-Za-z0-9+.#-])[^A-Za-z]*+){1,32}"


def is_name(w: Column) -> Column:
    """Does a word look like the name of something: an acronym, two humps, or a code identifier?"""
    site = F.lower(w).startswith("www.")
    for tail in SITES:
        site = site | F.lower(w).endswith(tail)
    likely = (F.lower(w) != w) | F.contains(w, F.lit("."))  # every form has a capital letter or a dot; most words have none
    return likely & (F.length(w) >= 3) & ~site & (w.rlike(ACRONYM) | w.rlike(PASCAL) | w.rlike(CAMEL) | (w.rlike(CODE) & (F.length(w) >= 5)))


def names_in(words: Column) -> Column:
    """Distinct names and pairs of capitalised words in a chunk's words (words_of).  A run is neither: it begins in lower case and holds a sign that no name has."""
    plain = lambda w: w.rlike(TITLE) & ~F.lower(w).isin(NO_CONCEPT)
    # Each word beside the next one: the pair where both are plain, else null.
    high = lambda w: (w >= "A") & (w < "[")
    pair = lambda a, b: F.when(high(a) & high(b), F.when(plain(a) & plain(b), F.concat(a, F.lit(" "), b)))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), pair)
    return F.array_distinct(F.concat(F.filter(words, is_name), F.filter(pairs, lambda p: p.isNotNull())))


def words_of(text: Column) -> Column:
    """A chunk's words in order, as names are made of; runs of lower-case ones, which are most of a text, come as one.  A column of its own, else each use cuts the text again."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{RUN}|{WORD}"), F.lit(0))


def candidates(text: Column) -> Column:
    """names_in() of a chunk."""
    return names_in(words_of(text))


def extract(chunks: DataFrame, doc: str = "doc", text: str = "text", top: int = TOP) -> DataFrame:
    """(doc, concept, df, score, place): the concepts of each document, best first.

    df counts the document's chunks that hold one; documents of three chunks or more ask for two.  Single words that are
    part of a kept pair are left out, pairs score one more than their df, ties go by name."""
    rows = chunks.select(F.col(doc).alias("doc"), words_of(F.col(text)).alias("words")).select("doc", names_in(F.col("words")).alias("found"))
    n = rows.groupBy("doc").agg(F.count("*").alias("chunks"))
    df = rows.select("doc", F.explode_outer("found").alias("concept")).where("concept is not null").groupBy("doc", "concept").agg(F.count("*").alias("df"))
    kept = written(df.join(n, "doc").where(F.col("df") >= F.when(F.col("chunks") >= 3, 2).otherwise(1)).drop("chunks"), "concepts")  # read twice, and texts once
    pair = F.contains("concept", F.lit(" "))
    inside = kept.where(pair).select("doc", F.explode(F.split("concept", " ")).alias("concept")).distinct()
    scored = kept.join(inside.withColumn("inside", F.lit(True)), ["doc", "concept"], "left").where(pair | F.col("inside").isNull()).withColumn("score", F.col("df") + F.when(pair, 1.0).otherwise(0.0))
    order = Window.partitionBy("doc").orderBy(F.desc("score"), "concept")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("doc", "concept", "df", "score", "place")


LETTERS = r"\p{L}\p{N}_"


def mentions(rows: DataFrame, names: DataFrame, by: tuple[str, ...] = (), letters: str = LETTERS, open_end: bool = False) -> DataFrame:
    """(rows' columns but text, name, at, span): each place where a name stands in a text as whole words, case aside.

    Texts are cut before every word.  Of the words only those that begin a name go on, with just as much of the text behind them as the longest name has
    words; they meet the names by as many whole words as a name has (and by the columns `by`, which both tables then have: a group's names are few, and stand beside
    its texts), so however many names there are or begin alike, a text is read once and what meets is nearly a mention.  at: the place of the first word, counted
    in words; span: how many words the name has.  A name ends where a word does; one that ends in a sign ends where a word begins, or anywhere with open_end.
    Names that begin with a sign are left out."""
    cut, first = rf"(?<![{letters}])(?=[{letters}])", rf"^[{letters}]+"
    head = lambda c: F.lower(F.regexp_extract(c, first, 0))
    key = F.lower(F.regexp_replace("name", rf"[^{letters}]+$", ""))
    known = names.select(*by, "name").distinct().withColumn("word", head(F.col("name"))).where("word <> ''")
    known = written(known.withColumn("span", F.size(F.split("name", cut))).withColumn("key", key), "names")
    spans = sorted(r["span"] for r in known.select("span").distinct().collect())  # numbers of words, no names
    keys = [c for c in rows.columns if c != "text"]
    begin = known.select(*by, "word").distinct()
    longest = max(spans, default=1)
    parts = rows.where("text is not null")
    if by:
        parts = parts.join(begin.groupBy(*by).agg(F.collect_set("word").alias("begin")), list(by))  # one group's names
    parts = parts.select(*keys, *(["begin"] if by else []), F.split("text", cut).alias("ps"))
    if by:
        places = F.filter(F.transform("ps", lambda p, i: F.when(F.array_contains("begin", head(p)), i)), lambda i: i.isNotNull())
        each = parts.select(*keys, "ps", F.explode_outer(places).alias("at")).where("at is not null")
    else:
        each = parts.select(*keys, "ps", F.explode(F.sequence(F.lit(0), F.size("ps") - 1)).alias("at"))
    words = each.select(*keys, "at", head(F.element_at("ps", F.col("at") + 1)).alias("word"), F.slice("ps", F.col("at") + 1, F.lit(longest + 1)).alias("ps")).where("word <> ''")
    words = words if by else words.join(I.held(begin), "word", "left_semi")
    whole = lambda n: F.lower(F.concat(F.array_join(F.slice("ps", 1, n - 1), ""), F.regexp_extract(F.element_at("ps", F.lit(n)), first, 0)))
    runs = F.array(*(F.when(F.size("ps") >= n, F.struct(F.lit(n).alias("span"), whole(n).alias("key"))) for n in spans or [1]))
    there = F.lower(F.array_join("ps", "")).alias("there")
    keyed = words.select(*keys, "at", there, F.explode_outer(F.filter(runs, lambda r: r.isNotNull())).alias("r")).where("r is not null").select(*keys, "at", "there", "r.span", "r.key")
    met = keyed.join(I.held(known.drop("word")), [*by, "span", "key"])
    n = F.length("name")
    behind, last = F.substring("there", n + 1, F.lit(1)), F.substring("name", n, F.lit(1))
    is_letter = lambda c: c.rlike(f"[{letters}]")
    ends = ~is_letter(behind) if open_end else F.when(is_letter(last), ~is_letter(behind)).otherwise(is_letter(behind))
    return met.where(F.startswith("there", F.lower("name")) & ends).select(*keys, "name", F.col("at").cast("bigint").alias("at"), F.col("span").cast("bigint").alias("span"))


def presence(chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc, pos, concept): which of its document's concepts (doc, concept) each chunk (doc, pos, text) holds."""
    found = mentions(chunks.select("doc", "pos", "text"), concepts.select("doc", F.col("concept").alias("name")), by=("doc",))
    return found.select("doc", "pos", F.col("name").alias("concept")).distinct()


def chunk_entities(tags: DataFrame, present: DataFrame) -> DataFrame:
    """(doc, pos, entities): tags (doc, pos, tag) and concepts (doc, pos, concept) of each chunk that has any, sorted and distinct."""
    both = tags.select("doc", "pos", F.col("tag").alias("entity")).unionByName(present.select("doc", "pos", F.col("concept").alias("entity")))
    return both.groupBy("doc", "pos").agg(F.array_sort(F.collect_set("entity")).alias("entities"))  # what one chunk holds


def document_entities(tags: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc, mentions): sorted distinct union of a document's tags (doc, pos, tag) and concepts (doc, concept)."""
    both = tags.select("doc", F.col("tag").alias("m")).unionByName(concepts.select("doc", F.col("concept").alias("m")))
    return both.groupBy("doc").agg(F.array_sort(F.collect_set("m")).alias("mentions"))  # what one document mentions
