"""Text functions as Column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists whose results must agree with the specification.
TOKEN = r"[a-z0-9][a-z0-9\-./·°]*"
KEYWORD = r"[A-Za-z][A-Za-z0-9\-]+"
TAG = r"\b(?:[A-Z]{1,3}-\d{2,3}|SAF-\d+|SOP-\d+|BRG-\d+|MS-\d+|CE-\d+|WO-\d+|MCC-\d-\d+|HS-\d+)\b"
KEYWORD_STOP = (
    "the and for with this that from into their using used have has were been being will shall would should about than also such "
    "there these those your they them then which where when what does each other more most very"
).split()
QUERY_STOP = "what is are the a an of in on for to and or do does how i we me my it be can should need about with this that there use used why when which please tell".split()
# End of fixed values.


def ascii_boundaries(pattern: str) -> str:
    """Word boundaries that mean ASCII letters, digits and underscore, as on any engine; beside a letter one look suffices."""
    pattern = re.sub(r"\\b(?=[A-Za-z0-9])", "(?<![A-Za-z0-9_])", pattern)
    pattern = re.sub(r"(?<!\\)([A-Za-z0-9])\\b", r"\1(?![A-Za-z0-9_])", pattern)
    return pattern.replace(r"\b", r"(?:^|$|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def lines(text: Column) -> Column:
    """Lines of a text that are not blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def singular(w: Column) -> Column:
    """A cautious English singular; words that are short, mixed with other signs or end like `class` stay.

    Only words in -s can change, so the tests after the first one are rarely made."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    ends = lambda *tails: reduce(or_, (w.endswith(t) for t in tails))
    changes = w.endswith("s") & (n > 3) & ~ends("ss", "us", "is") & w.rlike("^[a-z]+$")
    short = F.when(w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(ends("ses", "xes", "zes", "ches", "shes"), cut(2)).otherwise(cut(1))
    return F.when(changes, short).otherwise(w)


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens as they stand; a compound with hyphens also gives its alphabetic parts of three letters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))

    def expand(t: Column) -> Column:
        parts = F.filter(F.split(t, "-"), lambda p: (F.length(p) >= 3) & p.rlike("^[a-z]+$"))
        return F.concat(F.array(t), F.when(F.contains(t, F.lit("-")), parts).otherwise(F.array().cast("array<string>")))

    return F.when(F.contains(text, F.lit("-")), F.flatten(F.transform(found, expand))).otherwise(found)


def tokens(text: Column) -> Column:
    """raw_tokens in singular."""
    return F.transform(raw_tokens(text), singular)


def query_terms(text: Column) -> Column:
    """Distinct tokens of a query without function words."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, QUERY_STOP)))


def keyword_words(text: Column) -> Column:
    """Words in order, of which keywords are those that is_keyword() lets."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(KEYWORD), F.lit(0))


def is_keyword(w: Column) -> Column:
    return (F.length(w) > 2) & ~w.isin(KEYWORD_STOP)


def keywords(text: Column) -> Column:
    """Keyword candidates in order, repeats included."""
    return F.filter(keyword_words(text), is_keyword)


def tags(text: Column) -> Column:
    """Equipment, part and document tags, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TAG), F.lit(0))))


def summary(text: Column, limit: int = 250) -> Column:
    """First line that is not blank, cut at the limit with three dots."""
    first = F.try_element_at(lines(text), F.lit(1))
    return F.coalesce(F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit), F.lit("..."))).otherwise(first), F.lit(""))


def prose_factor(text: Column) -> Column:
    """Share of lines with eight words or more; 0 for tables of contents, reference lists and address lists."""
    ls = lines(text)
    n = F.size(ls)
    share = lambda pattern: F.size(F.filter(ls, lambda x: x.rlike(pattern))) / n
    long = F.size(F.filter(ls, lambda x: F.size(F.filter(F.split(x, r"[ \t]+"), lambda w: w != "")) >= 8))
    bad = (share(r"\.{3,}[ \t]*[0-9]+[ \t]*$") > 0.30) | (share(r"^\[[0-9]+\][ \t]") > 0.25) | (share(r"[^ \t]+@[^ \t]+\.[^ \t]+") > 0.15)
    return F.when(n == 0, F.lit(0.0)).when(bad, F.lit(0.0)).otherwise(long / n)


def slug(text: Column, limit: int = 40) -> Column:
    """Upper case, runs of other signs become a hyphen, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "-"), "^-+|-+$", ""), 1, limit)


def doc_no(text: Column, limit: int = 40) -> Column:
    """Identifier of an upload."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "-"), 1, limit)


def norm_id(text: Column) -> Column:
    """Identifier reduced to letters and digits, for alias resolution."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\.pdf$", ""), "[^a-z0-9]+", "")


def parts_of(text: Column) -> Column:
    """Part numbers of a list such as `BRG-204 x2; MS-7`, without counts and empty entries."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.trim(F.regexp_replace(x, r"(?i)\s+x\s*[0-9]+\s*$", "")))
    return F.filter(items, lambda x: (x != "") & ~F.lower(x).isin("none", "n/a", "nil", "-"))


def parse_date(text: Column) -> Column:
    """A date from ISO, day-first or named-month notations; the first that fits, else null."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(F.trim(text), F.lit(p))) for p in ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy")))


def clip(text: Column, limit: int) -> Column:
    """Cut at the limit, at the last end of a sentence if that keeps two fifths, else at a word."""
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*(?:\.[ \n]|[!?] ))", 1)
    kept = F.substring(sentence, F.lit(1), F.length(sentence) - 1)
    word = F.concat(F.regexp_replace(head, r"(?s)(.) [^ ]*$", "$1"), F.lit(" …"))
    return F.when(F.length(text) <= limit, text).when((sentence != "") & (F.length(sentence) - 2 >= int(limit * 0.4)), kept).otherwise(word)


def title_from(text: Column, limit: int = 60) -> Column:
    """Short title of a conversation from its first question, without one leading courtesy."""
    line = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n]+"), lambda w: w != ""), " ")
    bare = F.trim(F.regexp_replace(line, r"(?i)^(please|hey|hi|hello|can you|could you|tell me) +", ""))
    line = F.when(bare == "", line).otherwise(bare)
    cut = F.when(F.length(line) > limit, F.concat(F.regexp_replace(F.substring(line, 1, limit), r"(.) [^ ]*$", "$1"), F.lit("…"))).otherwise(line)
    return F.when(cut == "", F.lit("New conversation")).otherwise(F.concat(F.upper(F.substring(cut, 1, 1)), F.substring(cut, F.lit(2), F.length(cut))))


def sentences(text: Column) -> Column:
    """Sentences, split behind . ! ? and at line ends."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t]+|\n+"), lambda x: F.trim(x)), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n]+"), lambda w: w != ""))
