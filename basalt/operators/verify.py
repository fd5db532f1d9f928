"""Answer checking: claims, support, numbers, citations, coverage, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T

# Bands and weights of the specification.
SUPPORTED, PARTLY, NUMERIC_CAP = 0.70, 0.45, 0.65
COVERAGE = (0.65, 0.25, 0.10)
FORMAT_LOSS, VALID = 0.15, 0.70
TAILS = [r"##?\s*General Knowledge\s*\(Not from Retrieved Documents\)", r"##?\s*Sources"]
DROPPED_SECTIONS = r"^##?\s*(Limitations|Suggested Follow-up Questions?)[ \t]*(\n|$)"
SEMANTIC, LEXICAL, SYNTHESIS = 0.70, 0.30, (3, 0.40, 0.25, 0.10)
REPAIR_LEAST = 0.60
ENTAILED, CONTRADICTED, CONTRADICTION_CAP = 0.5, 0.9, 0.30
# End of fixed values.


def claims(answers: DataFrame, id_col: str, text_col: str, least_words: int = 5) -> DataFrame:
    """(aid, pos, claim): distinct sentences of five words or more that are no questions, headings or table rows."""
    bare = F.transform(T.sentences(F.col(text_col)), lambda s: F.trim(F.regexp_replace(s, r"^([-*+] |[0-9]+[.)] |#+ )", "")))
    rows = answers.select(F.col(id_col).alias("aid"), F.posexplode(F.array_distinct(bare)).alias("pos", "claim"))
    return rows.where((T.word_count(F.col("claim")) >= least_words) & ~F.col("claim").rlike(r"\?$|\|"))


def content_tokens(text: Column) -> Column:
    """Distinct lower-case words over two characters without function words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9][a-z0-9_\-]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(T.KEYWORD_STOP)))


def status(score: Column) -> Column:
    return F.when(score.isNull(), "UNVERIFIABLE").when(score >= SUPPORTED, "SUPPORTED").when(score >= PARTLY, "PARTIALLY_SUPPORTED").otherwise("INSUFFICIENT")


def support(claim_rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(aid, pos, score, best, status): the claims' best lexical overlap with their answer's evidence.

    Without a semantic model the lexical share stands for the whole score.  A number of the claim that
    the evidence lacks caps it at NUMERIC_CAP.  claim_rows: (aid, pos, claim); evidence: (aid, eid, text)."""
    c = claim_rows.select("aid", "pos", content_tokens(F.col("claim")).alias("ct"), F.array_distinct(F.regexp_extract_all("claim", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("nums"))
    e = evidence.select("aid", "eid", "text", content_tokens(F.col("text")).alias("et"))
    share = F.size(F.array_intersect("ct", "et")) / F.greatest(F.lit(1), F.size("ct"))
    missing = F.exists("nums", lambda x: ~F.contains(F.coalesce(F.col("text"), F.lit("")), x))
    rows = c.join(e, "aid", "left").withColumn("raw", F.when(F.col("eid").isNotNull(), F.when(missing, F.least(F.lit(NUMERIC_CAP), share)).otherwise(share)))
    best = rows.groupBy("aid", "pos").agg(F.round(F.max("raw"), 4).alias("score"), F.min(F.when(F.col("raw").isNotNull(), F.struct((-F.round("raw", 6)).alias("s"), F.col("eid").alias("eid")))).alias("b"))
    return best.select("aid", "pos", "score", F.col("b.eid").alias("best"), status(F.col("score")).alias("status"))


def rollup(supported: DataFrame) -> DataFrame:
    """(aid, n, supported, partly, insufficient, claim_score, verdict)."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = supported.groupBy("aid").agg(F.count("*").alias("n"), n("SUPPORTED").alias("supported"), n("PARTIALLY_SUPPORTED").alias("partly"), n("INSUFFICIENT").alias("insufficient"))
    score = F.round((F.col("supported") + 0.5 * F.col("partly")) / F.col("n"), 4)
    verdict = F.when(F.col("supported") == F.col("n"), "SUPPORTED").when(F.col("supported") + F.col("partly") > 0, "PARTIALLY_SUPPORTED").otherwise("INSUFFICIENT")
    return out.withColumn("claim_score", score).withColumn("verdict", verdict)


def citations(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(aid, eid): ids cited as [n]."""
    found = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("bigint"))
    return answers.select(F.col(id_col).alias("aid"), F.explode(F.array_distinct(found)).alias("eid"))


def dangling(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited ids that are no evidence."""
    return cited.join(evidence.select("aid", "eid").distinct(), ["aid", "eid"], "left_anti")


def alignment(score: Column, cited: Column) -> Column:
    return F.when(~cited, "UNCITED").when(score >= SUPPORTED, "ALIGNED").when(score >= PARTLY, "WEAKLY_ALIGNED").otherwise("MISMATCHED")


def coverage(claim: Column, citation: Column, issues: Column) -> Column:
    """.65 claims + .25 citations + .10 format, the format losing .15 for each issue."""
    a, b, c = COVERAGE
    return a * claim + b * citation + c * F.greatest(F.lit(0.0), 1 - FORMAT_LOSS * issues)


def valid(cover: Column, bad_ids: Column, mismatched: Column) -> Column:
    return (cover >= VALID) & (bad_ids == 0) & (mismatched == 0)


def grounding_level(ratio: Column) -> Column:
    return F.when(ratio >= 0.8, "Strong").when(ratio >= 0.6, "Moderate").when(ratio >= 0.4, "Weak").otherwise("Unsupported")


def aspect_strength(aspects: DataFrame, evidence: DataFrame) -> DataFrame:
    """(aid, aspect, mentions, substantive, strength).  aspects: (aid, aspect); evidence: (aid, eid, text).

    Substantive: a sentence of eight words or more names the aspect."""
    s = evidence.select("aid", "eid", F.explode(T.sentences(F.col("text"))).alias("s"))
    rows = aspects.join(s, "aid", "left").withColumn("hit", F.contains(F.lower("s"), F.lower("aspect"))).withColumn("long", F.col("hit") & (T.word_count(F.col("s")) >= 8))
    out = rows.groupBy("aid", "aspect").agg(F.count_distinct(F.when(F.col("hit"), F.col("eid"))).alias("mentions"), F.count_distinct(F.when(F.col("long"), F.col("eid"))).alias("substantive"))
    return out.withColumn("strength", F.when(F.col("substantive") >= 2, "STRONG").when(F.col("substantive") == 1, "PARTIAL").when(F.col("mentions") > 0, "MENTION_ONLY").otherwise("MISSING"))


def sufficiency(evidence: DataFrame, strong: float = 0.35) -> DataFrame:
    """(qid, strong, sections, score, sufficient): .6 min(strong / 4, 1) + .4 min(sections / 3, 1).
    evidence: (qid, doc, section, score)."""
    out = evidence.groupBy("qid").agg(F.count_if(F.col("score") >= strong).alias("strong"), F.count_distinct("doc", "section").alias("sections"))
    score = 0.6 * F.least(F.col("strong") / 4, F.lit(1.0)) + 0.4 * F.least(F.col("sections") / 3, F.lit(1.0))
    return out.withColumn("score", F.round(score, 4)).withColumn("sufficient", (F.col("strong") >= 3) & (F.col("sections") >= 2))


def budget(evidence: DataFrame, limit: int = 24_000, each: int = 1_800) -> DataFrame:
    """Evidence in order as long as the running length of the clipped texts stays within the limit.  evidence: (qid, place, text)."""
    w = Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return evidence.withColumn("used", F.sum(F.least(F.length("text"), F.lit(each))).over(w)).where(F.col("used") <= limit)


def grounded_text(answer: Column) -> Column:
    """The part of an answer that is to be checked: without what follows general knowledge or sources, and without limitations and follow-up questions."""
    t = F.coalesce(answer, F.lit(""))
    for tail in TAILS:
        t = F.regexp_replace(t, f"(?is){tail}.*$", "")
    parts = F.split(F.regexp_replace(t, r"(?m)^(##?\s+\S)", "\u001f$1"), "\u001f")
    return F.trim(F.array_join(F.filter(parts, lambda x: ~x.rlike(f"(?i){DROPPED_SECTIONS}")), ""))


def scored_claims(claim_rows: DataFrame, evidence: DataFrame, semantic: DataFrame | None = None, entailment: DataFrame | None = None) -> DataFrame:
    """(aid, pos, best, score, mode, status, missing): each claim's support by its answer's evidence.

    A claim and a piece of evidence score .70 of their semantic similarity and .30 of the share of the claim's words that the evidence holds.
    `semantic` (aid, pos, eid, value) is the slot of a model; without one the lexical share stands in its place.  Up to three related pieces together
    count if they hold a tenth more of the words than the best one.  `entailment` (aid, pos, entail, contradict), the slot of an inference
    model, can only lower a score.  Numbers that none of these pieces holds cap it.  claim_rows: (aid, pos, claim); evidence: (aid, eid, text)."""
    most, least_sem, least_lex, gain = SYNTHESIS
    c = claim_rows.select("aid", "pos", content_tokens(F.col("claim")).alias("ct"), F.array_distinct(F.regexp_extract_all("claim", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))).alias("nums"))
    e = evidence.select("aid", "eid", F.coalesce("text", F.lit("")).alias("text"), content_tokens(F.col("text")).alias("et"))
    rows = c.join(e, "aid").withColumn("hit", F.array_intersect("ct", "et")).withColumn("lex", F.size("hit") / F.greatest(F.lit(1), F.size("ct")))
    rows = rows.withColumn("sem", F.col("lex")) if semantic is None else rows.join(semantic.select("aid", "pos", "eid", F.col("value").alias("sem")), ["aid", "pos", "eid"], "left").withColumn("sem", F.coalesce("sem", F.lit(0.0)))
    rows = rows.withColumn("s", F.round(SEMANTIC * F.col("sem") + LEXICAL * F.col("lex"), 6))
    order = Window.partitionBy("aid", "pos").orderBy(F.desc("s"), "eid")
    related = F.when((F.col("sem") >= least_sem) | (F.col("lex") >= least_lex), 1).otherwise(0)
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("related", related)
    rows = rows.withColumn("place", F.sum("related").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(f"i = 1 or (related = 1 and place <= {most})")
    joint = rows.withColumn("in", (F.col("related") == 1) & (F.col("place") <= most))
    first = F.when(F.col("i") == 1, F.struct("eid", "s", "sem", "lex", "text"))
    out = joint.groupBy("aid", "pos").agg(  # four rows of a claim at most
        F.first("ct").alias("ct"), F.first("nums").alias("nums"), F.max(first).alias("b"), F.count_if("in").alias("n"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("in"), F.col("hit"))))).alias("together"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("in"), F.col("text")))), "\n").alias("blob"),
    )
    both = F.size("together") / F.greatest(F.lit(1), F.size("ct"))
    multi = (F.col("n") > 1) & (F.round(both, 6) > F.round(F.col("b.lex") + gain, 6))
    score = F.when(multi, F.greatest(F.col("b.s"), SEMANTIC * F.col("b.sem") + LEXICAL * both)).otherwise(F.col("b.s"))
    out = out.withColumn("score", score).withColumn("mode", F.when(multi, "MULTI_EVIDENCE_SYNTHESIS").otherwise("SINGLE_EVIDENCE"))
    if entailment is not None:
        lex = F.when(multi, both).otherwise(F.col("b.lex"))
        out = out.join(entailment, ["aid", "pos"], "left").withColumn("score", F.when(F.col("entail").isNull() | (F.col("score") < PARTLY), F.col("score")).otherwise(F.least("score", SEMANTIC * F.col("entail") + LEXICAL * lex, F.when((F.col("contradict") >= CONTRADICTED) & (F.col("entail") < ENTAILED), CONTRADICTION_CAP).otherwise(1.0))))
    held = F.when(F.col("n") > 0, F.col("blob")).otherwise(F.col("b.text"))
    out = out.withColumn("missing", F.array_sort(F.filter("nums", lambda x: ~F.contains(held, x))))
    out = out.withColumn("score", F.round(F.when(F.size("missing") > 0, F.least("score", F.lit(NUMERIC_CAP))).otherwise(F.col("score")), 4))
    return out.select("aid", "pos", F.col("b.eid").alias("best"), "score", "mode", status(F.col("score")).alias("status"), F.array_join("missing", ",").alias("missing"))


def aligned(claim_rows: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """(aid, pos, alignment): every claim scored against the evidence that it cites alone.  cited: (aid, pos, eid)."""
    own = cited.join(evidence, ["aid", "eid"]).select(F.concat_ws("/", "aid", "pos").alias("aid"), "eid", "text")
    rows = claim_rows.select(F.concat_ws("/", "aid", "pos").alias("aid"), "pos", "claim")
    scores = scored_claims(rows, own).select(F.col("aid").alias("key"), "score")
    some = cited.select("aid", "pos").distinct().withColumn("cites", F.lit(True))
    out = claim_rows.select("aid", "pos").withColumn("key", F.concat_ws("/", "aid", "pos")).join(scores, "key", "left").join(some, ["aid", "pos"], "left")
    return out.select("aid", "pos", alignment(F.coalesce("score", F.lit(0.0)), F.coalesce("cites", F.lit(False))).alias("alignment"))


def alignment_rollup(rows: DataFrame) -> DataFrame:
    """(aid, aligned, weak, mismatched, citation_score): (aligned + .5 weak) / all that cite; 0 without a citation."""
    n = lambda s: F.count_if(F.col("alignment") == s)
    out = rows.groupBy("aid").agg(n("ALIGNED").alias("aligned"), n("WEAKLY_ALIGNED").alias("weak"), n("MISMATCHED").alias("mismatched"))
    total = F.col("aligned") + F.col("weak") + F.col("mismatched")
    return out.withColumn("citation_score", F.round(F.when(total > 0, (F.col("aligned") + 0.5 * F.col("weak")) / total).otherwise(0.0), 4))


def repaired(claim_rows: DataFrame, scores: DataFrame, alignments: DataFrame) -> DataFrame:
    """(aid, pos, claim): claims supported from REPAIR_LEAST on get their best evidence's number where they cite nothing or the wrong one; others stay."""
    rows = claim_rows.select("aid", "pos", "claim").join(scores.select("aid", "pos", "best", "score"), ["aid", "pos"], "left").join(alignments, ["aid", "pos"], "left")
    bare = F.trim(F.regexp_replace("claim", r"\s*\[[0-9]+\]", ""))
    body, end = F.regexp_extract(bare, r"(?s)^(.*?)([.!?]*)$", 1), F.regexp_extract(bare, r"(?s)^(.*?)([.!?]*)$", 2)
    fix = (F.col("score") >= REPAIR_LEAST) & F.col("alignment").isin("UNCITED", "MISMATCHED")
    return rows.select("aid", "pos", F.when(fix, F.concat(body, F.lit(" ["), F.col("best"), F.lit("]"), end)).otherwise(F.col("claim")).alias("claim"))


def better(before: DataFrame, after: DataFrame) -> DataFrame:
    """(aid, accepted): a rewritten answer counts only if its coverage is strictly higher.  Both: (aid, coverage)."""
    return before.select("aid", F.col("coverage").alias("old")).join(after.select("aid", F.col("coverage").alias("new")), "aid", "left").select("aid", F.coalesce(F.col("new") > F.col("old"), F.lit(False)).alias("accepted"))
