"""Literal cases of the iterative controller."""

from pyspark.sql import functions as F

from basalt.operators import controller as K

QUESTIONS = "qid bigint, text string, subqueries array<string>, options array<string>"


def loop(spark, rows, retrieve, cover):
    """cover: column over the answers' evidence texts (list) to (coverage, status of its one claim)."""
    def verify(answers, told):
        texts = told.groupBy("qid").agg(F.collect_list("text").alias("texts"))
        rows = answers.join(texts, "qid", "left").withColumn("c", cover(F.coalesce("texts", F.array().cast("array<string>"))))
        return rows.select("qid", F.col("c").alias("coverage")), rows.where("c < 0.7").select("qid", F.lit(0).alias("pos"), F.lit("needs strong evidence [1]").alias("claim"), F.lit("INSUFFICIENT_EVIDENCE").alias("status"))

    none = lambda open_, told: open_.where("false").select("qid", F.lit("").alias("facet"), F.lit("").alias("probe"), F.lit(True).alias("covered"))
    said = lambda open_, told: open_.select("qid", F.when(F.col("text") != "silent", F.lit("answer text")).alias("answer"))
    return {r["qid"]: r for r in K.run(spark.createDataFrame(rows, QUESTIONS), retrieve, said, verify, none).collect()}


def strong_when_asked(asked):
    """A weak chunk for every question, a strong one where the query asks for it."""
    hit = lambda n, t: F.struct(F.lit(n).cast("bigint").alias("chunk"), F.lit(t).alias("text"), F.lit(0).alias("rank"))
    found = F.when(F.contains("query", F.lit("strong")) & (F.col("qid") == 1), F.array(hit(2, "strong"))).otherwise(F.array(hit(1, "weak")))
    return asked.select("qid", "no", F.explode(found).alias("x")).select("qid", "no", "x.rank", "x.chunk", "x.text")


def test_recovers_gives_up_and_asks_back(spark):
    rows = [(1, "q", None, None), (2, "q", ["q"], []), (3, "Explain attention", None, ["self-attention", "cross-attention", "multi-head attention"]), (4, "silent", None, None)]
    out = loop(spark, rows, strong_when_asked, lambda t: F.when(F.array_contains(t, "strong"), 0.95).otherwise(0.4))
    assert (out[1]["status"], out[1]["answer"], out[1]["coverage"], out[1]["iterations"], out[1]["evidence"]) == ("ANSWER", "answer text", 0.965, 1, 2)
    assert (out[2]["status"], out[2]["coverage"], out[2]["iterations"], out[2]["evidence"]) == ("INSUFFICIENT", 0.58, 1, 1)  # nothing new is found
    assert "insufficient" in out[2]["answer"].lower()
    assert (out[3]["status"], out[3]["answer"], len(out[3]["options"])) == ("CLARIFY", None, 3)
    assert (out[4]["status"], out[4]["coverage"]) == ("INSUFFICIENT", 0.0)


def test_notes_and_limits(spark):
    fresh = lambda asked: asked.select("qid", "no", F.lit(0).alias("rank"), F.pmod(F.xxhash64("query", "no"), F.lit(1 << 40)).alias("chunk"), F.lit("weak").alias("text"))
    out = loop(spark, [(1, "q", None, None)], fresh, lambda t: F.lit(0.6))
    assert out[1]["status"] == "NOTE" and out[1]["answer"] == f"answer text\n\n{K.NOTE}"  # 0.7 * 0.6 + 0.3
    out = loop(spark, [(1, "q", None, None)], fresh, lambda t: F.lit(0.2))
    assert (out[1]["status"], out[1]["iterations"]) == ("INSUFFICIENT", 2)


def test_next_queries_are_few_and_distinct(spark):
    claims = spark.createDataFrame([(1, k, f"claim {k // 2} [{k}]", "INSUFFICIENT") for k in range(5)] + [(1, 9, "fine", "SUPPORTED"), (2, 0, " [3]", "INSUFFICIENT")], "qid bigint, pos int, claim string, status string")
    facets = spark.createDataFrame([(1, f, f"probe {f}", False) for f in "cab"] + [(1, "d", "x", True)], "qid bigint, facet string, probe string, covered boolean")
    got = [(r["qid"], r["no"], r["query"]) for r in K.next_queries(claims, facets).orderBy("qid", "no").collect()]
    assert got == [(1, 1, "claim 0"), (1, 2, "claim 1"), (1, 3, "probe a"), (1, 4, "probe b")]
