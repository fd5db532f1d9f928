"""Literal cases of the operators that SQL doesn't cover."""

import math

import pytest
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import assets as A
from basalt.operators import graph as G
from basalt.operators import memory as C
from basalt.operators import rank as R
from basalt.operators import telemetry as M
from basalt.operators import understand as U
from basalt.operators import verify as V


def values(spark, rows, expr, schema="x string"):
    return [r["y"] for r in spark.createDataFrame([(r,) for r in rows], schema).select(expr.alias("y")).collect()]


def test_tokens(spark):
    got = values(spark, ["Self-attention of Transformers", "class analyses flies boxes P-101 node.js", None], T.tokens(F.col("x")))
    assert got[0] == ["self-attention", "self", "attention", "of", "transformer"]
    assert got[1] == ["class", "analys", "fly", "box", "p-101", "node.js"] and got[2] == []


def test_tags_dates_parts(spark):
    assert values(spark, ["P-101 and SOP-207, BRG-204 xWO-9"], T.tags(F.col("x"))) == [["BRG-204", "P-101", "SOP-207"]]
    got = values(spark, ["2022-01-15", "12/12/2005", "3 Mar 2021", "soon"], F.date_format(T.parse_date(F.col("x")), "yyyy-MM-dd"))
    assert got == ["2022-01-15", "2005-12-12", "2021-03-03", None]
    assert values(spark, ["BRG-204 x2; MS-7, none"], T.parts_of(F.col("x"))) == [["BRG-204", "MS-7"]]


def test_spelling(spark):
    vocab = spark.createDataFrame([("transformer", 50), ("attention", 40), ("retrieval", 30), ("langchain", 20), ("langgraph", 20), ("graph", 60), ("embedding", 30), ("difference", 10)], "term string, freq bigint")
    asked = spark.createDataFrame([(w,) for w in ["transformar", "attension", "retrival", "langchan", "embeding", "differece", "graph", "ax"]], "word string")
    got = {r["word"]: r["term"] for r in U.corrections(asked, vocab).collect()}
    assert got == {"transformar": "transformer", "attension": "attention", "retrival": "retrieval", "langchan": "langchain", "embeding": "embedding", "differece": "difference"}
    assert U.osa("si", "is") == 1 and U.osa("ca", "abc") == 3 and U.osa("", "ab") == 2


def test_classes_aspects_policy(spark):
    label, _ = U.classify(F.col("x"))
    got = values(spark, ["What is a transformer?", "difference between A and B", "Why was it needed?", "How do I fix this error", "hello"], label)
    assert got == ["definition", "comparison", "reasoning", "debugging", "explanation"]
    assert values(spark, ["difference between LangChain and LangGraph", "LangChain vs LangGraph"], U.aspects(F.col("x"))) == [["LangChain", "LangGraph"]] * 2
    got = [r["p"] for r in spark.createDataFrame([(0.95, 0), (0.8, 0), (0.5, 0), (0.5, 2)], "c double, i int").select(U.policy(F.col("c"), F.col("i")).alias("p")).collect()]
    assert got == ["ANSWER", "NOTE", "RETRY", "INSUFFICIENT"]


def test_telemetry(spark):
    v = [2.0 + 0.01 * (i % 3) for i in range(200)] + [2.0 + 0.05 * i for i in range(72)]
    r = M.analyze(spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "s int, t int, v double"), "s", "t", "v").collect()[0]
    half = sorted(v[: len(v) // 2])
    recent = sum(v[-24:]) / 24
    assert r["baseline"] == half[len(half) // 2] and math.isclose(r["recent_mean"], recent, abs_tol=1e-6)
    assert math.isclose(r["slope_day"], 0.05 * 24, abs_tol=1e-6) and math.isclose(r["rul_hours"], (7.1 - v[-1]) / 0.05, abs_tol=1e-3) and r["anomalous"]
    one = M.analyze(spark.createDataFrame([(1, 0, 3.0)], "s int, t int, v double"), "s", "t", "v").collect()[0]
    assert one["baseline"] == 3.0 and one["rul_hours"] is None


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "GOVERNS"), ("b", "c", "REQUIRES"), ("c", "d", "MENTIONS")], "src string, dst string, rel string")
    w = {r["node"]: r["score"] for r in G.weighted_expand(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert w == {"a": 1.0, "b": round(0.9 * 0.85, 6), "c": round((0.9 * 0.85) ** 2, 6)}
    assert {r["node"]: (r["hops"], r["previous"]) for r in G.path_lengths(e, "a").collect()} == {"a": (0, None), "b": (1, "a"), "c": (2, "b"), "d": (3, "c")}


def test_mmr_keeps_variety(spark):
    half = 0.5**0.5
    rows = [(1, 1, "s", 1.0, ["a", "b"], [half, half]), (1, 2, "t", 0.99, ["a", "b"], [half, half]), (1, 3, "u", 0.7, ["x", "y"], [half, half]), (1, 4, "v", 0.5, ["p"], [1.0])]
    got = R.mmr(spark.createDataFrame(rows, "qid long, doc long, section string, score double, terms array<string>, weights array<double>"), 3).orderBy("position").collect()
    assert [r["doc"] for r in got] == [1, 3, 2]


def test_events(spark):
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, A.overlay(base, new, "k").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert values(spark, ["Corrective work", "REPAIR", "prevent", "Inspection", "", "Other"], A.maintenance_type(F.col("x"))) == ["corrective", "corrective", "preventive", "inspection", "event", "other"]


def test_claims_and_numbers(spark):
    ans = spark.createDataFrame([(1, "# Head\nThe pump failed after 45 hours of use. Is it so? The bearing was replaced by the crew today.")], "aid long, text string")
    ev = spark.createDataFrame([(1, 1, "The pump failed after 12 hours of use")], "aid long, eid long, text string")
    got = {r["pos"]: (r["score"], r["status"]) for r in V.support(V.claims(ans, "aid", "text"), ev).collect()}
    assert len(got) == 2 and (V.NUMERIC_CAP, "PARTIALLY_SUPPORTED") in got.values()


def test_meta_and_titles(spark):
    assert values(spark, ["What did I just ask?", "What is a pump?"], C.is_meta(F.col("x"))) == [True, False]
    assert values(spark, ["please explain pumps", None], T.title_from(F.col("x"))) == ["Explain pumps", "New conversation"]


@pytest.mark.parametrize("limit,want", [(100, "One two. Three four five."), (12, "One two."), (6, "One …"), (20, "One two. Three four …")])
def test_clip(spark, limit, want):
    assert values(spark, ["One two. Three four five."], T.clip(F.col("x"), limit)) == [want]
