"""Names told by runs of words, limits of queries inside tasks, and scores of pairs that are not listed."""

import random
import re

from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import agent as A
from basalt.operators import concepts as C
from basalt.operators import hybrid as H
from basalt.operators import index as I
from basalt.operators import store as S

from .test_hybrid import index_of, plan


def test_runs_of_plain_words_hide_no_name(spark):
    rng = random.Random(3)
    parts = ["Pump", "Valve", "oil", "and", "x.y", "e.g.", "ABC", "a-b", "fooBar", "FooBar", "9abc", "foo9", "The", "w", "foo.", "node.js", "site.com", "3.5", "#tag", "c++"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", ", ", ". ", "\n", "-", "", " 3."]) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["low " * 5000 + "Big Pump", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(C.WORD), F.lit(0))
    got = rows.select(C.candidates(F.col("text")).alias("a"), C.names_in(words).alias("b"), F.size(C.words_of(F.col("text"))).alias("n"), F.size(words).alias("m")).collect()
    assert all(r["a"] == r["b"] for r in got) and sum(len(r["a"]) for r in got) > 400 and sum(r["n"] for r in got) < sum(r["m"] for r in got) * 2 / 3


def test_limited_queries_are_ranked_inside_tasks(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("pump seal oil valve gear bolt".split()) for _ in range(rng.randint(1, 9)))) for i in range(200)]
    home = {i: rng.choice("abc") for i, _ in docs}
    ix = I.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    asked = spark.createDataFrame([(1, "pump oil"), (2, "pump oil"), (3, "seal gear bolt"), (4, "oil")], "item_id long, text string")
    weights = I.queries_of(asked, "item_id", "text").select("qid", "term", F.col("qtf").cast("double").alias("one"), F.lit(2.0).alias("two"))
    rows = ix.postings.select("doc", "term", F.col("tf").alias("one"), F.col("dl").alias("two"))
    facts = spark.createDataFrame([(i, 2.0, 1.0 + i % 3, home[i]) for i, _ in docs], "doc long, one double, two double, home string")
    limits = spark.createDataFrame([(2, ["a", "c"]), (3, ["b"]), (4, [])], "qid long, homes array<string>")
    got = I.legs(rows, weights, ["one", "two"], 7, facts, limits)
    plan_text = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(qid" not in plan_text and "SortMergeJoin" not in plan_text
    best = {}
    for r in got.collect():
        best.setdefault((r["leg"], r["qid"]), []).append((-r["score"], r["doc"]))
    want = {}
    terms = {1: "pump oil", 2: "pump oil", 3: "seal gear bolt", 4: "oil"}
    for q, homes in ((1, "abc"), (2, "ac"), (3, "b"), (4, "")):
        for i, text in docs:
            ws = text.split()
            met = [t for t in terms[q].split() if t in ws]
            if met and home[i] in homes:
                want.setdefault(("one", q), []).append((-round(sum(ws.count(t) / 2 for t in met), 6), i))
                want.setdefault(("two", q), []).append((-round(sum(2 * len(ws) / (1 + i % 3) for t in met), 6), i))
    cut = lambda found: {k: sorted(v)[:7] for k, v in found.items()}
    assert cut(best) == cut(want) and max(map(len, best.values())) <= 7 * 8
    I.QUERY_TERMS, kept = 2, I.QUERY_TERMS  # the same by Spark's sums, for larger batches
    try:
        large = I.legs(rows, weights, ["one", "two"], 7, facts, limits).collect()
    finally:
        I.QUERY_TERMS = kept
    best = {}
    for r in large:
        best.setdefault((r["leg"], r["qid"]), []).append((-r["score"], r["doc"]))
    assert cut(best) == cut(want)


def test_composed_legs_leave_no_list_of_pairs(spark, monkeypatch):
    ix, seen = index_of(spark), []
    q = plan(spark, (1, "pump oil valve", [], [], ["P-101"], None, None), (2, "pump oil", [], [], [], None, [2]), (3, "pump", [], [], [], None, []))
    legs = I.legs
    monkeypatch.setattr(I, "legs", lambda *a, **k: seen.append(legs(*a, **k)) or seen[-1])
    got = {(r["qid"], r["chunk"]): r for r in H.fused(ix, q).collect()}
    assert len(seen) == 2 and all(re.search("MapInArrow", x._jdf.queryExecution().executedPlan().toString()) for x in seen)
    assert {c for k, c in got if k == 2} == {20} and not [c for k, c in got if k == 3] and {c for k, c in got if k == 1} >= {10, 11, 20}
    bm25 = {(r["qid"], r["doc"]): r["score"] for r in I.bm25(ix.text, q, "qid", "query").collect()}
    dense = {(r["qid"], r["doc"]): r["score"] for r in I.dense(ix.text, q, "qid", "query").collect()}
    assert all(r["bm25"] == bm25[k] and r["dense"] == dense[k] for k, r in got.items())


def test_agent_lists_no_chunks_of_a_question(spark, monkeypatch):
    ix, calls = index_of(spark), []
    monkeypatch.setattr(I, "scores", lambda *a, **k: calls.append(a))  # takes pairs, which a large source has millions of for each question
    asked = spark.createDataFrame([(1, "pump oil", 12, None), (2, "pump oil", 6, [1]), (3, "pump oil", 1, [1, 2]), (4, "pump", 6, [])], "key bigint, query string, k int, docs array<bigint>")
    got = {}
    for r in A.lexical_retriever(ix)(asked).collect():
        got.setdefault(r["key"], []).append((r["place"], r["chunk"], r["doc"]))
    assert not calls and {c for _, c, _ in got[1]} == {10, 20} and got[2] == [(1, 10, 1)] and len(got[3]) == 1 and got[3][0][2] in (1, 2) and 4 not in got


def test_added_texts_are_cut_once(spark, tmp_path, monkeypatch):
    cuts, cut = [], T.raw_tokens
    monkeypatch.setattr(T, "raw_tokens", lambda c: cuts.append(c) or cut(c))
    store = S.IndexStore(spark, f"file://{tmp_path}/ix", buckets=4)
    store.add(spark.createDataFrame([(1, "pump pump seal"), (2, "oil"), (2, "oil gear"), (3, ""), (4, None), (None, "lost")], "doc_id long, text string"))
    assert len(cuts) == 1 and {r["doc"]: r["dl"] for r in store.open().docs.collect()} == {1: 3, 2: 3, 3: 0, 4: 0}
