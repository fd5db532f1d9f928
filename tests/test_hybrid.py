"""The kept index through its life, composed retrieval with a scorer, limits by question, merged runs, and the agent over it."""

import pytest
from pyspark.sql import functions as F

from basalt.operators import agent as A
from basalt.operators import hybrid as H
from basalt.operators import index as I
from basalt.operators import store as S


def terms(store):
    return {r["term"]: (r["df"], r["cf"]) for r in store.open().postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).collect()}


def test_store_adds_replaces_deletes_and_merges(spark, tmp_path):
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    store = S.IndexStore(spark, f"file://{tmp_path}/ix", buckets=4)
    assert store.open().stats.first()["n_docs"] == 0
    store.add(docs((1, "pump pump valve"), (2, "seal"), (None, "lost"), (3, None)))
    assert terms(store) == {"pump": (1, 2), "valve": (1, 1), "seal": (1, 1)} and store.open().stats.first()["n_docs"] == 3
    store.add(docs((2, "valve"), (4, "seal seal")))  # 2 is replaced
    assert terms(store) == {"pump": (1, 2), "valve": (2, 2), "seal": (1, 2)}
    store.delete(docs((1, None), (99, None)))
    assert terms(store) == {"valve": (1, 1), "seal": (1, 2)} and store.open().stats.first()["n_docs"] == 3
    store.add(docs((1, "pump")))  # and is there again
    before, state = terms(store), store.state()
    assert before == {"pump": (1, 1), "valve": (1, 1), "seal": (1, 2)}
    store.merge()
    assert terms(store) == before and store.state() != state and len(list((tmp_path / "ix/docs").glob("segment=*"))) == 1
    store.delete(docs((4, None)))
    assert terms(store) == {"pump": (1, 1), "valve": (1, 1)}
    asked = docs((7, "pump of a kind"))
    part = store.open(S.batch_terms(asked))
    top = [(r["qid"], r["doc"]) for r in I.ranked(I.bm25(part, asked, "doc_id"), 3).collect()]
    whole = [(r["qid"], r["doc"], r["score"]) for r in I.ranked(I.dense(store.open(), asked, "doc_id"), 3).collect()]
    assert top == [(7, 1)] and whole == [(r["qid"], r["doc"], r["score"]) for r in I.ranked(I.dense(part, asked, "doc_id"), 3).collect()]
    # A writer that died leaves a segment without its mark: nothing of it is read.
    spark.createDataFrame([(5, 1)], "doc bigint, dl bigint").write.parquet(f"file://{tmp_path}/ix/docs/segment=50")
    (tmp_path / "ix/docs/segment=50/_SUCCESS").unlink()
    assert store.open().stats.first()["n_docs"] == 3


PUMP = "The pump of the plant needs oil and care each week because it runs by day and night.\nIts housing is kept dry by the crew of the morning shift."
VALVE = "A valve closes the line when pressure rises and so saves what stands behind it from harm.\nEngineers test every one in spring with water before the season begins."
BEARING = "Each bearing turns many thousand times an hour and wears out where grease is missing or old.\nReplace worn parts with those named in the manual of its maker."
SEAL = "Under high heat a seal grows brittle, leaks follow, and then the whole pump must stop for days.\nKeep some spare rings near oil stores on site."
WEATHER = "Nothing of it here, only words about the weather of the coast and its long winters by the sea."
CHUNKS = [(10, 1, 0, "Overview", PUMP, ["pump"], ["P-101"]), (11, 1, 1, "Overview", VALVE, ["valve"], []), (12, 1, 2, "Steps", BEARING, ["bearing"], []), (20, 2, 0, "Overview", SEAL, ["seal"], ["P-101"]), (30, 3, 0, "Other", WEATHER, [], [])]
PLAN = "qid bigint, query string, judge string, intent string, entities array<string>, aspects array<string>, boost_sections array<string>, boost_entities array<string>, graph_entities array<string>, k int, docs array<bigint>"


def index_of(spark):
    rows = [(c, d, p, s, t, t.split("\n")[0], k, [], e) for c, d, p, s, t, k, e in CHUNKS]
    return H.prepare(spark.createDataFrame(rows, "chunk bigint, doc bigint, pos bigint, section string, text string, summary string, keywords array<string>, concepts array<string>, entities array<string>"))


def plan(spark, *rows):
    full = [(q, t, t, "general", e, a, [], e, g, k, docs) for q, t, e, a, g, k, docs in rows]
    return spark.createDataFrame(full, PLAN)


def weather(q, e):
    """A scorer that likes the weather, whatever is asked."""
    return e.str.contains("weather").map({True: 0.9, False: 0.3})


def test_scorer_and_collapse(spark):
    ix, q = index_of(spark), plan(spark, (1, "pump oil weather", [], [], [], None, None))
    lexical = H.candidates(ix, q).collect()
    assert all(r["collapsed"] for r in lexical) and min(lexical, key=lambda r: r["rank"])["chunk"] in (10, 20)
    scored = {r["chunk"]: r for r in H.candidates(ix, q, weather).collect()}
    assert not any(r["collapsed"] for r in scored.values()) and scored[30]["rank"] == 0 and scored[30]["relevance"] == 0.9
    weak = {r["chunk"]: r for r in H.candidates(ix, q, lambda q, e: weather(q, e) / 9).collect()}
    assert all(r["collapsed"] for r in weak.values())  # the best is below the floor: support stands in


def test_limits_by_question(spark):
    """One question within one small document, one over all, one for a graph entity alone; all in one batch."""
    ix = index_of(spark)
    q = plan(spark, (1, "pump oil valve bearing", ["pump"], [], [], 6, [1]), (2, "pump oil valve bearing", [], [], [], None, None), (3, "zzz", [], [], ["P-101"], None, None))
    got = {}
    for r in H.retrieve(ix, q).collect():
        got.setdefault(r["qid"], []).append(r)
    assert {r["doc"] for r in got[1]} == {1} and {r["doc"] for r in got[2]} >= {1, 2}
    assert sorted(c for r in got[1] for c in r["chunks"]) == [10, 11, 12]  # a small document keeps all of its chunks
    assert {c for r in got[3] for c in r["chunks"]} == {10} and all(r["method"] == "Graph" for r in got[3])  # the anchor; 20 alone is too weak for the gate
    first = next(r for r in got[1] if 10 in r["chunks"])
    assert first["chunks"] == [10, 11] and first["text"] == PUMP + "\n\n" + PUMP + "\n\n" + VALVE  # neighbours of one section; what is short then takes in the chunk before its last one
    assert "Covers query entities: pump" in first["why"]


def test_runs_merge_up_to_the_limit(spark):
    rows = [(1, 7, p, 70 + p, "a" if p < 5 else "b", p / 10, ch * 900 + " ") for p, ch in enumerate("uvwxyz")] + [(1, 8, 0, 80, "a", 0.9, "z")]
    got = sorted((r["doc"], r["chunk"], tuple(r["chunks"]), r["pos"], r["score"], len(r["text"])) for r in H.merge_runs(spark.createDataFrame(rows, "qid bigint, doc bigint, pos bigint, chunk bigint, section string, score double, text string")).collect())
    assert got == [(7, 70, (70, 71), 1, 0.1, 1803), (7, 72, (72, 73), 3, 0.3, 1803), (7, 74, (74,), 4, 0.4, 901), (7, 75, (75,), 5, 0.5, 901), (8, 80, (80,), 0, 0.9, 1)]


def test_focus(spark):
    first = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "a"), (2, 2, "b"), (2, 3, "c"), (3, 1, "a"), (3, 2, "a")], "qid bigint, place int, doc string")
    named = spark.createDataFrame([(3, "z"), (3, "y")], "qid bigint, doc string")
    got = {r["qid"]: (r["docs"], r["routed_by"], r["rejected"]) for r in A.focus(first, named).collect()}
    assert got == {1: (["a"], "dominant document (72%)", ["b"]), 3: (["y", "z"], "named entity/concept", [])}  # 2: one hit of each


@pytest.mark.parametrize("hybrid", [False, True])
def test_agent(spark, hybrid):
    ix = index_of(spark)
    asked = [(1, "pump oil housing", [], "document", None), (2, "pump and seal", ["pump", "seal"], "asset", ["pump", "seal", "weather"])]
    q = spark.createDataFrame(asked, "qid bigint, asked string, aspects array<string>, strategy string, subqueries array<string>")
    named = spark.createDataFrame([(1, 1)], "qid bigint, doc bigint")
    retrieve = A.hybrid_retriever(ix, plan(spark, (1, "pump oil housing", [], [], [], None, None))) if hybrid else A.lexical_retriever(ix)
    evidence, told = A.run(q, named, ix, retrieve)
    rows = evidence.collect()
    assert {r["chunk"] for r in rows if r["qid"] == 1 and r["used"]} <= {10, 11, 12} and any(r["used"] for r in rows if r["qid"] == 1)
    assert {r["chunk"]: r["reason"] for r in rows if r["qid"] == 2}[30] is not None  # the weather names neither side
    d = {r["qid"]: (r["strategy"], r["routed_by"]) for r in told.collect()}
    assert d == {1: ("document", "named entity/concept"), 2: ("asset", None)}
