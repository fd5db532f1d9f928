"""Golden sets: reading, metrics by hand, the gate, the results file."""

import json

import pytest

from basalt.operators import golden as E

LINES = [
    {"id": "g1", "query": "a?", "expected_doc": "LangChain", "expected_terms": ["lcel", "P-101"], "intent": "definition"},
    {"id": "g2", "query": "b?", "expected_docs": ["one", "two"], "category": "multi", "intent": "comparison"},
    {"id": "g3", "query": "c?", "expect_refusal": True, "expected_answer_terms": ["x"]},
    {"id": "g4", "query": "d?", "expected_doc": "none"},
]


@pytest.fixture
def cases(spark, tmp_path):
    path = tmp_path / "golden.jsonl"
    path.write_text("\n".join(map(json.dumps, LINES)) + "\n\n{broken\n" + json.dumps({"query": "no id"}) + "\n")
    good, bad = E.read_golden(spark, str(path))
    assert bad.count() == 2
    return good


def test_retrieval_metrics(spark, cases):
    hits = [("g1", 1, "doc-7 Pump", "nothing"), ("g1", 2, "d8 LangChain book", "LCEL is here; p-101a is not"), ("g1", 3, "langchain 2", "x"), ("g2", 1, "one.pdf", "t"), ("g2", 2, "three", "t")]
    told = spark.createDataFrame([("g1", "definition", 10.0), ("g2", "general", 20.0)], "id string, intent string, latency_ms double")
    rows = E.retrieval_rows(cases, spark.createDataFrame(hits, "id string, place int, label string, text string"), told)
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {"g1", "g2", "g4"}
    a = got["g1"]
    assert (a["hit"], a["rank"], a["rr"], a["recall_at_1"], a["recall_at_5"], a["precision_at_k"], a["term_coverage"], a["missing_terms"], a["intent_ok"]) == (True, 2, 0.5, False, True, 0.667, 0.5, ["P-101"], True)
    assert a["ndcg"] == 0.693  # (1/log2 3 + 1/log2 4) / (1 + 1/log2 3)
    assert (got["g2"]["hit"], got["g2"]["rank"], got["g2"]["ndcg"], got["g2"]["term_coverage"], got["g2"]["intent_ok"]) == (False, 1, 1.0, 1.0, False)
    assert (got["g4"]["hit"], got["g4"]["rank"], got["g4"]["rr"], got["g4"]["precision_at_k"], got["g4"]["intent_ok"]) == (False, None, 0.0, 0.0, None)
    s = E.retrieval_summary(rows, 6).first()
    assert (s["cases"], s["hit_rate"], s["mrr"], s["intent_accuracy"], s["latency_ms_mean"], s["latency_ms_max"]) == (3, 0.333, 0.5, 0.5, 15.0, 20.0)


ANSWERS = "id string, answer string, verdict string, coverage double, claims int, supported int, insufficient int, citation_alignment double, latency_s double, error string"


def test_answer_metrics(spark, cases):
    rows = [("g1", "x", "ANSWER", 0.8, 4, 3, 1, 0.5, 2.0, None), ("g2", "x", "ESCALATE: no", 0.2, 0, 0, 0, None, 4.0, None), ("g3", "has X.", "refuse", None, None, None, None, None, 1.0, None), ("g4", None, None, None, None, None, None, None, None, "Timeout: y")]
    out = E.answer_rows(cases, spark.createDataFrame(rows, ANSWERS))
    got = {r["id"]: r for r in out.collect()}
    assert (got["g1"]["refusal_ok"], got["g1"]["claim_support_rate"], got["g1"]["hallucination_rate"]) == (True, 0.75, 0.25)
    assert (got["g2"]["refusal_ok"], got["g2"]["claim_support_rate"]) == (False, None)
    assert (got["g3"]["refusal_ok"], got["g3"]["answer_term_coverage"]) == (True, 1.0)
    s = E.answer_summary(out).first().asDict()
    assert (s["cases"], s["errors"], s["coverage_mean"], s["refusal_accuracy"], s["latency_s_mean"], s["answer_term_coverage"]) == (4, 1, 0.5, 0.667, 2.333, 1.0)


def test_gate_and_results_file(spark, tmp_path):
    summary = lambda hit, ndcg: spark.createDataFrame([(3, hit, ndcg, None)], "cases int, hit_rate double, ndcg double, intent_accuracy double")
    rows = spark.createDataFrame([("g1", ["a"])], "id string, missing_terms array<string>")
    g = {r["metric"]: (r["delta"], r["regression"]) for r in E.gate(summary(0.9, 0.8), summary(0.84, 0.75)).collect()}
    assert g == {"hit_rate": (-0.06, True), "ndcg": (-0.05, False)}
    path = str(tmp_path / "results.json")
    assert E.read_results(spark, path) == {}
    assert E.write_results(spark, path, {"retrieval": (summary(0.9, 0.8), rows)}) == []
    assert E.write_results(spark, path, {"retrieval": (summary(0.5, 0.8), rows)}) == ["hit_rate"]
    assert E.read_results(spark, path)["retrieval"]["summary"]["hit_rate"] == 0.9  # the old file stays
    assert E.write_results(spark, path, {"answers": (summary(0.1, 0.1), rows)}) == []
    assert E.write_results(spark, path, {"retrieval": (summary(0.5, 0.8), rows)}, accept=True) == ["hit_rate"]
    stored = E.read_results(spark, path)
    assert stored["retrieval"]["summary"]["hit_rate"] == 0.5 and stored["answers"]["rows"] == [{"id": "g1", "missing_terms": ["a"]}]
