"""Signatures of document types are only read where a literal that each match must hold is there."""

import random
import re

from pyspark.sql import functions as F

from basalt.operators import assets as A

PATTERNS = [p for rules in A.SIGNATURES.values() for p, _ in rules]


def test_literals_of_patterns():
    assert A.needed(r"\bwork\s*order\b") == ["order"] and A.needed(r"\bmsds\b|\bsds\b") == ["msds", "sds"] and A.needed(r"\b(operating|user)\s*manual\b") == ["manual"]
    assert A.needed(r"\brepair(ed|s)?\b") == ["repair"] and A.needed(r"\blabou?r\b") == ["labo"] and A.needed(r"[a-z]+") == [] and A.needed(r"\bab|[0-9]") == []
    assert all(map(A.needed, PATTERNS))


def test_types_as_without_literals(spark, monkeypatch):
    rng = random.Random(4)
    words = sorted({w for p in PATTERNS for w in re.findall(r"[a-z]{2,}|&|/", re.sub(r"\\[bsd]", " ", p))}) + ["wo 5", "sop-1", "5 whys", "p & id", "mm/s", "as-found", "non destructive", "Step 3"]
    docs = spark.createDataFrame([(i, "".join(rng.choice(words) + rng.choice([" ", " ", "-", "", "\n", "s ", "ed "]) for _ in range(60))) for i in range(300)] + [(900, None), (901, "WORK ORDER")], "doc_id long, text string")
    types = lambda: A.document_types(docs, "doc_id", "text")
    plan = types()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(") >= len(PATTERNS) and plan.count("lower(") == 1
    got = sorted(map(tuple, types().collect()))
    monkeypatch.setattr(A, "needed", lambda p: [])
    assert got == sorted(map(tuple, types().collect())) and len({r[1] for r in got}) > 6
    assert dict((r[0], r[1]) for r in got)[901] == "Work Order"
