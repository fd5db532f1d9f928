"""Where scores are summed, and what a kept index writes."""

import os
import re

import numpy as np
import pyarrow as pa
from basalt.operators import index as I
from basalt.operators import rank as R
from basalt.operators import store as S


def test_pairs_of_query_and_document_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"pump seal number {i % 5} bearing") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "pump bearing"), (2, "seal number 3")], "item_id long, text string")
    ix = I.build(docs)
    for scores in (I.bm25(ix, asked), I.dense(ix, asked)):
        assert not re.search(r"hashpartitioning\(qid#\d+L?, doc#", scores._jdf.queryExecution().executedPlan().toString())
        assert scores.count() == 80


def test_vector_lengths_are_written_when_asked_for(spark, tmp_path):
    store = S.IndexStore(spark, f"file://{tmp_path}/ix")
    store.add(spark.createDataFrame([(1, "pump seal"), (2, "bearing")], "doc_id long, text string"))
    ix = store.open()
    assert not os.path.exists(tmp_path / "ix" / "norms")
    assert ix.norms().count() == 2 and os.path.exists(tmp_path / "ix" / "norms")


def test_tasks_leave_only_the_best_documents_of_a_query(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"pump Seal number {i % 7} bearing " + "oil " * (i % 4)) for i in range(300)] + [(1000, None)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "pump bearing oil"), (2, "Seal number 3"), (3, "nothing known")], "item_id long, text string")
    ix = I.build(docs)
    legs = [lambda **k: I.bm25(ix, asked, **k), lambda **k: I.dense(ix, asked, **k), lambda **k: I.graph_leg(docs, asked, **k)]
    monkeypatch.setattr(I, "CELLS", 8)  # cut in many blocks here; tasks have their own value
    for leg in legs:
        rows = lambda df: sorted(map(tuple, I.ranked(df, 5).select("qid", "doc", "score", "rank").collect()))
        best = leg(depth=5)
        assert rows(best) == rows(leg()) and best.count() <= 5 * 2 * 4 < leg().count()
        pairs = spark.createDataFrame([(1, 4), (2, 4), (2, 17), (3, 4)], "qid long, doc long")
        assert sorted(map(tuple, leg(pairs=pairs).collect())) == sorted(map(tuple, leg().join(pairs, ["qid", "doc"]).collect()))


def test_blocks_and_batches_give_the_best_of_all():
    rng = np.random.default_rng(1)
    docs, terms = np.repeat(np.arange(900), 6), np.tile(np.arange(6), 900)
    w = rng.integers(0, 4, len(docs)) / 2  # many ties
    starts, queries, weights = np.arange(0, 13, 2), np.tile(np.arange(2), 6), rng.integers(1, 3, 12).astype(float)
    total = np.zeros((900, 2))
    np.add.at(total, (np.repeat(docs, 2), np.tile(queries[:2], len(docs))), (w[:, None] * weights.reshape(6, 2)[terms]).ravel())
    wanted = {q: sorted((-s, d) for d, s in enumerate(total[:, q]) if s > 0)[:7] for q in range(2)}
    for size, cells in ((11, 10), (5000, 64), (10_000, 200_000)):
        I.CELLS, before = cells, I.CELLS
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (docs, terms.astype("int32"), w)], ["doc", "t", "w"]) for i in range(0, len(docs), size)]
        out = [r for b in I._best(2, starts, queries, weights, 7)(iter(batches)) for r in b.to_pylist()]
        I.CELLS = before
        assert {q: sorted((-r["score"], r["doc"]) for r in out if r["q"] == q) for q in range(2)} == wanted


def test_nearest_vectors_of_blocks_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)] + [(200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(R, "QUERY_BLOCK", 5)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 16)
    found = R.cosine_topk(vectors, vectors.where("vec_id % 10 = 0 and vec_id < 120"), 4)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 4 and None not in v and any(v)}
    want = {(q, d, round(float(unit[q] @ unit[d]), 6)) for q in unit if q % 10 == 0 and q < 120 for d in sorted((d for d in unit if d != q), key=lambda d: (-round(float(unit[q] @ unit[d]), 6), d))[:4]}
    assert {(r["qid"], r["doc"], r["score"]) for r in found.where("qid <> 200 and score is not null").collect()} >= want
    alone = R.cosine_topk(vectors.where("vec_id > 200"), vectors.where("vec_id = 203"), 9).collect()
    assert [(r["doc"], r["score"], r["rank"]) for r in alone] == [(201, None, 0), (202, None, 1)]
