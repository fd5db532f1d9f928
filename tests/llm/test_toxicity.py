import math
import random
import re
from collections import Counter

import numpy as np

from basalt.llm import toxicity

from .conftest import document_rows, sentence


def corpus(spark):
    bad = ["idiot", "scumlike", "scumming", "trash"]
    rows = [(i, f"{sentence(i % 30)} {bad[i % 4]} {sentence(i % 7, 5)}" if i % 5 == 0 else sentence(i % 30, 45)) for i in range(300)]
    labels = [(i, int(i % 5 == 0)) for i in range(250)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_marked_words_are_found(spark):
    rows, docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(model).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i, _ in rows)
    assert all(r["evidence"] for r in got.values()) and sum(e["label"] for e in got[5]["evidence"]) > 7
    again = {r["doc_id"]: r["toxic_score"] for r in toxicity.judge(docs, model.index).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def brute(rows, labels, k=toxicity.NEIGHBOURS):
    """Scores of all rows, from the definition: every word of every labelled text, all cosines."""
    words = {i: Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for i, t in rows}
    known = {i: y for i, y in labels.items() if i in words}
    space = sorted({w for i in known for w in words[i]})
    size = Counter(known.values())
    share = size[1] / max(1, len(known))
    weight = {}
    for w in space:
        df = sum(w in c for c in words.values())
        table = Counter((y, w in words[i]) for i, y in known.items())
        info = 0.0
        for y in (0, 1):
            for has in (False, True):
                joint, lone = table[y, has] / len(known), (table[0, has] + table[1, has]) / len(known)
                if joint:
                    info += joint * math.log(joint / (lone * size[y] / len(known)))
        weight[w] = (math.log((len(rows) + 1) / (df + 1)) + 1) * (1 + 2 * toxicity.EVIDENCE * max(0.0, info))

    def unit(c):
        v = {w: (1 + math.log(n)) * weight[w] for w, n in c.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = {i: unit(words[i]) for i in known}
    out = {}
    for i, c in words.items():
        q = unit(c)
        best = sorted(((sum(x * e.get(w, 0.0) for w, x in q.items()), known[j]) for j, e in examples.items()), reverse=True)[:k]
        best = [(round(s, 6), y) for s, y in best if s > 1e-6]
        top = sum(s * s * y for s, y in best) + toxicity.PRIOR_WEIGHT * share
        out[i] = top / (sum(s * s for s, _ in best) + toxicity.PRIOR_WEIGHT)
    return out


def test_scores_equal_brute_force(spark):
    """The whole operator, with several blocks, frequent and rare terms."""
    rnd = random.Random(9)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows = [(i, " ".join(rnd.choice(vocabulary[: rnd.choice([6, 40, 400])]) for _ in range(rnd.randint(0, 40))) + (" scum idiot" if i % 9 == 0 else "")) for i in range(700)]
    labels = {i: int(i % 9 == 0) for i in range(0, 700) if i % 4}
    assert len(labels) > 3 * toxicity.BLOCK
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id bigint, toxic int"))).collect()}
    want = brute(rows, labels)
    # Cosines that tie up to single precision may change places at the end of the list: votes then differ by one neighbour.
    off = [i for i in want if abs(got[i] - want[i]) > 1e-4]
    assert len(off) <= 7 and all(abs(got[i] - want[i]) < 0.1 for i in off)


def test_blocks_passed_over_hold_none_of_the_best(spark):
    rnd = np.random.default_rng(3)
    size, n = 500, 600
    lens = rnd.integers(1, 30, n)
    terms = np.concatenate([np.sort(rnd.choice(size, m, replace=False, p=np.arange(size, 0, -1) / np.arange(size, 0, -1).sum())) for m in lens])
    counts = rnd.integers(1, 4, len(terms))
    index = toxicity.build_index(np.arange(n), (np.arange(n) % 3 == 0).astype(np.int64), terms, counts, lens, [f"t{i}" for i in range(size)], np.arange(size) + 1, 1000, {})
    assert len(index.dense) > 20 and len(index.docs) > 100
    owner, v = index.unit(terms, counts, lens)
    full = np.zeros((n, size))
    full[owner, terms] = v
    examples = np.zeros((n, size))
    for t in range(size):
        if index.place[t] >= 0:
            examples[:, t] = index.dense[index.place[t]]
        at = slice(index.at[t], index.at[t + 1])
        examples[index.docs[at], t] = index.impacts[at]
    cos = full @ examples.T
    assert np.allclose(cos[np.arange(n), np.argsort(index.ids)], 1, atol=1e-5)
    got = index.nearest(terms, counts, lens, 10)
    for i in range(n):
        best = np.sort(cos[i])[::-1][:10]
        assert np.allclose(got[i][1], best[best > 1e-6], atol=1e-5)
        assert np.allclose(cos[i, got[i][0]], got[i][1], atol=1e-5)


def test_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1), (3, 0), (3, 0), (99, 1)], "doc_id bigint, toxic int")
    got = toxicity.score(toxicity.fit(docs, labels)).collect()
    assert len(got) == len(document_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.score(toxicity.fit(no_docs, labels)).count() == 0
    assert {r["score"] for r in toxicity.score(toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_held_out(spark):
    out = toxicity.query(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    rows = [(r["toxic"], r["predicted"]) for r in out.select("toxic", "predicted").collect()]
    hit = sum(a and b for a, b in rows)
    assert hit >= 0.9 * sum(a for a, _ in rows) and hit >= 0.9 * sum(b for _, b in rows)
