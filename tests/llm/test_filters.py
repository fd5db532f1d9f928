import re
from itertools import permutations

import numpy as np
import pyarrow as pa

from basalt.llm import filters

from .conftest import document_rows, sentence


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"words": len(words), "distinct": len(set(words)), "capitals": len(re.findall("[A-Z]", text)), "chars": len(text), "symbols": len(re.findall(r"[#$%&*|]", text))}


def some_texts():
    rng = np.random.default_rng(2)
    letters = list("abAB é日😀 \t\n\x0b\x0c\r\x85 #$") + ["word ", "Two ", "x" * 30]
    return [t or "" for _, t in document_rows()] + ["".join(rng.choice(letters, rng.integers(0, 400))) for _ in range(200)]


def check(texts):
    got = filters.measure(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert {name: int(v[k]) for name, v in got.items()} == counts(t), (k, t[:80])


def test_measures():
    check(some_texts())
    check([])
    check(["", "", ""])
    assert filters.measure(pa.array(["x y", None, "a b c"], pa.string()).slice(1))["words"].tolist() == [0, 3]


def test_small_pieces(monkeypatch):
    """Texts and words that are longer than a piece."""
    for size in (1, 3, 64):
        monkeypatch.setattr(filters, "PIECE", size)
        check([t[:600] for t in some_texts()][::3])


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(filters, "VALUES", np.ones(256, np.uint64))
    check(some_texts())
    monkeypatch.setattr(filters, "PIECE", 16)
    check(some_texts())


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    docs, first = [], {}
    for i, text, lang in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, lang in rows:
        c = counts(text or "")
        fails = {"A": c["words"] < 200, "B": 100 * c["distinct"] < 50 * c["words"], "C": 100 * c["capitals"] > 3 * c["chars"], "D": c["symbols"] > 0, "E": i is not None and i > first[text or ""]}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [d for d in mine if f in d[0] and not d[0] & set(order[:k])]
                kept = sum(not d[0] & set(order[: k + 1]) for d in mine)
                again = sum(f in d[0] and bool(d[0] & set(order[:k])) for d in mine)
                out[part, "".join(order), k + 1] = [kept, len(here), again, sum(d[0] == {f} for d in mine), sum(d[1] for d in here), sum(d[2] for d in here), f]
    for (part, order, k), row in out.items():
        row[6] = sum(r[1] for (p, o, j), r in out.items() if p == part and o[j - 1] == order[k - 1])
    return {k: tuple(v) for k, v in out.items()}


def filter_rows():
    rows = [(i, t, ["en", None, "", "fr"][k % 4]) for k, (i, t) in enumerate(document_rows())]
    rows += [(100 + i, " ".join(f"word{j}" for j in range(250)) + ("#" if i % 2 else "") + ("A" * 200 if i % 3 else ""), "en") for i in range(8)]
    rows += [(130, sentence(2), "fr"), (131, " ".join(["x"] * 300), "de"), (None, sentence(2), "fr"), (None, sentence(2), "fr"), (130, sentence(2), "fr"), (0, sentence(3), "en")]
    return rows


LABELS = [(0, 1, 0), (10, 1, 1), (11, 1, 0), (11, 0, 1), (100, 1, None), (101, None, 1), (103, 0, 1), (130, 1, 1), (None, 1, 1), (999, 1, 1)]


def test_all_orders(spark):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in filter_rows()], "doc_id bigint, text string, lang string, mask int, id int, part int").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filters.interactions(docs, labels).collect()}
    assert got == brute(filter_rows(), LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filters.interactions(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    rows = filters.interactions(one, labels).collect()
    assert len(rows) == 600 and sum(r["removed"] for r in rows) == 120  # an empty text fails A alone
