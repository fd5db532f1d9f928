import math
import re
from collections import Counter

import numpy as np
import public_tokenizers

from basalt.llm import lmscore, shared

from .conftest import document_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def run(docs, learn):
    counts = shared.cut(lmscore.word_counts(learn), "t-words")
    return lmscore.score(docs, lmscore.fit(learn, counts, PATH), counts)


def test_base_scores(spark, docs, monkeypatch):
    for frequent in (lmscore.FREQUENT, 5):
        monkeypatch.setattr(lmscore, "FREQUENT", frequent)
        learn = docs.where("doc_id < 20")
        c = Counter(w for i, t in document_rows() if i is not None and i < 20 for w in [*words(t), ""])
        n, v = sum(c.values()), len(c)
        texts = dict(document_rows())
        got = run(docs, learn).collect()
        assert len(got) == len(document_rows())
        for r in got:
            ws = [*words(texts[r["doc_id"]]), ""]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
            assert abs(r["base_score"] - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws)
            assert math.isfinite(r["score"]) and r["score"] < 0


def test_score_takes_the_counts_of_all_words(spark, docs, monkeypatch):
    """FREQUENT decides where a count is looked up, not what it is."""
    learn = docs.where("doc_id < 20")
    counts = shared.cut(lmscore.word_counts(learn), "t-words")
    got = []
    for frequent in (lmscore.FREQUENT, 5, 0):
        monkeypatch.setattr(lmscore, "FREQUENT", frequent)
        model = lmscore.fit(learn, counts, PATH)
        assert len(model.words) <= frequent
        got.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in lmscore.score(docs, model, counts).collect()))
    for other in got[1:]:
        assert np.allclose([r[2] for r in got[0]], [r[2] for r in other], rtol=1e-9)


def test_class_table_counts_all_texts_and_the_sample_grows(spark, docs, monkeypatch):
    rng = np.random.default_rng(3)
    sub = lmscore.subwords(PATH)
    classes = rng.integers(0, 7, sub.size)
    rows = docs.selectExpr("doc_id id", "text")
    want = np.zeros((sub.size, 7))
    for _, t in document_rows():
        ids = [sub.end, *sub.split(lmscore.words_of(t or ""))[0].tolist(), sub.end]
        np.add.at(want, (ids[:-1], classes[ids[1:]]), 1)
    for cache in (lmscore.CACHE_WORDS, 50):
        monkeypatch.setattr(lmscore, "CACHE_WORDS", cache)
        assert (lmscore.following(rows, classes, 7, PATH) == want).all()
    many = spark.range(3000).selectExpr("id", "concat('text ', id, repeat(' and more', 2500)) text")
    monkeypatch.setattr(lmscore, "SAMPLE", 1 / 20)
    monkeypatch.setattr(lmscore, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(lmscore, "BUCKET_DOCS", 20)
    sizes = []
    for n in (1000, 3000):
        got = [t for r in lmscore.sample_buckets(many.where(many.id < n), n, PATH).collect() for t in r["texts"]]
        assert all(len(t) > 4 * 5000 for t in got)  # whole
        sizes.append(len(got))
    assert 25 < sizes[0] < 90 and sizes[1] > 2 * sizes[0]


def test_all_that_is_learned_counts_every_text(spark, docs):
    """By the counts' definitions, position by position; one text more or less changes them."""
    rng, sub = np.random.default_rng(4), lmscore.subwords(PATH)
    classes, n = rng.integers(0, 5, sub.size), 5
    col = np.where(rng.random(sub.size) < 0.3, rng.integers(0, lmscore.NEIGHBOURS, sub.size), -1)
    near, total = np.zeros((sub.size, 2 * lmscore.NEIGHBOURS), int), np.zeros(2 * sub.size * n + n**3, int)
    first, later, three = total[: sub.size * n].reshape(-1, n), total[sub.size * n : 2 * sub.size * n].reshape(-1, n), total[2 * sub.size * n :].reshape(n, n, n)
    for _, t in document_rows():
        ids = [sub.end, *sub.split(lmscore.words_of(t or ""))[0].tolist(), sub.end]
        c = [int(classes[x]) for x in ids]
        for at, x in enumerate(ids):
            for step in range(1, min(31, len(ids) - at)):
                y = ids[at + step]
                if step == 1:
                    first[x, c[at + 1]] += 1
                if step <= 4 and col[y] >= 0:
                    near[x, col[y]] += 12 // step
                if step <= 4 and col[x] >= 0:
                    near[y, col[x] + lmscore.NEIGHBOURS] += 12 // step
                if step in lmscore.LAGS:
                    later[x, c[at + step]] += 1
                if step in lmscore.PAIR_LAGS:
                    three[c[at + step - 1], c[at], c[at + step]] += 1
    for parts in (1, 5):
        stream = shared.cut(lmscore.streams(docs.repartition(parts), PATH), "t-stream")
        assert (lmscore.summed(stream, near.size, PATH, lambda ids, docs, total: lmscore.company(ids, docs, col, total)) == near.ravel()).all()
        assert (lmscore.summed(stream, total.size, PATH, lambda ids, docs, total: lmscore.contexts(ids, docs, classes, n, total)) == total).all()
        want = Counter(w for _, t in document_rows() for w in [*words(t), ""])
        assert {r["word"]: r["c"] for r in lmscore.counted(stream).collect()} == want


def test_share_of_the_text_so_far(spark):
    """A word that stood before in its text is likelier there; in another text it is not."""
    learn = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(9)], "doc_id bigint, text string")
    counts = shared.cut(lmscore.word_counts(learn), "t-words")
    texts = spark.createDataFrame([(1, "qwxyz alpha beta"), (2, "alpha beta qwxyz"), (3, "alpha beta qwxyz qwxyz"), (4, "alpha qwxyz beta qwxyz")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in lmscore.score(texts.coalesce(1), lmscore.fit(learn, counts, PATH), counts).collect()}
    assert got[3] - got[2] > math.log10(lmscore.MIX[3] / 4) - 0.5  # the share is 1 / 4, ends apart
    assert got[2] < -3 and got[1] < -3


def test_nothing_to_learn_or_score(spark, docs, no_docs):
    assert run(no_docs, docs).count() == 0
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in run(docs, no_docs).collect())


def small_model():
    rng = np.random.default_rng(0)
    sub = lmscore.subwords(PATH)
    ids = rng.choice([262, 257, 318, 290, 511, 1100, 1169, 407], 4000).astype(np.int32)
    ids[::50] = sub.end
    return sub, ids, lmscore.train(ids, np.cumsum(ids == sub.end).astype(np.int32), sub.starts, sub.size)


def test_windows_score_each_token_once_and_causally():
    """Whatever the slices, a position's value depends on its own text up to it, at most two contexts back."""
    sub, ids, att = small_model()
    docs, target = np.zeros(300, np.int32), att.classes[ids[1:301]]
    whole = lmscore.class_logs(att, ids[:300], docs, target)
    old, lmscore.SLICE = lmscore.SLICE, 32
    assert np.allclose(lmscore.class_logs(att, ids[:300], docs, target), whole, atol=1e-5)
    lmscore.SLICE = old
    changed = ids[:300].copy()
    changed[200:] = 262
    assert np.allclose(lmscore.class_logs(att, changed, docs, target)[:200], whole[:200], atol=1e-5)
    alone = lmscore.class_logs(att, ids[160:300], docs[:140], target[160:])
    two = lmscore.class_logs(att, ids[:300], (np.arange(300) >= 160).astype(np.int32), target)
    assert np.allclose(two[160:], alone, atol=1e-5) and np.allclose(two[:160], whole[:160], atol=1e-5)
    assert not np.allclose(two[160:176], whole[160:176], atol=1e-5)


def test_class_logs_equal_brute_force():
    """Masked attention by its definition, position by position, over several texts."""
    sub, ids, att = small_model()
    ids, docs = ids[:400], np.repeat(np.arange(8), 50).astype(np.int32)
    target = att.classes[np.roll(ids, -1)]
    got = lmscore.class_logs(att, ids, docs, target)
    for i in range(400):
        seen = [j for j in range(max(0, i // 16 * 16 - 16), i + 1) if docs[j] == docs[i]]
        weight = np.exp([float(att.query[ids[i]] @ att.key[ids[j]]) + float(att.lag[i - j]) for j in seen])
        state = sum(w * att.value[ids[j]].astype(float) for w, j in zip(weight / weight.sum(), seen, strict=True))
        z = att.table[ids[i]] + state @ att.out
        assert abs(got[i] - (z[target[i]] - np.log(np.exp(z).sum()))) < 1e-4


def test_class_distribution_sums_to_one():
    sub, ids, att = small_model()
    n = att.out.shape[1]
    total = sum(np.exp(lmscore.class_logs(att, ids[:64], np.zeros(64, np.int32), np.full(64, c))) for c in range(n))
    assert np.allclose(total, 1, atol=1e-4)
    begin, begun, inner = lmscore.output_tables(att, [(-1, 262, 5), (3, 407, 2)], sub.size, 7)
    assert np.allclose(np.bincount(att.classes, np.exp(begin), minlength=n)[np.unique(att.classes)], 1, atol=1e-3)
    assert np.allclose(np.bincount(att.classes, np.exp(inner[3]), minlength=n)[np.unique(att.classes)], 1, atol=1e-3)


def test_held_out_beats_the_base(spark):
    r = lmscore.query(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").collect()[0]
    assert r["s"] > r["b"]


def test_held_out_score(spark):
    """Classes are all that attention predicts: with 80 of them this is -3.976."""
    r = lmscore.query(spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(score) / sum(n_tokens) s").collect()[0]
    assert r["s"] > -3.96
