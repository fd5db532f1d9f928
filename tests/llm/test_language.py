import zlib

import numpy as np

from basalt.llm import language

from .conftest import document_rows

SAMPLES = {"en": "the people of the town thought that this was the right thing to do with their time", "fr": "les gens de la ville pensaient que c'était une bonne chose à faire avec leur temps", "de": "die Leute der Stadt dachten, dass es das Richtige wäre, was sie mit ihrer Zeit tun könnten"}


def test_languages(spark):
    model = language.fit(spark.createDataFrame([(t, k) for k, t in SAMPLES.items()], "text string, lang string"))
    assert model[0] == ["de", "en", "fr"]
    rows = [("the town of the people",), ("la ville de gens",), ("die Stadt der Leute",), (None,), ("",), ("123 !!",), ("日本",)]
    got = [(r["lang_pred"], r["lang_score"]) for r in language.predict(spark.createDataFrame(rows, "text string"), model).collect()]
    assert [p for p, _ in got[:6]] == ["en", "fr", "de", "und", "und", "und"] and got[6][0] in model[0]
    assert all(0 <= s <= 1 for _, s in got)


def test_odd_rows(spark, docs, no_docs):
    model = language.fit(docs)
    got = language.predict(docs, model)
    assert got.columns == [*docs.columns, "lang_pred", "lang_score"] and got.count() == len(document_rows())
    assert {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()} == {20, 21, 22, 27}
    assert language.fit(no_docs)[0] == []
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(no_docs)).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_vectors():
    import numpy as np

    owner, which, distinct, has = language.trigrams(["ab a", ""])
    assert has.tolist() == [True, False]
    got = language.trigram_vectors(distinct)[which].astype(int).sum(0)
    v = {c: language.letter_vector(ord(c) if c != " " else 0).astype(int) for c in "ab "}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in (" ab", "ab ", "b a", " a "))
    assert (got == want).all() and set(owner.tolist()) == {0}


def test_held_out_accuracy(spark):
    out = language.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() >= 0.98 * out.count()


def brute_bundle(text):
    """Sum of the bound trigram vectors of a text, letter by letter."""
    seq = [0]
    for c in (text or "").lower() + " ":
        if c.isalpha():
            seq.append(ord(c))
        elif seq[-1]:
            seq.append(0)
    total = np.zeros(language.DIM)
    for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
        total += np.roll(language.letter_vector(a), 2).astype(float) * np.roll(language.letter_vector(b), 1) * language.letter_vector(c)
    return total, max(0, len(seq) - 2)


def test_query_equals_brute_force(spark, tmp_path):
    """Prototypes and cosines of the whole query from the definition."""
    rows = [(r["doc_id"], r["text"][:300], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + [(9001, None, "en"), (9002, "123 !!", "de"), (9003, "wort", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    protos = {}
    for i, t, lang in rows:
        total, n = brute_bundle(t)
        if lang is not None and t is not None and n and zlib.crc32(str(i).encode()) % 4 != 2:
            protos[lang] = protos.get(lang, 0) + total / n
    unit = {lang: v / np.linalg.norm(v) for lang, v in protos.items()}
    for r in language.query(spark, str(tmp_path)).collect():
        total, n = brute_bundle(dict((i, t) for i, t, _ in rows)[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not n:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cos = {lang: float(total @ v) / np.linalg.norm(total) for lang, v in unit.items()}
        assert abs(r["score"] - max(0.0, max(cos.values()))) < 1e-3 and max(cos.values()) - cos[r["lang_pred"]] < 1e-3


def test_a_batch_is_taken_in_pieces():
    """Trigrams of a batch never stand in memory at once: pieces hold PIECE_CHARS characters at most, or one text, and every text once."""
    texts = ["", "a" * 10, "b" * language.PIECE_CHARS, "c", "d" * (language.PIECE_CHARS + 5), "", "e"]
    got = list(language.pieces(texts))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(len(texts)))
    assert all(hi - lo == 1 or sum(map(len, texts[lo:hi])) <= language.PIECE_CHARS for lo, hi in got)
    assert len(got) > 3 and list(language.pieces([])) == []
