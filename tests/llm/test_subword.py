import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import sentencepiece

from basalt.llm import subword

from .conftest import document_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_text_equal_the_library(spark, docs, no_docs):
    back = subword.decode(subword.encode(docs, MODEL), MODEL)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], r["text"]) for r in back.collect()))
    want = sorted(((i is None, i or 0, LIB.encode(t or ""), LIB.decode(LIB.encode(t or ""))) for i, t in document_rows()))
    assert got == want
    assert subword.encode(no_docs, MODEL).count() == 0


def test_random_texts():
    rnd, enc = random.Random(3), subword.Encoder(MODEL)
    texts = ["".join(rnd.choice(["a", "b", "th", "e", " ", "  ", "▁", "\n", "1", "é", "日", "😀", "<0x0A>", "ing", "==", "�"]) for _ in range(rnd.randint(0, 120))) for _ in range(400)]
    ids, lens = enc.encode(texts)
    back, at = subword.decode_ids(enc.table, ids, lens), 0
    for t, n, b in zip(texts, lens, back, strict=True):
        assert ids[at : at + n].tolist() == LIB.encode(t)
        assert b == LIB.decode(LIB.encode(t))
        at += n


def test_cache_size_does_not_matter(monkeypatch):
    monkeypatch.setattr(subword, "CACHE_SEGMENTS", 5)
    enc = subword.Encoder(MODEL)
    for text in ("one two three four five six seven", "two three", "eight nine ten one"):
        assert enc.encode([text])[0].tolist() == LIB.encode(text)


def test_decoding_any_ids():
    table, rnd = subword.merge_table(MODEL), random.Random(4)
    for _ in range(300):
        ids = [rnd.choice([rnd.randrange(3, 300), rnd.randrange(259, 32000)]) for _ in range(rnd.randint(0, 12))]
        assert subword.decode_ids(table, np.array(ids, np.int64), np.array([len(ids)]))[0] == LIB.decode(ids)


def unbroken(rnd, kind, n):
    """A text without a space."""
    if kind == "letters":
        return "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    if kind == "runs":
        return "".join(rnd.choice(["a" * rnd.randint(1, 40), "b", "aa", "--", "==", "ing", "the"]) for _ in range(n // 5))
    if kind == "base64":
        return base64.b64encode(rnd.randbytes(n * 3 // 4)).decode()
    if kind == "code":
        return "".join(rnd.choice(["function(", "var_", "{", "}", "();", "return", "Name", "0x1f", "===", "//", "getElement"]) for _ in range(n // 5))
    return "".join(chr(rnd.randint(0x4E00, 0x5FFF)) for _ in range(n))


def test_texts_without_spaces():
    rnd, enc = random.Random(6), subword.Encoder(MODEL)
    for kind in ("letters", "runs", "base64", "code", "han"):
        texts = [unbroken(rnd, kind, rnd.randint(subword.LONG - 20, 3000)) for _ in range(40)]
        ids, lens = enc.encode(texts)
        for t, n, at in zip(texts, lens, np.cumsum(lens) - lens, strict=True):
            assert ids[at : at + n].tolist() == LIB.encode(t)


def test_a_megabyte_without_a_space_takes_linear_time():
    rnd = random.Random(7)
    for kind in ("letters", "base64"):
        text, began = unbroken(rnd, kind, 1_000_000), time.time()
        ids = subword.Encoder(MODEL).encode([text])[0]
        assert time.time() - began < 20 and ids.tolist() == LIB.encode(text)


def test_characters_of_every_plane():
    """100,000 code points, known to the vocabulary or not: alone, in short and in long segments, beside pieces that merge."""
    rnd, enc = random.Random(8), subword.Encoder(MODEL)
    points = [rnd.choice([rnd.randrange(0x20, 0xD800), rnd.randrange(0xE000, 0x110000), rnd.randrange(0x7D01, 0xA000), rnd.randrange(0x10000, 0x20000)]) for _ in range(100_000)]
    chars, texts = [chr(p) for p in points] + ["\ufb03", "\U0001d400", "\U0001f300", "\u7d01", "\uffff", "\U0010ffff"], []
    at = 0
    while at < len(chars):
        n = rnd.choice([1, 2, 5, 30, 400, 900])
        part = chars[at : at + n]
        at += n
        texts.append("".join(c + rnd.choice(["", "", "ing", "the ", "a", " "]) for c in part) if rnd.random() < 0.5 else "".join(part))
    ids, lens = enc.encode(texts)
    back = subword.decode_ids(enc.table, ids, lens)
    for t, n, at, b in zip(texts, lens, np.cumsum(lens) - lens, back, strict=True):
        assert ids[at : at + n].tolist() == LIB.encode(t)
        assert b == LIB.decode(LIB.encode(t))


def test_query_keeps_rows_with_unknown_characters(spark, tmp_path):
    rows = [(1, "\u7d01\ud7a3 plain words"), (2, "x\U0001f300" * 300), (3, "\ue000\U0010ffff"), (4, "\ufb03 \U0001d400")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_tokens"] for r in subword.query(spark, str(tmp_path)).collect()}
    assert got == {i: len(LIB.encode(t)) for i, t in rows}


def test_query_digests(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in subword.query(spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    every = [(i, LIB.encode(t or "")) for i, t in document_rows()]
    assert got == sorted((i is None, i or 0, len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids))) for i, ids in every)
