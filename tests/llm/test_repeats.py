import hashlib

import numpy as np
import pytest

from basalt.llm import repeats

from .conftest import document_rows, sentence

L = repeats.LEAST


def brute(rows):
    """(id, n_bytes, n_removed, n_spans, digest) by a table of all windows."""
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for p in range(len(b) - L + 1):
                w = b[p : p + L]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - L + 1) if i is not None else ():
            if first[b[p : p + L]] < i:
                gone[p : p + L] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    rng = np.random.default_rng(4)
    shared = [sentence(70 + k, 30) for k in range(4)] + ["=" * 120, "ab" * 60, "é日" * 40]
    rows = document_rows()
    for i in range(60):
        parts = [sentence(200 + i, int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(0, 4))):
            s = shared[int(rng.integers(0, len(shared)))]
            lo = int(rng.integers(0, 40))
            parts += [s[lo : lo + int(rng.integers(20, 140))], sentence(300 + i, int(rng.integers(0, 12)))]
        rows.append((100 + int(rng.integers(0, 500)), " ".join(parts)))
    first = rows[-1][1]
    rows += [(90, first), (91, first), (900, first), (900, first), (901, first + " and then something else goes on here that is long enough to be new"), (None, first), (902, "x" * 49), (903, "x" * 49), (904, "x" * 50), (905, "x" * 51), (906, "y" * 300)]
    return rows


def collected(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_equals_a_table_of_all_windows(spark, hot):
    rows = repeat_rows()
    docs = spark.createDataFrame([(*r, 1, 2, "p") for r in rows], "doc_id bigint, text string, row int, unit int, path string").repartition(5)
    out = repeats.remove_repeats(docs, hot=hot)
    assert collected(out) == brute(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out.collect())


def test_query(spark, tmp_path):
    rows = repeat_rows()[::2]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert collected(repeats.query(spark, str(tmp_path))) == brute(rows)


def test_empty(spark, no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0


def test_longest_previous_factor():
    """Against the definition, on every prefix length."""
    rng = np.random.default_rng(1)
    for letters in (1, 2, 3):
        words = rng.integers(97, 97 + letters, (120, L)).astype(np.uint8)
        words[:, 8:] = words[0, 8:]
        doc = rng.integers(0, 30, len(words))
        order, prefix = repeats.suffix_order(np.ascontiguousarray(words).view(f"V{L}").ravel(), doc)
        w, d = words[order], doc[order]
        equal = np.cumprod(w[:, None] == w[None], axis=2).sum(2)
        want = np.where(d[None] < d[:, None], equal, 0).max(1)
        for least in (1, 4, L):
            got = repeats.longest_previous(d, prefix, least)
            assert (got[want >= least] == want[want >= least]).all() and (got[want < least] == 0).all()


def test_long_texts_are_cut_with_overlap(monkeypatch):
    texts = [b"", b"x" * 10, sentence(5, 200).encode(), sentence(6, 40).encode(), b"z" * 1000]
    whole = {}
    for size in (repeats.CHUNK, 60, 7):
        monkeypatch.setattr(repeats, "CHUNK", size)
        found = set()
        for data, text, place, starts, ends in repeats.chunks(texts):
            of, at, n, h = repeats.runs(data, starts, ends)
            for o, a, m, x in zip(of, at, n, h, strict=True):
                found |= {(int(text[o]), int(place[o] + a - starts[o]) + k, int(x)) for k in range(int(m))}
        assert found == whole.setdefault("runs", found)
    assert len(found) == sum(max(0, len(t) - L + 1) for t in texts)


def test_slices_keep_equal_windows_together(monkeypatch):
    data = np.frombuffer((sentence(1, 40) * 3).encode(), np.uint8)
    where = np.arange(len(data) - L + 1)
    doc = where // 100
    want = repeats.repeated(repeats.windows_of(data, where), doc)
    monkeypatch.setattr(repeats, "SLICE", 50)
    got, seen = np.zeros(len(where), bool), 0
    for part in repeats.slices(data, where):
        got[part], seen = repeats.repeated(repeats.windows_of(data, where[part]), doc[part]), seen + len(part)
    assert seen == len(where) and (got == want).all() and want.any()
