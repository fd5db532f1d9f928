import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from basalt.llm import packing

from .conftest import document_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def ids_of(t):
    return [*LIB.encode(t or "", add_special_tokens=False).ids, 0]


def pieces_are_whole(got, rows, window):
    docs, seqs = {}, {}
    for r in got:
        docs.setdefault((r["doc_id"] is None, r["doc_id"] or 0), []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    want = {}
    for i, t in rows:
        want.setdefault((i is None, i or 0), []).append(ids_of(t))
    assert set(docs) == set(want)
    for k, texts in want.items():
        have = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in docs[k])
        assert sum(len(x) for _, x in have) == sum(map(len, texts))
        for start, x in have:
            assert any(t[start : start + len(x)] == x for t in texts)
        if len(texts) == 1:
            assert [x for _, p in have for x in p] == texts[0]
    short = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert 0 < at <= window and at & (at - 1) == 0
        short += at < window
    return short, len(seqs)


def test_each_token_lies_in_one_piece(spark, docs, no_docs):
    for window in (1024, 64):
        short, _ = pieces_are_whole(packing.pack(docs, PATH, window).collect(), document_rows(), window)
        assert short <= 3 * window.bit_length()
    assert packing.pack(no_docs, PATH).count() == 0


def test_small_shards(spark, docs):
    pieces_are_whole(packing.pack(docs, PATH, 128, shard=3).collect(), document_rows(), 128)


def bm25_of(docs):
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400)
    idf, mean = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])

    def bm25(a, b):
        return sum(idf[t] * (docs[b] == t).sum() * 2.2 / ((docs[b] == t).sum() + 1.2 * (0.25 + 0.75 * len(docs[b]) / mean)) for t in set(docs[a].tolist()) & set(docs[b].tolist()))

    return idf, mean, bm25


def random_docs(seed, n=40):
    rng = np.random.default_rng(seed)
    return [np.append(rng.integers(1, 400, rng.integers(0, 60)) // rng.integers(1, 9) + 1, 0).astype(np.uint32) for _ in range(n)]


def test_neighbours_are_ranked_by_bm25():
    docs = random_docs(1)
    idf, mean, bm25 = bm25_of(docs)
    shard = packing.Shard(docs, idf, mean)
    for a in range(len(docs)):
        scores = [bm25(a, b) for b in shard.neighbours(a)]
        assert all(x > y - 1e-4 for x, y in zip(scores, scores[1:], strict=False)) and sorted(shard.neighbours(a)) == list(range(len(docs)))


def test_filling_equals_brute_force():
    """Seeds from the longest rest on, each followed by its unused neighbours, best first; every window is full."""
    window = 32
    for seed in (2, 3, 4):
        docs = random_docs(seed)
        idf, mean, bm25 = bm25_of(docs)
        rest = {k: d.tolist() for k, d in enumerate(docs)}
        want, flat = [], []
        for k, d in rest.items():
            while len(d) >= window:
                want.append(d[:window])
                d = rest[k] = d[window:]
        for k in sorted((k for k in rest if rest[k]), key=lambda k: (-len(rest[k]), k)):
            while rest[k]:
                for b in [k, *sorted(rest, key=lambda b: (-np.float32(bm25(k, b)), b))]:
                    take = min(len(rest[b]), window - len(flat))
                    flat, rest[b] = flat + rest[b][:take], rest[b][take:]
                    if len(flat) == window:
                        want.append(flat)
                        flat = []
                        break
        done, left = packing.fill(list(range(len(docs))), docs, [], idf, mean, window)
        assert [[t for p in seq for t in p[2].tolist()] for seq in done] == want
        assert [t for p in left for t in p[2].tolist()] == flat


def test_related_documents_share_a_shard(spark):
    """Copies and near copies, dealt over all partitions, come to lie in one shard; a common term gathers no more than its share."""
    texts = [" ".join(["common"] + [f"word{(k * 37 + j * j) % 211}" for j in range(30)]) for k in range(150)]
    rows = [(c * 1000 + k, t + (" more" if c else "")) for k, t in enumerate(texts) for c in range(3)] + [(9000 + i, "the same text " * 9) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    tokens = packing.tokenize(df, PATH)
    n, mean, held = packing.statistics(tokens)
    keys = packing.keyed(tokens, n, mean, held, shard=20).collect()
    place = {r["id"]: (r["k1"], r["salt"], r["k2"], r["k3"]) for r in keys}
    assert sum(place[k] == place[1000 + k] == place[2000 + k] for k in range(150)) >= 120
    groups = {}
    for i, p in place.items():
        groups.setdefault(p[:2], []).append(i)
    assert max(map(len, groups.values())) <= 8 * 20
    pieces_are_whole(packing.pack(df, PATH, 128, shard=20).collect(), rows, 128)


def test_ids_equal_the_library():
    words = packing.Words(PATH)
    texts = [t or "" for _, t in document_rows()] + ["<|endoftext|> a", "a  b\n\n c\t", "don't I'LL"]
    assert [x.tolist() for x in words.encode(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


def test_statistics_cover_all_documents(spark, docs):
    n, mean, df = packing.statistics(packing.tokenize(docs, PATH))
    texts = [ids_of(t) for _, t in document_rows()]
    assert n == len(texts) and abs(mean - np.mean([len(t) for t in texts])) < 1e-9
    assert df[0] == n and all(df[t] == sum(t in x for x in texts) for t in {t for x in texts[:3] for t in x})
