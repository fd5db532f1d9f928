import numpy as np

from basalt.llm import vectors


def brute(rows, least=0.98):
    ok = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok[i] = (np.array(v, float), lab)
    ids = sorted(ok)
    links, top = {i: 0 for i in ids}, {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (x, p), (y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a] += 1
                links[b] += 1
                m, n = find(a), find(b)
                top[max(m, n)] = min(m, n)
    return {i: (links[i], find(i)) for i in ids}


def some_rows():
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for g in range(40):
        centre = rng.standard_normal(16)
        for _ in range(1 + g % 9 * (6 if g == 8 else 1)):
            rows.append((n, (centre + rng.standard_normal(16) * 0.06).tolist(), g % 3))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, [2 * x for x in rows[0][1]], 0)]
    odd = [None, [], [0.0] * 16, [1.0, None, 2.0], [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.0]]
    return rows + [(n + 10 + k, v, 0) for k, v in enumerate(odd)] + [(n + 30, rows[0][1], None), (None, rows[0][1], 0)]


SCHEMA = "vec_id bigint, embedding array<double>, label int, n int, key bigint, rep int"


def check(spark, **kw):
    rows = some_rows()
    want = brute(rows)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in [*rows, rows[3]]], SCHEMA).repartition(3)
    got = vectors.near_duplicates(df, **kw).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        links, comp = want.get(r["vec_id"], (0, r["vec_id"]))
        assert (r["n_links"], r["component_id"]) == (links, comp), r
        assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == comp)


def test_all_links(spark):
    check(spark)


def test_many_leaves_and_blocks(spark, monkeypatch):
    """Small leaves, samples and blocks take the paths that large tables take."""
    monkeypatch.setattr(vectors, "LEAF", 16)
    monkeypatch.setattr(vectors, "LEAST_SAMPLE", 8)
    monkeypatch.setattr(vectors, "BLOCK", 4)
    check(spark, trees=12)


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_finds_the_links(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    want = brute(list(zip(t["vec_id"], t["embedding"], t["label"], strict=True))) if len(t["vec_id"]) <= 600 else None
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.query(spark, "/root/testdata/sf0.1").collect()}
    if want is None:
        x, lab = np.array(t["embedding"], float), np.array(t["label"])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = (x @ x.T >= 0.98) & (lab[:, None] == lab[None, :])
        np.fill_diagonal(near, False)
        assert sum(n for n, _ in got.values()) >= 0.9 * near.sum() and all(got[i][0] <= n for i, n in zip(t["vec_id"], near.sum(1), strict=True))
    else:
        assert got == want
