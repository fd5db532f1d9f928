import hashlib
import math

import numpy as np

from basalt.llm import codes


def brute(rows):
    """rows: (id, vector, label), of one length; results by id."""
    ok = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = len(ok[0][1])
    cut = [dim * k // 4 for k in range(5)]
    part = lambda v, p: v[cut[p] : cut[p + 1]]
    first = {}
    for i, v, _ in ok:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[part(first[i], p) for i in sorted(first)[:256]] for p in range(4)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(4):
        new = []
        for p in range(4):
            of = [nearest(v, p)[0] for _, v, _ in ok]
            book = []
            for k, e in enumerate(books[p]):
                mine = [part(v, p) for (_, v, _), o in zip(ok, of, strict=True) if o == k]
                book.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else e)
            new.append(book)
        books = new
    out = []
    for i, v, lab in ok:
        found = [nearest(v, p) for p in range(4)]
        out.append([i, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found), lab])
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, c, e, total[lab], sha) for i, c, e, lab in out), key=str)


SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, v int, code int"


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim)) * 0.2
    rows = [(int(i), np.float32(centres[k % 12] + rng.standard_normal(dim) * 0.03).tolist(), [0, 1, None][k % 3]) for k, i in enumerate(rng.permutation(n * 3)[:n])]
    return rows + [(i, rows[0][1], 1) for i in range(5000, 5010)]


def test_equals_brute_force(spark):
    rows = some_rows(330, 18)
    rows += [(7000, None, 1), (7001, [1.0] * 17 + [None], 1), (7002, [float("nan")] * 18, 1), (7003, [float("inf")] * 18, 2), (None, rows[1][1], 1), (rows[2][0], rows[3][1], 0), rows[4]]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    assert collected(codes.compress(df)) == brute(rows)


def test_few_rows_and_lengths(spark):
    for rows in ([(1, [0.5, -0.5, 0.25, 1.0], 1)], [(1, [0.5, -0.25], None), (2, [0.5, -0.25], None), (3, [9.0, -7.0], 1)]):
        assert collected(codes.compress(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA))) == brute(rows)
    mixed = [(1, [], 1), (2, [0.5], 1), (3, [1e30, -1e30, 0.0, 0.0, 0.0], 1), (4, [0.5, 1.0], None), (5, [-1e30, 0.0, 0.0, 0.0, 1e30], 1)]
    got = collected(codes.compress(spark.createDataFrame([(*r, 1, 2, 3) for r in mixed], SCHEMA)))
    assert [r[0] for r in got] == [1, 2, 3, 4, 5] and got[0][1:3] == ("00000000", 0) and all(r[2] == 0 for r in got)


def test_empty_tables(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1, 1, 2, 3), (2, [None], 1, 1, 2, 3)], SCHEMA)).count() == 0
    null_ids = codes.compress(spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0], 1, 1, 2, 3)] * 2, SCHEMA)).collect()
    assert [r["error"] for r in null_ids] == [0, 0]


def test_bounds_lose_no_nearest_entry():
    """Integers of many sizes, ties included; and fewer exact distances than entries."""
    rng = np.random.default_rng(3)
    for size in (2, 50, 1000, codes.BOUND):
        for width in (1, 3, 16, 17):
            x, e = (rng.integers(-size, size + 1, (n, width)) for n in (300, 90))
            e[40:60] = e[:20]
            x[:30] = e[:30]
            of, dist, _ = codes.Codebook(e).nearest(x)
            d = ((x[:, None].astype(object) - e[None].astype(object)) ** 2).sum(2)
            assert (of == d.argmin(1)).all() and (dist == d.min(1)).all()
    near = rng.integers(-500, 500, (256, 16))
    _, _, taken = codes.Codebook(near).nearest(near[rng.integers(0, 256, 1000)] + rng.integers(-20, 20, (1000, 16)))
    assert taken < 1000 * 256 / 20
