"""The folded graph against brute force over listed edges."""

import random

from basalt.operators import graph as G

E = "src string, dst string, rel string"


def sample():
    """Edges and blocks with nodes that are alike, lie in two blocks, are linked to themselves, or have a block's edge listed as well."""
    rng = random.Random(5)
    left, right = [("x", f"l{i}") for i in range(6)] + [("y", f"l{i}") for i in range(4, 9)], [("x", f"r{i}") for i in range(7)] + [("y", f"r{i}") for i in range(5, 9)] + [("z", "r1"), (None, "r2")]
    listed = {(f"t{rng.randrange(4)}", f"l{rng.randrange(9)}", rng.choice(["REQUIRES", "GOVERNS"])) for _ in range(9)} | {("t0", "t0", "MENTIONS"), ("u", "t1", "MENTIONS"), ("l0", "r0", "CONNECTED_TO"), ("r0", "l0", "CONNECTED_TO"), ("a", "b", "GOVERNS"), ("c", "b", "GOVERNS")}
    every = listed | {(x, y, "CONNECTED_TO") for p, x in left for q, y in right if p == q}
    return listed, left, right, every


def graph(spark):
    listed, left, right, every = sample()
    b = "block string, node string"
    return G.fold(spark.createDataFrame(sorted(listed), E), ((spark.createDataFrame(left, b), spark.createDataFrame(right, b), "CONNECTED_TO"),)), every


def around(every):
    out = {}
    for s, d, r in every:
        out.setdefault(s, []).append((d, r))
        out.setdefault(d, []).append((s, r))
    return out


def hops_from(adj, start, most):
    seen, front = {start: 0}, {start}
    for h in range(1, most + 1):
        front = {o for x in front for o, _ in adj.get(x, ())} - set(seen)
        seen |= dict.fromkeys(front, h)
    return seen


def test_edges_degrees_and_subgraph(spark):
    g, every = graph(spark)
    adj = around(every)
    got = [tuple(r) for r in G.unfolded(g).collect()]
    assert len(got) == len(every) and set(got) == every
    n = spark.createDataFrame([(x,) for x in [*adj, "lone"]], "id string")
    assert {r["id"]: r["degree"] for r in G.degree(n, g).collect()} == {x: len(adj.get(x, ())) for x in [*adj, "lone"]}
    some = ["l0", "l5", "r0", "r6", "t1", "u", "nobody"]
    assert {tuple(r) for r in G.induced(g, spark.createDataFrame([(x,) for x in some], "node string")).collect()} == {x for x in every if x[0] in some and x[1] in some}
    groups = {r["node"]: (r["connected"], r["documented"], r["other"]) for r in G.relation_groups(g, n.withColumnRenamed("id", "node")).collect()}
    count = lambda x, *rels: sum(r in rels for _, r in adj[x])
    assert groups == {x: (count(x, "CONNECTED_TO"), count(x, "GOVERNS"), count(x, "REQUIRES", "MENTIONS")) for x in adj}


def test_searches(spark):
    g, every = graph(spark)
    adj = around(every)
    want = {}
    for s in ("l1", "t2", "nobody"):
        for x, h in hops_from(adj, s, 2).items():
            want[x] = min(h, want.get(x, 9))
    assert {r["node"]: r["hop"] for r in G.expand(g, spark.createDataFrame([("l1",), ("t2",), ("nobody",)], "node string"), 2).collect()} == want
    hops = hops_from(adj, "l1", 5)
    previous = {x: min(o for o, _ in adj[x] if hops.get(o) == h - 1) if h else None for x, h in hops.items()}
    assert {r["node"]: (r["hops"], r["previous"]) for r in G.path_lengths(g, "l1", 5).collect()} == {x: (h, previous[x]) for x, h in hops.items()}
    rank = dict.fromkeys(adj, 1 / len(adj))
    for _ in range(6):
        rank = {x: 0.15 / len(adj) + 0.85 * sum(rank[o] / len(adj[o]) for o, _ in adj[x]) for x in adj}
    got = {r["id"]: r["rank"] for r in G.pagerank(spark.createDataFrame([(x,) for x in adj], "id string"), g, 6).collect()}
    assert set(got) == set(rank) and all(abs(got[x] - rank[x]) < 1e-12 for x in rank)


def test_paths_of_all_pairs(spark):
    g, every = graph(spark)
    adj = around(every)
    pairs = [(a, b) for a in adj for b in adj]
    want = set()
    for a, b in pairs:
        far = hops_from(adj, b, 5)
        x, left = a, far.get(a, 0)
        for k in range(left):
            o, r = min((o, r) for o, r in adj[x] if far.get(o) == left - k - 1)
            want.add((a, b, k + 1, x, o, r))
            x = o
    assert {tuple(r) for r in G.paths_between(g, spark.createDataFrame(pairs, "a string, b string"), 5).collect()} == want


def test_a_block_is_not_listed(spark):
    """A million million edges between nodes that are alike: their pairs are counted, never made."""
    left, right = (spark.range(1_000_000).selectExpr("'b' as block", f"concat('{x}', id) as node") for x in "lr")
    g = G.fold(spark.createDataFrame([("root", "l7", "GOVERNS")], E), ((left, right, "CONNECTED_TO"),))
    assert g.links.count() == 3 and g.sizes().count() == 4
    n = spark.createDataFrame([("l7",), ("r7",)], "id string")
    assert {r["id"]: r["degree"] for r in G.degree(n, g).collect()} == {"l7": 1_000_001, "r7": 1_000_000}
