"""Property graph as edge tables: build, neighbours, expansion, PageRank, paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.runtime import shared_root, written

# How strongly each relation carries relevance, and the loss of each hop.
REL_WEIGHTS = {
    "CAUSED_BY": 1.0, "REQUIRES": 0.9, "GOVERNS": 0.9, "HAS_FAILURE": 0.95, "USED_PART": 0.75, "RECOMMENDED": 0.7,
    "MEASURED_BY": 0.8, "CONNECTED_TO": 0.7, "PERFORMED_ON": 0.8, "DOCUMENTED_BY": 0.6, "MENTIONS": 0.5, "RELATED_TO": 0.4,
}
OTHER_WEIGHT, HOP_DECAY = 0.5, 0.85
# End of fixed values.


def nodes(*sources: DataFrame) -> DataFrame:
    """Distinct (id, type, label) of sources in order of priority: the first one that has an id wins."""
    rows = None
    for k, s in enumerate(sources):
        part = s.select("id", "type", "label", F.lit(k).alias("priority"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("id").agg(F.min(F.struct("priority", "type", "label")).alias("n")).select("id", F.col("n.type").alias("type"), F.col("n.label").alias("label"))


def edges(*sources: DataFrame) -> DataFrame:
    """Distinct (src, dst, rel)."""
    rows = sources[0].select("src", "dst", "rel")
    for s in sources[1:]:
        rows = rows.unionByName(s.select("src", "dst", "rel"))
    return rows.distinct()


def both_ways(e: DataFrame) -> DataFrame:
    """Adjacency (node, other, rel): every edge from either end."""
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "rel").unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "rel"))


@dataclass
class Folded:
    """A graph by classes of nodes that have the same edges.  members: (node, cls), each node with edges once; links: distinct (src, dst, rel) between classes,
    each of which stands for the edges from every member of src to every member of dst.  A class is named by its smallest node."""

    members: DataFrame
    links: DataFrame

    def sizes(self) -> DataFrame:
        """(cls, size)."""
        return self.members.groupBy("cls").agg(F.count("*").alias("size"))


def fold(e: DataFrame, blocks: tuple[tuple[DataFrame, DataFrame, str], ...] = ()) -> Folded:
    """Distinct edges, and blocks of edges that are never listed: (left, right, rel) with columns (block, node) links every left node of a block to every right one.

    Nodes are alike if they have the same neighbours by direction and relation and lie in the same blocks; sets are compared by their size and 128 bits of hashes.
    Work grows with the edges and the blocks' members, not with the pairs in a block."""
    ends = e.select(F.col("src").alias("node"), F.lit("to").alias("way"), "rel", F.col("dst").cast("string").alias("at"))
    ends = ends.unionByName(e.select(F.col("dst").alias("node"), F.lit("from").alias("way"), "rel", F.col("src").cast("string").alias("at")))
    sides = [(side.where("block is not null and node is not null").select(F.col("block").cast("string").alias("block"), "node").distinct(), f"{way} {k}", rel) for k, (left, right, rel) in enumerate(blocks) for side, way in ((left, "left"), (right, "right"))]
    for side, way, rel in sides:
        ends = ends.unionByName(side.select("node", F.lit(way).alias("way"), F.lit(rel).alias("rel"), F.col("block").alias("at")))
    bits = [F.bit_xor(F.xxhash64(F.lit(salt), "way", "rel", "at")).alias(f"bits{salt}") for salt in (0, 1)]
    like = written(ends.distinct().groupBy("node").agg(F.count("*").alias("n"), *bits), "fold-sets")
    names = like.groupBy("n", "bits0", "bits1").agg(F.min("node").alias("cls"))
    members = written(like.join(names, ["n", "bits0", "bits1"]).select("node", "cls"), "fold-members")
    src, dst = (members.select(F.col("node").alias(x), F.col("cls").alias(f"{x}_cls")) for x in ("src", "dst"))
    links = e.join(src, "src").join(dst, "dst").select(F.col("src_cls").alias("src"), F.col("dst_cls").alias("dst"), "rel")
    for k, (_, _, rel) in enumerate(blocks):
        left, right = (side.join(members, "node").select("block", F.col("cls").alias(name)).distinct() for (side, _, _), name in zip(sides[2 * k : 2 * k + 2], ("src", "dst")))
        links = links.unionByName(left.join(right, "block").select("src", "dst", F.lit(rel).alias("rel")))
    return Folded(members, written(links.distinct(), "fold-links"))


def folded(e: DataFrame | Folded) -> Folded:
    return e if isinstance(e, Folded) else fold(e)


EDGES_PIECE = 1024


def unfolded(g: Folded) -> DataFrame:
    """All edges (src, dst, rel), each once without looking for repeats; large classes are dealt out in pieces, so no task has a whole one."""
    tasks = 4 * g.members.sparkSession.sparkContext.defaultParallelism
    cut = g.sizes().select("cls", F.ceil(F.col("size") / EDGES_PIECE).cast("int").alias("pieces"))
    to = g.members.join(cut, "cls").select(F.col("cls").alias("dst_cls"), F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("piece"), F.col("node").alias("dst"))
    links = g.links.join(cut.withColumnRenamed("cls", "dst"), "dst").select(F.col("src").alias("cls"), F.col("dst").alias("dst_cls"), "rel", "pieces")
    of = links.join(g.members, "cls").select(F.col("node").alias("src"), "dst_cls", "rel", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    key = ["dst_cls", "piece"]
    return of.repartition(tasks, *key).join(to.repartition(tasks, *key), key).select("src", "dst", "rel")


def apart(g: Folded, nodes: DataFrame) -> Folded:
    """The graph with each of the nodes (column node) in a class of its own."""
    marked = g.members.join(nodes.select("node", F.lit(True).alias("own")).distinct(), "node", "left")
    alone, others = marked.where("own").select("node", "cls"), marked.where("own is null").select("node", "cls")
    rest = others.groupBy("cls").agg(F.min("node").alias("new"))
    names = written(rest.unionByName(alone.select("cls", F.col("node").alias("new"))), "apart-names")
    src, dst = (names.select(F.col("cls").alias(x), F.col("new").alias(f"new_{x}")) for x in ("src", "dst"))
    links = g.links.join(src, "src").join(dst, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "rel")
    members = others.join(rest, "cls").select("node", F.col("new").alias("cls")).unionByName(alone.select("node", F.col("node").alias("cls")))
    return Folded(members, written(links, "apart-links"))


def degree(n: DataFrame, e: DataFrame | Folded) -> DataFrame:
    """(id, degree): neighbours counted with repeats, 0 for lone nodes."""
    g = folded(e)
    d = both_ways(g.links).join(g.sizes().withColumnRenamed("cls", "other"), "other").groupBy("node").agg(F.sum("size").alias("degree"))
    d = g.members.join(d.withColumnRenamed("node", "cls"), "cls").select(F.col("node").alias("id"), "degree")
    return n.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def neighbours(e: DataFrame, of: DataFrame, rel: str | None = None) -> DataFrame:
    """(node, other, rel) of the nodes in `of` (column node)."""
    adj = both_ways(e)
    return (adj if rel is None else adj.where(F.col("rel") == rel)).join(of.select("node"), "node", "left_semi")


def expand(e: DataFrame | Folded, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(node, hop): nodes within `hops` of the seeds (column node), each with its smallest number of hops."""
    g = apart(folded(e), seeds)
    adj = both_ways(g.links).select("node", "other").distinct()
    start = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    seen = front = start
    for h in range(1, hops + 1):
        nxt = front.join(adj, "node").select(F.col("other").alias("node")).distinct()
        front = nxt.join(seen, "node", "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(front)
    return start.unionByName(g.members.join(seen.where("hop > 0").withColumnRenamed("node", "cls"), "cls").select("node", "hop"))


def induced(e: DataFrame | Folded, members: DataFrame) -> DataFrame:
    """Edges with both ends among members (column node)."""
    g = folded(e)
    return unfolded(Folded(written(g.members.join(members.select("node"), "node", "left_semi").select("node", "cls"), "induced"), g.links))


def weighted_expand(e: DataFrame | Folded, seeds: DataFrame, hops: int = 2, limit: int = 60) -> DataFrame:
    """(node, score): best product of relation weights and hop losses over paths from the seeds; the best `limit`."""
    weight = F.lit(OTHER_WEIGHT)
    for rel, w in REL_WEIGHTS.items():
        weight = F.when(F.col("rel") == rel, w).otherwise(weight)
    g = apart(folded(e), seeds)
    adj = both_ways(g.links).select("node", "other", (weight * HOP_DECAY).alias("w")).groupBy("node", "other").agg(F.max("w").alias("w"))
    start = seeds.select("node").distinct().withColumn("score", F.lit(1.0))
    best = front = start
    for _ in range(hops):
        reach = front.join(adj, "node").groupBy("other").agg(F.max(F.col("score") * F.col("w")).alias("score")).withColumnRenamed("other", "node")
        old = best.withColumnRenamed("score", "old")
        front = reach.join(old, "node", "left").where(F.col("old").isNull() | (F.col("score") > F.col("old"))).select("node", "score")
        best = best.unionByName(front).groupBy("node").agg(F.max("score").alias("score"))
    rows = g.members.join(best.withColumnRenamed("node", "cls"), "cls").select("node", "score").unionByName(start.join(g.members, "node", "left_anti"))
    return rows.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "node").limit(limit)


def pagerank(n: DataFrame, e: DataFrame | Folded, rounds: int = 20, damping: float = 0.85, checkpoint_every: int = 5) -> DataFrame:
    """(id, rank) over the undirected multigraph; the mass of nodes without edges is dropped.

    Nodes of a class have one rank.  The adjacency of classes with its shares is laid out once; every few rounds the ranks are
    checkpointed, so the plan doesn't grow with the rounds."""
    spark = n.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    g = folded(e)
    adj = both_ways(g.links).groupBy("node", "other").agg(F.count("*").alias("m"))
    out = adj.join(g.sizes().withColumnRenamed("cls", "other"), "other").groupBy("node").agg(F.sum(F.col("m") * F.col("size")).alias("out"))
    giving = g.members.join(n.select(F.col("id").alias("node")), "node", "left_semi").groupBy("cls").agg(F.count("*").alias("givers")).withColumnRenamed("cls", "node")
    shares = written(adj.join(out, "node").join(giving, "node").select("node", "other", (F.col("m") * F.col("givers") / F.col("out")).alias("share")), "pagerank-shares")
    size = n.count()
    classes = written(g.members.select("cls").distinct(), "pagerank-classes")
    ranks = classes.select("cls", F.lit(1.0 / size).alias("rank"))
    for k in range(rounds):
        got = shares.join(ranks.withColumnRenamed("cls", "node"), "node").groupBy("other").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = classes.join(got.withColumnRenamed("other", "cls"), "cls", "left").select("cls", (F.lit((1 - damping) / size) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if (k + 1) % checkpoint_every == 0 and k + 1 < rounds:
            ranks = ranks.checkpoint()
    of = g.members.join(ranks, "cls").select(F.col("node").alias("id"), "rank")
    return n.select("id").join(of, "id", "left").select("id", F.coalesce("rank", F.lit((1 - damping) / size if rounds else 1.0 / size)).alias("rank"))


def path_lengths(e: DataFrame | Folded, source, most: int = 5) -> DataFrame:
    """(node, hops, previous) from one node, breadth first; the smallest predecessor on a shortest path."""
    g = folded(e)
    spark, kind = g.links.sparkSession, dict(g.members.dtypes)["node"]
    start = spark.createDataFrame([(source,)], f"node {kind}")
    g = apart(g, start)
    adj = both_ways(g.links).select("node", "other").distinct()
    start = start.select("node", F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("previous"))
    seen = front = start
    for h in range(1, most + 1):
        nxt = front.select("node").join(adj, "node").groupBy("other").agg(F.min("node").alias("previous"))
        front = nxt.withColumnRenamed("other", "node").join(seen, "node", "left_anti").select("node", F.lit(h).alias("hops"), "previous")
        seen = seen.unionByName(front)
    return start.unionByName(g.members.join(seen.where("hops > 0").withColumnRenamed("node", "cls"), "cls").select("node", "hops", "previous"))


def _levels(adj: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, h): nodes within `hops` of each start, at their distance."""
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("h"))
    front = seen
    for h in range(1, hops + 1):
        nxt = front.select("start", "node").join(adj, "node").select("start", F.col("other").alias("node")).distinct()
        front = written(nxt.join(seen, ["start", "node"], "left_anti").withColumn("h", F.lit(h)), "path-front")
        seen = seen.unionByName(front)
    return seen


def _class_paths(adj: DataFrame, pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, n, hop, source, target, rel): a shortest path of n edges for each pair of different classes.

    Both ends are searched half way, each distinct end once however many pairs it has; where they meet, the path's nodes are marked back to either end, and only
    marked nodes are walked."""
    near, link = (most + 1) // 2, adj.select("node", "other")
    fore = _levels(link, pairs.select(F.col("a").alias("start")).distinct(), near).select(F.col("start").alias("a"), "node", "h")
    back = _levels(link, pairs.select(F.col("b").alias("start")).distinct(), most - near).select(F.col("start").alias("b"), "node", F.col("h").alias("g"))
    met = pairs.join(fore, "a").join(back, ["b", "node"]).withColumn("n", F.col("h") + F.col("g"))
    met = met.withColumn("least", F.min("n").over(Window.partitionBy("a", "b"))).where("n = least").select("a", "b", F.col("least").alias("n"), "node", F.col("h").alias("at"))
    marks = front = written(met, "path-marks")
    for _ in range(near):  # toward a: neighbours one hop nearer to it
        step = front.where("at > 0").join(link, "node").select("a", "b", "n", F.col("other").alias("node"), (F.col("at") - 1).alias("at")).distinct()
        front = step.join(fore, ["a", "node"]).where("h = at").select("a", "b", "n", "node", "at")
        marks = marks.unionByName(front)
    front = met
    for _ in range(most - near):  # toward b
        step = front.where("at < n").join(link, "node").select("a", "b", "n", F.col("other").alias("node"), (F.col("at") + 1).alias("at")).distinct()
        front = step.join(back, ["b", "node"]).where("g = n - at").select("a", "b", "n", "node", "at")
        marks = marks.unionByName(front)
    marks = written(marks.distinct(), "path-marks")
    here, out = pairs.join(marks.select("a", "b", "n").distinct(), ["a", "b"]).withColumn("node", F.col("a")), None
    for k in range(most):
        ways = here.where(F.col("n") > k).join(adj, "node").select("a", "b", "n", F.col("node").alias("source"), F.col("other").alias("node"), "rel")
        ways = ways.join(marks.where(F.col("at") == k + 1).select("a", "b", "node"), ["a", "b", "node"], "left_semi")
        step = written(ways.groupBy("a", "b", "n").agg(F.min(F.struct("node", "source", "rel")).alias("x")).select("a", "b", "n", "x.node", "x.source", "x.rel"), "path-step")
        edge = step.select("a", "b", "n", F.lit(k + 1).alias("hop"), "source", F.col("node").alias("target"), "rel")
        here, out = step.select("a", "b", "n", "node"), edge if out is None else out.unionByName(edge)
    return out


def paths_between(e: DataFrame | Folded, pairs: DataFrame, most: int = 5) -> DataFrame:
    """(a, b, hop, source, target, rel): for each pair (a, b) a shortest path of at most `most` edges, edge by edge; none for pairs that are not connected so closely or are one node.

    Of several shortest paths it is the one of the smallest nodes, from a on, and of parallel edges the smallest relation.  No shortest path enters the classes of
    its ends in between, so pairs of the same two classes share all but the ends; within one class it is an edge or one neighbour both have."""
    g = folded(e)
    a, b = (g.members.select(F.col("node").alias(x), F.col("cls").alias(f"{x}_cls")) for x in ("a", "b"))
    pairs = written(pairs.select("a", "b").distinct().where("a <> b").join(a, "a").join(b, "b"), "pairs")
    ends = written(pairs.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct(), "pair-classes")
    adj = written(both_ways(g.links).groupBy("node", "other").agg(F.min("rel").alias("rel")), "adjacency")
    ways = _class_paths(adj, ends.where("a <> b"), most)
    inside = ends.where("a = b").join(adj, F.col("a") == F.col("node")).groupBy("a", "b").agg(F.min(F.when(F.col("other") == F.col("a"), F.col("rel"))).alias("loop"), F.min(F.struct("other", "rel")).alias("x"))
    ways = ways.unionByName(inside.where(F.col("loop").isNotNull() & (F.lit(most) >= 1)).select("a", "b", F.lit(1).alias("n"), F.lit(1).alias("hop"), F.col("a").alias("source"), F.col("b").alias("target"), F.col("loop").alias("rel")))
    for hop in (1, 2):
        ways = ways.unionByName(inside.where(F.col("loop").isNull() & (F.lit(most) >= 2)).select("a", "b", F.lit(2).alias("n"), F.lit(hop).alias("hop"), F.col("x.other").alias("source"), F.col("x.other").alias("target"), F.col("x.rel").alias("rel")))
    ways = ways.withColumnsRenamed({"a": "a_cls", "b": "b_cls"})
    source, target = F.when(F.col("hop") == 1, F.col("a")).otherwise(F.col("source")), F.when(F.col("hop") == F.col("n"), F.col("b")).otherwise(F.col("target"))
    return pairs.join(ways, ["a_cls", "b_cls"]).select("a", "b", "hop", source.alias("source"), target.alias("target"), "rel")


def two_hop(e: DataFrame, first: str, second: str) -> DataFrame:
    """(a, via, b): a -first- via -second-> b, following edges forward."""
    x = e.where(F.col("rel") == first).select(F.col("src").alias("a"), F.col("dst").alias("via"))
    y = e.where(F.col("rel") == second).select(F.col("src").alias("via"), F.col("dst").alias("b"))
    return x.join(y, "via").select("a", "via", "b").distinct()


def relation_groups(e: DataFrame | Folded, of: DataFrame) -> DataFrame:
    """(node, connected, measured, documented, failure, other): neighbours of the nodes counted by kind of relation."""
    kind = F.when(F.col("rel") == "CONNECTED_TO", "connected").when(F.col("rel") == "MEASURED_BY", "measured").when(F.col("rel").isin("DOCUMENTED_BY", "GOVERNS"), "documented").when(F.col("rel").isin("HAS_FAILURE", "CAUSED_BY"), "failure").otherwise("other")
    names = ["connected", "measured", "documented", "failure", "other"]
    g = folded(e)
    rows = both_ways(g.links).withColumn("kind", kind).join(g.sizes().withColumnRenamed("cls", "other"), "other").withColumnRenamed("node", "cls")
    rows = rows.groupBy("cls").agg(*(F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0)).alias(k) for k in names))
    return g.members.join(of.select("node"), "node", "left_semi").join(rows, "cls").select("node", *names)
