"""Near-duplicate embeddings with a forest of random-projection trees.

Equal vectors (of one label) form a class and are compared once.  Each tree splits the space
again and again at a random direction; vectors within SPILL of a threshold go to both sides, so a
close pair is rarely torn apart, and hardly ever in all trees.  The trees are fitted on a bounded
sample, every vector is routed.  A node is not split where the margin would hold more than
MAX_SPILL of it: a dense group stays in one leaf rather than being copied into all of them.

Within a leaf and label, vectors are compared in double precision, block against block: a leaf of
any size becomes tasks of at most 2 * BLOCK vectors.  A task reports, for each of its vectors, how
many links it has that no earlier leaf holds, and the smallest vector it hangs together with
there; pairs are never emitted.  Sums give the number of links, joins the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared
from basalt.llm.links import components

TREES = 4
SAMPLE = 50_000
LEAF = 512
#: Vector lengths that get trees of their own, the most frequent first; vectors of rarer lengths share one leaf for each label and length.
DIMS = 64
LEAST_SAMPLE = 32
BLOCK = 256
#: Half the margin, in standard deviations of the step between vectors at the threshold along a random direction.
SPILL = 0.6
MAX_SPILL = 0.25
TRIES = 6


def fit_tree(x: np.ndarray, levels: int, margin: float, rng: np.random.Generator) -> list:
    """Nodes [direction, threshold, left, right] in a list, a leaf being None; x: unit rows."""
    nodes: list = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        if depth >= levels or len(rows) < 2 * LEAST_SAMPLE:
            return at
        best = None
        for _ in range(TRIES):
            d = rng.standard_normal(x.shape[1])
            d /= np.linalg.norm(d)
            p = x[rows] @ d
            for q in (0.5, 0.4, 0.6):
                t = float(np.quantile(p, q))
                spill = float((np.abs(p - t) <= margin).mean())
                if best is None or spill < best[0]:
                    best = (spill, d, t, p)
            if best[0] <= 0.12:
                break
        spill, d, t, p = best
        if spill > MAX_SPILL:
            return at
        nodes[at] = [d, t, split(rows[p <= t + margin], depth + 1), split(rows[p >= t - margin], depth + 1)]
        return at

    split(np.arange(len(x)), 0)
    return nodes


def route(nodes: list, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all leaves that the rows of x reach."""
    rows_out, leaf_out, todo = [], [], [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if nodes[at] is None:
            rows_out.append(rows)
            leaf_out.append(np.full(len(rows), at))
            continue
        d, t, left, right = nodes[at]
        p = x[rows] @ d
        todo += [(left, rows[p <= t + margin]), (right, rows[p >= t - margin])]
    return (np.concatenate(rows_out), np.concatenate(leaf_out)) if rows_out else (np.empty(0, int), np.empty(0, int))


def matrix(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.split(flat, np.cumsum(np.diff(column.offsets.to_numpy()))[:-1]) if len(column) else []


def unit(x: np.ndarray) -> np.ndarray:
    """Unit rows; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes_of(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, key), key being null where a row links with nothing; and the classes (rep, label, v, dim, n, key)."""
    v = F.col(vec_col).cast("array<double>")
    big = F.lit(float("inf"))
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big)) & F.exists(v, lambda c: c != 0)
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.withColumn("key", F.when(F.col("good"), F.concat_ws("-", F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "label", "v"))))  # 128 bits: unequal vectors never meet
    known = rows.where("good").dropDuplicates(["key", "id"])
    classes = known.groupBy("key").agg(F.min("id").alias("rep"), F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"))
    return rows.select("id", "key"), classes.withColumn("dim", F.size("v"))


def leaf_links(units: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task (unit) to (id, links, root) for each vector of a task that has a link there."""
    kept: list[tuple] = []
    names = ["id", "links", "root"]

    def compare() -> pa.RecordBatch | None:
        ids = np.array([r[1] for r in kept])
        block = np.array([r[2] for r in kept])
        n = np.array([r[3] for r in kept], np.int64)
        x = unit(np.stack([r[5] for r in kept]))
        one, other = map(int, kept[0][0][2].split("-"))
        two = one != other
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == other)
        if not len(left) or not len(right):
            return None
        cos = x[left] @ x[right].T
        i, j = np.nonzero(cos >= least) if two else np.nonzero(np.triu(cos >= least, 1))
        if not len(i):
            return None
        i, j = left[i], right[j]
        # A pair counts in the first leaf that both vectors reach.
        width = max(len(r[4]) for r in kept)
        leaves = np.full((len(kept), width), -1, np.int64)
        for k, r in enumerate(kept):
            leaves[k, : len(r[4])] = r[4]
        own = kept[0][0][0]
        links = np.zeros(len(kept), np.int64)
        for lo in range(0, len(i), 100_000):
            a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
            both = (leaves[a][:, :, None] == leaves[b][:, None, :]) & (leaves[a] >= 0)[:, :, None]
            first = np.where(both.any(2), leaves[a], np.iinfo(np.int64).max).min(1) == own
            np.add.at(links, a[first], n[b[first]])
            np.add.at(links, b[first], n[a[first]])
        root = ids.copy()
        while True:  # smallest id along the links of this task
            low = root.copy()
            np.minimum.at(low, i, root[j])
            np.minimum.at(low, j, root[i])
            if (low == root).all():
                break
            root = low
        some = np.union1d(i, j)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], names)

    for b in units:
        cols = [b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5, 7)]
        vec = matrix(b.column(6))
        for k, key in enumerate(zip(cols[0], cols[1], cols[2], strict=True)):
            if kept and kept[0][0] != key:
                if len(kept) > 1 and (out := compare()) is not None:
                    yield out
                kept = []
            kept.append((key, cols[3][k], cols[4][k], cols[6][k], cols[5][k], vec[k]))
    if len(kept) > 1 and (out := compare()) is not None:
        yield out


def near_duplicates(table: DataFrame, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", trees: int = TREES, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: vectors of one label link from this cosine on.

    A null id or label, and a vector that is null, empty, zero or holds null or non-finite
    components, links with nothing: n_links 0 and its own component.  So do vectors of different
    lengths among each other.  Repeated rows (same id, label and vector) count as one vector and
    are all returned.  Other columns are ignored."""
    spark = table.sparkSession
    shared.tune(spark)
    rows, classes = classes_of(table, id_col, vec_col, label_col)
    classes = shared.cut(classes, "vector-classes")
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(DIMS).collect()}
    total = sum(sizes.values())
    forest: dict[int, tuple[float, list]] = {}
    for dim, n in sizes.items():
        part = classes.where(F.col("dim") == dim)
        most = max(1, SAMPLE * n // max(1, total))
        picked = shared.thinned(part, n, most, "rep")
        x = unit(np.array([r["v"] for r in picked.select("v").collect()], np.float64))
        margin = SPILL * float(np.sqrt(2 - 2 * least)) / np.sqrt(dim)
        levels = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        forest[dim] = (margin, [fit_tree(x, levels, margin, np.random.default_rng([seed, dim, t])) for t in range(trees)])
    grown = spark.sparkContext.broadcast(forest)  # trees * SAMPLE / LEAST_SAMPLE directions at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = matrix(b.column(1))
            dims = np.array([len(v) for v in vec])
            leaves: list[list[int]] = [[] for _ in vec]
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in grown.value:
                    for k in at:
                        leaves[k].append(0)
                    continue
                x = unit(np.stack([vec[k] for k in at]))
                margin, trees_ = grown.value[dim]
                for t, nodes in enumerate(trees_):
                    for r, leaf in zip(*route(nodes, x, margin), strict=True):
                        leaves[at[r]].append(t << 32 | int(leaf))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(x) for x in leaves], pa.list_(pa.int64()))], ["rep", "leaves"])

    placed = shared.cut(classes.select("rep", "v").mapInArrow(place, "rep bigint, leaves array<bigint>"), "vector-leaves")
    per_leaf = classes.join(placed, "rep").withColumn("leaf", F.explode("leaves"))
    groups = shared.cut(per_leaf.groupBy("leaf", "label", "dim").agg(F.count("*").alias("size")).where("size > 1"), "vector-groups")
    # Blocks of a leaf meet each other in tasks (first block, second block).
    per_leaf = per_leaf.join(groups, ["leaf", "label", "dim"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    per_leaf = per_leaf.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
    tasks = per_leaf.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("leaf", F.concat_ws("/", "label", "dim").alias("group"), F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), F.col("rep").alias("id"), "block", "leaves", "v", "n")
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.repartition(n_tasks, "leaf", "group", "pair").sortWithinPartitions("leaf", "group", "pair")
    found = shared.cut(dealt.select("leaf", "group", "pair", "id", "block", "leaves", "v", "n").mapInArrow(lambda it: leaf_links(it, least), "id bigint, links bigint, root bigint"), "vector-links")
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = classes.select("key", "rep", "n").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = shared.cut(per_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-result")
    out = rows.join(per_class, "key", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: near-duplicate vectors of equal labels, from the cosine 0.98 on."""
    return near_duplicates(shared.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.seen FROM r JOIN p ON p.a = r.node WHERE r.seen < p.b),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT e.vec_id, coalesce(l.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e LEFT JOIN l ON l.a = e.vec_id JOIN c ON c.node = e.vec_id
"""
