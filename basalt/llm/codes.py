"""Product codes of vectors in exact integers, with segment-mean lower bounds.

A vector becomes integers (floor of 1024 x) and is cut into PARTS consecutive parts; each part position has a codebook of at most ENTRIES
entries, which ROUNDS rounds of assigning and averaging improve.  To find a part's nearest entry, few exact distances are needed:

* a part is cut into blocks, and of each block its mean and its residual norm (what is left beside the mean) are kept.  For blocks x, c of
  size s, |x - c|^2 >= s (mean x - mean c)^2 + (|res x| - |res c|)^2, so the sum over blocks bounds a part's distance from below;
* coarse to fine, with one, two, four ... blocks, entries whose bound exceeds an upper bound are dropped: the least exact distance
  to the entries whose bounds were least so far.  Bounds are rounded down by more than their floating-point error, so no nearest entry, and no tie, is lost;
* what is left gets its exact integer distance, ties going to the lower index.

Codebooks are small (PARTS * ENTRIES entries for each vector length) and travel with the plan; each round is one pass over the table, which reports
sums and counts by entry.  Those are added up by Spark, task by task before anything is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components stay within this bound, so that squared distances fit in 64 bits (components of vectors up to 65,536).
BOUND = 1 << 26
#: Rows that are compared at a time.
ROWS = 1024


def cuts(dim: int) -> list[int]:
    """Where the parts of a vector of this length begin, and its end."""
    return [dim * k // PARTS for k in range(PARTS + 1)]


def blocks(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and residual norms (rows, n) of n consecutive blocks, and the blocks' sizes."""
    at = np.array([x.shape[1] * k // n for k in range(n)])
    size = np.diff(np.append(at, x.shape[1]))
    mean = np.add.reduceat(x, at, axis=1) / size
    rest = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, at, axis=1)
    return mean, np.sqrt(rest), size


class Codebook:
    """The entries of one part position, with the block means of every level."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width = entries.shape[1]
        self.levels = [n for n in (1, 2, 4, 8) if n <= width] if width else []
        self.coarse = [blocks(entries.astype(np.float64), n) for n in self.levels]

    def exact(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = x[row] - self.entries[entry]
        return (d * d).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each row the nearest entry (lowest index of equally near ones), its squared distance, and how many exact distances were taken in all."""
        n, k = len(x), len(self.entries)
        if not self.levels or not n:
            return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        fine = [blocks(x.astype(np.float64), m) for m in self.levels]
        scale = max(float(np.abs(x).max()), float(np.abs(self.entries).max()), 1.0)
        slack = 1e-9 * scale * scale * x.shape[1]  # far above the rounding of the bounds

        every = np.arange(n)
        upper, open_ = np.full(n, np.inf), np.ones((n, k), bool)
        for (m, r, size), (cm, cr, _) in zip(fine, self.coarse, strict=True):
            low = np.zeros((n, k))
            for j in range(m.shape[1]):  # block by block, so that what is at work stays in the cache
                low += size[j] * (m[:, j, None] - cm[None, :, j]) ** 2 + (r[:, j, None] - cr[None, :, j]) ** 2
            # The entry of the least bound is measured exactly: no nearest entry is farther.
            upper = np.minimum(upper, self.exact(x, every, low.argmin(1)))
            open_ &= low <= upper[:, None] + slack
        # Of what is left, the likely quarter of each row's range first: it lowers the upper bound for the rest.
        likely = open_ & (low <= 0.75 * low.min(1, keepdims=True) + 0.25 * upper[:, None])
        row, entry = np.nonzero(likely)
        if len(row):
            np.minimum.at(upper, row, self.exact(x, row, entry))
        row, entry = np.nonzero(open_ & (low <= upper[:, None] + slack))
        taken = len(row) + int(likely.sum())
        d = self.exact(x, row, entry)
        # Rows are in order, entries ascend within a row: the first least one wins.
        start = np.searchsorted(row, every)
        least = np.minimum.reduceat(d, start)
        hit = np.flatnonzero(d == least[row])
        first = hit[np.searchsorted(row[hit], every)]
        return entry[first], least, taken


def floats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat components and the vectors' lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the integer vectors of each length in a batch."""
    flat, lens = floats(column)
    at = np.cumsum(lens) - lens
    for dim in np.unique(lens).tolist():
        rows = np.flatnonzero(lens == dim)
        for lo in range(0, len(rows), ROWS):
            k = rows[lo : lo + ROWS]
            yield dim, k, flat[at[k][:, None] + np.arange(dim)].astype(np.int64)


def assigned(books: dict[int, list[Codebook]], dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, PARTS) indices and squared distances."""
    c = cuts(dim)
    found = [books[dim][p].nearest(np.ascontiguousarray(x[:, c[p] : c[p + 1]])) for p in range(PARTS)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def kept_vectors(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, has_label, v, dim) of the usable rows; v: bounded integers."""
    v, big = F.col(vec_col).cast("array<double>"), F.lit(float("inf"))
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < big))
    whole = F.transform(v, lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), c * SCALE))))).cast("int"))
    rows = table.where(good).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("label"), F.col(label_col).isNotNull().alias("has_label"), whole.alias("v"))
    return rows.withColumn("dim", F.size("v"))


def first_entries(kept: DataFrame) -> dict[int, list[Codebook]]:
    """The vectors of each length's smallest ids, cut into parts.  Of rows that share an id, the smallest vector counts."""
    dims = [r["dim"] for r in kept.select("dim").distinct().collect()]
    books = {}
    for dim in dims:
        own = kept.where((F.col("dim") == dim) & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
        rows = [r["v"] for r in own.orderBy("id").limit(ENTRIES).collect()]
        if not rows:  # null ids only
            rows = [r["v"] for r in kept.where(F.col("dim") == dim).agg(F.min("v").alias("v")).collect()]
        x, c = np.array(rows, np.int64).reshape(len(rows), dim), cuts(dim)
        books[dim] = [Codebook(x[:, c[p] : c[p + 1]]) for p in range(PARTS)]
    return books


def improved(kept: DataFrame, books: dict[int, list[Codebook]]) -> dict[int, list[Codebook]]:
    """Codebooks after one round."""
    width = max((c[k + 1] - c[k] for c in map(cuts, books) for k in range(PARTS)), default=0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: [(np.zeros(e.entries.shape, np.int64), np.zeros(len(e.entries), np.int64)) for e in book] for d, book in books.items()}
        for b in batches:
            for dim, _, x in by_length(b.column(0)):
                of, _ = assigned(books, dim, x)
                c = cuts(dim)
                for p in range(PARTS):
                    s, n = total[dim][p]
                    np.add.at(s, of[:, p], x[:, c[p] : c[p + 1]])
                    n += np.bincount(of[:, p], minlength=len(n))
        keys = [(d, p, k) for d in total for p in range(PARTS) for k in np.flatnonzero(total[d][p][1]).tolist()]
        if keys:
            values = [total[d][p][0][k].tolist() for d, p, k in keys]
            values = [v + [0] * (width - len(v)) for v in values]
            cols = [pa.array([x[i] for x in keys], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([int(total[d][p][1][k]) for d, p, k in keys], pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["dim", "part", "entry", "n", "sums"])

    found = kept.select("v").mapInArrow(sums, "dim int, part int, entry int, n bigint, sums array<bigint>")
    added = found.groupBy("dim", "part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)))
    entries = {d: [e.entries.copy() for e in book] for d, book in books.items()}
    for r in added.collect():  # an entry of a codebook each
        old = entries[r["dim"]][r["part"]]
        old[r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(old.shape[1])]
    return {d: [Codebook(e) for e in book] for d, book in entries.items()}


def digest(books: dict[int, list[Codebook]]) -> str:
    """SHA-256 of all components by part, entry and position; shorter vectors' codebooks first."""
    whole = [str(c) for d in sorted(books) for book in books[d] for c in book.entries.ravel().tolist()]
    return hashlib.sha256(",".join(whole).encode()).hexdigest()


def train(kept: DataFrame, rounds: int = ROUNDS) -> dict[int, list[Codebook]]:
    books = first_entries(kept)
    for _ in range(rounds):
        books = improved(kept, books)
    return books


def encode(kept: DataFrame, books: dict[int, list[Codebook]]) -> DataFrame:
    """(id, label, has_label, code, error) of each vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros((b.num_rows, PARTS), np.uint8), np.zeros(b.num_rows, np.int64)
            for dim, rows, x in by_length(b.column(3)):
                of, d = assigned(books, dim, x)
                code[rows], error[rows] = of, d.sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([c.tobytes().hex() for c in code]), pa.array(error)], ["id", "label", "has_label", "code", "error"])

    return kept.select("id", "label", "has_label", "v").mapInArrow(run, "id bigint, label string, has_label boolean, code string, error bigint")


def compress(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for each row whose vector is whole: not null, no null or non-finite component.

    A row with a null id is coded but begins no codebook entry (unless all ids are null); of repeated ids the smallest vector does; repeated rows are
    coded each.  Vectors of different lengths have codebooks of their own, and lengths that PARTS does not divide have parts that
    differ by one; an empty vector has the code 00000000 and no error.  Components beyond 65,536 count as that.  Label errors that exceed 64 bits count as
    the largest number.  An empty table gives no rows; further columns are ignored."""
    spark = table.sparkSession
    shared.tune(spark)
    kept = shared.cut(kept_vectors(table, id_col, vec_col, label_col), "code-vectors")
    books = train(kept)
    coded = shared.cut(encode(kept, books), "codes")
    shared.drop_cut(kept)
    total = coded.groupBy("label", "has_label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    out = coded.join(total, ["label", "has_label"])
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: codes of all embeddings."""
    return compress(shared.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    distance = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(
            f"d{k} AS MATERIALIZED (SELECT x.vec_id, x.part, arg_min(c.entry, {distance} * 1024 + c.entry) AS entry, min({distance}) AS dist FROM p x JOIN c{k} c ON c.part = x.part GROUP BY x.vec_id, x.part)"
        )
        if k < ROUNDS:
            rounds.append(
                f"s{k} AS (SELECT part, entry, pos, CAST(floor(sum(val) / count(*)) AS BIGINT) AS val FROM (SELECT p.part, d.entry, unnest(p.v) AS val, generate_subscripts(p.v, 1) AS pos FROM d{k} d JOIN p USING (vec_id, part)) GROUP BY part, entry, pos), "
                f"n{k} AS (SELECT part, entry, list(val ORDER BY pos) AS v FROM s{k} GROUP BY part, entry), "
                f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN n{k} n USING (part, entry))"
            )
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[len(v) * part // 4 + 1 : len(v) * (part + 1) // 4] AS v FROM k, (SELECT unnest([0, 1, 2, 3]) AS part)),
i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 256),
c0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN i USING (vec_id)),
{", ".join(rounds)},
e AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM d{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id) CROSS JOIN h
"""


ORACLE = _oracle()
