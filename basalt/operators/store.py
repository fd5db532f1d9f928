"""A text index that is kept: segments of postings in buckets by term, deletions as tombstones, merges, and reads of a batch's buckets only.

Layout below `path`: postings/segment=S/bucket=B (doc, term, tf, dl), docs/segment=S (doc, dl), gone/segment=S (doc) for documents that are deleted
from all segments before S, merged/segment=S where S replaces all earlier ones, norms/state=... with vector lengths of one state.
A segment counts once its docs are there, which are written last; a writer that dies leaves nothing that is read.  One writer at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators.index import TextIndex, counted, held
from basalt.runtime import released, spread

BUCKETS = 16


def field_stream(*fields: Column) -> Column:
    """Text and lists of words as one text; nulls are left out."""
    return F.concat_ws(" ", *fields)


class IndexStore:
    """buckets: how many each segment has; it is fixed for a path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self, kind: str) -> list[int]:
        """Segments of a kind that are whole: their writer's mark is there."""
        fs, at = self._fs(f"{self.path}/{kind}")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("segment=") and fs.exists(self._fs(f"{self.path}/{kind}/{n}/_SUCCESS")[1]))

    def _next(self) -> int:
        return max([0, *self._numbers("docs"), *self._numbers("gone"), *self._numbers("merged")]) + 1

    def _read(self, kind: str, schema: str) -> DataFrame:
        """All whole segments of a kind since the last merge."""
        base = max([0, *self._numbers("merged")])
        parts = [n for n in self._numbers("docs" if kind == "postings" else kind) if n >= base]
        if not parts:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        out = None
        for n in parts:  # a handful: merges keep it so
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/segment={n}").withColumn("segment", F.lit(n))
            out = part if out is None else out.unionByName(part)
        return out

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._read("gone", "doc bigint").groupBy("doc").agg(F.max("segment").alias("until"))
        if not [n for n in self._numbers("gone") if n >= max([0, *self._numbers("merged")])]:
            return rows
        return rows.join(held(gone), "doc", "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")

    def _write(self, postings: DataFrame, docs: Callable[[str], DataFrame], n: int) -> None:
        """A segment: its postings, then what docs makes of the path where they lie."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        postings.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={n}")
        docs(f"{self.path}/postings/segment={n}").write.parquet(f"{self.path}/docs/segment={n}")
        released(self.spark)

    def add(self, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """A new segment; documents that are there already are replaced.  A null id is not indexed; of repeated ids the texts are joined.

        Rows are read three times, their texts once: what is costly to compute is written first."""
        rows = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
        n = self._next()
        old = self._live(self._read("docs", "doc bigint, dl bigint"))
        rows.select("doc").distinct().join(old.select("doc"), "doc", "left_semi").write.parquet(f"{self.path}/gone/segment={n}")
        # A document's length is the sum of its postings, two narrow columns; texts are not cut into tokens a second time.
        counts = self.spark.read.schema("doc bigint, tf bigint").parquet
        self._write(counted(spread(rows)), lambda path: rows.select("doc").distinct().join(counts(path).groupBy("doc").agg(F.sum("tf").alias("dl")), "doc", "left").select("doc", F.coalesce("dl", F.lit(0)).alias("dl")), n)
        return n

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> int:
        """Documents no longer found; nothing is rewritten."""
        n = self._next()
        ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc")).distinct().write.parquet(f"{self.path}/gone/segment={n}")
        return n

    def merge(self) -> int:
        """One segment of what is alive; earlier ones are no longer read, and their files go."""
        old = {kind: self._numbers(kind) for kind in ("postings", "docs", "gone", "merged")}
        n = self._next()
        self._write(self._live(self._read("postings", "doc bigint, term string, tf bigint, dl bigint")).drop("segment"), lambda _: self._live(self._read("docs", "doc bigint, dl bigint")).drop("segment"), n)
        self.spark.createDataFrame([(n,)], "n int").write.parquet(f"{self.path}/merged/segment={n}")
        for kind, numbers in old.items():
            for k in numbers:
                fs, at = self._fs(f"{self.path}/{kind}/segment={k}")
                fs.delete(at, True)
        return n

    def state(self) -> str:
        """A name for what is alive now."""
        base = max([0, *self._numbers("merged")])
        return "-".join(str(k) for k in (base, *(n for n in self._numbers("docs") if n > base), 0, *(n for n in self._numbers("gone") if n > base)))

    def open(self, terms: DataFrame | None = None) -> TextIndex:
        """The index of all live documents.  With the terms (column term) of a batch of queries, only their buckets' postings are read;
        statistics and vector lengths always are those of the whole corpus."""
        schema = "doc bigint, term string, tf bigint, dl bigint, bucket int"
        every = self._read("postings", schema)
        docs = self._live(self._read("docs", "doc bigint, dl bigint")).select("doc", "dl")
        some = every
        if terms is not None:
            wanted = terms.select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct().limit(self.buckets).collect()
            some = every.where(F.col("bucket").isin([r["b"] for r in wanted]))  # partitions that are not wanted are not listed
        live = lambda x: self._live(x).select("doc", "term", "tf", "dl")
        postings = live(some)
        stats = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
        row = stats.first()
        stats = self.spark.createDataFrame([(row["n_docs"], row["avg_dl"])], "n_docs bigint, avg_dl double")
        path = f"{self.path}/norms/state={self.state()}"
        return TextIndex(postings, docs, postings.groupBy("term").agg(F.count("*").alias("df")), stats, lambda: self._norms(path, live(every), stats))

    def _norms(self, path: str, postings: DataFrame, stats: DataFrame) -> DataFrame:
        """Vector lengths, written once for each state, when they are first asked for."""
        fs, done = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(done):
            df = postings.groupBy("term").agg(F.count("*").alias("df"))
            w = (1 + F.log("tf")) * (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)
            rows = postings.join(df, "term").crossJoin(F.broadcast(stats))  # one row of statistics
            rows.groupBy("doc").agg(F.sqrt(F.sum(w * w)).alias("norm")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema("doc bigint, norm double").parquet(path)


def batch_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct terms of a batch of queries."""
    return queries.select(F.explode(T.tokens(F.col(text_col))).alias("term")).distinct()
