"""Inverted index and its statistics: term frequencies, document frequencies, lengths."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from basalt.functions import text as T
from basalt.runtime import dealt, released, ship, written


@dataclass
class TextIndex:
    """postings (doc, term, tf, dl), written once; docs (doc, dl), terms (term, df), size and mean length of the corpus (one row)."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame
    make_norms: Callable[[], DataFrame] | None = None
    _norms: DataFrame | None = None

    def norms(self) -> DataFrame:
        """(doc, norm): lengths of the documents' TF-IDF vectors, written when they are first asked for."""
        if self._norms is None and self.make_norms is not None:
            self._norms = self.make_norms()
        if self._norms is None:
            idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
            w = (1 + F.log("tf")) * idf
            # Terms of so many postings are QUERY_TERMS at most and hold most postings, which they meet where these lie; rows of the rarer ones are shuffled.
            least = self.postings.count() / QUERY_TERMS
            posts = self.postings.select("doc", "term", "tf")
            often, seldom = self.terms.where(F.col("df") >= least), self.terms.where(F.col("df") < least)
            rows = posts.join(F.broadcast(often), "term").unionByName(posts.join(seldom.hint("shuffle_hash"), "term")).crossJoin(F.broadcast(self.stats))  # one row of statistics
            self._norms = written(rows.groupBy("doc").agg(F.sqrt(F.sum(w * w)).alias("norm")), "index-norms")
            released(posts.sparkSession)
        return self._norms


def counted(rows: DataFrame) -> DataFrame:
    """(doc, term, tf, dl) of texts (doc, text).  Texts are dealt out once by document, which is less than a row for each of their terms; a document's
    postings are then counted, and lie, in one task."""
    toks = dealt(rows, "doc").select("doc", T.raw_tokens(F.col("text")).alias("ts"))
    # Exploded first: the singular is then generated code over rows, not a function over arrays.  And with empty arrays: without them Spark filters by the array's
    # size before the shuffle, for which it cuts all texts into tokens once more.
    each = toks.select("doc", F.size("ts").cast("bigint").alias("dl"), F.explode_outer("ts").alias("t")).where("t is not null").select("doc", "dl", T.singular(F.col("t")).alias("term"))
    return each.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def build(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TextIndex:
    """Index of all chunks for one batch of work (store.IndexStore keeps one).  Texts are read and cut into tokens once: postings are counted by document
    and written to the shared folder; statistics and all legs read them there, and only the columns and terms that they need."""
    rows = chunks.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    postings = written(counted(rows), "index-postings")
    released(chunks.sparkSession)
    terms = written(postings.groupBy("term").agg(F.count("*").alias("df")), "index-terms")
    docs = rows.select("doc").join(postings.groupBy("doc").agg(F.first("dl").alias("dl")), "doc", "left").select("doc", F.coalesce("dl", F.lit(0)).alias("dl"))
    total, n = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n")).collect()[0]["n"], rows.select("doc").count()
    stats = chunks.sparkSession.createDataFrame([(n, total / n if n else None)], "n_docs bigint, avg_dl double")
    return TextIndex(postings, docs, terms, stats)


def queries_of(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, term, qtf) of a batch of queries."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(T.tokens(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def hits(index: TextIndex, terms: DataFrame) -> DataFrame:
    """Postings of the query terms only: the index's inverted lists met by a term join."""
    return index.postings.join(terms, "term")


QUERY_TERMS = 200_000


def held(df: DataFrame, most: int = QUERY_TERMS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows (counted), else as it is: it is then joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def by_doc(found: DataFrame) -> DataFrame:
    """Postings of a batch's terms, each shuffled once to its document: scores by (qid, doc) are then summed where they are, and what leaves a task
    for a ranking are its best rows, not every pair of a query and a document."""
    return found.repartition("doc")


def near(rows: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """rows of the documents that pairs (qid, doc) name; all rows without pairs."""
    return rows if pairs is None else rows.join(held(pairs.select("doc").distinct()), "doc", "left_semi")


CELLS = 200_000


def scores(rows: DataFrame, asked: DataFrame, depth: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score): the sum of both weights over the terms that a document (doc, term, w) and a query (qid, term, w) share, rounded to 6 digits.

    With pairs, of these pairs (qid, doc) only.  With depth, what each task leaves are the best `depth` documents of a query among its own,
    ties by doc, for a ranking no deeper than that; batches of more than QUERY_TERMS terms leave every pair also then."""
    total = F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score")
    asked = asked.select("qid", "term", F.col("w").alias("qw"))
    if pairs is not None:
        wanted = held(pairs.select("qid", "doc").distinct())
        # A document's terms meet the few queries that want it, not all that hold the term.
        return rows.join(wanted, "doc").join(held(asked), ["qid", "term"]).groupBy("qid", "doc").agg(total)
    small = asked.limit(QUERY_TERMS + 1).collect() if depth is not None else None  # at most QUERY_TERMS rows are used
    if small is None or len(small) > QUERY_TERMS:
        return by_doc(rows.join(held(asked.select("term").distinct()), "term")).join(held(asked), "term").groupBy("qid", "doc").agg(total)
    best = _in_tasks(rows, small, asked.schema["qid"].dataType, ["w"], depth)
    return best.select("qid", "doc", "score")


def legs(rows: DataFrame, asked: DataFrame, names: list[str], depth: int, facts: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """(leg, qid, doc, score): what scores() finds with each of several weights of the same terms, for rankings of `depth`, from one pass over the rows.

    rows: (doc, term, a weight by the name of each leg), asked: (qid, term, such weights).  facts: (doc, by what each leg's weights are divided there, home),
    shuffled as rows of their own and not by a join.  limits: (qid, homes) of the queries that only look at documents of some homes."""
    ours = asked.select("qid", "term", *(F.col(x).alias(f"q_{x}") for x in names))
    small = ours.limit(QUERY_TERMS + 1).collect()  # at most QUERY_TERMS rows are used
    bound = limits.select("qid", F.explode_outer("homes").alias("home")).limit(QUERY_TERMS + 1).collect() if limits is not None else []  # so are these
    if max(len(small), len(bound)) <= QUERY_TERMS:
        return _in_tasks(rows, small, asked.schema["qid"].dataType, names, depth, facts, bound)
    found = by_doc(rows.join(held(ours.select("term").distinct()), "term"))
    if facts is not None:
        found = found.join(facts.select("doc", "home", *(F.col(x).alias(f"d_{x}") for x in names)), "doc").withColumns({x: F.col(x) / F.col(f"d_{x}") for x in names})
    found = found.join(ours, "term")
    if limits is not None:
        found = found.join(limits, "qid", "left").where(F.col("homes").isNull() | F.array_contains("homes", F.col("home")))
    each = found.groupBy("qid", "doc").agg(*(F.round(F.sum(F.col(x) * F.col(f"q_{x}")), 6).alias(x) for x in names))
    return each.select("qid", "doc", F.explode(F.array(*(F.struct(F.lit(x).alias("leg"), F.col(x).alias("score")) for x in names))).alias("x")).where("x.score > 0").select("x.leg", "qid", "doc", "x.score")


def _in_tasks(rows: DataFrame, small: list, kind: DataType, names: list[str], depth: int, facts: DataFrame | None = None, bound: Sequence = ()) -> DataFrame:
    """(leg, qid, doc, score): each task's best documents (see _best) of rows (doc, term, a weight for each leg).

    small: (qid, term, a weight for each leg); facts: see legs(); bound: (qid, home) of limited queries, home null where there is none."""
    spark = rows.sparkSession
    ship(spark)
    qids, terms = list(dict.fromkeys(r["qid"] for r in small)), list(dict.fromkeys(r["term"] for r in small))
    place, number = {q: i for i, q in enumerate(qids)}, {t: i for i, t in enumerate(terms)}
    small.sort(key=lambda r: number[r["term"]])
    starts = np.searchsorted([number[r["term"]] for r in small], np.arange(len(terms) + 1))
    weights = np.array([[r[2 + i] for r in small] for i in range(len(names))], "float64")
    homes = {h: i for i, h in enumerate(dict.fromkeys(r["home"] for r in bound if r["home"] is not None))}
    free, lets = np.ones(len(qids), bool), [[] for _ in homes]
    for r in bound:
        if r["qid"] in place:
            free[place[r["qid"]]] = False
            if r["home"] is not None:
                lets[homes[r["home"]]].append(place[r["qid"]])
    best = _best(len(qids), starts, np.array([place[r["qid"]] for r in small], "int64"), weights, depth, free, [np.array(x, "int64") for x in lets])
    known = spark.createDataFrame(list(number.items()), "term string, t int")
    ids = [(i * len(qids) + k, leg, q) for i, leg in enumerate(names) for k, q in enumerate(qids)]
    ids = spark.createDataFrame(ids, StructType([StructField("q", LongType()), StructField("leg", StringType()), StructField("qid", kind)]))
    ws = [F.col(x).cast("double").alias(f"w{i}") for i, x in enumerate(names)]
    found = rows.join(F.broadcast(known), "term").select("doc", "t", *ws, F.lit(-1).alias("home"))  # terms of the batch, QUERY_TERMS at most
    if facts is not None:
        which = spark.createDataFrame(list(homes.items()), StructType([StructField("home", facts.schema["home"].dataType), StructField("i", IntegerType())]))
        found = found.unionByName(facts.join(F.broadcast(which), "home", "left").select("doc", F.lit(-1).alias("t"), *ws, F.coalesce("i", F.lit(-1)).alias("home")))  # homes that the batch names
    out = StructType([StructField("q", LongType()), StructField("doc", rows.schema["doc"].dataType), StructField("score", DoubleType())])
    return by_doc(found).sortWithinPartitions("doc").mapInArrow(best, out).join(F.broadcast(ids), "q").select("leg", "qid", "doc", "score")  # the batch's ids


def _best(
    n: int, starts: np.ndarray, queries: np.ndarray, weights: np.ndarray, depth: int, free: np.ndarray | None = None, lets: Sequence[np.ndarray] = ()
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over rows (doc, t, a weight for each leg, home) in order of doc that keeps the best `depth` documents of each of n queries in each leg.

    queries and weights (one leg, or a row for each) list the queries of term t from starts[t] on; query q of leg i counts as query i * n + q.  A row with t below 0 says
    by what its document's weights are divided, and its home.  Queries that are not free only look at homes that let them.  Home may be missing.
    Documents are scored in blocks of CELLS pairs; only what passes a query's last kept score is looked at again."""
    weights = np.atleast_2d(weights)
    limited = free is not None and not free.all()
    every = len(weights) * n

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar, docs, rest = np.full(every, -1.0), None, None
        kept = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))  # query, place in docs, score

        def cut(q, d, s, docs):
            order = np.lexsort((d, -s, q))
            q, d, s = q[order], d[order], s[order]
            i = np.arange(len(q)) - np.searchsorted(q, q)
            last = i == depth - 1
            bar[q[last]] = s[last]
            first = i < depth
            used, d = np.unique(d[first], return_inverse=True)
            return (q[first], d, s[first]), docs.take(pa.array(used))

        def block(doc, t, ws, home, lo, hi):
            a, b = np.searchsorted(doc, [lo, hi])
            each = starts[t[a:b] + 1] - starts[t[a:b]]
            row = np.repeat(np.arange(a, b), each)
            at = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[t[a:b]], each)
            cell, parts = (doc[row] - lo) * n + queries[at], []
            seen = True
            if limited:
                seen = np.repeat(free[None], hi - lo, 0)
                for h in np.unique(home[lo:hi][home[lo:hi] >= 0]):
                    seen[np.ix_(home[lo:hi] == h, lets[h])] = True
            for i, (w, weight) in enumerate(zip(ws, weights, strict=True)):
                total = np.bincount(cell, weights=w[row] * weight[at], minlength=(hi - lo) * n).reshape(-1, n)
                score = np.round(total, 6)
                d, q = np.nonzero((total > 0) & (score > bar[i * n : (i + 1) * n]) & seen)
                parts.append((q + i * n, d + lo, score[d, q]))
            return tuple(map(np.concatenate, zip(*parts, strict=True)))

        for batch in itertools.chain(batches, [None]):
            rows = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if rest is not None or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            code = rows["doc"].combine_chunks().dictionary_encode("encode")
            doc, count = code.indices.to_numpy(zero_copy_only=False).astype("int64"), len(code.dictionary)
            if batch is not None:  # the last document may go on in the next batch
                end = int(np.searchsorted(doc, count - 1))
                rest, doc, count = rows.slice(end).to_batches()[0], doc[:end], count - 1
            t, *ws = (rows[c].to_numpy()[: len(doc)] for c in rows.column_names[1 : 2 + len(weights)])
            home, fact = np.full(count, -1), t < 0
            if fact.any():
                at, over = doc[fact], np.ones(count)
                home[at] = rows["home"].to_numpy()[: len(doc)][fact]
                doc, t = doc[~fact], t[~fact]
                for i, w in enumerate(ws):
                    over[at] = w[fact]
                    ws[i] = w[~fact] / over[doc]
            base = 0 if docs is None else len(docs)
            docs = code.dictionary[:count] if docs is None else pa.concat_arrays([docs, code.dictionary[:count]])
            step = max(1, CELLS // n)
            for lo in range(0, count, step):
                q, d, s = block(doc, t, ws, home, lo, min(count, lo + step))
                kept = tuple(map(np.concatenate, zip(kept, (q, d + base, s), strict=True)))
                if len(kept[0]) > 2 * every * depth + CELLS // 4:
                    # Documents of this batch that are still to come keep their places behind what is kept.
                    head, ahead = docs[: base + min(count, lo + step)], docs[base + min(count, lo + step) :]
                    kept, head = cut(*kept, head)
                    base, docs = len(head) - min(count, lo + step), pa.concat_arrays([head, ahead])
        if len(kept[0]):
            (q, d, s), docs = cut(*kept, docs)
            yield pa.RecordBatch.from_arrays([pa.array(q), docs.take(pa.array(d)), pa.array(s)], ["q", "doc", "score"])

    return task


def bm25(index: TextIndex, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, depth: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score): BM25 of every document that shares a term with the query; depth, pairs: see scores().

    What is shuffled are the postings of the batch's terms, partial document frequencies of these terms and, by callers, each task's best rows."""
    terms = queries_of(queries, id_col, text_col)
    df = index.postings.join(held(terms.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = terms.join(df, "term").crossJoin(F.broadcast(index.stats)).select("qid", "term", (F.col("qtf") * idf).alias("w"))  # one row of statistics
    w = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    rows = near(index.postings, pairs).crossJoin(F.broadcast(index.stats)).select("doc", "term", w.alias("w"))  # one row of statistics
    return scores(rows, asked, depth, pairs)


def dense(index: TextIndex, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", depth: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score): cosine of TF-IDF vectors; unknown query terms count in the query's length; depth, pairs: see scores().

    Only the batch's terms are weighed; the documents' vector lengths stand beside the index."""
    terms = queries_of(queries, id_col, text_col)
    idf = F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    few = held(terms.select("term").distinct())
    raw = terms.join(index.terms.join(few, "term"), "term", "left").crossJoin(F.broadcast(index.stats)).select("qid", "term", idf.alias("idf"), ((1 + F.log("qtf")) * idf).alias("q"))
    norm = raw.groupBy("qid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    asked = raw.join(norm, "qid").select("qid", "term", (F.col("q") / F.col("qnorm") * F.col("idf")).alias("w"))
    some = by_doc(near(index.postings, pairs).select("doc", "term", "tf").join(few, "term"))
    return scores(some.join(index.norms(), "doc").select("doc", "term", ((1 + F.log("tf")) / F.col("norm")).alias("w")), asked, depth, pairs)


def ranked(scores: DataFrame, depth: int, by: str = "qid", key: str = "doc") -> DataFrame:
    """The first `depth` rows of each query, ties by key; rank counts from 0.

    The filter stands on the row number itself, so each task keeps `depth` rows of a query before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth).withColumn("rank", F.col("rank") - 1)


def graph_leg(
    chunks: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", q_id: str = "item_id", q_text: str = "text", depth: int | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """(qid, doc, score): how many of the query's entities, capitalised words of four letters or more, the chunk names; depth, pairs: see scores()."""
    entity = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[A-Z][A-Za-z]{3,}"), F.lit(0)))
    of = queries.select(F.col(q_id).alias("qid"), F.explode(entity(F.col(q_text))).alias("term"), F.lit(1.0).alias("w"))
    have = near(chunks.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), pairs).select("doc", F.explode_outer(entity(F.col("text"))).alias("term"), F.lit(1.0).alias("w")).where("term is not null")
    return scores(have, of, depth, pairs)


def rrf(legs: dict[str, tuple[DataFrame, float]], depth: int = 40, k: int = 60) -> DataFrame:
    """(qid, doc, score): weighted reciprocal rank fusion: the sum of weight / (k + rank) over the legs' first `depth` hits."""
    parts = None
    for frame, weight in legs.values():
        part = ranked(frame, depth).select("qid", "doc", (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("qid", "doc").agg(F.round(F.sum("part"), 8).alias("score"))
