"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words; the space is that of all words which the labelled examples hold, none left out.  A
term's weight is its inverse document frequency, counted over *all* documents, times one plus
EVIDENCE times the information that it carries on the label (from its rates among the examples of either label
and the labels' true shares, so that it means the same at every size of the sample).  Every document
with any such word is compared with the examples of both labels.

The index: rare terms have postings lists; a frequent term's impacts lie densely, by blocks of BLOCK
examples, with the block's largest impact beside them.  The postings are summed first, which gives each
document a lower bound on its k-th best cosine; a block whose sums and largest impacts cannot reach that bound
is passed over, all others are summed in full.  So the k nearest are exact.
Votes are weighted by cosine and by how many labelled rows an example stands for, which calibrates them.

Bound: about MAX_EXAMPLES labelled rows of each label (by a hash of the id; never twice as many), a
parameter.  All documents are scored, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from basalt.llm import shared
from basalt.llm.subword import spread as ranges

MAX_EXAMPLES = 3_000
EVIDENCE = 800.0
NEIGHBOURS = 15
BLOCK = 128
#: Terms that more than this share of the examples hold have dense impacts, most of them DENSE ones.
FREQUENT, DENSE = 0.02, 768
#: Documents that are searched for at a time.
TEXTS = 64
PRIOR_WEIGHT = 0.25
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def sample(labels: DataFrame, id_col: str, label_col: str, most: int) -> tuple[DataFrame, dict[int, float]]:
    """About `most` rows of each label, chosen by a hash of the id, as (id, label); and for each label, rows that one stands for.

    Ids with two different labels and null labels are left out; repeated rows count once."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("hi"))
    rows = rows.where("label = hi").select("id", "label")
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label in (0, 1):
        part = shared.thinned(rows.where(F.col("label") == label), total.get(label, 0), most, "id")
        picked = part if picked is None else picked.unionByName(part)
    return shared.cut(picked, "toxic-sample"), {x: max(1.0, n / most) for x, n in total.items()}


class Vectors:
    """Texts to the index's terms that they hold, in flat arrays."""

    def __init__(self, vocabulary: list[str]):
        self.index = {t: i for i, t in enumerate(vocabulary)}

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and their counts, one text after another, and how many terms each text has."""
        get, terms, counts, lens = self.index.get, [], [], []
        for text in texts:
            n = len(terms)
            for w, c in words_of(text).items():
                t = get(w)
                if t is not None:
                    terms.append(t)
                    counts.append(c)
            lens.append(len(terms) - n)
        return np.array(terms, np.int64), np.array(counts, np.int64), np.array(lens, np.int64)


@dataclass
class Index:
    """Unit vectors of the examples, in the order of their blocks."""

    vocabulary: list[str]
    weights: np.ndarray  # of each term
    ids: np.ndarray
    labels: np.ndarray
    stands: np.ndarray  # labelled rows that an example of each label stands for
    place: np.ndarray  # term -> row of dense, or -1
    dense: np.ndarray  # (frequent term, example) -> impact
    block_max: np.ndarray  # (frequent term, block) -> largest impact
    at: np.ndarray  # term -> its first posting, for rare terms
    docs: np.ndarray
    impacts: np.ndarray
    base: float  # share of label 1

    def unit(self, terms: np.ndarray, counts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(lens)), lens)
        v = (1 + np.log(counts)) * self.weights[terms]
        norm = np.sqrt(np.bincount(owner, v * v, minlength=len(lens)))
        return owner, (v / np.maximum(norm, 1e-300)[owner]).astype(np.float32)

    def cosines(self, terms: np.ndarray, counts: np.ndarray, lens: np.ndarray, k: int) -> np.ndarray:
        """(text, example): cosines, exact for each text's k best; others may lack frequent terms where these cannot matter."""
        owner, v = self.unit(terms, counts, lens)
        n, size = len(lens), len(self.ids)
        row = self.place[terms]
        rare = row < 0
        first = self.at[terms[rare]]
        many = self.at[terms[rare] + 1] - first
        post = ranges(first, many)
        cos = np.bincount(np.repeat(owner[rare], many) * size + self.docs[post], np.repeat(v[rare], many) * self.impacts[post], minlength=n * size)[: n * size].reshape(n, size).astype(np.float32)
        query = np.zeros((n, len(self.dense)), np.float32)
        query[owner[~rare], row[~rare]] = v[~rare]
        blocks = -(-size // BLOCK)
        starts = np.arange(blocks) * BLOCK
        reach = np.maximum.reduceat(cos, starts, axis=1) + query @ self.block_max + np.float32(1e-5)
        least = (lambda: np.partition(cos, size - k, axis=1)[:, size - k]) if size > k else (lambda: np.zeros(n, np.float32))
        todo = reach >= least()[:, None]

        def add(rows: np.ndarray, block: int) -> None:
            lo, hi = block * BLOCK, min(size, (block + 1) * BLOCK)
            cos[rows, lo:hi] += query[rows] @ self.dense[:, lo:hi]

        # Each text's most promising block first: what it finds there raises its bound.
        best = reach.argmax(1)
        for block in np.unique(best):
            add(np.flatnonzero(best == block), int(block))
        todo[np.arange(n), best] = False
        todo &= reach >= least()[:, None]
        for block in np.flatnonzero(todo.any(0)):
            add(np.flatnonzero(todo[:, block]), int(block))
        return cos

    def nearest(self, terms: np.ndarray, counts: np.ndarray, lens: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its k best examples with a positive cosine (ties: lower place first) and the cosines, to six decimals."""
        none = (np.empty(0, np.int64), np.empty(0))
        if not len(self.ids):
            return [none] * len(lens)
        out = []
        cos = self.cosines(terms, counts, lens, k)
        least = np.partition(cos, len(self.ids) - k, axis=1)[:, len(self.ids) - k] if len(self.ids) > k else np.zeros(len(lens))
        for i in range(len(lens)):
            at = np.flatnonzero(cos[i] >= max(least[i] - 2e-6, 1e-6))
            value = np.round(cos[i, at].astype(np.float64), 6)
            order = np.lexsort((at, -value))[:k]
            out.append((at[order], value[order]))
        return out

    def score(self, terms: np.ndarray, counts: np.ndarray, lens: np.ndarray) -> tuple[list[float], list[list[dict]]]:
        """Calibrated shares of label 1, and the evidence: id, cosine and label of the neighbours."""
        scores, evidence = [], []
        ends = np.cumsum(lens)
        for lo in range(0, len(lens), TEXTS):
            hi = min(lo + TEXTS, len(lens))
            a, z = (int(ends[lo - 1]) if lo else 0), int(ends[hi - 1])
            for who, cos in self.nearest(terms[a:z], counts[a:z], lens[lo:hi], NEIGHBOURS):
                w = cos**2 * self.stands[self.labels[who]]
                s = (float(w @ self.labels[who]) + PRIOR_WEIGHT * self.base) / (float(w.sum()) + PRIOR_WEIGHT)
                scores.append(min(1.0, max(0.0, s)))
                evidence.append([{"id": int(self.ids[i]), "cosine": float(c), "label": int(self.labels[i])} for i, c in zip(who, cos, strict=True)])
        return scores, evidence


def information(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, share: float) -> np.ndarray:
    """Information (nats) between a term and the label, from how many examples of each label hold it and the share of label 1."""
    p, q = pos / max(1, n_pos), neg / max(1, n_neg)
    both = share * p + (1 - share) * q

    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(y, 1e-300)), 0.0)

    return np.maximum(0.0, share * (part(p, both) + part(1 - p, 1 - both)) + (1 - share) * (part(q, both) + part(1 - q, 1 - both)))


def build_index(ids: np.ndarray, labels: np.ndarray, terms: np.ndarray, counts: np.ndarray, lens: np.ndarray, vocabulary: list[str], df: np.ndarray, n_docs: int, stands: dict[int, float]) -> Index:
    """ids, labels and flat terms and counts of the examples; df: in how many of n_docs documents each term stands."""
    weight = np.array([stands.get(0, 1.0), stands.get(1, 1.0)])
    totals = np.bincount(labels, minlength=2) * weight
    share = float(totals[1] / max(1.0, totals.sum()))
    owner = np.repeat(np.arange(len(ids)), lens)
    size = len(vocabulary)
    held = [np.bincount(terms[labels[owner] == y], minlength=size) for y in (0, 1)]
    known = information(held[1], held[0], int((labels == 1).sum()), int((labels == 0).sum()), share)
    weights = (np.log((n_docs + 1) / (df + 1)) + 1) * (1 + EVIDENCE * 2 * known)
    # Terms of many examples lie densely; examples that begin with the same of them lie together, which keeps the blocks' bounds low.
    many = held[0] + held[1]
    top = np.argsort(-many, kind="stable")[:DENSE]
    top = top[many[top] > FREQUENT * len(ids)]
    place = np.full(size, -1)
    place[top] = np.arange(len(top))
    value = (1 + np.log(counts)) * weights[terms]
    value /= np.maximum(np.sqrt(np.bincount(owner, value * value, minlength=len(ids))), 1e-300)[owner]
    lead = np.full((len(ids), 3), -1)
    common = np.flatnonzero(place[terms] >= 0)
    common = common[np.lexsort((-value[common], owner[common]))]
    if len(common):
        rank = np.arange(len(common)) - np.maximum.accumulate(np.where(np.concatenate(([True], owner[common][1:] != owner[common][:-1])), np.arange(len(common)), 0))
        for k in range(3):
            at = common[rank == k]
            lead[owner[at], k] = place[terms[at]]
    order = np.lexsort((ids, lead[:, 2], lead[:, 1], lead[:, 0]))
    moved = np.empty(len(ids), np.int64)
    moved[order] = np.arange(len(ids))
    owner = moved[owner]
    dense = np.zeros((len(top), len(ids)), np.float32)
    mine = place[terms] >= 0
    dense[place[terms[mine]], owner[mine]] = value[mine]
    starts = np.arange(-(-len(ids) // BLOCK)) * BLOCK
    block_max = np.maximum.reduceat(dense, starts, axis=1) if len(ids) else np.zeros((len(top), 0), np.float32)
    t, d, x = terms[~mine], owner[~mine], value[~mine]
    by = np.lexsort((d, t))
    at = np.searchsorted(t[by], np.arange(size + 1))
    return Index(vocabulary, weights, ids[order], labels[order], weight, place, dense, block_max, at, d[by], x[by].astype(np.float32), share)


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, np.ndarray]:
    """How many documents there are, and in how many each word of the vocabulary stands: counted where the texts lie, added up by Spark."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)  # the words of at most 4 * MAX_EXAMPLES texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, df, n = Vectors(sent.value), np.zeros(len(sent.value), np.int64), 0
        for b in batches:
            terms, _, lens = made.of(shared.strings(b.column(0)))
            df += np.bincount(terms, minlength=len(df))
            n += len(lens)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], some))), pa.array(np.concatenate(([n], df[some])))], ["term", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    got = rows.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row for each known word
    counts = np.zeros(len(vocabulary) + 1, np.int64)
    counts[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return int(counts[-1]), counts[:-1]


@dataclass
class Model:
    index: Index
    docs: DataFrame
    id_col: str
    text_col: str


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_EXAMPLES) -> Model:
    """Learn from the labelled rows among docs; words are counted over all of them."""
    shared.tune(docs.sparkSession)
    ids, stands = sample(labels, id_col, label_col, most)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [words_of(t) for t in shared.strings(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(c) for c in got], pa.list_(pa.string())), pa.array([list(c.values()) for c in got], pa.list_(pa.int64()))], ["id", "label", "words", "counts"])

    picked = texts.join(F.broadcast(ids), "id").dropDuplicates(["id"]).select("id", "label", "text")  # two labels, 2 * `most` ids each at most
    got = picked.mapInArrow(run, "id bigint, label int, words array<string>, counts array<bigint>").toArrow().sort_by("id").combine_chunks()
    words = got.column("words").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.string()))
    coded = words.flatten().dictionary_encode()
    vocabulary, terms = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lens = np.diff(words.offsets.to_numpy()).astype(np.int64)
    counts = got.column("counts").combine_chunks().flatten().to_numpy() if got.num_rows else np.empty(0, np.int64)
    n_docs, df = document_frequencies(docs, vocabulary, text_col)
    shared.drop_cut(ids)
    return Model(build_index(got.column("id").to_numpy(), got.column("label").to_numpy().astype(np.int64), terms, counts, lens, vocabulary, df, n_docs, stands), docs, id_col, text_col)


def score(model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted, evidence) for each row of the documents given to fit.

    A null or empty text, or one without any word of the examples, gets the share of label 1 and no evidence.
    Repeated rows give repeated rows, null ids stay null and are never learned from.  Where nothing could be learned every score is 0."""
    spark = model.docs.sparkSession
    shared.tune(spark)
    sent = spark.sparkContext.broadcast(model.index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, made = sent.value, Vectors(sent.value.vocabulary)
        kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for b in batches:
            scores, evidence = index.score(*made.of(shared.strings(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(evidence, kind)], ["id", "score", "predicted", "evidence"])

    rows = model.docs.select(F.col(model.id_col).cast("bigint").alias("id"), F.col(model.text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, score double, predicted int, evidence array<struct<id: bigint, cosine: double, label: int>>").withColumnRenamed("id", id_col)


def judge(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """docs with toxic_score appended (in place of a column so named); a null text counts as empty."""
    spark = docs.sparkSession
    shared.tune(spark)
    docs = docs.drop("toxic_score")
    fields = docs.schema.fieldNames()
    at = fields.index(text_col)
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Vectors(sent.value.vocabulary)
        for b in batches:
            scores, _ = sent.value.score(*made.of(shared.strings(b.column(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*fields, "toxic_score"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("toxic_score", DoubleType()))


def learnable(labels: DataFrame) -> DataFrame:
    """The labelled rows that the contract allows to learn from."""
    return labels.where(shared.remainder("doc_id", 5) != 0)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: a score for every whole document, learned from four of five folds of the labels."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, learnable(shared.table(spark, sf_dir, "labels")))
    return score(model).select("doc_id", (shared.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")
