"""Language identification with hyperdimensional profiles.

Every letter (and the word boundary) has a random vector of +1 and -1, drawn from its code point.
A trigram's vector binds its letters' vectors, each permuted by its place:
``roll(L[a], 2) * roll(L[b], 1) * L[c]``.  A text bundles (sums) the vectors of all its trigrams, a
language bundles its labelled texts, each at the weight 1, and a text goes to the language whose
prototype has the largest cosine.

Training gathers, for each language, integer sums (so their order is immaterial) that Spark adds
up by (language, dimension).  What reaches the driver and the tasks is one vector for each
language: DIM * 8 bytes times the number of languages, which is checked against MAX_LANGUAGES.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared

DIM = 1024
SCALE = 1 << 20
#: The cosine that random vectors have by chance (one standard deviation): a text that is no closer to any language is told from none.
NOISE = DIM**-0.5
MAX_LANGUAGES = 4096
DENSE_CODES = 1 << 22
SLICE_CODES = 2 << 20
#: Texts are taken in pieces of a batch of about this many characters, since their trigrams take up to a hundred bytes for each.
PIECE_CHARS = 1 << 19


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=20_000)
def letter_vector(code: int) -> np.ndarray:
    """The vector of a code point; 0 is the word boundary."""
    return np.random.default_rng([code, 77]).integers(0, 2, DIM, dtype=np.int8) * np.int8(2) - np.int8(1)


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Where runs of whole texts begin and end that have PIECE_CHARS characters at most, or one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > PIECE_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if texts:
        yield lo, len(texts)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All trigrams of all texts: their text's index and their place among `distinct`,
    the distinct trigrams' three code points, and which texts have a letter."""
    lowered = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    is_letter = letters()[codes]
    has = np.zeros(len(texts), bool)
    has[owner[is_letter]] = True
    # One boundary stands for a run of other characters.
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    codes, owner = np.where(is_letter, codes, 0)[keep], owner[keep]
    present = np.flatnonzero(np.bincount(codes, minlength=1)) if len(codes) else np.empty(0, np.int64)
    small = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    small[present] = np.arange(len(present))
    s, n = small[codes], max(1, len(present))
    inside = (owner[2:] == owner[:-2]) & ((codes[1:-1] != 0) | (codes[2:] != 0)) if len(codes) > 2 else np.empty(0, bool)
    at = np.flatnonzero(inside)
    key = (s[at] * n + s[at + 1]) * n + s[at + 2]
    if n**3 <= DENSE_CODES:
        found = np.flatnonzero(np.bincount(key, minlength=1)) if len(key) else np.empty(0, np.int64)
        place = np.zeros(n**3, np.int64)
        place[found] = np.arange(len(found))
        which = place[key]
    else:
        found, which = np.unique(key, return_inverse=True)
    distinct = present[np.stack([found // (n * n), found // n % n, found % n], 1)] if len(found) else np.empty((0, 3), np.int64)
    return owner[at], which, distinct, has


def trigram_vectors(distinct: np.ndarray) -> np.ndarray:
    """Bound vectors, one row for each trigram."""
    used, where = np.unique(distinct, return_inverse=True)
    base = np.stack([letter_vector(int(c)) for c in used]) if len(used) else np.empty((0, DIM), np.int8)
    where = where.reshape(distinct.shape)
    return np.roll(base, 2, 1)[where[:, 0]] * np.roll(base, 1, 1)[where[:, 1]] * base[where[:, 2]]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes (unit rows), from all rows with a language and a letter."""
    shared.tune(docs.sparkSession)

    def add(sums: dict[str, np.ndarray], texts: list[str], langs: list[str]) -> None:
        owner, which, distinct, has = trigrams(texts)
        names = sorted({x for x, h in zip(langs, has, strict=True) if h})
        if not names or not len(which):
            return
        index = {x: i for i, x in enumerate(names)}
        of = np.array([index.get(x, 0) for x in langs])
        share = 1.0 / np.maximum(1, np.bincount(owner, minlength=len(langs)))
        vectors = trigram_vectors(distinct).astype(np.float32)
        for x, i in index.items():
            mine = of[owner] == i
            weights = np.bincount(which[mine], share[owner[mine]], minlength=len(distinct))
            sums[x] = sums.get(x, 0) + np.rint(weights.astype(np.float32) @ vectors * SCALE).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, tags = shared.strings(b.column(0)), b.column(1).to_pylist()
            for lo, hi in pieces(texts):
                add(sums, texts[lo:hi], tags[lo:hi])
        for x, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()), pa.array([v.tolist()], pa.list_(pa.int64()))], ["lang", "part"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parts = rows.mapInArrow(run, "lang string, part array<bigint>")
    summed = parts.select("lang", F.posexplode("part").alias("dim", "v")).groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    got = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    got = sorted((r["lang"], r["v"]) for r in got)
    protos = np.array([v for _, v in got], np.float64).reshape(len(got), DIM)
    return [x for x, _ in got], protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-300)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred (string) and lang_score (the cosine, at least 0) appended, in place of columns so named.

    A null text or one without a letter gets `und` and 0, and so does every text if nothing was
    learned.  Of equal cosines the first language in order wins.  Repeated rows get equal values."""
    shared.tune(docs.sparkSession)
    names, protos = model
    docs = docs.drop("lang_pred", "lang_score")
    fields = docs.schema.fieldNames()
    at = fields.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = protos.astype(np.float32).T
        for b in batches:
            texts = shared.strings(b.column(at))
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            for first, last in pieces(texts):
                owner, which, distinct, has = trigrams(texts[first:last])
                if not len(which) or not names:
                    continue
                vectors = trigram_vectors(distinct).astype(np.float32)
                step = max(1, SLICE_CODES // len(distinct))
                for lo in range(0, last - first, step):
                    hi = min(lo + step, last - first)
                    a, z = np.searchsorted(owner, [lo, hi])
                    counts = np.bincount((owner[a:z] - lo) * np.int64(len(distinct)) + which[a:z], minlength=(hi - lo) * len(distinct))
                    bundle = counts.reshape(hi - lo, len(distinct)).astype(np.float32) @ vectors
                    cos = bundle @ flat / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-30)
                    best = cos.argmax(1)
                    for i in np.flatnonzero(has[lo:hi]):
                        pred[first + lo + i] = names[best[i]]
                        score[first + lo + i] = min(1.0, max(0.0, float(cos[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], [*fields, "lang_pred", "lang_score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("lang_score", DoubleType())
    return docs.mapInArrow(run, schema)


def train_rows(docs: DataFrame) -> DataFrame:
    """The rows that the contract allows to learn from."""
    return docs.where(shared.remainder("doc_id", 4) != 2)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the language of every whole document, learned from three of four folds."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(train_rows(docs))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (shared.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
