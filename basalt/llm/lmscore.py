"""Language-model scores from a small causal self-attention model over subword ids.

Words are counted over all training documents (a Spark aggregation); the subword model's output
tables are derived from these counts, so they cover the whole corpus as well.

The model predicts a subword in two steps: its class from the attention state, then the subword in
the class from corpus counts (inside a word given the class of the subword before).  Classes keep
subwords that begin a word apart from those that go on with it.  The class logits are a table row
of the last subword plus a projection of masked self-attention over the last CONTEXT to
2 * CONTEXT - 1 subwords of the same text.  All that the model learns comes from counts over all training
documents, whatever the partitions: their subwords are written down once, and tasks count which frequent
subwords stand near each subword (features, from which classes are clustered), which class follows it at once (the table)
and at LAGS (values and outputs: what it tells on classes to come beyond the class before, by its leading directions; keys: how
much it tells), and which classes stand at PAIR_LAGS and follow, given the last class (queries and keys).  Texts are scored in overlapping windows
of 2 * CONTEXT subwords, of which the later half is scored, so each subword is scored once.

A word's probability mixes the product of its subwords' with that of its first class times its share
among the corpus' words that begin with this class, with its smoothed share of the corpus, and with its share of
the words before it in its text; the second and the third need the word's count.  Every task holds the counts of the FREQUENT most common words; all
other words meet theirs in a join, which completes both scores (see Scorer.score).  No result depends on FREQUENT.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared
from basalt.llm.packing import Words
from basalt.llm.subword import spread

CONTEXT = 16
DIM, MATCH, FEATURES = 16, 7, 32
START_CLASSES, INNER_CLASSES = 56, 39
FREQUENT = 100_000
#: For sample_buckets(), which is no step of fit().
SAMPLE, SAMPLE_DOCS, BUCKET_DOCS = 1.0, 2_000, 500
NEIGHBOURS = 128
#: Distances at which subwords are counted with the classes to come, and at which pairs of classes are.
LAGS, PAIR_LAGS = (2, 3, 5, 8, 12, 17, 23, 30), (3, 12)
#: Counts that a subword's, and a pair's, are smoothed by; of what attention tells, how far it moves the logits; powers of what keys and pairs of classes tell.
SHRINK, PAIR_SHRINK, GAIN, KEY_POWER, PAIR_POWER = 300, 50, 2.0, 0.7, 0.3
#: Numbers of a piece of summed() counts.
PIECE = 1 << 18
CACHE_WORDS = 200_000
FLUSH_WORDS = 250_000
#: Weights of the subwords, of a frequent word's share of its class, of the smoothed share of any word, and of its share of the text so far.
MIX = (0.55, 0.15, 0.20, 0.10)
#: Texts and subwords that are worked on at a time, so that arrays stay in the cache; no result depends on them.
TEXTS, SLICE = 256, 1 << 11


def words_of(text: str) -> list[bytes]:
    """Words in A-Z lower case, between the white space of ASCII, in UTF-8 (bytes know no other letters or spaces)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Subwords:
    """Ids of words, each encoded behind a space, with a cache."""

    def __init__(self, tokenizer: str):
        self.words = Words(tokenizer)
        if self.words.fast is None:
            raise ValueError("a byte-level vocabulary is needed")
        self.size = self.words.fast.n_vocab + 1
        self.end = self.size - 1
        shown = [self.words.fast.decode_single_token_bytes(i) for i in range(self.size - 1)]
        self.bytes = np.array([len(x) for x in shown], np.int64)
        self.starts = np.array([*(x[:1] == b" " for x in shown), False])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.len, self.at = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def split(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        made, lens = [], []
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            # Behind a space each word begins anew, so all can be encoded in one go and cut by length.
            ids = np.asarray(self.words.fast.encode_to_numpy((b" " + b" ".join(part)).decode("utf-8", "replace"), allowed_special=set(), disallowed_special=()), np.int32)
            stops = np.cumsum([len(w) + 1 for w in part])
            upto = np.searchsorted(np.cumsum(self.bytes[ids]), stops) + 1
            made.append(ids)
            lens.append(np.diff(np.concatenate(([0], upto))))
        return np.concatenate([*made, np.empty(0, np.int32)]), np.concatenate([*lens, np.empty(0, np.int64)])

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places of words in the cache, or -1; where it is -1; the words that are not in it, each once."""
        which = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(which < 0)
        return which, lost, list(dict.fromkeys(words[i] for i in lost.tolist()))

    def learn(self, words: list[bytes]) -> None:
        ids, lens = self.split(words)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.flat, self.len = np.concatenate((self.flat, ids)), np.concatenate((self.len, lens))
        self.at = np.cumsum(self.len) - self.len


@functools.lru_cache(maxsize=1)
def subwords(tokenizer: str) -> Subwords:
    return Subwords(tokenizer)


# ---------------------------------------------------------------- the model


@dataclass
class Attention:
    """Everything that does not depend on corpus counts."""

    classes: np.ndarray  # subword -> class
    table: np.ndarray  # last subword -> class logits
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray  # subword -> projected features
    lag: np.ndarray  # bias by distance, 0 the subword itself
    out: np.ndarray  # attention state -> class logits


def company(ids: np.ndarray, docs: np.ndarray, col: np.ndarray, total: np.ndarray) -> None:
    """Adds to total how close frequent subwords (col: their columns, else -1) stand to each subword, in twelfths: by subword * 2 * NEIGHBOURS + column and side."""
    at = col[ids]
    row = ids.astype(np.int64) * (2 * NEIGHBOURS)
    for step in (1, 2, 3, 4):
        same = docs[:-step] == docs[step - 1 : -1]
        for x, y, side in ((row[:-step], at[step:], 0), (row[step:], at[:-step], NEIGHBOURS)):
            hit = np.flatnonzero(same & (y >= 0))
            np.add.at(total, x[hit] + (y[hit] + side), 12 // step)


def contexts(ids: np.ndarray, docs: np.ndarray, classes: np.ndarray, n_classes: int, total: np.ndarray) -> None:
    """Adds to total, in a row: how often each class follows each subword; how often it comes at LAGS; by the last class and the one before it at PAIR_LAGS, how often it follows."""
    size, c, row = len(classes) * n_classes, classes[ids].astype(np.int64), ids.astype(np.int64) * n_classes
    np.add.at(total[:size], row[:-1] + c[1:], 1)
    for lag in LAGS:
        np.add.at(total[size : 2 * size], (row[:-lag] + c[lag:])[docs[:-lag] == docs[lag - 1 : -1]], 1)
    for lag in PAIR_LAGS:
        np.add.at(total[2 * size :], ((c[lag - 1 : -1] * n_classes + c[:-lag]) * n_classes + c[lag:])[docs[:-lag] == docs[lag - 1 : -1]], 1)


def frequent_columns(freq: np.ndarray) -> np.ndarray:
    top = np.argsort(-freq, kind="stable")[:NEIGHBOURS]
    col = np.full(len(freq), -1)
    col[top] = np.arange(len(top))
    return col


def features_of(freq: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Unit rows that tell subwords by their company(): a truncated SVD of log counts of frequent neighbours."""
    size, present = len(freq), np.flatnonzero(freq)
    m = near.reshape(size, -1)[present].astype(np.float32) / 12
    columns = m.sum(0, keepdims=True) / max(1.0, float(m.sum())) * 20 + np.float32(1e-3)
    m *= 20 / (m.sum(1, keepdims=True) + 5)
    m /= columns
    np.log1p(m, out=m)
    u = m @ rng.standard_normal((m.shape[1], FEATURES + 8)).astype(np.float32)
    for _ in range(3):
        q, _ = np.linalg.qr(u)
        u = m @ (m.T @ q)
    q, _ = np.linalg.qr(u)
    left, s, _ = np.linalg.svd(q.T @ m, full_matrices=False)
    k = min(FEATURES, len(s))
    f = np.zeros((size, FEATURES), np.float32)
    f[present, :k] = (q @ left[:, :k]) * s[:k]
    f[present] /= np.maximum(np.linalg.norm(f[present], axis=1, keepdims=True), 1e-6)
    return f


def cluster(f: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by cosine, weighted."""
    k = min(k, len(f))
    if not k:
        return np.empty(0, np.int64)
    centre = f[rng.choice(len(f), k, replace=False, p=weight / weight.sum())]
    for _ in range(12):
        of = (f @ centre.T).argmax(1)
        centre = np.zeros_like(centre)
        np.add.at(centre, of, f * weight[:, None])
        lost = np.linalg.norm(centre, axis=1) < 1e-6
        centre[lost] = f[rng.integers(0, len(f), lost.sum())]
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-6)
    return (f @ centre.T).argmax(1)


def distance() -> np.ndarray:
    return np.clip(np.arange(CONTEXT, 2 * CONTEXT)[:, None] - np.arange(2 * CONTEXT)[None, :], 0, 2 * CONTEXT - 1)


def classes_of(f: np.ndarray, freq: np.ndarray, sub_starts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    size = len(freq)
    classes, end = np.where(sub_starts, 0, START_CLASSES), size - 1
    for inner, n in ((False, START_CLASSES), (True, INNER_CLASSES)):
        some = np.flatnonzero((freq > 0) & (sub_starts != inner) & (np.arange(size) != end))
        if len(some):
            classes[some] = cluster(f[some], freq[some].astype(np.float64), n, rng) + (START_CLASSES if inner else 0)
    classes[end] = START_CLASSES + INNER_CLASSES
    return classes


def class_table(pairs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """pairs: how often each class follows each subword.  Its log share, smoothed by the subword's class."""
    by_class = np.zeros((pairs.shape[1], pairs.shape[1]))
    np.add.at(by_class, classes, pairs)
    by_class += 0.05
    by_class /= by_class.sum(1, keepdims=True)
    return np.log((pairs + 8 * by_class[classes]) / (pairs.sum(1, keepdims=True) + 8)).astype(np.float32)


def attention_of(total: np.ndarray, freq: np.ndarray, classes: np.ndarray, n_classes: int) -> Attention:
    """total: what contexts() has added up."""
    size = len(classes)
    pairs, later = total[: size * n_classes].reshape(size, n_classes), total[size * n_classes : 2 * size * n_classes].reshape(size, n_classes)
    table = class_table(pairs.astype(np.float64), classes)
    # What a subword tells on classes to come: how much oftener they come than after its classes to come anyway.
    onward = np.full((n_classes, n_classes), 0.05)
    np.add.at(onward, classes, pairs)
    onward /= onward.sum(1, keepdims=True)
    prior = SHRINK * (later.sum(0) + 0.05) / (later.sum() + 0.05 * n_classes)
    tells = np.log((later + prior) / (later @ onward + prior)).astype(np.float32)
    weighted = tells * np.sqrt(freq).astype(np.float32)[:, None]
    main = np.linalg.svd((weighted.T @ weighted).astype(np.float64))[0][:, :DIM].astype(np.float32)
    much = np.maximum((later * tells).sum(1) / np.maximum(later.sum(1), 1), 1e-4)
    own = np.clip(KEY_POWER * np.log(much / np.average(much, weights=freq)), -6, 6)
    # What a class tells on the next, given the last one.
    three = total[2 * size * n_classes :].reshape((n_classes,) * 3)
    alone = three.sum(1) + 0.05
    alone /= alone.sum(1, keepdims=True)
    given = (three + PAIR_SHRINK * alone[:, None]) / (three.sum(2, keepdims=True) + PAIR_SHRINK)
    gain = np.log((given * np.log(given / alone[:, None])).sum(2) + 1e-3)
    seen = three.sum(2) + 1
    u, s, v = np.linalg.svd(np.clip(PAIR_POWER * (gain - (gain * seen).sum(1, keepdims=True) / seen.sum(1, keepdims=True)), -4, 4))
    root = np.sqrt(s[:MATCH])
    query = np.concatenate((np.ones((size, 1)), (u[:, :MATCH] * root)[classes]), 1).astype(np.float32)
    key = np.concatenate((own[:, None], (v[:MATCH].T * root)[classes]), 1).astype(np.float32)
    lag = np.zeros(2 * CONTEXT, np.float32)
    lag[0] = -3  # the table knows the last subword
    value, out = tells @ main, GAIN * main.T
    # Exponentials are taken as they are when texts are scored: keep all of them in range.
    reach = np.linalg.norm(query, axis=1).max() * np.linalg.norm(key, axis=1).max()
    top = np.linalg.norm(value, axis=1).max() * np.linalg.norm(out, axis=0).max()
    return Attention(classes, table, query * np.float32(min(1.0, 40 / max(reach, 1e-9))), key, value, lag, out * np.float32(min(1.0, 60 / max(top, 1e-9))))


def train(ids: np.ndarray, docs: np.ndarray, sub_starts: np.ndarray, size: int, seed: int = 5) -> Attention:
    """What fit() does over a corpus, in one place.  ids: subwords, an end before, between and behind texts; docs: the text that each belongs to or begins."""
    rng, freq, near = np.random.default_rng(seed), np.bincount(ids, minlength=size), np.zeros(size * 2 * NEIGHBOURS, np.int64)
    company(ids, docs, frequent_columns(freq), near)
    classes = classes_of(features_of(freq, near, rng), freq, sub_starts, rng)
    n_classes = START_CLASSES + INNER_CLASSES + 1
    total = np.zeros(2 * size * n_classes + n_classes**3, np.int64)
    contexts(ids, docs, classes, n_classes, total)
    return attention_of(total, freq, classes, n_classes)


def class_logs(model: Attention, ids: np.ndarray, docs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each position's target class; windows never look into another text."""
    out = np.empty(len(ids), np.float32)
    causal = np.arange(2 * CONTEXT)[None, :] <= np.arange(CONTEXT, 2 * CONTEXT)[:, None]
    bias = np.where(causal, model.lag[distance()], np.float32(-1e9)).astype(np.float32)[None]
    value = np.concatenate((model.value, np.ones((len(model.value), 1), np.float32)), 1)  # the last column sums the weights
    n_classes, most = model.out.shape[1], -(-SLICE // CONTEXT)
    ones, place = np.ones(n_classes, np.float32), np.arange(SLICE)
    # Room for a slice, used again and again.
    room = {k: np.empty(shape, np.float32) for k, shape in (("query", (most * CONTEXT, model.query.shape[1])), ("key", ((most + 1) * CONTEXT, model.key.shape[1])), ("value", ((most + 1) * CONTEXT, DIM + 1)), ("s", (most, CONTEXT, 2 * CONTEXT)), ("table", (SLICE, n_classes)), ("z", (SLICE, n_classes)))}

    def overlapping(x: np.ndarray) -> np.ndarray:
        """Windows of 2 * CONTEXT rows, each CONTEXT behind the one before, without a copy."""
        return np.lib.stride_tricks.as_strided(x, (len(x) // CONTEXT - 1, 2 * CONTEXT, *x.shape[1:]), (CONTEXT * x.strides[0], *x.strides), writeable=False)

    def rows(name: str, of: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.take(of, x, axis=0, out=room[name][: len(x)], mode="clip")

    for lo in range(0, len(ids), SLICE):
        hi = min(lo + SLICE, len(ids))
        n, back = -(-(hi - lo) // CONTEXT), max(0, lo - CONTEXT)
        x, d = np.zeros((n + 1) * CONTEXT, np.intp), np.full((n + 1) * CONTEXT, -1, np.int32)
        x[CONTEXT - (lo - back) : CONTEXT + hi - lo], d[CONTEXT - (lo - back) : CONTEXT + hi - lo] = ids[back:hi], docs[back:hi]
        s = np.matmul(rows("query", model.query, x[CONTEXT:]).reshape(n, CONTEXT, -1), overlapping(rows("key", model.key, x)).transpose(0, 2, 1), out=room["s"][:n])
        s += bias
        np.exp(s, out=s)  # attention_of() has bounded the scores and the logits
        of = overlapping(d)
        torn = np.flatnonzero(of[:, 0] != of[:, -1])
        s[torn] *= of[torn][:, CONTEXT:, None] == of[torn][:, None, :]
        h = (s @ overlapping(rows("value", value, x))).reshape(-1, DIM + 1)[: hi - lo]
        z = np.matmul(h[:, :DIM] / (h[:, DIM:] + np.float32(1e-30)), model.out, out=room["z"][: hi - lo])
        z += rows("table", model.table, x[CONTEXT : CONTEXT + hi - lo])
        hit = z[place[: hi - lo], targets[lo:hi]]
        np.exp(z, out=z)
        out[lo:hi] = hit - np.log(z @ ones)
    return out


@dataclass
class Model:
    tokenizer: str
    attention: Attention
    begin: np.ndarray  # log p(subword | class) at a word's beginning
    begun: np.ndarray  # log of how many words begin with each class
    inner: np.ndarray  # log p(subword | class, class before) inside a word, by class before and subword
    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    ends: int


def output_tables(att: Attention, rows: list[tuple[int, int, int]], size: int, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows: (class before or -1, subword, count) over the corpus' words.  The tables of subwords are smoothed, so that every subword is possible."""
    n_classes = att.out.shape[1]
    begin, inner = np.full(size, 0.01), np.zeros((n_classes, size))
    for before, sub, n in rows:
        if before < 0:
            begin[sub] += n
        else:
            inner[before, sub] += n
    begin[size - 1] += ends
    total = np.bincount(att.classes, begin, minlength=n_classes)
    plain = inner.sum(0) + 0.01
    plain /= np.bincount(att.classes, plain, minlength=n_classes)[att.classes]
    logs = np.empty((n_classes, size), np.float32)
    for c in range(n_classes):
        total_c = np.bincount(att.classes, inner[c], minlength=n_classes)
        logs[c] = np.log((inner[c] + 10 * plain) / (total_c[att.classes] + 10))
    with np.errstate(divide="ignore"):
        return np.log(begin / total[att.classes]).astype(np.float32), np.log(total), logs


# ---------------------------------------------------------------- Spark


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all rows; the end of each text is the empty word."""
    shared.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            texts = shared.strings(b.column(0))
            for t in texts:
                seen.update(words_of(t))
            seen[b""] += len(texts)
            if len(seen) >= FLUSH_WORDS:
                yield flush()
        if seen:
            yield flush()

    return counted(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n bigint"))


def counted(parts: DataFrame) -> DataFrame:
    return parts.where("word is not null").groupBy("word").agg(F.sum("n").alias("c"))


def streams(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Rows of two kinds: (ids) subwords of some whole texts with an end before, between and behind them; (word, n) as word_counts() adds them up."""
    shared.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(tokenizer)
        sub.clear()
        used = np.zeros(0, np.int64)

        def words() -> pa.RecordBatch:
            met = pa.array(used > 0)
            word, n = pa.array(list(sub.index), pa.binary()).cast(pa.string()).filter(met), pa.array(used).filter(met)
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.binary()), word, n], ["ids", "word", "n"])

        for b in batches:
            texts = shared.strings(b.column(0))
            for lo in range(0, len(texts), TEXTS):
                flat = [b""]  # stands for the end
                for t in texts[lo : lo + TEXTS]:
                    flat += words_of(t)
                    flat.append(b"")
                which, lost, new = sub.find(flat)
                if not sub.index or len(sub.index) + len(new) > FLUSH_WORDS:
                    if sub.index:
                        yield words()
                    sub.clear()
                    sub.index[b""] = 0
                    sub.flat, sub.len, sub.at = np.full(1, sub.end, np.int32), np.ones(1, np.int64), np.zeros(1, np.int64)
                    used = np.zeros(1, np.int64)
                    which, lost, new = sub.find(flat)
                if new:
                    sub.learn(new)
                    used = np.concatenate((used, np.zeros(len(new), np.int64)))
                    which[lost] = [sub.index[flat[i]] for i in lost.tolist()]
                used += np.bincount(which, minlength=len(used))
                used[0] -= 1
                ids = sub.flat[spread(sub.at[which], sub.len[which])].astype(stored(sub.size))
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], ["ids", "word", "n"])
        if sub.index:
            yield words()
        sub.clear()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "ids binary, word string, n bigint")


def stored(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def summed(stream: DataFrame, size: int, tokenizer: str, f: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """What f(ids, texts, total) adds to `size` counts, over all ids of streams().

    Each task adds up on its own; its counts are sent in pieces, which are added where they meet: what is sent depends on cores and size."""
    codec = "zstd"

    def packed(p: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([pa.compress(total.tobytes(), codec, asbytes=True)], pa.binary())], ["piece", "counts"])

    def unpacked(p: int, counts: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(counts, 8 * (min(size, (p + 1) * PIECE) - p * PIECE), codec), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, total, some = subwords(tokenizer), np.zeros(size, np.int64), False
        for b in batches:
            for x in b.column(0):
                ids, some = np.frombuffer(x.as_buffer(), stored(sub.size)).astype(np.int32), True
                f(ids, np.cumsum(ids == sub.end, dtype=np.int32), total)
        for p in range(-(-size // PIECE) if some else 0):
            yield packed(p, total[p * PIECE : (p + 1) * PIECE])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[p] = sums[p] + unpacked(p, counts) if p in sums else unpacked(p, counts)
        for p, total in sums.items():
            yield packed(p, total)

    ids = stream.where("ids is not null").select("ids")
    cores, parts = ids.sparkSession.sparkContext.defaultParallelism, ids._jdf.rdd().getNumPartitions()
    made = ids.coalesce(max(cores, parts // 4)).mapInArrow(count, "piece bigint, counts binary").repartition(min(cores, -(-size // PIECE)), "piece")
    total = np.zeros(size, np.int64)
    for p, counts in zip(*(c.to_pylist() for c in made.mapInArrow(add, "piece bigint, counts binary").toArrow().columns), strict=True):
        total[p * PIECE : (p + 1) * PIECE] = unpacked(p, counts)
    return total


def sample_buckets(rows: DataFrame, n_docs: int, tokenizer: str) -> DataFrame:
    """(bucket, texts): a share of the rows (id, text), by default all, as subword ids, dealt out by a hash; the same whatever the partitions.  fit() takes nothing from it."""
    share, unit = max(SAMPLE, min(1.0, SAMPLE_DOCS / max(1, n_docs))), 1 << 40
    n = max(1, -(-int(share * n_docs) // BUCKET_DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(tokenizer)
        for b in batches:
            made = [np.concatenate(([sub.end], sub.split(words_of(t))[0], [sub.end])).astype("<i4").tobytes() for t in shared.strings(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["bucket", "id", "ids"])

    h = F.xxhash64("id", "text")
    picked = rows.where(F.pmod(h, F.lit(unit)) < int(unit * share)).select(F.pmod(F.xxhash64(h), F.lit(n)).alias("bucket"), "id", "text")
    made = picked.mapInArrow(run, "bucket bigint, id bigint, ids binary")
    return shared.cut(made.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("id", "ids"))).alias("texts")).select("bucket", F.col("texts.ids").alias("texts")), "lm-sample")


def following(rows: DataFrame, classes: np.ndarray, n_classes: int, tokenizer: str) -> np.ndarray:
    """(subword, class): how often each class follows each subword, over all rows (text)."""
    stream, size = shared.cut(streams(rows, tokenizer), "lm-stream"), len(classes) * n_classes
    total = summed(stream, 2 * size + n_classes**3, tokenizer, lambda ids, docs, total: contexts(ids, docs, classes, n_classes, total))
    shared.drop_cut(stream)
    return total[:size].reshape(len(classes), n_classes)


def learn_attention(stream: DataFrame, tokenizer: str, seed: int = 5) -> Attention:
    """stream: streams() of all training documents, written down."""
    sub, rng = subwords(tokenizer), np.random.default_rng(seed)
    size, n_classes = sub.size, START_CLASSES + INNER_CLASSES + 1

    def frequency(ids: np.ndarray, docs: np.ndarray, total: np.ndarray) -> None:
        total += np.bincount(ids, minlength=size)

    freq = summed(stream, size, tokenizer, frequency)
    if not freq.any():
        freq[sub.end] = 1
    col = frequent_columns(freq)
    near = summed(stream, size * 2 * NEIGHBOURS, tokenizer, lambda ids, docs, total: company(ids, docs, col, total))
    classes = classes_of(features_of(freq, near, rng), freq, sub.starts, rng)
    del near
    total = summed(stream, 2 * size * n_classes + n_classes**3, tokenizer, lambda ids, docs, total: contexts(ids, docs, classes, n_classes, total))
    return attention_of(total, freq, classes, n_classes)


def fit(docs: DataFrame, counts: DataFrame, tokenizer: str, text_col: str = "text", stream: DataFrame | None = None) -> Model:
    """docs: training rows; counts: their words' counts, written down; stream: their streams(), written down, if that was done."""
    sub = subwords(tokenizer)
    stats = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == "", F.col("c"))).alias("ends")).collect()[0]
    n_docs = int(stats["ends"] or 0)
    own = stream if stream is not None else shared.cut(streams(docs, tokenizer, text_col), "lm-stream")
    att = learn_attention(own, tokenizer)
    if stream is None:
        shared.drop_cut(own)
    classes = att.classes

    def subword_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, sums = subwords(tokenizer), Counter()
        for b in batches:
            ids, lens = mine.split(b.column(0).cast(pa.binary()).to_pylist())
            first = np.zeros(len(ids), bool)
            first[np.cumsum(lens) - lens] = True
            before = np.where(first, -1, np.concatenate(([0], classes[ids[:-1]]))) + 1
            key, at = np.unique(before.astype(np.int64) << 32 | ids, return_inverse=True)
            n = np.bincount(at, np.repeat(b.column(1).to_numpy(), lens))
            sums.update(dict(zip(key.tolist(), n.astype(np.int64).tolist(), strict=True)))
        keys = np.array(list(sums), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((keys >> 32) - 1), pa.array(keys & 0xFFFFFFFF), pa.array(list(sums.values()), pa.int64())], ["before", "sub", "n"])

    found = counts.where("word <> ''").mapInArrow(subword_counts, "before bigint, sub bigint, n bigint").groupBy("before", "sub").agg(F.sum("n").alias("n")).toArrow()  # classes * vocabulary rows at most
    begin, begun, inner = output_tables(att, list(zip(*(c.to_pylist() for c in found.columns), strict=True)), sub.size, n_docs)
    # The most common words: the count that at most FREQUENT words reach, from a histogram of eighths of powers of two.
    step = F.floor(F.log2("c") * 8)
    least, many = None, 0
    for r in counts.where("word <> ''").groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        many += r["n"]
        if many > FREQUENT:
            break
        least = r["step"]
    top = counts.where("word <> ''").where(step >= (least if least is not None else 1 << 30)).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return Model(tokenizer, att, begin, begun, inner, top.column("word").cast(pa.binary()).to_pylist(), top.column("c").to_numpy(), int(stats["n"] or 0), int(stats["v"]), n_docs)


class Scorer:
    """Scores batches of texts; holds the cache of words."""

    def __init__(self, model: Model):
        self.model, self.sub = model, subwords(model.tokenizer)
        self.known = len(model.words)
        self.unit = -np.log10(model.n + model.v + 1)
        self.sub.clear()
        self.sub.learn(model.words)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """For each text: tokens, known ones and base score of frequent words and the end, score, and all other words.

        The score takes other words as unseen.  A word's probability is linear in its count c, p(c) = p(0) * (1 + gain * c),
        so each of them comes with its gain, and log(1 + gain * c) is what its count adds to the score."""
        m, sub = self.model, self.sub
        split = [words_of(t) for t in texts]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        flat = list(chain.from_iterable(split))
        which, lost, new = sub.find(flat)
        if len(sub.index) + len(new) > CACHE_WORDS:
            sub.clear()
            sub.learn(m.words)
            which, lost, new = sub.find(flat)
        if new:
            sub.learn(new)
            which[lost] = [sub.index[flat[i]] for i in lost.tolist()]
        owner = np.repeat(np.arange(len(texts)), lens)
        frequent = which < self.known
        c = np.zeros(len(which))
        c[frequent] = m.counts[which[frequent]]
        base = np.bincount(owner[frequent], np.log10(c[frequent] + 1), minlength=len(texts)) + np.log10(m.ends + 1) + self.unit * (lens + 1)
        known = np.bincount(owner[frequent], minlength=len(texts)) + (m.ends > 0)
        # The stream: the end, then a text's subwords, then the end again, for each text.
        size = sub.len[which]
        per_text = np.bincount(owner, size, minlength=len(texts)).astype(np.int64)
        first = np.cumsum(per_text + 2) - (per_text + 2)
        ids = np.full(int((per_text + 2).sum()), sub.end, np.int32)
        docs = np.repeat(np.arange(len(texts), dtype=np.int32), per_text + 2)
        body = np.ones(len(ids), bool)
        body[first] = body[first + per_text + 1] = False
        ids[body] = sub.flat[spread(sub.at[which], size)]
        cls = m.attention.classes[ids]
        logs = class_logs(m.attention, ids[:-1], docs[:-1], cls[1:]).astype(np.float64) if len(ids) else np.empty(0)
        begins = np.zeros(len(ids), bool)
        word_at = np.flatnonzero(body)[np.cumsum(size) - size] if len(which) else np.empty(0, np.int64)
        begins[word_at] = True
        begins[~body] = True
        nxt = ids[1:]
        class_log = logs.copy()
        at = np.flatnonzero(begins[1:])
        logs[at] += m.begin[nxt[at]]
        at = np.flatnonzero(~begins[1:])
        logs[at] += m.inner[cls[at], nxt[at]]
        run = np.concatenate(([0.0], np.cumsum(logs)))
        of_words = run[word_at + size - 1] - run[word_at - 1]
        # How often each word stands before in its text: by text, word and place.
        place = np.arange(len(which))
        order = np.sort(owner << 55 | which << 28 | place)
        group = order >> 28
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(order) else place
        before = np.empty(len(which), np.int64)
        before[order & (1 << 28) - 1] = place - np.repeat(begin, np.diff(np.append(begin, len(order))))
        # The share of all words keeps the sum far from nought, however small the others are.
        by_parts = MIX[0] * np.exp(of_words) + MIX[3] * before / (place - np.repeat(np.cumsum(lens) - lens, lens) + 1)
        first_class = np.exp(class_log[word_at - 1] - m.begun[cls[word_at]])
        of_words = np.log(by_parts + MIX[1] * c * first_class + MIX[2] * (c + 1) * 10.0**self.unit)
        end_log = logs[first + per_text]
        score = (np.bincount(owner, of_words, minlength=len(texts)) + end_log) / np.log(10)
        other = np.flatnonzero(~frequent)
        unseen = MIX[2] * 10.0**self.unit
        gain = (MIX[1] * first_class[other] + unseen) / (by_parts[other] + unseen)
        items = pa.StructArray.from_arrays([pa.array([flat[i] for i in other.tolist()], pa.binary()).cast(pa.string()), pa.array(gain, pa.float64())], ["word", "gain"])
        upto = np.concatenate(([0], np.cumsum(np.bincount(owner[other], minlength=len(texts)))))
        return lens + 1, known, base, score, pa.ListArray.from_arrays(pa.array(upto, pa.int32()), items)


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    A null or empty text is only its end.  Repeated rows give repeated rows, null ids stay null, other
    columns are ignored.  With nothing to learn from, every word is unknown."""
    shared.tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FREQUENT words and tables of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        partition, row = TaskContext.get().partitionId(), 0
        for b in batches:
            texts, ids = shared.strings(b.column(1)), b.column(0)
            for lo in range(0, len(texts), TEXTS):
                part = texts[lo : lo + TEXTS]
                tokens, known, base, value, rest = scorer.score(part)
                rows = np.arange(row, row + len(part), dtype=np.int64) + (partition << 33)
                row += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(rows), ids.slice(lo, TEXTS), pa.array(tokens), pa.array(known, pa.int64()), pa.array(base), pa.array(value), rest], ["row", "id", "n_tokens", "known", "base", "score", "rest"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = shared.cut(rows.mapInArrow(run, "row bigint, id bigint, n_tokens bigint, known bigint, base double, score double, rest array<struct<word: string, gain: double>>"), "lm-scored")
    rare = scored.select("row", F.inline("rest")).join(counts, "word").groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("c") + 1)).alias("b"), F.sum(F.log1p(F.col("gain") * F.col("c"))).alias("s"))
    out = scored.join(rare, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(model.n).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0)) / math.log(10)).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: scores of all whole documents, learned from six of seven folds."""
    import public_tokenizers

    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    learnable = docs.where(shared.remainder("doc_id", 7) != 2)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    stream = shared.cut(streams(learnable, tokenizer), "lm-stream")
    counts = shared.cut(counted(stream), "lm-words")
    model = fit(learnable, counts, tokenizer, stream=stream)
    shared.drop_cut(stream)
    out = score(docs, model, counts)
    return out.select("doc_id", (shared.remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
