"""Packing documents into fixed windows by lexical retrieval.

Documents are tokenised once.  Document frequencies and the mean length are
counted over all documents; terms are token ids, so these statistics are bounded by the
vocabulary.  Related documents are brought together first: a document's weightiest terms (BM25) that
at least SHARD_DOCS, a few dozen and two documents hold are the key by which documents are dealt out and
sorted, so texts on one subject, and copies most of all, lie side by side.  The corpus is then packed in
shards of SHARD_DOCS such neighbours (fewer where they are long), each with an inverted
index of BM25 weights: the longest unused rest seeds a window, the index returns its unused
neighbours, best first, and they fill the window; the last one is cut and its rest stays unused.

Every window is full: what is left at the end of a shard seeds the next shard's first window, and
at the end of a partition it is cut into sequences whose lengths are powers of two, which need no
padding.  Tokens are written once and shuffled once; a shard is a bounded part of one partition.
A term that very many documents hold is salted by the finer terms, and where these are as frequent (copies
beyond COPIES shards) by the id, from document frequencies alone, so no key gathers a large group.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared
from basalt.llm.subword import spread

WINDOW = 1024
END = 0
SHARD_DOCS = 512
SHARD_TOKENS = 2_000_000
#: How many documents hold the second term of a key at least.
FINE_DOCS = 32
#: Shards' worth of documents that may hold all terms of a key before their ids deal them out.
COPIES = 4
K1, B = 1.2, 0.75


# Fixed value: how the byte-level vocabulary's published pre-tokeniser splits a text.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """Which byte a character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Words:
    """Texts to the ids of a `tokenizers` file.

    Where the file is a byte-level BPE whose merges are in the order of its ids, the ids come from
    tiktoken's faster merge loop over the same vocabulary; any other file is read by tokenizers itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre, model = config.get("pre_tokenizer") or {}, config["model"]
        self.fast = None
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not config.get("normalizer") and not config.get("truncation")
        vocab = model.get("vocab", {})
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", [])]
        if plain and model.get("type") == "BPE" and merged == list(range(256, 256 + len(merged))):
            import tiktoken

            of, special = byte_of_char(), {t["content"]: t["id"] for t in config.get("added_tokens", [])}
            ranks = {bytes(of[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is not None:
            return [self.fast.encode_to_numpy(t, allowed_special="all", disallowed_special=()) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


def tokenize(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each row's token ids and END behind them, as little-endian unsigned 32-bit integers in a binary.

    A null or empty text has only END."""
    shared.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        for b in batches:
            raw = [np.append(x, END).astype("<u4").tobytes() for x in words.encode(shared.strings(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id bigint, ids binary")


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (term, document) pairs of the token arrays, and how often each occurs."""
    owner = np.repeat(np.arange(len(docs), dtype=np.int64), [len(d) for d in docs])
    key = np.sort(np.concatenate(docs).astype(np.int64) << 24 | owner)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first] >> 24, key[first] & 0xFFFFFF, np.diff(np.append(first, len(key)))


def statistics(tokens: DataFrame) -> tuple[int, float, np.ndarray]:
    """Over all documents: how many, their mean length, and in how many each token id occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        n = total = 0
        for b in batches:
            docs = [np.frombuffer(x, "<u4") for x in b.column(0).to_pylist()]
            if docs:
                terms, _, _ = term_counts(docs)
                part = np.bincount(terms)
                if len(part) > len(df):
                    df = np.concatenate((df, np.zeros(len(part) - len(df), np.int64)))
                df[: len(part)] += part
                n, total = n + len(docs), total + sum(map(len, docs))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], some))), pa.array(np.concatenate(([n, total], df[some])))], ["term", "n"])

    got = {r["term"]: r["n"] for r in tokens.select("ids").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the vocabulary's size at most
    n, total = got.pop(-2, 0) or 0, got.pop(-1, 0) or 0
    df = np.zeros(max(got, default=0) + 1, np.int64)
    for t, c in got.items():
        df[t] = c
    return n, total / max(1, n), df


def keyed(tokens: DataFrame, n: int, mean: float, df: np.ndarray, shard: int = SHARD_DOCS) -> DataFrame:
    """tokens with (k1, salt, k2, k3): the weightiest terms that a shard's number, FINE_DOCS and two documents at least hold, -1 if there is none."""
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            docs = [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
            term, doc, tf = term_counts(docs)
            length = np.array([len(d) for d in docs], float)[doc]
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            order = np.argsort(doc, kind="stable")
            term, doc, weight = term[order], doc[order], weight[order]
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))  # every document has its end
            keys = []
            for least in (shard, min(shard, FINE_DOCS), 2):
                mine = np.where(df[term] >= least, weight, -1.0)
                top = np.maximum.reduceat(mine, first)
                at = np.flatnonzero(mine == top[doc])
                at = at[np.concatenate(([True], doc[at][1:] != doc[at][:-1]))]
                keys.append(np.where(top >= 0, term[at], -1))
            held = lambda key: np.where(key >= 0, df[key], n)
            own = np.array([int(x) if x is not None else -1 for x in b.column(0).to_pylist()], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            fine = (keys[1] * 1_000_003 + keys[2]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            salts = np.maximum(1, held(keys[0]) // shard).astype(np.uint64)
            copies = np.maximum(1, np.minimum(held(keys[1]), held(keys[2])) // (COPIES * shard)).astype(np.uint64)
            salt = (fine + own % copies) % salts
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys[0]), pa.array(salt.astype(np.int64)), pa.array(keys[1]), pa.array(keys[2])], ["id", "ids", "k1", "salt", "k2", "k3"])

    return tokens.mapInArrow(run, "id bigint, ids binary, k1 bigint, salt bigint, k2 bigint, k3 bigint")


class Shard:
    """Inverted index of BM25 weights over the shard's whole documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        term, self.doc, tf = term_counts(docs)
        length = np.array([len(d) for d in docs], float)[self.doc]
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))).astype(np.float32)
        self.terms, self.at = np.unique(term, return_index=True)
        self.stop = np.append(self.at[1:], len(term))
        order = np.argsort(self.doc, kind="stable")
        place = np.searchsorted(self.terms, term)[order]
        self.of = np.split(place, np.cumsum(np.bincount(self.doc, minlength=len(docs)))[:-1])
        self.size = len(docs)

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents of the shard, best first (ties: in order)."""
        t = self.of[seed]
        at = spread(self.at[t], self.stop[t] - self.at[t])
        return np.argsort(-np.bincount(self.doc[at], self.weight[at], minlength=self.size), kind="stable")


def fill(ids: list, docs: list[np.ndarray], left: list, idf: np.ndarray, mean: float, window: int) -> tuple[list, list]:
    """Pack a shard.  left: pieces (document's key, start, tokens, document's length) of the window still open.
    Full windows as lists of pieces, and the open window's pieces."""
    done, start = [], [0] * len(docs)
    for k, d in enumerate(docs):
        while len(d) - start[k] >= window:
            done.append([(ids[k], start[k], d[start[k] : start[k] + window], len(d))])
            start[k] += window
    shard = Shard(docs, idf, mean)
    order = sorted((k for k in range(len(docs)) if start[k] < len(docs[k])), key=lambda k: (start[k] - len(docs[k]), k))
    room = window - sum(len(p[2]) for p in left)
    for seed in order:
        while start[seed] < len(docs[seed]):
            for k in (seed, *shard.neighbours(seed).tolist()):
                rest = len(docs[k]) - start[k]
                if rest <= 0:
                    continue
                take = min(rest, room)
                left = [*left, (ids[k], start[k], docs[k][start[k] : start[k] + take], len(docs[k]))]
                start[k] += take
                room -= take
                if not room:
                    done.append(left)
                    left, room = [], window
                    break
    return done, left


def halves(left: list) -> list[list]:
    """The open window as sequences whose lengths are powers of two, longest first."""
    total, out = sum(len(p[2]) for p in left), []
    while total:
        room = size = 1 << (total.bit_length() - 1)
        seq = []
        while room:
            key, at, tokens, n = left[0]
            seq.append((key, at, tokens[:room], n))
            if len(tokens) > room:
                left = [(key, at + room, tokens[room:], n), *left[1:]]
                room = 0
            else:
                room -= len(tokens)
                left = left[1:]
        out.append(seq)
        total -= size
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD_DOCS) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece of a document.

    Each token lies in exactly one piece; offsets in a sequence run on from 0.  window must be a power
    of two.  Repeated rows are packed as documents of their own; a null text is only END; null ids
    stay null; other columns are ignored; an empty table gives no rows."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    tokens = shared.cut(tokenize(docs, tokenizer, id_col, text_col), "pack-tokens")
    n, mean, df = statistics(tokens)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made, left = TaskContext.get().partitionId(), 0, []
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def batch(sequences: list[list]) -> pa.RecordBatch:
            nonlocal made
            cols: list[list] = [[] for _ in range(7)]
            for seq in sequences:
                offset = 0
                for key, start, ids, total in seq:
                    for c, x in zip(cols, (key, start, len(ids), ids.tobytes(), total, partition << 36 | made, offset), strict=True):
                        c.append(x)
                    offset += len(ids)
                made += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(key)
                held.append(np.frombuffer(raw, "<u4"))
                size += len(held[-1])
                if len(held) >= shard or size > SHARD_TOKENS:
                    done, left = fill(keys, held, left, idf, mean, window)
                    yield batch(done)
                    keys, held, size = [], [], 0
        if held:
            done, left = fill(keys, held, left, idf, mean, window)
            yield batch(done)
        if left:
            yield batch(halves(left))

    dealt = keyed(tokens, n, mean, df, shard).repartition("k1", "salt").sortWithinPartitions("k1", "salt", "k2", "k3", "id", F.crc32("ids")).select("id", "ids")
    out = dealt.mapInArrow(run, "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents in windows of 1024 tokens."""
    import public_tokenizers

    packed = pack(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
