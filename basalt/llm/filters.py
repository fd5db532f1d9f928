"""How filters of a corpus act together: what each removes, in every order they could be applied in.

Texts are scanned as they lie in Arrow's buffers.  A table of byte classes turns a batch's bytes into flags, prefix sums of the
flags give the words, capitals, code points and symbols of each text.  Words are hashed by prefix sums too (a sum of byte
values times powers of an odd number); a text's word hashes are sorted, equal neighbours are compared byte by byte, and where
two unequal words share a hash that text's words are counted as strings.  So counts are exact.

A text then is a *mask*, one bit for each filter that it fails.  What any order of filters keeps, removes and removes twice
follows from how many documents of a part have which mask, so rows are counted by (part, mask, labels) before anything is
shuffled, and the 120 orders are worked out over 32 numbers for each part.

Memory: a Python worker holds one Arrow batch and the arrays of PIECE bytes; of a longer text, it also holds the distinct words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Percent of the words that must be distinct, and of the characters that may be capitals.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
SYMBOLS = b"#$%&*|"
PIECE = 1 << 20
SPACE, CAPITAL, SYMBOL, LEAD = 1, 2, 4, 8
ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_classes() -> np.ndarray:
    """Flags of each byte value; LEAD: it begins a code point."""
    of = np.zeros(256, np.uint8)
    of[[0x20, *range(0x09, 0x0E)]] |= SPACE
    of[ord("A") : ord("Z") + 1] |= CAPITAL
    of[list(SYMBOLS)] |= SYMBOL
    of[[b for b in range(256) if b & 0xC0 != 0x80]] |= LEAD
    return of


CLASSES = byte_classes()
#: Values of bytes in the sums that hash words: any fixed random numbers.
VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def odd_inverse(x: np.uint64) -> np.uint64:
    """The inverse of an odd number modulo 2**64."""
    return np.uint64(pow(int(x), -1, 1 << 64))


POWERS = np.cumprod(np.concatenate(([np.uint64(1)], np.full(PIECE, ODD))), dtype=np.uint64)
INVERSE = np.cumprod(np.concatenate(([np.uint64(1)], np.full(PIECE, odd_inverse(ODD)))), dtype=np.uint64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the places where its texts begin and end; nulls are empty."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most PIECE bytes that cover the texts and cut no word; only a longer word makes a longer one."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + PIECE, end)
        if stop < end:
            k = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[k] > at:
                stop = int(offsets[k])
            else:
                spaces = np.flatnonzero(CLASSES[data[at:stop]] & SPACE)[-1:]
                while not len(spaces) and offsets[k + 1] > stop:  # one long word, up to its end
                    more = min(stop + PIECE, int(offsets[k + 1]))
                    spaces = np.flatnonzero(CLASSES[data[stop:more]] & SPACE)[:1] + (stop - at)
                    stop = more
                stop = at + int(spaces[0]) + 1 if len(spaces) else stop
        yield at, stop
        at = stop


def word_hashes(data: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Hashes of the words data[at:to] of one piece; words longer than PIECE are hashed by a digest."""
    out = np.zeros(len(at), np.uint64)
    for k in np.flatnonzero(to - at > PIECE):
        out[k] = int.from_bytes(hashlib.sha256(data[at[k] : to[k]]).digest()[:8], "little")
    short = np.flatnonzero(to - at <= PIECE)
    if not len(short):
        return out
    lo, hi = at[short], to[short]
    base, n = int(lo[0]), int(hi[-1] - lo[0])
    sums = np.concatenate(([np.uint64(0)], np.cumsum(VALUES[data[base : base + n]] * POWERS[:n], dtype=np.uint64)))
    h = (sums[hi - base] - sums[lo - base]) * INVERSE[lo - base]
    h ^= h >> np.uint64(31)
    out[short] = (h + (hi - lo).astype(np.uint64)) * ODD
    return out


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] equals data[b:b+n], for each pair of places."""
    if not len(a):
        return np.empty(0, bool)
    ends = np.cumsum(n)
    step = np.arange(ends[-1]) - np.repeat(ends - n, n)
    differs = data[np.repeat(a, n) + step] != data[np.repeat(b, n) + step]
    return np.add.reduceat(differs, ends - n) == 0


class Words:
    """Distinct words of the texts of a batch: hashes, sorted by text, verified."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.counts, self.words = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
        self.clashed: set[int] = set()
        self.open: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # distinct words of the text that goes on in the next piece
        self.text = -1

    def distinct(self, doc: np.ndarray, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first of each run of equal words, as places in a sort by text and hash; unequal ones of one hash mark the text as clashed."""
        order = np.lexsort((h, doc))
        doc, h, at, n = doc[order], h[order], at[order], n[order]
        same = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
        good = n[same] == n[same + 1]
        good[good] = equal_bytes(self.data, at[same[good]], at[same[good] + 1], n[same[good]])
        self.clashed.update(doc[same[~good]].tolist())
        first = np.ones(len(doc), bool)
        first[same + 1] = False
        return order[first]

    def close(self) -> None:
        """Count the text that ran over several pieces."""
        if self.open:
            h, at, n = (np.concatenate(x) for x in zip(*self.open, strict=True))
            self.counts[self.text] = len(self.distinct(np.zeros(len(h), np.int64) + self.text, h, at, n))
        self.open, self.text = [], -1

    def add(self, at: np.ndarray, to: np.ndarray, stop: int) -> None:
        """Words of the next piece, which ends at stop."""
        if not len(at):
            return
        doc = np.searchsorted(self.offsets, at, "right") - 1
        self.words += np.bincount(doc, minlength=len(self.words))
        h, n = word_hashes(self.data, at, to), to - at
        if doc[0] != self.text:
            self.close()
        some = self.distinct(doc, h, at, n)
        if self.offsets[doc[-1] + 1] > stop:  # such a piece lies within one text
            self.text = int(doc[-1])
        if self.text >= 0:
            part = some[doc[some] == self.text]
            self.open.append((h[part], at[part], n[part]))
        self.counts += np.bincount(doc[some[doc[some] != self.text]], minlength=len(self.counts))

    def result(self) -> np.ndarray:
        self.close()
        for d in self.clashed:
            text = self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()
            self.counts[d] = len(set(text.split()))  # bytes.split() cuts at the same six bytes
        return self.counts


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """words, distinct, capitals, chars and symbols of each text of an Arrow column."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    out = {k: np.zeros(n, np.int64) for k in ("capitals", "chars", "symbols")}
    words = Words(data, offsets)
    for lo, hi in pieces(data, offsets):
        of = CLASSES[data[lo:hi]]
        first = int(np.searchsorted(offsets, lo, "right")) - 1
        last = int(np.searchsorted(offsets, hi, "left"))
        cuts = np.clip(offsets[first : last + 1], lo, hi) - lo
        for name, flag in (("capitals", CAPITAL), ("chars", LEAD), ("symbols", SYMBOL)):
            sums = np.concatenate(([0], np.cumsum((of & flag) != 0)))
            out[name][first:last] += np.diff(sums[cuts])
        inside = (of & SPACE) == 0
        edge = np.zeros(len(of) + 1, bool)  # a text begins here
        edge[cuts] = True
        starts = inside & np.concatenate(([True], ~inside[:-1] | edge[1:-1]))
        ends = inside & np.concatenate((~inside[1:] | edge[1:-1], [True]))
        words.add(np.flatnonzero(starts) + lo, np.flatnonzero(ends) + lo + 1, hi)
    return out | {"distinct": words.result(), "words": words.words}


def masks(m: dict[str, np.ndarray]) -> np.ndarray:
    """Bits 0 to 3: fails A, B, C, D."""
    a = m["words"] < LEAST_WORDS
    b = 100 * m["distinct"] < LEAST_DISTINCT * m["words"]
    c = 100 * m["capitals"] > MOST_CAPITALS * m["chars"]
    return a | b << 1 | c << 2 | (m["symbols"] > 0).astype(np.int64) << 3


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, digest) for each row: bits of the filters that the text alone decides, and its SHA-256."""
    shared.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column(2))
            digests = [hashlib.sha256(data[lo:hi]).digest() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks(measure(b.column(2))), pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), part.alias("part"), shared.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, part string, mask int, digest binary")


def with_copies(scanned: DataFrame) -> DataFrame:
    """scanned with bit 4 where a row of a smaller id has the same text.

    The first of each text (a sum with map-side combining, so copies cost nothing) is looked up by id and digest together: that key is as
    spread as the ids are, however many copies there are.  A null id is smaller than nothing, and nothing is smaller than it."""
    first = scanned.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    found = scanned.join(first, ["id", "digest"], "left")
    return found.withColumn("mask", F.when(F.col("id").isNull() | F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(16)))).drop("first", "digest")


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with good and toxic (0 or 1): whether some label of the id says so."""
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    return rows.join(known, "id", "left").fillna(0, ["good", "toxic"])


ORDERS = ["".join(p) for p in permutations(FILTERS)]


def step_masks() -> dict[str, np.ndarray]:
    """For each order and step (600 rows) and each of the 32 masks: does the step keep, remove or find removed a document with that mask?"""
    mask = np.arange(1 << len(FILTERS))
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    failing = np.array([bin(m).count("1") for m in mask])
    for order in ORDERS:
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails, gone = mask & bit != 0, mask & before != 0
            out["kept"].append(~fails & ~gone)
            out["removed"].append(fails & ~gone)
            out["redundant"].append(fails & gone)
            out["unique_fails"].append(mask == bit)
            # A filter comes before all others that a document fails in one of so many orders.
            out["shapley"].append(np.where(fails, len(ORDERS) // np.maximum(failing, 1), 0))
            before |= bit
    return {k: np.array(v, np.int64) for k, v in out.items()}


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows for each part.

    A null text is empty (it fails A), a null part is the empty one, a null id is never a copy and has no labels; repeated rows count
    each, and are no copies of one another, as their ids are equal; a label that is null or whose id is null counts for nothing; an empty table has no
    parts, so no rows.  Further columns are ignored."""
    scanned = shared.cut(scan(docs, id_col, text_col, part_col), "filter-masks")
    rows = with_labels(with_copies(scanned), labels, id_col)
    counted = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most

    def work_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, names = step_masks(), ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        orders, step = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS))
        for b in batches:
            for part, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, good, toxic = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for x in found:
                    n[x["mask"]], good[x["mask"]], toxic[x["mask"]] = x["n"], x["good"], x["toxic"]
                lost = [steps["removed"] @ good, steps["removed"] @ toxic]
                cols = [steps[k] @ n for k in ("kept", "removed", "redundant", "unique_fails")] + lost + [steps["shapley"] @ n]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(orders)), pa.array(orders.tolist()), pa.array(step, pa.int32()), *(pa.array(c, pa.int64()) for c in cols)], names)

    counts = "kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    return parts.mapInArrow(work_out, f"part string, filter_order string, step int, {counts}")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: five filters over all documents, in all 120 orders."""
    return interactions(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
f AS (SELECT doc_id, part,
  [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
   regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails FROM w),
g AS (SELECT f.*, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic FROM f
  LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY part, fails),
k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS p FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda x: chr(64 + x)), '') AS filter_order, k AS step, p[k] AS f, p[1:k - 1] AS earlier FROM o, k),
r AS (SELECT part, filter_order, step, f,
  sum(CASE WHEN NOT fails[f] AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails[f] AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails[f] AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN fails[f] AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails[f] AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone FROM c CROSS JOIN s) GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
