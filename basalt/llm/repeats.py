"""Repeated passages by longest-previous-factor arrays: later copies of long strings go, the first stays.

A byte goes if it lies in a string of LEAST bytes (a window) that also starts in a document of a smaller id.  The longest earlier
match of each window comes from a suffix order: the windows are sorted, and of each one the nearest before and behind it in that order
that belong to a smaller document (previous and next smaller) share the longest prefixes with it that any smaller document does.

One suffix order of a whole corpus fits nowhere, so windows are dealt out such that equal ones meet:

* each window has an *anchor*, the string of GRAM bytes in it whose hash is smallest.  It is a function of the window's bytes, so equal windows
  have equal anchors; windows that follow each other mostly share theirs (one anchor for some 14 bytes), and make a *run*;
* only anchors of two documents or more can hold a match.  Tasks report the hashes of their texts' anchors to buckets (four bytes each), the
  buckets answer with those that more than one document has;
* runs of such anchors go to the bucket of their anchor as short strings, and each bucket is a suffix order of its own.

What buckets answer goes back to the texts' *unit*, a part of the table of texts that was written once: a task reads its unit's file
again, so texts are never shuffled.  Exact copies of a whole text need none of this: the first stands for all.

An anchor that very many documents have (HOT) would make one bucket large: its windows are dealt out singly, by their own hashes, and equal ones
of a unit are settled there, where only the first goes on.  So a bucket gets a string once from each unit, however frequent it is.

Memory: a task holds one batch of texts, its unit's repeated anchors (eight bytes each), or one bucket's runs in slices of at most SLICE windows
(equal windows are never parted).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared

LEAST = 50
GRAM = 24
HOT = 5_000
#: Bytes of text for each bucket, and the fewest and most buckets.
BUCKET_BYTES, FEWEST, MOST = 8 << 20, 24, 50_000
CHUNK = 2 << 20
SLICE = 500_000
#: Bytes of runs that a task gathers before it deals them out.
PENDING = 24 << 20
PLACE_BITS = 22  # CHUNK and a window more must fit
EMPTY = hashlib.sha256(b"").hexdigest()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    w = data.astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes as one number
        w = w[:-step] | (w[step:] << np.uint64(8 * step))
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for at in range(0, GRAM, 8):
        h = (h ^ w[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (text, place of the first window, windows, anchor's hash); the texts lie one after another."""
    width = LEAST - GRAM + 1
    none = np.empty(0, np.int64)
    if len(data) < LEAST:
        return none, none, none, np.empty(0, np.uint64)
    h = gram_hashes(data)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost is smallest
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & mask).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(anchor)]
    inside = np.arange(len(anchor)) + LEAST <= ends[text]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(anchor)))
    keep = inside[at]
    at, n = at[keep], n[keep]
    return text[at], at, n, h[anchor[at]]


def chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in chunks of some CHUNK bytes: (data, indices of texts, places in the texts, starts, ends).  Parts of a longer text overlap by a window less one byte, so each window lies in one part."""
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def whole():
        lens = np.array([len(x[2]) for x in part])
        ends = np.cumsum(lens)
        return np.frombuffer(b"".join(x[2] for x in part), np.uint8), np.array([x[0] for x in part]), np.array([x[1] for x in part]), ends - lens, ends

    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LEAST + 1), CHUNK):
            if len(t) < LEAST:
                break
            piece = t[at : at + CHUNK + LEAST - 1] if len(t) > CHUNK else t
            if part and size + len(piece) > CHUNK:
                yield whole()
                part, size = [], 0
            part.append((k, at, piece))
            size += len(piece)
    if part:
        yield whole()


def flat(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... at + n - 1 of each range, one after another."""
    ends = np.cumsum(n)
    return np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def windows_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The LEAST bytes from each place on, as one fixed-length string each."""
    every = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - LEAST + 1), LEAST), (1, 1))
    return np.ascontiguousarray(every[at]).view(f"V{LEAST}").ravel()


def suffix_order(strings: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, equal ones by document; and the length of the prefix that each shares with the one before it."""
    order = np.argsort(doc, kind="stable")
    order = order[np.argsort(strings[order].view(f"S{LEAST}"), kind="stable")]
    s = strings[order].view(np.uint8).reshape(len(order), LEAST)
    shared_prefix = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = s[1:] != s[:-1]
        shared_prefix[1:] = np.where(differ.any(1), differ.argmax(1), LEAST)
    return order, shared_prefix


def longest_previous(doc: np.ndarray, prefix: np.ndarray, least: int) -> np.ndarray:
    """For each place of a suffix order the longest prefix shared with a smaller document; lengths below `least` may come out as 0.

    Previous smaller: a pointer to the place before, which jumps along the pointers of the places it meets while those are of no smaller document.
    Everything between a place and its pointer is of no smaller document, so a jump skips nothing; pointers double, and one whose
    shared prefix has become shorter than `least` stops, as it could only get shorter.  Next smaller: the same from the other side."""
    n = len(doc)
    best = np.zeros(n, np.int64)
    for turn in (1, -1):
        d = doc[::turn]
        to = np.arange(n) - 1
        # The prefix shared with the pointer's target: the least of the prefixes on the way.
        common = prefix.copy() if turn == 1 else np.append(prefix[1:], 0)[::-1].copy()
        if n:
            common[0] = 0
        todo = np.flatnonzero((common >= least) & (to >= 0))
        while True:
            todo = todo[(common[todo] >= least) & (to[todo] >= 0)]
            todo = todo[d[to[todo]] >= d[todo]]
            if not len(todo):
                break
            via = to[todo]
            common[todo], to[todo] = np.minimum(common[todo], common[via]), to[via]
        common[(to < 0) | (common < least)] = 0
        best = np.maximum(best, common[::turn])
    return best


def repeated(strings: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each window also stands in a smaller document."""
    out = np.zeros(len(doc), bool)
    order, prefix = suffix_order(strings, doc)
    out[order] = longest_previous(doc[order], prefix, LEAST) >= LEAST
    return out


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by bucket, and (bucket, from, to) of each in it."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
    return order, [(int(b[lo]), lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo]


def numbers(x: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(x or b"", kind)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by a key column, one group at a time."""
    held, of = [], None
    for b in batches:
        for row in b.to_pylist():
            if held and row[key] != of:
                yield of, held
                held = []
            of = row[key]
            held.append(row)
    if held:
        yield of, held


def texts_of(path: str) -> Iterator[tuple[np.ndarray, list, list[bytes]]]:
    """Rows of a unit's file in batches: their numbers in the file, ids and texts."""
    fs, name = shared.open_fs(path)
    at = 0
    with fs.open_input_file(name) as f:
        for b in pq.ParquetFile(f).iter_batches(batch_size=128, columns=["id", "text"]):
            yield np.arange(at, at + len(b)), b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()
            at += len(b)


class Unit:
    """A unit's file as the tasks read it: rows that are no copies, cut into runs."""

    def __init__(self, rows: list[dict]):
        first = rows[0]  # the head sorts before the answers
        self.path, self.copies = first["path"], set(numbers(first["a"], "<i8").tolist())

    def runs(self) -> Iterator[tuple]:
        """(data, id, row, place in the text, place in data, windows, hash) of the runs of each chunk; rows with a null id have none."""
        for row, ids, texts in texts_of(self.path):
            some = np.array([k for k in range(len(ids)) if ids[k] is not None and int(row[k]) not in self.copies], np.int64)
            id_of = np.array([ids[k] for k in some], np.int64)
            for data, text, place, starts, ends in chunks([texts[k] for k in some]):
                of, at, n, h = runs(data, starts, ends)
                yield data, id_of[text[of]], row[some[text[of]]], place[of] + at - starts[of], at, n, h


def stage(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The texts, written once, as (id, digest, n, unit, row), and the units as (unit, path, a): a holds the rows that copy a smaller document's whole text."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), shared.text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).withColumn("n", F.octet_length("text").cast("bigint"))
    texts = shared.cut(rows.select("rid", "id", "n", "digest", "text"), "repeat-texts")
    place = texts.select("id", "n", "digest", F.shiftright("rid", 33).alias("unit"), F.col("rid").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), F.col("_metadata.file_path").alias("path"))
    first = place.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = place.join(first, ["id", "digest"], "left").withColumn("copy", F.col("id").isNotNull() & F.col("first").isNull() & (F.col("n") >= LEAST))
    copies = marked.where("copy").groupBy("unit").agg(F.collect_list("row").alias("copies"))  # rows of one file at most
    units = place.groupBy("unit").agg(F.min("path").alias("path")).join(copies, "unit", "left")
    return texts, shared.cut(units.select("unit", "path", F.coalesce("copies", F.array().cast("array<bigint>")).alias("copies")), "repeat-units")


def with_heads(units: DataFrame, answers: DataFrame | None, n: int) -> DataFrame:
    """Each unit's head followed by the answers for it, in one partition, sorted."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = [np.array(x, np.int64).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([-2] * len(b), pa.int32()), b.column(1), pa.array(a, pa.binary()), pa.array([b""] * len(b), pa.binary()), pa.array([b""] * len(b), pa.binary())], ["unit", "bucket", "path", "a", "b", "c"])

    rows = units.mapInArrow(pack, "unit bigint, bucket int, path string, a binary, b binary, c binary")
    if answers is not None:
        rows = rows.unionByName(answers.withColumn("path", F.lit(None).cast("string")))
    return rows.repartition(n, "unit").sortWithinPartitions("unit", "bucket")


def report_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, unit, a, b, c): hashes of the anchors of one document of the unit; those of several, and of how many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, group in grouped(batches, "unit"):
            seen = [np.stack((h, ids.astype(np.uint64))) for _, ids, _, _, _, _, h in Unit(group).runs()]
            if not seen:
                continue
            h, doc = np.concatenate(seen, axis=1)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            other = new | np.concatenate(([True], doc[1:] != doc[:-1]))
            at = np.flatnonzero(new)
            docs_of = np.add.reduceat(other.astype(np.int64), at)
            h = h[at]
            order, cuts = by_bucket((h % np.uint64(buckets)).astype(np.int64))
            rest, docs_of = (h >> np.uint64(32)).astype("<u4")[order], docs_of[order].astype("<u4")
            for bucket, lo, hi in cuts:
                many = docs_of[lo:hi] > 1
                x, m = rest[lo:hi], docs_of[lo:hi]
                cols = [x[~many].tobytes(), x[many].tobytes(), m[many].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([unit], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], ["bucket", "unit", "a", "b", "c"])

    return rows.mapInArrow(batched(run), "bucket int, unit bigint, a binary, b binary, c binary")


def batched(run):
    """run with its small batches joined, some megabytes each."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > 4 << 20 or len(held) >= 512:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def answer_anchors(reports: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(unit, bucket, a, b, c): of the hashes that a unit reported, those of several documents (a), and of those the hot ones (b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in grouped(batches, "bucket"):
            part = [(numbers(r["a"], "<u4"), numbers(r["b"], "<u4"), numbers(r["c"], "<u4")) for r in group]
            h = np.concatenate([np.concatenate((a, b)) for a, b, _ in part])
            n = np.concatenate([np.concatenate((np.ones(len(a), np.int64), c)) for a, _, c in part])
            of = np.repeat(np.arange(len(part)), [len(a) + len(b) for a, b, _ in part])
            order = np.argsort(h, kind="stable")
            h, n, of = h[order], n[order], of[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            total = np.repeat(np.add.reduceat(n, at), np.diff(np.append(at, len(h))))
            some = total > 1
            h, of, heat = h[some], of[some], total[some] >= hot
            order, cuts = by_bucket(of)
            h, heat = h[order], heat[order]
            for k, lo, hi in cuts:
                cols = [h[lo:hi].tobytes(), h[lo:hi][heat[lo:hi]].tobytes(), b""]
                yield pa.RecordBatch.from_arrays([pa.array([group[k]["unit"]], pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], ["unit", "bucket", "a", "b", "c"])

    rows = reports.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(batched(run), "unit bigint, bucket int, a binary, b binary, c binary")


RUNS = "bucket int, unit bigint, docs binary, rows binary, places binary, counts binary, bytes binary"


def send_runs(rows: DataFrame, buckets: int) -> DataFrame:
    """The runs of repeated anchors, by bucket, in packed rows; and under bucket -1, what a unit settles by itself."""
    names = ["bucket", "unit", "docs", "rows", "places", "counts", "bytes"]

    def dealt(unit: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        """parts: (bucket, doc, row, place, windows, bytes of the runs)."""
        bucket, doc, row, place, n, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        size = n + LEAST - 1
        at = np.cumsum(size) - size
        order, cuts = by_bucket(bucket)
        for b, lo, hi in cuts:
            k = order[lo:hi]
            cols = [doc[k].astype("<i8"), row[k].astype("<i4"), place[k].astype("<i4"), n[k].astype("<i4"), data[flat(at[k], size[k])]]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([unit], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names)

    def settle(unit: int, hot: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Windows of hot anchors: equal ones of the unit meet here, the first of each goes to the bucket of its own hash."""
        windows, doc, row, place = (np.concatenate(x) for x in zip(*hot, strict=True))
        gone = repeated(windows, doc)
        if gone.any():
            cols = [doc[gone].astype("<i8"), row[gone].astype("<i4"), place[gone].astype("<i4"), np.ones(int(gone.sum()), "<i4"), np.empty(0, np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([unit], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names)
        data = windows[~gone].view(np.uint8)
        words = np.zeros((len(data) // LEAST, -(-LEAST // 8) * 8), np.uint8)
        words[:, :LEAST] = data.reshape(-1, LEAST)
        h = np.zeros(len(words), np.uint64)
        for w in words.view(np.uint64).T:
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield from dealt(unit, [((h % np.uint64(buckets)).astype(np.int64), doc[~gone], row[~gone], place[~gone], np.ones(len(h), np.int64), data)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, group in grouped(batches, "unit"):
            key = lambda r, c: numbers(r[c], "<u4").astype(np.uint64) << np.uint64(20) | np.uint64(r["bucket"])
            wanted = np.sort(np.concatenate([np.empty(0, np.uint64), *(key(r, "a") for r in group[1:])]))
            burning = np.sort(np.concatenate([np.empty(0, np.uint64), *(key(r, "b") for r in group[1:])]))
            if not len(wanted):
                continue
            parts, size, hot, hot_size = [], 0, [], 0
            for data, doc, row, place, at, n, h in Unit(group).runs():
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                x = (h >> np.uint64(32)) << np.uint64(20) | bucket.astype(np.uint64)
                k = np.flatnonzero(held(wanted, x))
                glow = held(burning, x[k])
                c, k = k[~glow], k[glow]
                parts.append((bucket[c], doc[c], row[c], place[c], n[c], data[flat(at[c], n[c] + LEAST - 1)]))
                size += len(parts[-1][-1])
                if size >= PENDING:
                    yield from dealt(unit, parts)
                    parts, size = [], 0
                if len(k):
                    step = flat(np.zeros(len(k), np.int64), n[k])
                    hot.append((windows_of(data, flat(at[k], n[k])), np.repeat(doc[k], n[k]), np.repeat(row[k], n[k]), np.repeat(place[k], n[k]) + step))
                    hot_size += len(step)
                    if hot_size >= SLICE // 2:
                        yield from settle(unit, hot)
                        hot, hot_size = [], 0
            if parts:
                yield from dealt(unit, parts)
            if hot:
                yield from settle(unit, hot)

    return rows.mapInArrow(batched(run), RUNS)


def held(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is one of the keys."""
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)] == x


def match_runs(sent: DataFrame, buckets: int) -> DataFrame:
    """(unit, bucket, a, b, c): rows, places and numbers of windows of a unit's runs that a smaller document has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in grouped(batches, "bucket"):
            count = lambda kind, c: [numbers(r[c], kind) for r in group]
            docs, rows, places, ns = (np.concatenate(x) for x in (count("<i8", "docs"), count("<i4", "rows"), count("<i4", "places"), count("<i4", "counts")))
            unit = np.repeat(np.array([r["unit"] for r in group]), [len(r["docs"]) // 8 for r in group])
            data = np.frombuffer(b"".join(r["bytes"] for r in group), np.uint8)
            size = ns.astype(np.int64) + LEAST - 1
            at = np.cumsum(size) - size
            where = flat(at, ns.astype(np.int64))
            of = np.repeat(np.arange(len(ns)), ns)
            gone = np.zeros(len(where), bool)
            for part in slices(data, where):
                gone[part] = repeated(windows_of(data, where[part]), docs[of[part]])
            k = np.flatnonzero(gone)
            if not len(k):
                continue
            # Windows that follow each other in a run are one answer.
            new = np.concatenate(([True], (of[k][1:] != of[k][:-1]) | (k[1:] != k[:-1] + 1)))
            lead, long = k[new], np.diff(np.append(np.flatnonzero(new), len(k)))
            r = of[lead]
            yield from answers(unit[r], rows[r], places[r] + (where[lead] - at[r]), long, bucket)

    rows = sent.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(batched(run), "unit bigint, bucket int, a binary, b binary, c binary")


def slices(data: np.ndarray, where: np.ndarray) -> Iterator[np.ndarray]:
    """Windows in slices that keep equal ones together, by their first bytes."""
    n = -(-len(where) // SLICE)
    if n <= 1:
        yield np.arange(len(where))
        return
    h = np.zeros(len(where), np.uint64)
    for k in range(0, LEAST, 7):
        h = (h ^ data[where + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    for k in range(n):
        yield np.flatnonzero(h % np.uint64(n) == k)


def answers(unit: np.ndarray, row: np.ndarray, place: np.ndarray, n: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
    order, cuts = by_bucket(unit)
    for u, lo, hi in cuts:
        k = order[lo:hi]
        cols = [row[k].astype("<i4"), place[k].astype("<i4"), n[k].astype("<i4")]
        yield pa.RecordBatch.from_arrays([pa.array([u], pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], ["unit", "bucket", "a", "b", "c"])


def spans(place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the bytes that windows cover, overlapping and touching ones joined."""
    if not len(place):
        return place, place
    order = np.argsort(place, kind="stable")
    lo, hi = place[order], np.maximum.accumulate(place[order] + n[order] + LEAST - 1)
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return lo[new], np.append(hi[np.flatnonzero(new)[1:] - 1], hi[-1])


def cut_out(rows: DataFrame, keep_texts: bool) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row; kept: the bytes that are left, if asked for."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in grouped(batches, "unit"):
            unit = Unit(group)
            row, place, n = (np.concatenate([np.empty(0, np.int64), *(numbers(r[c], "<i4") for r in group[1:])]).astype(np.int64) for c in "abc")
            order = np.argsort(row, kind="stable")
            row, place, n = row[order], place[order], n[order]
            for at, ids, texts in texts_of(unit.path):
                out: list[tuple] = []
                lo, hi = np.searchsorted(row, at, "left"), np.searchsorted(row, at, "right")
                for k, (i, raw) in enumerate(zip(ids, texts, strict=True)):
                    if int(at[k]) in unit.copies:
                        out.append((i, len(raw), len(raw), 1, EMPTY, b""))
                        continue
                    begin, end = spans(place[lo[k] : hi[k]], n[lo[k] : hi[k]])
                    parts = [raw[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True)]
                    left = b"".join(parts) if len(begin) else raw
                    out.append((i, len(raw), len(raw) - len(left), len(begin), hashlib.sha256(left).hexdigest(), left))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c if x != "kept" or keep_texts else [None] * len(c), t) for c, t, x in zip(cols, kinds, names, strict=True)], names)

    return rows.mapInArrow(run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, keep_texts: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs.

    Texts are UTF-8 bytes; a null text is empty, and a text of fewer than LEAST bytes loses nothing.  A null id is smaller than nothing and nothing is smaller
    than it, so such a row loses nothing and costs no other row anything; so do rows of one id among each other, repeated rows
    included.  kept may cut characters in two, as strings are judged by bytes.  An empty table gives no rows; further columns are ignored."""
    spark = docs.sparkSession
    shared.tune(spark)
    texts, units = stage(docs, id_col, text_col)
    total = texts.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    buckets = max(FEWEST, min(MOST, total["bytes"] // BUCKET_BYTES))
    # More partitions than units, so that those are spread well over tasks.
    tasks = 3 * max(units.count(), 1)
    reports = report_anchors(with_heads(units, None, tasks), buckets)
    wanted = shared.cut(answer_anchors(reports, buckets, hot), "repeat-anchors")
    sent = shared.cut(send_runs(with_heads(units, wanted, tasks), buckets), "repeat-runs")
    shared.drop_cut(wanted)
    found = shared.cut(match_runs(sent, buckets), "repeat-matches")
    settled = sent.where("bucket < 0").select("unit", "bucket", F.col("rows").alias("a"), F.col("places").alias("b"), F.col("counts").alias("c"))
    return cut_out(with_heads(units, found.unionByName(settled), tasks), keep_texts).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: what all documents lose to strings of 50 bytes that smaller documents hold."""
    return remove_repeats(shared.table(spark, sf_dir, "documents"), keep_texts=False).drop("kept")
