"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

A text is normalised as the model asks (a leading space mark, spaces become marks) and cut
before every run of marks: no piece reaches over such a cut, so each *segment* merges alone
and equal segments merge once.  The segments of a batch lie in one flat array of symbols.
A round finds each segment's lowest pair rank (``minimum.reduceat``), merges all leftmost
non-overlapping pairs of that rank and compacts the array, until no pair is left.  Where a
merge could open a pair of a better rank, only the leftmost one of the segment is merged in
that round, so the result equals the library's queue in every case.  Segments longer than LONG (texts
without spaces) have thousands of ranks, and rounds over all their symbols would take quadratic time:
there a round takes up only the places of the lowest rank at hand, which are kept in one bucket for each
rank, and joins neighbours by links instead of moving symbols, so a text takes time in proportion to its length.

Memory: one batch's symbols and a cache of segments, which is emptied when it holds
``CACHE_SEGMENTS``; its size never changes a result.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared

MARK = "▁"
NONE = np.int32(2**31 - 1)
CACHE_SEGMENTS = 150_000
ROUND_CHARS = 400_000
LONG = 256
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class MergeTable:
    """Pairs, ranks and piece bytes of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        model = pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with an identity normaliser and a leading space mark are supported")
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        self.size = len(pieces)
        normal = {s: i for i, (s, _, kind) in enumerate(pieces) if kind == NORMAL}
        if any(MARK in s.strip(MARK) or s.endswith(MARK) and s.strip(MARK) for s in normal):
            raise ValueError("a piece has a space mark behind other characters")
        by_score = sorted(normal.values(), key=lambda i: -pieces[i][1])
        rank = np.full(self.size, NONE, np.int32)
        rank[by_score] = np.arange(len(by_score), dtype=np.int32)
        scores = np.array([pieces[i][1] for i in by_score])
        rank[by_score] -= np.concatenate(([0], np.cumsum(scores[1:] == scores[:-1]))).astype(np.int32)
        triples = [(normal[s[:k]], normal[s[k:]], i) for s, i in normal.items() for k in range(1, len(s)) if s[:k] in normal and s[k:] in normal]
        left, right, out = (np.array(x, np.int64) for x in zip(*triples, strict=True))
        order = np.argsort(left * self.size + right)
        self.keys, self.out = (left * self.size + right)[order], out[order].astype(np.int32)
        self.rank = rank
        # A merge is simple if no pair with its result has a better rank than itself.
        best = np.full(self.size, NONE, np.int64)
        np.minimum.at(best, left, rank[out])
        np.minimum.at(best, right, rank[out])
        self.simple = best > rank
        singles = {s: i for s, i in normal.items() if len(s) == 1}
        if any(c not in singles for s in normal for c in s):
            raise ValueError("a character of a piece is no piece itself")
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in singles.items():
            self.char[ord(s)] = i
        self.byte = np.zeros(256, np.int32)
        for i, (s, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte[int(s[3:5], 16)] = i
        shown = [b"" if kind == CONTROL else trainer.unk_surface.encode() if kind == UNKNOWN else bytes([int(s[3:5], 16)]) if kind == BYTE else s.replace(MARK, " ").encode() for s, _, kind in pieces]
        self.blob = np.frombuffer(b"".join(shown), np.uint8)
        self.blob_len = np.array([len(x) for x in shown], np.int64)
        self.blob_at = np.concatenate(([0], np.cumsum(self.blob_len)[:-1]))
        self.shown = shown
        self.special = np.array([kind != NORMAL for _, _, kind in pieces])
        self.is_byte = np.array([kind == BYTE for _, _, kind in pieces])
        #: Pairs whose symbols can be merged at all, to spare most searches.
        self.may_left = np.zeros(self.size + 1, bool)
        self.may_right = np.zeros(self.size + 1, bool)
        self.may_left[left], self.may_right[right] = True, True

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that a pair makes, or -1."""
        made = np.full(len(left), -1, np.int32)
        # Characters outside the vocabulary are negative and no index: they make no pair.
        may = np.flatnonzero((left >= 0) & (right >= 0) & self.may_left[np.maximum(left, 0)] & self.may_right[np.maximum(right, 0)])
        key = left[may].astype(np.int64) * self.size + right[may]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        made[may[hit]] = self.out[at[hit]]
        return made

    def merge_long(self, sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of all segments and their owners; only the places of one rank are looked at in a round."""
        n = len(sym)
        sym, right, left = sym.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        right[np.flatnonzero(owner[1:] != owner[:-1])] = n
        right[-1:] = n
        left[np.flatnonzero(owner[1:] != owner[:-1]) + 1] = -1
        live, made = np.ones(n, bool), np.full(n, -1, np.int32)
        buckets: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            """Find the pairs at these places anew and put them into their ranks' buckets."""
            to = right[at]
            made[at] = -1
            inside = to < n
            at = at[inside]
            made[at] = self.pair(sym[at], sym[to[inside]])
            at = at[made[at] >= 0]
            of = self.rank[made[at]]
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.empty(0, np.int64)
            for r, part in zip(of[first].tolist(), np.split(at, first[1:]), strict=False):
                if r not in buckets:
                    buckets[r] = []
                    heapq.heappush(ranks, r)
                buckets[r].append(part)

        look(np.arange(n))
        while ranks:
            r = ranks[0]
            at = np.unique(np.concatenate(buckets.pop(r)))
            heapq.heappop(ranks)
            at = at[live[at] & (made[at] >= 0)]
            at = at[self.rank[made[at]] == r]
            if not len(at):
                continue
            # Of overlapping pairs every second one, from the left.
            new_run = np.concatenate(([True], right[at[:-1]] != at[1:]))
            place = np.arange(len(at))
            run = place - np.maximum.accumulate(np.where(new_run, place, 0))
            some = at[run % 2 == 0]
            if not self.simple[made[some]].all():
                # Up to the first merge that opens a better pair on either side; the rest waits.
                before, behind = left[some], right[right[some]]
                # A neighbour merged just before stands there as what it made.
                merged = np.zeros(len(some), bool)
                merged[1:] = right[right[some[:-1]]] == some[1:]
                one = np.where(merged, np.concatenate(([0], made[some[:-1]])), sym[np.maximum(before, 0)])
                opens = np.zeros(len(some), bool)
                for ok, a, b in ((before >= 0, one, made[some]), (behind < n, made[some], sym[np.minimum(behind, n - 1)])):
                    k = np.flatnonzero(ok)
                    new = self.pair(a[k], b[k])
                    opens[k[new >= 0]] |= self.rank[new[new >= 0]] < r
                if opens.any():
                    stop = int(opens.argmax()) + 1
                    # Other segments' merges don't matter to each other, but one order for all is as good as any.
                    later = at[at > some[stop - 1]]
                    some = some[:stop]
                    if len(later):
                        buckets[r] = [later]
                        heapq.heappush(ranks, r)
            gone = right[some]
            sym[some] = made[some]
            live[gone] = False
            made[gone] = -1
            right[some] = right[gone]
            inner = right[some] < n
            left[right[some[inner]]] = some[inner]
            # Neighbours that were merged themselves have moved their left ends: links are settled, now pairs are.
            touched = np.concatenate((some, left[some][left[some] >= 0]))
            look(np.unique(touched))
        keep = np.flatnonzero(live)
        return sym[keep], owner[keep]

    def merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in one flat array, and how many each has."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        owner = np.repeat(np.arange(len(segments), dtype=np.int32), sizes)
        sym = self.char[codes]
        sym[sym < 0] = -1 - codes[sym < 0].astype(np.int32)  # kept apart until the bytes are written
        done_sym, done_owner = [], []
        long = np.repeat(sizes > LONG, sizes)
        if long.any():
            a, b = self.merge_long(sym[long], owner[long])
            done_sym.append(a)
            done_owner.append(b)
            sym, owner = sym[~long], owner[~long]
        made = np.full(len(sym), -1, np.int32)
        same = owner[1:] == owner[:-1]
        made[:-1][same] = self.pair(sym[:-1][same], sym[1:][same])
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], NONE)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lens = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(rank, starts)
            live = np.repeat(low != NONE, lens)
            if not live.all():
                done_sym.append(sym[~live])
                done_owner.append(owner[~live])
                low = np.repeat(low, lens)[live]
                sym, owner, made, rank = sym[live], owner[live], made[live], rank[live]
                if not len(sym):
                    break
            else:
                low = np.repeat(low, lens)
            at = np.flatnonzero(rank == low)
            # Of overlapping pairs every second one, from the left.
            new_run = np.concatenate(([True], at[1:] != at[:-1] + 1))
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            first = np.concatenate(([True], owner[at][1:] != owner[at][:-1]))
            at = at[np.where(self.simple[made[at]], run % 2 == 0, first)]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            sym, owner, made, changed = sym[keep], owner[keep], made[keep], changed[keep]
            changed[:-1] |= changed[1:]
            again = np.flatnonzero(changed)
            nxt = np.minimum(again + 1, len(sym) - 1)
            inside = (nxt > again) & (owner[nxt] == owner[again])
            made[again] = -1
            made[again[inside]] = self.pair(sym[again[inside]], sym[nxt[inside]])
        sym, owner = np.concatenate([*done_sym, np.empty(0, np.int32)]), np.concatenate([*done_owner, np.empty(0, np.int32)])
        order = np.argsort(owner, kind="stable")
        sym, owner = sym[order], owner[order]
        odd = np.flatnonzero(sym < 0)
        if len(odd):
            width = np.ones(len(sym), np.int64)
            raw = [chr(-1 - int(x)).encode("utf-8", "surrogatepass") for x in sym[odd]]
            width[odd] = [len(x) for x in raw]
            to = np.cumsum(width) - width
            sym, owner = np.repeat(sym, width), np.repeat(owner, width)
            for i, x in zip(odd, raw, strict=True):
                sym[to[i] : to[i] + len(x)] = self.byte[list(x)]
        return sym, np.bincount(owner, minlength=len(segments)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def spread(at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the ranges [at, at + lens), one after another."""
    ends = np.cumsum(lens)
    return np.repeat(at - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Texts to ids, with a cache of the segments seen."""

    def __init__(self, path: str):
        self.table = merge_table(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.at, self.len = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """words: segments without their first mark."""
        made, lens, chunk, chars = [self.flat], [self.len], [], 0
        for k, w in enumerate(words):
            chunk.append(MARK + w)
            chars += len(w) + 1
            if chars >= ROUND_CHARS or k == len(words) - 1:
                ids, n = self.table.merge(chunk)
                made.append(ids)
                lens.append(n)
                chunk, chars = [], 0
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.flat, self.len = np.concatenate(made), np.concatenate(lens)
        self.at = np.cumsum(self.len) - self.len

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and how many each text has."""
        split = [segments(t) for t in texts]
        new = list(set().union(*split).difference(self.index))
        if len(self.index) + len(new) > CACHE_SEGMENTS:
            self.clear()
            new = list(set().union(*split))
        if new:
            self.learn(new)
        get, total = self.index.__getitem__, sum(map(len, split))
        which = np.fromiter((get(w) for s in split for w in s), np.int64, total)
        lens = self.len[which]
        ids = self.flat[spread(self.at[which], lens)]
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(lens)))[ends]))) if len(ends) else np.empty(0, np.int64)


def segments(text: str) -> list[str]:
    """The normalised text's segments, each without its first mark."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, marks = [], 0
    for w in words[:-1]:
        if w:
            out.append(MARK * marks + w)
            marks = 0
        else:
            marks += 1
    out.append(MARK * marks + words[-1])
    return out


def lossy(raw: bytes) -> str:
    """UTF-8 to text; each byte that fits nowhere becomes one U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in range(min(4, len(raw) - i), 0, -1):
            try:
                out.append(raw[i : i + n].decode())
                if len(out[-1]) == 1 or n == 1:
                    i += n
                    break
                out.pop()
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


def decode_ids(table: MergeTable, ids: np.ndarray, lens: np.ndarray) -> list[str]:
    """Texts of flat ids; lens: how many each text has."""
    blob = table.blob[spread(table.blob_at[ids], table.blob_len[ids])].tobytes()
    ends = np.concatenate(([0], np.cumsum(table.blob_len[ids])))[np.cumsum(lens)] if len(ids) else np.zeros(len(lens), np.int64)
    odd = np.concatenate(([0], np.cumsum(table.special[ids])))
    texts, at, lo = [], 0, 0
    for end, hi in zip(ends.tolist(), np.cumsum(lens).tolist(), strict=True):
        if odd[hi] == odd[lo]:
            t = blob[at:end].decode()
        else:
            parts, run = [], bytearray()
            for i in ids[lo:hi].tolist():
                if table.is_byte[i]:
                    run += table.shown[i]
                else:
                    if run:
                        parts.append(lossy(bytes(run)))
                        run = bytearray()
                    parts.append(table.shown[i].decode())
            t = "".join(parts) + (lossy(bytes(run)) if run else "")
        first = ids[lo] if hi > lo else -1
        texts.append(t[1:] if first >= 0 and not table.special[first] and t[:1] == " " else t)
        at, lo = end, hi
    return texts


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def list_array(flat: np.ndarray, lens: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32)), pa.array(flat, kind))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row of docs; a null or empty text has no ids.

    Characters outside the vocabulary, of any plane, become the ids of their UTF-8 bytes.  Repeated rows give repeated rows, any other column is ignored, an empty table gives none.
    model: path of a SentencePiece BPE model, readable on every executor."""
    shared.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(model)
        for b in batches:
            ids, lens = enc.encode(shared.strings(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(ids, lens)], ["id", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the text that the library's decode(ids) gives; null ids count as none."""
    shared.tune(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(model)
        for b in batches:
            col = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            ids = col.flatten().to_numpy(zero_copy_only=False)
            lens = np.diff(col.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), col, pa.array(decode_ids(table, ids, lens), pa.string())], ["id", "ids", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id bigint, ids array<int>, text string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: encode and decode all documents; digests of the ids and of the decoded texts."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = decode(encode(shared.table(spark, sf_dir, "documents"), model), model)
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
