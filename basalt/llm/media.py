"""Media columns: payloads as 8-bit samples, stored as content-defined chunks.

``store`` turns each text into a payload, cuts it where a rolling gear hash says so, and appends
the chunks that its task has not seen yet to a pack file in the shared folder.  A Spark
aggregation over the chunk digests then chooses one stored copy of each chunk for all tasks, and
a join gives every document the ordered list of its chunks' places.  ``load`` follows such a
list by range reads, verifies each chunk's digest and the length, and returns the media file.

Only digests and places are shuffled, never payload bytes.  A pack belongs to one task attempt
and is read only through the rows of an attempt that ended, which are written to the shared
folder as well: losing executors loses nothing.

The media form is a binary grey map: ``P5\\n24 HEIGHT\\n255\\n`` and HEIGHT rows of 24 samples.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared

UNIT, WIDTH = 576, 24
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 8192, 11
SEEN_CHUNKS = 200_000
#: The gear: a fixed random number for each byte value.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 filled up with bytes 255 to a positive multiple of UNIT; and its length before."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def header_of(size: int) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, size // WIDTH)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum over j of gear[byte i-j] << j, by doubling the span."""
    h, span = GEAR[data], 1
    while span < 32:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def cut_points(payload: bytes) -> list[int]:
    """Ends of the chunks.  They depend on the bytes alone, and return soon after an edit."""
    n = len(payload)
    if n <= MIN_CHUNK:
        return [n]
    marks = np.flatnonzero(gear(np.frombuffer(payload, np.uint8)) >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, at = [], 0
    for m in marks.tolist():
        while m - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if m - at >= MIN_CHUNK:
            at = m
            ends.append(at)
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


PLACE = "pack string, offset bigint, stored int"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, n_bytes, payload_bytes, chunks), chunks being the ordered
    array of (seq, digest, length, pack, offset, stored), one stored copy for equal chunks.

    A null text counts as empty (its payload is UNIT bytes 255).  Repeated rows and equal texts
    share all chunks; the caller's other columns are ignored; an empty table stores nothing."""
    spark = docs.sparkSession
    shared.tune(spark)
    folder = shared.new_dir(spark, "media-packs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared.open_fs(folder)
        pack, out, offset, seen = "", None, 0, {}
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            rows = []
            for text in shared.strings(b.column(1)):
                payload, n = payload_of(text)
                chunks, at = [], 0
                for end in cut_points(payload):
                    piece = payload[at:end]
                    digest = hashlib.blake2b(piece, digest_size=20).digest()
                    place = seen.get(digest)
                    if place is None:
                        if out is None:
                            fs.create_dir(base, recursive=True)
                            pack = f"{uuid.uuid4().hex}.pack"
                            out = fs.open_output_stream(f"{base}/{pack}")
                        raw = press.compress(piece)
                        out.write(raw)
                        place = (pack, offset, len(raw))
                        offset += len(raw)
                        if len(seen) < SEEN_CHUNKS:
                            seen[digest] = place
                    chunks.append((digest, end - at, *place))
                    at = end
                rows.append((n, len(payload), chunks))
            flat = [c for r in rows for c in r[2]]
            kinds = [pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int32()]
            names = ["digest", "length", "pack", "offset", "stored"]
            items = pa.StructArray.from_arrays([pa.array([c[i] for c in flat], k) for i, k in enumerate(kinds)], names)
            bounds = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), items)], ["id", "n_bytes", "payload_bytes", "chunks"])
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    local = shared.cut(rows.mapInArrow(run, f"id bigint, n_bytes bigint, payload_bytes bigint, chunks array<struct<digest: binary, length: int, {PLACE.replace(' string', ': string').replace(' bigint', ': bigint').replace(' int', ': int')}>>"), "media-lists")
    # Rows of equal texts have equal lists, so lists are resolved once for each distinct row key.
    local = local.withColumn("row_key", F.sha2(F.array_join(F.transform("chunks", lambda c: F.hex(c["digest"])), ""), 256))
    lists = local.groupBy("row_key").agg(F.min_by("chunks", F.col("chunks")[0]["pack"]).alias("chunks"))
    flat = shared.cut(lists.select("row_key", F.posexplode("chunks").alias("seq", "c")).select("row_key", "seq", "c.*"), "media-chunks")
    chosen = shared.cut(flat.groupBy("digest").agg(F.min(F.struct("pack", "offset", "stored")).alias("place")), "media-index")
    placed = flat.drop("pack", "offset", "stored").join(chosen, "digest").select("row_key", F.struct("seq", "digest", "length", "place.*").alias("c"))
    resolved = shared.cut(placed.groupBy("row_key").agg(F.array_sort(F.collect_list("c")).alias("chunks")), "media-resolved")
    shared.drop_cut(flat, chosen)
    out = local.drop("chunks").join(resolved, "row_key").drop("row_key").withColumn("store", F.lit(folder))
    return out.withColumnRenamed("id", id_col)


def feature_of(samples: np.ndarray) -> str:
    """Sum, largest step and an 8-bin histogram of the samples, as exact integers."""
    hist = np.bincount(samples >> 5, minlength=8)
    step = int(np.abs(np.diff(samples.astype(np.int16))).max()) if len(samples) > 1 else 0
    return f"sum={int(samples.sum(dtype=np.int64))};step={step};hist={','.join(map(str, hist.tolist()))}"


class Chunks:
    """Reads chunks by range, with a bounded cache; what is read must have its digest."""

    def __init__(self, folder: str, cache_bytes: int = 16 << 20):
        self.fs, self.base = shared.open_fs(folder)
        self.files: OrderedDict = OrderedDict()
        self.kept: OrderedDict = OrderedDict()
        self.bytes, self.most = 0, cache_bytes
        self.plain = zstandard.ZstdDecompressor()

    def file(self, pack: str):
        f = self.files.pop(pack, None)
        if f is None:
            f = self.fs.open_input_file(f"{self.base}/{pack}")
            if len(self.files) >= 64:
                self.files.popitem(last=False)[1].close()
        self.files[pack] = f
        return f

    def payload(self, chunks: list[dict]) -> bytes:
        parts, k = [], 0
        while k < len(chunks):
            c = chunks[k]
            got = self.kept.get(c["digest"])
            if got is not None:
                parts.append(got)
                k += 1
                continue
            # Neighbours in the same pack are fetched by one read.
            end, j = c["offset"] + c["stored"], k + 1
            while j < len(chunks) and chunks[j]["pack"] == c["pack"] and chunks[j]["offset"] == end and chunks[j]["digest"] not in self.kept:
                end += chunks[j]["stored"]
                j += 1
            raw = self.file(c["pack"]).read_at(end - c["offset"], c["offset"])
            for x in chunks[k:j]:
                at = x["offset"] - c["offset"]
                piece = self.plain.decompress(raw[at : at + x["stored"]], max_output_size=MAX_CHUNK)
                if len(piece) != x["length"] or hashlib.blake2b(piece, digest_size=20).digest() != x["digest"]:
                    raise ValueError(f"a chunk of {x['pack']} at {x['offset']} is damaged")
                parts.append(piece)
                self.kept[x["digest"]] = piece
                self.bytes += len(piece)
            while self.bytes > self.most:
                self.bytes -= len(self.kept.popitem(last=False)[1])
            k = j
        return b"".join(parts)


def load(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media, payload, feature) of every stored row, read back from the packs and verified."""
    shared.tune(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Chunks] = {}
        for b in batches:
            cols = b.to_pydict()
            media, payloads, features = [], [], []
            for size, chunks, folder in zip(cols["payload_bytes"], cols["chunks"], cols["store"], strict=True):
                if folder not in readers:
                    readers[folder] = Chunks(folder)
                payload = readers[folder].payload(chunks)
                if len(payload) != size:
                    raise ValueError("a payload has lost bytes")
                media.append(header_of(size) + payload)
                payloads.append(payload)
                features.append(feature_of(np.frombuffer(payload, np.uint8)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), pa.array(features, pa.string())], ["id", "n_bytes", "media", "payload", "feature"])

    rows = stored.withColumnRenamed(id_col, "id")
    return rows.mapInArrow(run, "id bigint, n_bytes bigint, media binary, payload binary, feature string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: store every document's payload, read it back, digest what was read."""
    back = load(store(shared.table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
