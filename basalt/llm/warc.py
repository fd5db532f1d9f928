"""WARC archives with a two-level capture index.

Writing: records of equal payloads (by SHA-1) are found with an aggregation over digests; the one
with the smallest id is a response, others are revisits that refer to it.  Each task appends its
records, one gzip member each, to an archive of its own in the shared folder.

Index: the captures, keyed by reversed-host URL (SURT) and id, are range-partitioned and sorted;
each task writes a shard of compressed blocks of BLOCK_LINES captures and, behind it, a sparse
directory with the first key and place of each block.  Only one row for each shard reaches the
driver.

Reading: a key is searched by bisection among the shards' first keys, then in the shard's
directory, then in one decompressed block; the capture's place leads to a range read of its
archive.  A revisit's payload is read through the index too.  Digests are verified.

Names of archives and shards are unique to a task attempt, and only rows of attempts that ended
(written to the shared folder) lead to them, so lost executors and repeated attempts do no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared

BLOCK_LINES = 1000
KEPT_PAYLOAD_BYTES = 8 << 20
KEPT_BLOCKS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "surt string, id bigint, file string, offset bigint, length bigint, kind string, to_surt string, to_id bigint"


def surt(url: str | None) -> str:
    """Reversed-host key: `https://www.example.com:443/a?b` is `com,example,www)/a?b`; empty for null."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return re.sub(r"\s", "+", url or "")
    if not host:
        return re.sub(r"\s", "+", url or "")
    key = ",".join(reversed(host.split(".")))
    if port and port != {"http": 80, "https": 443}.get(parts.scheme):
        key += f":{port}"
    return re.sub(r"\s", "+", key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def header_value(x: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def record(page: int | None, url: str | None, payload: bytes, to_id: int | None, to_url: str | None) -> bytes:
    """The bytes of one response or revisit record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if to_id is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {header_value(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if to_id is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(to_id)}", f"WARC-Refers-To-Date: {DATE}"]
        if to_url:
            head.append(f"WARC-Refers-To-Target-URI: {header_value(to_url)}")
    body = http + payload if to_id is None else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the payload behind the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def roles(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(id, digest, to_id, to_url) of the pages that revisit another one's payload."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    seen = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.sha1(body).alias("digest"), F.length(body).alias("size"))
    seen = shared.cut(seen.where(F.col("id").isNotNull() & (F.col("size") >= least)).select("id", "url", "digest"), "warc-digests")
    first = shared.cut(seen.groupBy("digest").agg(F.min(F.struct("id", "url")).alias("first"), F.max("id").alias("last")).where("first.id < last").select("digest", F.col("first.id").alias("to_id"), F.col("first.url").alias("to_url")), "warc-firsts")
    return seen.join(first, "digest").where("id > to_id").select("id", "digest", "to_id", "to_url").distinct()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write all pages into archives below folder; the captures, one row for each record.

    Equal payloads of at least `least` bytes are stored once.  A null html is an empty payload, a null
    url has no target.  Rows with a null id are responses; repeated rows of the smallest id are all
    responses.  Other columns are ignored; an empty table writes nothing."""
    shared.tune(pages.sparkSession)
    again = roles(pages, id_col, url_col, html_col, least)
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(again, ["id", "digest"], "left").select("id", "url", "html", "to_id", "to_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared.open_fs(folder)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for b in batches:
            made = []
            for page, url, html, to_id, to_url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                raw = gzip.compress(record(page, url, html.encode("utf-8", "surrogatepass"), to_id, to_url), 4, mtime=0)
                out.write(raw)
                made.append((surt(url), page, name, at, len(raw), "response" if to_id is None else "revisit", None if to_id is None else surt(to_url), to_id))
                at += len(raw)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], [x.split()[0] for x in CAPTURE.split(", ")])
        if out is not None:
            out.close()

    return shared.cut(rows.mapInArrow(run, CAPTURE), "warc-captures")


def key_of(s: str, page: int | None) -> tuple[str, int]:
    return s, -(1 << 63) if page is None else page


def build_index(captures: DataFrame, folder: str) -> list[tuple[tuple[str, int], str, int, int]]:
    """Write the index shards below folder; (first key, shard, place and length of its directory), in order."""
    spark = captures.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.repartitionByRange(n, "surt", "id").sortWithinPartitions("surt", "id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = shared.open_fs(folder)
        name, out, at, lines, directory = f"{uuid.uuid4().hex}.idx", None, 0, [], []

        def block() -> None:
            nonlocal out, at
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            raw = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 6)
            out.write(raw)
            directory.append((*key_of(*lines[0][:2]), at, len(raw)))
            at += len(raw)
            lines.clear()

        for b in batches:
            for line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    block()
        if lines:
            block()
        if out is not None:
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(raw)
            out.close()
            s, page, *_ = directory[0]
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([page], pa.int64()), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(raw)], pa.int64())], ["surt", "id", "shard", "at", "length"])

    shards = shared.cut(dealt.mapInArrow(run, "surt string, id bigint, shard string, at bigint, length bigint"), "warc-shards")
    return sorted(((r["surt"], r["id"]), r["shard"], r["at"], r["length"]) for r in shards.collect())  # a row for each partition


class Archive:
    """Looks captures up and reads their records."""

    def __init__(self, folder: str, shards: list):
        self.fs, self.base = shared.open_fs(folder)
        self.shards, self.firsts = shards, [s[0] for s in shards]
        self.files: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()
        self.directories: OrderedDict = OrderedDict()
        self.payloads: OrderedDict = OrderedDict()
        self.bytes = 0

    def read(self, name: str, at: int, length: int) -> bytes:
        f = self.files.pop(name, None)
        if f is None:
            f = self.fs.open_input_file(f"{self.base}/{name}")
            if len(self.files) >= 64:
                self.files.popitem(last=False)[1].close()
        self.files[name] = f
        return f.read_at(length, at)

    def kept(self, cache: OrderedDict, key, most: int, make):
        got = cache.pop(key, None)
        cache[key] = got = make() if got is None else got
        while len(cache) > most:
            cache.popitem(last=False)
        return got

    def lookup(self, s: str, page: int | None) -> list[list]:
        """All captures of a key."""
        key, found = key_of(s, page), []
        k = max(0, bisect_left(self.firsts, key) - 1)  # equal keys may begin in the shard before
        while k < len(self.shards) and self.firsts[k] <= key:
            _, name, at, length = self.shards[k]
            directory = self.kept(self.directories, name, KEPT_BLOCKS, lambda name=name, at=at, length=length: [((x[0], x[1]), x[2], x[3]) for x in json.loads(zlib.decompress(self.read(name, at, length)))])
            firsts = [x[0] for x in directory] if len(directory) < 8 else None
            lo = max(0, (bisect_left(firsts, key) if firsts else bisect_left(directory, key, key=lambda x: x[0])) - 1)
            while lo < len(directory) and directory[lo][0] <= key:
                _, begin, size = directory[lo]
                keys, lines = self.kept(self.blocks, (name, begin), KEPT_BLOCKS, lambda name=name, begin=begin, size=size: self.block(name, begin, size))
                found += lines[bisect_left(keys, key) : bisect_right(keys, key)]
                lo += 1
            k += 1
        return found

    def block(self, name: str, at: int, length: int) -> tuple[list, list]:
        lines = [json.loads(x) for x in zlib.decompress(self.read(name, at, length)).decode().split("\n")]
        return [key_of(*x[:2]) for x in lines], lines

    def payload(self, capture: list) -> tuple[dict[str, str], bytes]:
        """A capture's header fields and full payload, verified; a revisit's payload is that of the record it refers to."""
        s, page, name, at, length, kind, to_surt, to_id = capture
        fields, payload = parse(gzip.decompress(self.read(name, at, length)))
        if fields["warc-record-id"] != record_id(page):
            raise ValueError("the index leads to another record")
        if kind == "revisit":
            payload = self.payloads.get((to_surt, to_id))
            if payload is None:
                payload = self.payload(next(c for c in self.lookup(to_surt, to_id) if c[5] == "response" and self.same(c, fields)))[1]
                self.payloads[to_surt, to_id] = payload
                self.bytes += len(payload)
                while self.bytes > KEPT_PAYLOAD_BYTES and len(self.payloads) > 1:
                    self.bytes -= len(self.payloads.popitem(last=False)[1])
        if fields["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
            raise ValueError("a payload's digest differs")
        return fields, payload

    def same(self, capture: list, fields: dict[str, str]) -> bool:
        other, _ = parse(gzip.decompress(self.read(*capture[2:5])))
        return other["warc-payload-digest"] == fields["warc-payload-digest"]


def read(requests: DataFrame, folder: str, shards: list, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, payload, payload_digest, record_type, refers_to): all records of the requested keys, each key once."""
    spark = requests.sparkSession
    shared.tune(spark)
    rows = requests.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column(1).to_pylist()], pa.string()), b.column(0)], ["surt", "id"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(keyed, "surt string, id bigint").repartitionByRange(n, "surt", "id").sortWithinPartitions("surt", "id")
    found = spark.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, last = Archive(folder, found.value), None
        for b in batches:
            out = []
            for key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key == last:
                    continue
                last = key
                for capture in archive.lookup(*key):
                    fields, payload = archive.payload(capture)
                    out.append((capture[1], fields.get("warc-target-uri"), payload, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], capture[7]))
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["id", "url", "payload", "payload_digest", "record_type", "refers_to"])

    return dealt.mapInArrow(run, "id bigint, url string, payload binary, payload_digest string, record_type string, refers_to bigint").withColumnsRenamed({"id": id_col, "url": url_col})


def query(spark, sf_dir: str) -> DataFrame:
    """op3: archive all pages, index the archives, read every page back through the index."""
    pages = shared.table(spark, sf_dir, "pages")
    folder = shared.new_dir(spark, "warc")
    captures = write(pages, folder)
    shards = build_index(captures, folder)
    back = read(pages, folder, shards)
    return back.select("page_id", F.length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


# DuckDB has no SHA-1 in base32: the digits are taken from the hexadecimal digest, 5 bits at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(((CAST(('0x' || substr(hex || '00', 1 + CAST((i * 5) // 4 AS INTEGER), 3)) AS BIGINT) >> (7 - (i * 5) % 4)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
