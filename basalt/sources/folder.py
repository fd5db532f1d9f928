"""A mixed folder as one Spark data source: plant records and documents, a partition for each file, a broken file as a row that says so.

spark.dataSource.register(MixedFolder); spark.read.format("basalt_folder").load(path) gives one row for each record or chunk:
file, kind, pos, key, fields (a map of strings), text, error.  What a file is follows from its name:

* pid/*.json: equipment and lines of a piping diagram (kinds `pid_node`, `pid_edge`)
* sensors*.csv: time stamps and numbers (`sensor`); spares*.csv (`spare`); maintenance_log*.csv (`order`); maintenance_events*.json (`event`)
* metadata.json of an asset's folder (`asset`)
* every other file with a reader: chunks of a document (`chunk`); generated ones below assets/ say so in their fields.

A file that can't be read gives one row with an error and nothing else; no other file is affected.  Files without a reader give a row too."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from basalt.runtime import ship
from basalt.sources import readers

SCHEMA = "file string, kind string, pos bigint, key string, fields map<string,string>, text string, error string"
SENSORS = ["vibration_mm_s", "bearing_temp_c", "discharge_pressure_bar"]
PACK = 1200
Row = tuple


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + str(path).removeprefix("file:"))


def _strings(record: dict) -> dict[str, str]:
    return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in record.items() if k is not None and v is not None}


def _table(raw: bytes, sep: str = ",") -> list[dict]:
    rows = csv.DictReader(io.StringIO(raw.decode()), delimiter=sep, strict=True)
    if not rows.fieldnames:
        raise ValueError("no header")
    return list(rows)


def _records(kind: str, key: str) -> Callable[[bytes], Iterator[Row]]:
    """A CSV of records, keyed by a column that must be there."""
    def read(raw: bytes) -> Iterator[Row]:
        rows = _table(raw)
        if rows and key not in rows[0]:
            raise ValueError(f"no column {key}")
        for i, r in enumerate(rows):
            yield kind, i, r[key], _strings(r), None

    return read


def _sensors(raw: bytes) -> Iterator[Row]:
    for i, r in enumerate(_table(raw)):
        yield "sensor", i, r["timestamp"], {"timestamp": r["timestamp"], **{c: str(float(r[c])) for c in SENSORS}}, None


def _listed(raw: bytes, *names: str) -> list:
    data = json.loads(raw)
    if isinstance(data, dict):
        data = next((data[n] for n in names if n in data), None)
    if not isinstance(data, list):
        raise ValueError(f"neither a list nor one under {', '.join(names)}")
    return data


def _pid(raw: bytes) -> Iterator[Row]:
    data = json.loads(raw)
    nodes, edges = data.get("nodes") or data.get("equipment") or [], data.get("edges") or data.get("connections") or []
    for i, n in enumerate(nodes):
        yield "pid_node", i, n.get("tag") or n["id"], _strings(n), None
    for i, e in enumerate(edges):
        a, b = (e["from"], e["to"]) if "from" in e else (e["source"], e["target"])
        yield "pid_edge", i, f"{a}>{b}", {**_strings(e), "src": a, "dst": b}, None


def _events(raw: bytes) -> Iterator[Row]:
    for i, e in enumerate(_listed(raw, "events", "maintenance_events")):
        yield "event", i, str(e.get("work_order") or e.get("wo_number") or ""), _strings(e), None


def _asset(raw: bytes) -> Iterator[Row]:
    data = json.loads(raw)
    yield "asset", 0, str(data.get("asset_id") or "").upper(), _strings(data), None


def front(text: str) -> tuple[dict[str, str], str]:
    """Fields between `---` lines at the top, and the rest."""
    m = re.match(r"(?s)^---\n(.*?)\n---\n?(.*)$", text)
    if not m:
        return {}, text
    pairs = (x.split(":", 1) for x in m[1].split("\n") if ":" in x)
    return {k.strip(): re.sub(r"^\[(.*)\]$", r"\1", v.strip()) for k, v in pairs}, m[2]


def sections(body: str) -> Iterator[tuple[str, str]]:
    """(section, text) of a Markdown text, cut at `## `; what stands before the first is the Preamble."""
    for part in re.split(r"\n(?=## )", body):
        head, _, rest = part.partition("\n")
        name, text = (re.sub(r"^#+ ", "", head), rest) if part.startswith("## ") else ("Preamble", part)
        if text.strip():
            yield name, text.strip()


def packed(body: str, limit: int = PACK) -> Iterator[tuple[str, str]]:
    """("", text): paragraphs packed greedily up to the limit; a longer one stands alone."""
    held = ""
    for p in (x.strip() for x in re.split(r"\n\s*\n", body)):
        if not p:
            continue
        if held and len(held) + len(p) > limit:
            yield "", held
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    if held:
        yield "", held


def _tabled(sep: str) -> Callable[[bytes], str]:
    """A table as text: its columns, the first ROW_CAP rows, and how many more there are."""
    def text(raw: bytes) -> str:
        rows = _table(raw, sep)
        head = list(rows[0]) if rows else next(csv.reader(io.StringIO(raw.decode()), delimiter=sep))
        lines = [f"Columns: {', '.join(head)}"] + ["; ".join(f"{k}: {v}" for k, v in r.items() if isinstance(v, str) and v.strip()) for r in rows[: readers.ROW_CAP]]
        return "\n".join(lines + ([f"... {len(rows) - readers.ROW_CAP} more rows"] if len(rows) > readers.ROW_CAP else []))

    return text


TEXTS: dict[str, Callable[[bytes], str]] = {
    ".html": lambda raw: readers.html_text(raw.decode()), ".htm": lambda raw: readers.html_text(raw.decode()), ".docx": readers.docx_text, ".xlsx": readers.xlsx_text, ".csv": _tabled(","), ".tsv": _tabled("\t"),
    ".json": lambda raw: json.dumps(json.loads(raw), indent=2, ensure_ascii=False)[: readers.JSON_CAP],
}


def document(name: str, generated: str | None) -> Callable[[bytes], Iterator[Row]]:
    """Chunks of a document, with its fields."""
    stem, suffix = re.sub(r"[^A-Za-z0-9_-]+", "-", PurePosixPath(name).stem)[:40], PurePosixPath(name).suffix.lower()

    def read(raw: bytes) -> Iterator[Row]:
        if suffix in (".md", ".markdown", ".txt"):
            meta, body = front(raw.decode())
            doc, parts = meta.get("doc_no", f"ASSET-{generated}-{stem}" if generated else stem), sections(body)
        else:
            meta, doc, parts = {}, stem, packed(TEXTS[suffix](raw))
        more = {"generated": "true", "asset_id": generated} if generated else {"uploaded": "true"} if "uploads" in PurePosixPath(name).parts else {}
        for i, (section, text) in enumerate(parts):
            yield "chunk", i, doc, {"title": PurePosixPath(name).name, **meta, **more, "section": section}, text

    return read


def reader_of(path: str) -> Callable[[bytes], Iterator[Row]] | None:
    """What reads a file, by its place and name; None if nothing does."""
    p = PurePosixPath(path)
    name, suffix = p.name.lower(), p.suffix.lower()
    for start, end, read in (("sensors", ".csv", _sensors), ("spares", ".csv", _records("spare", "part_no")), ("maintenance_log", ".csv", _records("order", "wo_number")), ("maintenance_events", ".json", _events)):
        if name.startswith(start) and suffix == end:
            return read
    if suffix == ".json" and "pid" in p.parts[:-1]:
        return _pid
    asset = p.parts[-2].upper() if len(p.parts) > 2 and p.parts[-3] == "assets" else None
    if name == "metadata.json" and asset:
        return _asset
    return document(path, asset) if suffix in TEXTS or suffix in (".md", ".markdown", ".txt") else None


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[FilePartition]:
        fs, at = _opened(self.root)
        info = fs.get_file_info(at)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return [FilePartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and not PurePosixPath(f.path).name.startswith((".", "_"))]

    def read(self, partition: FilePartition) -> Iterator[Row]:
        fs, at = _opened(self.root)
        file = partition.path[len(at) :].lstrip("/") or PurePosixPath(partition.path).name
        read = reader_of(partition.path[len(at) :] if partition.path != at else partition.path)
        if read is None:
            yield file, "none", 0, None, {}, None, f"no reader for {PurePosixPath(file).suffix or file}"
            return
        try:
            with fs.open_input_stream(partition.path) as f:
                rows = [(file, kind, pos, key, fields, text, None) for kind, pos, key, fields, text in read(f.read())]
        except Exception as problem:  # whatever a broken file does to its parser is told in its row
            yield file, "broken", 0, None, {}, None, f"{type(problem).__name__}: {problem}"[:300]
            return
        yield from rows


class MixedFolder(DataSource):
    """format("basalt_folder"): the folder (or file) that load() names."""

    @classmethod
    def name(cls) -> str:
        return "basalt_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"].rstrip("/"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a mixed folder."""
    ship(spark)
    spark.dataSource.register(MixedFolder)
    return spark.read.format("basalt_folder").load(path)


def chunks(rows: DataFrame) -> DataFrame:
    """(doc_no, chunk_pos, section, title, revision, uploaded, generated, asset_id, text, file); chunk_pos counts through each document."""
    f = F.col("fields")
    flag = lambda name: F.coalesce(f[name] == "true", F.lit(False)).alias(name)
    return rows.where("kind = 'chunk'").select(F.col("key").alias("doc_no"), F.col("pos").alias("chunk_pos"), f["section"].alias("section"), f["title"].alias("title"), F.coalesce(f["revision"], F.when(f["generated"] == "true", "generated"), F.when(f["uploaded"] == "true", "uploaded"), F.lit("?")).alias("revision"), flag("uploaded"), flag("generated"), f["asset_id"].alias("asset_id"), "text", "file")


def sensors(rows: DataFrame) -> DataFrame:
    """(file, ts, vibration_mm_s, bearing_temp_c, discharge_pressure_bar)."""
    return rows.where("kind = 'sensor'").select("file", F.try_to_timestamp("key").alias("ts"), *(F.col("fields")[c].cast("double").alias(c) for c in SENSORS))


def spares(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'spare'").select(F.col("key").alias("part_no"), "fields")


def topology(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, fields), edges (src, dst, rel)) of the piping diagrams."""
    f = F.col("fields")
    return rows.where("kind = 'pid_node'").select(F.col("key").alias("id"), "fields"), rows.where("kind = 'pid_edge'").select(f["src"].alias("src"), f["dst"].alias("dst"), F.coalesce(f["rel"], F.lit("CONNECTED_TO")).alias("rel")).distinct()


#: What an event says under other names than the log does.
EVENT_COLUMNS = {"asset_id": "tag", "maintenance_date": "date", "work_performed": "action_taken", "engineer": "technician"}


def maintenance(rows: DataFrame) -> DataFrame:
    """(wo_number, fields, extracted): the log with the events extracted from documents laid over it: an event replaces the log's row of
    its work order, others are added; of several with one number the last one counts.  An event without a number stands by itself."""
    renamed = F.transform_keys("fields", lambda k, v: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in EVENT_COLUMNS.items() for x in kv)), k), k))
    log = rows.where("kind = 'order'").select(F.col("key").alias("wo_number"), "fields", F.lit(False).alias("extracted"), "file", "pos")
    events = rows.where("kind = 'event'").select(F.when(F.col("key") != "", F.col("key")).alias("wo_number"), renamed.alias("fields"), F.lit(True).alias("extracted"), "file", "pos")
    both = log.unionByName(events)
    last = both.where("wo_number is not null").groupBy("wo_number").agg(F.max_by(F.struct("fields", "extracted"), F.struct("extracted", "file", "pos")).alias("x")).select("wo_number", "x.fields", "x.extracted")
    return last.unionByName(both.where("wo_number is null").select("wo_number", "fields", "extracted"))


def errors(rows: DataFrame) -> DataFrame:
    """(file, error) of what could not be read."""
    return rows.where("error is not null").select("file", "error")
