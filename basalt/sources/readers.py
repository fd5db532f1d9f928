"""Document sources: one reader for each kind of file, chosen by suffix.

Every reader returns (doc_no, title, section, pos, text).  Text formats are read by Spark's own
sources; packed formats come as binaryFile rows and are opened in Arrow batches on the executors.
PDF and images need libraries that are not part of this package: register a handler for them.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.runtime import ship

SCHEMA = "doc_no string, title string, section string, pos int, text string"
ROW_CAP, JSON_CAP = 500, 60_000  # documents made from tables and JSON are cut here: a feature of these readers
# Tags that end a block, tags whose contents are dropped.
BLOCK = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table".split())
DROPPED = frozenset("script style noscript".split())
# End of fixed values.


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.hidden += 1
        elif tag in BLOCK:
            self.parts.append("\n\n")

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCK:
            self.parts.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(page: str | None) -> str:
    """Visible text; block tags part paragraphs, white space inside a line becomes one space."""
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    blocks = (re.sub(r"\s+", " ", b).strip() for b in re.split(r"\n\s*\n", "".join(parser.parts)))
    return "\n\n".join(b for b in blocks if b)


def html_to_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with a column text in place of html."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def convert(col: pd.Series) -> pd.Series:
        return col.map(html_text)

    return pages.withColumn("text", convert(F.col(html_col))).drop(html_col)


def _name(col: Column) -> Column:
    return T.doc_no(F.regexp_replace(F.element_at(F.split(col, "/"), -1), r"\.[^.]+$", ""))


def _chunks(df: DataFrame, text: Column, title: Column, doc: Column) -> DataFrame:
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(doc.alias("doc_no"), title.alias("title"), F.lit("").alias("section"), F.posexplode(parts).alias("pos", "text"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """(map of the fields, body) of a text that begins with `---` lines; lists in brackets keep their commas."""
    has = text.rlike(r"(?s)^---\n.*?\n---")
    head = F.when(has, F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)).otherwise("")
    pairs = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), r"^\[(.*)\]$", "$1")))
    return F.map_from_entries(entries), F.when(has, F.regexp_replace(text, r"(?s)^---\n.*?\n---\n?", "")).otherwise(text)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Sections at `## `; text before the first is `Preamble`."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    fields, body = front_matter(F.col("value"))
    rows = raw.select("file", fields.alias("f"), F.posexplode(F.split(body, r"\n(?=## )")).alias("pos", "part"))
    section = F.when(F.col("part").startswith("## "), F.regexp_replace(F.substring_index("part", "\n", 1), "^#+ ", "")).otherwise("Preamble")
    content = F.regexp_replace(F.when(F.col("part").startswith("## "), F.regexp_replace("part", r"^## [^\n]*\n?", "")).otherwise(F.col("part")), r"^\s+|\s+$", "")
    out = rows.select(F.coalesce(F.element_at("f", "doc_no"), _name(F.col("file"))).alias("doc_no"), F.coalesce(F.element_at("f", "title"), _name(F.col("file"))).alias("title"), section.alias("section"), "pos", content.alias("text"))
    return out.where("text <> ''")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return _chunks(raw, F.col("value"), _name(F.col("file")), _name(F.col("file")))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    raw = html_to_text(spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.col("_metadata.file_name").alias("file")))
    return _chunks(raw, F.col("text"), _name(F.col("file")), _name(F.col("file")))


def table_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header; all columns are strings."""
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).csv(path)


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table as a document: its columns, then the first ROW_CAP rows as `name: value; ...` without empty cells."""
    df = table_rows(spark, path, sep)
    cells = F.filter(F.array(*(F.when((F.col(f"`{c}`").isNotNull()) & (F.trim(F.col(f"`{c}`")) != ""), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in df.columns)), lambda x: x.isNotNull())
    rows = df.select(F.monotonically_increasing_id().alias("i"), F.array_join(cells, "; ").alias("line")).limit(ROW_CAP)
    body = rows.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("body"))  # ROW_CAP rows
    name = PurePosixPath(path).stem
    return body.select(F.lit(name).alias("doc_no"), F.lit(name).alias("title"), F.lit("").alias("section"), F.lit(0).alias("pos"), F.concat(F.lit(f"Columns: {', '.join(df.columns)}\n"), "body").alias("text"))


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file as a document, indented anew and cut at JSON_CAP characters; a broken file stays as it is."""
    ship(spark)

    @F.pandas_udf("string")
    def tidy(col: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            try:
                return json.dumps(json.loads(x), indent=2, ensure_ascii=False)[:JSON_CAP]
            except ValueError:
                return x[:JSON_CAP]

        return col.map(one)

    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return raw.select(_name(F.col("file")).alias("doc_no"), _name(F.col("file")).alias("title"), F.lit("").alias("section"), F.lit(0).alias("pos"), tidy("value").alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(raw: bytes) -> str:
    """Paragraphs, then table rows with cells joined by ` | `."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    para = lambda p: "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
    lines = [para(p) for p in body.findall(f"{_W}p")]
    lines += [" | ".join(" ".join(filter(None, map(para, c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")) for r in body.iter(f"{_W}tr")]
    return "\n\n".join(x for x in lines if x)


def xlsx_text(raw: bytes) -> str:
    """Each sheet: its name, its columns (a missing name is colN) and at most ROW_CAP rows."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = set(z.namelist())
    strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    out = []
    for k, title in enumerate(titles, 1):
        grid = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for c in row:
                col = 0
                for ch in re.match("[A-Z]+", c.get("r", "A1"))[0]:
                    col = col * 26 + ord(ch) - 64
                v, inline = c.find(f"{_S}v"), "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells[col - 1] = inline if v is None else strings[int(v.text)] if c.get("t") == "s" else v.text or ""
            grid.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        if not grid:
            continue
        head = [h or f"col{i + 1}" for i, h in enumerate(grid[0])]
        out += [f"Sheet: {title}", f"Columns: {', '.join(head)}"]
        out += ["; ".join(f"{h}: {v}" for h, v in zip(head, r, strict=False) if v) for r in grid[1 : ROW_CAP + 1]]
        if len(grid) - 1 > ROW_CAP:
            out.append(f"... {len(grid) - 1 - ROW_CAP} more rows")
    return "\n".join(x for x in out if x)


def packed_reader(convert: Callable[[bytes], str]) -> Callable[[SparkSession, str], DataFrame]:
    """A reader of files that `convert` turns into text; a file it can't read gives no rows and stops nothing."""

    def read(spark: SparkSession, path: str) -> DataFrame:
        ship(spark)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for file, raw in zip(b["path"], b["content"], strict=True):
                    name = re.sub(r"[^A-Za-z0-9_-]+", "-", PurePosixPath(file).stem)[:40]
                    try:
                        parts = [p.strip() for p in re.split(r"\n\s*\n", convert(bytes(raw)))]
                    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                        continue
                    rows += [(name, name, "", i, p) for i, p in enumerate(p for p in parts if p)]
                yield pd.DataFrame(rows, columns=["doc_no", "title", "section", "pos", "text"])

        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)

    return read


HANDLERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".md": read_markdown, ".markdown": read_markdown, ".txt": read_text, ".html": read_html, ".htm": read_html, ".csv": read_table,
    ".tsv": lambda spark, path: read_table(spark, path, "\t"), ".json": read_json_document, ".docx": packed_reader(docx_text), ".xlsx": packed_reader(xlsx_text),
}


def register(suffix: str, handler: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add or replace the reader of a suffix, such as .pdf or .png."""
    HANDLERS[suffix.lower()] = handler


def supported() -> list[str]:
    return sorted(HANDLERS)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a file or a glob of files of one suffix."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in HANDLERS:
        raise ValueError(f"no reader for {suffix or path}; there are {', '.join(supported())}")
    return HANDLERS[suffix](spark, path)


def load_corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Chunks of all files in order of their paths; chunk_pos numbers them through each document."""
    rows = None
    for p in sorted(paths):
        part = read_document(spark, p)
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy("doc_no").orderBy("pos", "section")
    return rows.withColumn("chunk_pos", F.row_number().over(order) - 1)
