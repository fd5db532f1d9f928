import io
import json
import zipfile

import pytest

from basalt.sources import readers, sinks
from basalt.streaming import telemetry as S

from .conftest import SF


def rows(df):
    return sorted((r["doc_no"], r["section"], r["pos"], r["text"]) for r in df.collect())


def test_readers(spark, tmp_path):
    (tmp_path / "sop.md").write_text("---\ndoc_no: SOP-1\ntitle: Bearing\ngoverns: [P-101, P-102]\n---\nIntro\n\n## Steps\nDo it\n## Safety\nTake care")
    (tmp_path / "a.txt").write_text("one\n\ntwo\n\n\n")
    (tmp_path / "p.html").write_text("<style>x</style><p>One &amp; two<p>three <b>four</b><br>five")
    (tmp_path / "t.csv").write_text("name,qty\nbolt,3\nnut,\n")
    (tmp_path / "j.json").write_text('{"a":[1,2]}')
    assert rows(readers.read_document(spark, str(tmp_path / "sop.md"))) == [("SOP-1", "Preamble", 0, "Intro"), ("SOP-1", "Safety", 2, "Take care"), ("SOP-1", "Steps", 1, "Do it")]
    assert rows(readers.read_document(spark, str(tmp_path / "a.txt"))) == [("a", "", 0, "one"), ("a", "", 1, "two")]
    assert [r[3] for r in rows(readers.read_document(spark, str(tmp_path / "p.html")))] == ["One & two", "three four", "five"]
    assert rows(readers.read_document(spark, str(tmp_path / "t.csv")))[0][3] == "Columns: name, qty\nname: bolt; qty: 3\nname: nut"
    assert rows(readers.read_document(spark, str(tmp_path / "j.json")))[0][3] == json.dumps({"a": [1, 2]}, indent=2)
    both = readers.load_corpus(spark, [str(tmp_path / "a.txt"), str(tmp_path / "sop.md")])
    assert both.count() == 5 and {r["chunk_pos"] for r in both.where("doc_no = 'SOP-1'").collect()} == {0, 1, 2}


def test_packed_readers(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "d.docx").write_bytes(docx.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    assert [r[3] for r in rows(readers.read_document(spark, str(tmp_path / "*.docx")))] == ["Hello", "a | b"]
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = io.BytesIO()
    with zipfile.ZipFile(xlsx, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>name</t></si><si><t>bolt</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"/></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>')
    assert readers.xlsx_text(xlsx.getvalue()) == "Sheet: S\nColumns: name, col2, col3\nname: bolt; col3: 5"


def test_registry(spark):
    assert ".md" in readers.supported() and ".pdf" not in readers.supported()
    with pytest.raises(ValueError, match="no reader"):
        readers.read_document(spark, "x.pdf")
    readers.register(".pdf", readers.packed_reader(lambda raw: raw.decode()))
    assert ".pdf" in readers.supported()
    del readers.HANDLERS[".pdf"]


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "events")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, created_at string")
    sinks.upsert(frame([(1, "a", "t0"), (2, "b", "t0")]), p, "k")
    sinks.upsert(frame([(2, "B", "t1"), (3, "C", "t1")]), p, "k")
    assert sorted(map(tuple, spark.read.parquet(p).collect())) == [(1, "a", "t0"), (2, "B", "t0"), (3, "C", "t1")]
    sinks.append_missing(frame([(3, "x", "t2"), (4, "D", "t2"), (4, "D", "t2")]), p, "k")
    sinks.delete(spark, p, "k", 1)
    assert sorted(r["k"] for r in spark.read.parquet(p).collect()) == [2, 3, 4]
    sinks.trace(frame([(1, "a", "t")]), str(tmp_path / "trace"))
    assert spark.read.json(str(tmp_path / "trace")).count() == 1


def test_late_rows_and_batches(spark, tmp_path):
    """Two batches give the same running state as one."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    first, second = str(tmp_path / "in"), events.schema
    events.where("event_id % 2 = 0").coalesce(1).write.mode("append").parquet(first)
    out = str(tmp_path / "run")
    S.drain(S.running(S.read(spark, first, second)), "update", out)
    events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(first)
    rows = S.drain(S.running(S.read(spark, first, second)), "update", out)
    n = {r["user_id"]: r["n"] for r in rows.groupBy("user_id").agg({"n": "max"}).withColumnRenamed("max(n)", "n").collect()}
    assert n == {r["user_id"]: r["count"] for r in events.groupBy("user_id").count().collect()}
