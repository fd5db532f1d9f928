"""A folder with every kind of file, one broken file of each kind among them."""

import json
import zipfile

import pytest

from basalt.sources import folder as D

FILES = {
    "sops/SOP-1.md": "---\ndoc_no: SOP-1\ntitle: Bearings\nrevision: B\n---\nIntro\n\n## Steps\nDo it.\n\n## Empty\n\n",
    "manuals/pump.md": "Plain text\n## One\nx",
    "uploads/notes.txt": "first\n\n## Second\nmore",
    "uploads/page.html": "<p>one</p><p>two &amp; three</p>",
    "uploads/data.tsv": "a\tb\n1\t\n2\t3\n",
    "uploads/data.json": '{"k": [1, 2]}',
    "uploads/photo.png": "not read",
    "uploads/.hidden": "x",
    "assets/p-101/metadata.json": '{"asset_id": "p-101", "type": "pump"}',
    "assets/p-101/report.md": "All is well",
    "pid/area1.json": json.dumps({"nodes": [{"tag": "P-101", "type": "pump"}, {"id": "V-2"}], "edges": [{"from": "P-101", "to": "V-2"}]}),
    "sensors_p101.csv": "timestamp,vibration_mm_s,bearing_temp_c,discharge_pressure_bar\n2024-01-01 00:00:00,1.5,60,4\n",
    "spares.csv": "part_no,stock\nBRG-1,3\n",
    "maintenance_log.csv": "wo_number,tag,date,action_taken\nWO-1,P-101,2024-01-01,oil\nWO-2,P-102,2024-01-02,seal\n",
    "maintenance_events.json": json.dumps([{"work_order": "WO-2", "asset_id": "P-102", "work_performed": "new seal", "confidence": 0.9}, {"work_order": "WO-3", "asset_id": "P-103"}, {"asset_id": "P-104"}]),
}
BROKEN = {
    "pid/broken.json": "{", "sensors_broken.csv": "timestamp,vibration_mm_s\nx,abc\n", "spares_broken.csv": "a,b\n1,2\n", "maintenance_log_broken.csv": "", "maintenance_events_broken.json": '{"x": 1}', "assets/q/metadata.json": "[",
    "uploads/broken.docx": "no zip", "uploads/broken.xlsx": "no zip", "uploads/broken.json": "{oops", "uploads/broken.csv": 'a\n"open', "uploads/broken.md": b"\xff\xfe\xff", "uploads/broken.html": b"\xff\xff",
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("mixed")
    for name, text in (FILES | BROKEN).items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    with zipfile.ZipFile(root / "uploads/letter.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Dear all</w:t></w:r></w:p></w:body></w:document>')
    return D.read_folder(spark, str(root)).cache()


def test_broken_files_are_told_and_stop_nothing(rows):
    got = {r["file"]: r["error"] for r in D.errors(rows).collect()}
    assert set(got) == {*BROKEN, "uploads/photo.png"} and got["uploads/photo.png"] == "no reader for .png"
    assert rows.rdd.getNumPartitions() == len(FILES) + len(BROKEN)  # a partition for each file that is no hidden one, the letter among them


def test_documents(rows):
    got = {(r["doc_no"], r["chunk_pos"]): r for r in D.chunks(rows).collect()}
    texts = {k: (r["section"], r["text"]) for k, r in got.items()}
    assert texts == {
        ("SOP-1", 0): ("Preamble", "Intro"), ("SOP-1", 1): ("Steps", "Do it."), ("pump", 0): ("Preamble", "Plain text"), ("pump", 1): ("One", "x"), ("notes", 0): ("Preamble", "first"), ("notes", 1): ("Second", "more"),
        ("page", 0): ("", "one\n\ntwo & three"), ("data", 0): texts["data", 0], ("ASSET-P-101-report", 0): ("Preamble", "All is well"), ("letter", 0): ("", "Dear all"),
    }
    assert got["SOP-1", 0]["revision"] == "B" and not got["SOP-1", 0]["uploaded"]
    assert got["notes", 0]["uploaded"] and got["notes", 0]["revision"] == "uploaded"
    assert (got["ASSET-P-101-report", 0]["generated"], got["ASSET-P-101-report", 0]["asset_id"]) == (True, "P-101")
    tables = {r["text"] for r in D.chunks(rows).where("doc_no = 'data'").collect()}
    assert tables == {"Columns: a, b\na: 1\na: 2; b: 3", '{\n  "k": [\n    1,\n    2\n  ]\n}'}


def test_plant_records(rows):
    assert [tuple(r)[2:] for r in D.sensors(rows).collect()] == [(1.5, 60.0, 4.0)]
    assert [r["part_no"] for r in D.spares(rows).collect()] == ["BRG-1"]
    nodes, edges = D.topology(rows)
    assert sorted(r["id"] for r in nodes.collect()) == ["P-101", "V-2"] and [tuple(r) for r in edges.collect()] == [("P-101", "V-2", "CONNECTED_TO")]
    assert [(r["key"], r["fields"]["type"]) for r in rows.where("kind = 'asset'").collect()] == [("P-101", "pump")]


def test_events_lie_over_the_log(rows):
    got = {r["wo_number"]: (r["extracted"], r["fields"].get("tag"), r["fields"].get("action_taken")) for r in D.maintenance(rows).collect()}
    assert got == {"WO-1": (False, "P-101", "oil"), "WO-2": (True, "P-102", "new seal"), "WO-3": (True, "P-103", None), None: (True, "P-104", None)}
