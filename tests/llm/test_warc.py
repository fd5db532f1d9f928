import base64
import gzip
import hashlib

import pyarrow.fs as pafs

from basalt.llm import shared, warc

PAGES = [
    (1, "http://www.example.com/a?b=1", "<p>one</p>"), (2, "https://example.org:8443/x", "<p>two é</p>"), (3, "http://www.example.com/a?b=1", "<p>one</p>"), (4, None, "<p>one</p>"),
    (5, "http://www.example.com/", None), (6, "not a url\r\nX: y", ""), (7, "http://[bad", "<p>seven</p>"), (None, "http://n.example/", "<p>one</p>"), (2, "https://example.org:8443/x", "<p>two é</p>"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, id int, digest string").repartition(3)


def run(spark, pages, **kw):
    folder = shared.new_dir(spark, "warc-test")
    captures = warc.write(pages, folder, **kw)
    return folder, captures, warc.read(pages, folder, warc.build_index(captures, folder))


def test_every_page_comes_back(spark):
    folder, captures, back = run(spark, frame(spark))
    got = back.collect()
    assert len(got) == len(PAGES)
    html = dict((i, h) for i, _, h in PAGES)
    for r in got:
        body = (html[r["page_id"]] or "").encode()
        assert bytes(r["payload"]) == body and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
    kind = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kind == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("revisit", 1), 5: ("response", None), 6: ("revisit", 5), 7: ("response", None), None: ("response", None)}


def test_archives_are_gzip_members_of_whole_records(spark):
    folder, captures, _ = run(spark, frame(spark))
    fs, base = shared.open_fs(folder)
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".warc.gz")]
    text = b"".join(gzip.decompress(fs.open_input_file(n).read()) for n in names)
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and text.count(b"WARC-Type: revisit") == 3


def test_least_size(spark):
    _, _, back = run(spark, frame(spark), least=5)
    assert {r["page_id"]: r["record_type"] for r in back.collect()}[6] == "response"


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = [(i, f"http://h{i % 3}.example/{i % 5}", f"<p>{i % 20}</p>") for i in range(60)]
    _, _, back = run(spark, frame(spark, rows))
    got = {r["page_id"]: (bytes(r["payload"]).decode(), r["refers_to"]) for r in back.collect()}
    assert got == {i: (f"<p>{i % 20}</p>", i % 20 if i >= 20 else None) for i in range(60)}


def test_no_pages(spark):
    _, captures, back = run(spark, frame(spark).limit(0))
    assert captures.count() == 0 and back.count() == 0


def test_keys():
    assert warc.surt("https://www.Example.com:443/a?b") == "com,example,www)/a?b"
    assert warc.surt("http://example.com:8080") == "com,example:8080)/" and warc.surt(None) == ""
