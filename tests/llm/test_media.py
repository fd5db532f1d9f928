import hashlib
import zlib

import numpy as np
import pytest

from basalt.llm import media

from .conftest import document_rows


def test_round_trip(spark, docs, no_docs):
    got = media.load(media.store(docs)).collect()
    want = sorted(((i is None, i or 0, media.payload_of(t or "")) for i, t in document_rows()))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, (bytes(r["payload"]), r["n_bytes"])) for r in got)) == want
    for r in got:
        assert len(r["payload"]) % 576 == 0 and bytes(r["media"]) == media.header_of(len(r["payload"])) + bytes(r["payload"])
    assert media.store(no_docs).count() == 0


def test_equal_chunks_are_stored_once(spark, docs):
    rows = media.store(docs).select("chunks").collect()
    places = {}
    for r in rows:
        for c in r["chunks"]:
            places.setdefault(bytes(c["digest"]), set()).add((c["pack"], c["offset"]))
    assert all(len(p) == 1 for p in places.values())


def test_cuts_depend_on_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    cut = lambda x: {hashlib.sha1(x[a:b]).hexdigest() for a, b in zip([0, *media.cut_points(x)], media.cut_points(x), strict=False)}
    one, two = cut(data), cut(data[:100] + b"inserted" + data[100:])
    assert len(one & two) > 0.8 * len(one)
    assert media.cut_points(data)[-1] == len(data)
    sizes = np.diff([0, *media.cut_points(b"a" * 50_000)])
    assert sizes.max() <= media.MAX_CHUNK


def test_gear_is_the_rolling_sum():
    data = np.frombuffer(bytes(range(200)), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (h * 2 + int(media.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert media.gear(data).tolist() == want


def test_damage_is_found(spark, tmp_path):
    stored = media.store(spark.createDataFrame([(1, "some text " * 200)], "doc_id bigint, text string"))
    row = stored.collect()[0]
    pack = row["store"].removeprefix("file://") + "/" + row["chunks"][0]["pack"]
    with open(pack, "r+b") as f:
        f.seek(row["chunks"][0]["offset"] + 12)
        f.write(b"\xff\xff\xff")
    with pytest.raises(Exception):  # noqa: B017
        media.load(stored).collect()


def test_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = dict(document_rows())
    for r in media.query(spark, str(tmp_path)).where("doc_id is not null").collect():
        payload, n = media.payload_of(texts[r["doc_id"]] or "")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] == len(media.header_of(len(payload))) + len(payload)
