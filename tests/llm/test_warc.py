"""WARC bundles: exact round trip, random access, revisits, edge cases."""

import glob

import pytest
import zstandard

from understory.llm import warc
from understory.session import scratch_path

SCHEMA = "page_id long, url string, html string, record_id string"


def test_round_trip_and_random_access(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    rows = [(i, f"http://h/{i}\r\nX: y", f"<p>é {i % 7}</p>\r\n\r\n" * (i % 5 + 1), "x") for i in range(300)]
    rows += [(900, None, None, None), (901, "http://e", "", None), (None, "http://n", "only here", None), (902, "http://l", "long " * 400_000, None), (902, "http://l", "long " * 400_000, None)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = scratch_path(spark, "warc-test")
    records = pages.selectExpr("concat('urn:', page_id) AS record_id", "url AS target_uri", "encode(html, 'utf-8') AS payload", "CAST(NULL AS string) AS refers_to").where("record_id IS NOT NULL")
    index = warc.write_archive(records, folder, frame_bytes=500, bundle_bytes=2000)
    back = {r["record_id"]: r for r in warc.read_archive(index).collect()}
    for i, url, html, _ in rows:
        if i is not None:
            assert bytes(back[f"urn:{i}"]["payload"]).decode() == (html or "")
            assert back[f"urn:{i}"]["payload_digest"] == warc.digest_of((html or "").encode())
    places = {r["record_id"]: r for r in index.collect()}
    assert len({r["bundle"] for r in places.values()}) > 3 and any(r["frame"] > 0 for r in places.values())
    for i in (0, 17, 299, 902):
        place = places[f"urn:{i}"]
        headers, payload = warc.read_one(place["bundle"], place["frame"], place["offset"])
        assert payload.decode() == (dict((r[0], r[2]) for r in rows)[i] or "")
        assert headers["WARC-Record-ID"] == f"<urn:{i}>"
    # Any reader of the format that knows nothing of the table gets the records too: the table is a skippable frame.
    path = glob.glob(f"{folder.removeprefix('file:')}/*.warc.zst")[0]
    with open(path, "rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    at = 0
    while at < len(plain):
        _, _, at = warc.parse(plain, at)


def test_revisits(spark):
    rows = [(5, "a", "same", "x"), (3, "b", "same", None), (9, "c", "same", "x"), (3, "b", "same", None), (4, "d", "other", "x"), (None, "e", "null id", "x"), (7, "f", "null id", "x"), (8, "g", None, "x"), (6, "h", "", "x")]
    index = warc.archive_pages(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "") for r in warc.read_archive(index).collect())
    name = "urn:page:{}".format
    assert got == sorted([
        (name(3), "response", ""), (name(3), "response", ""), (name(5), "revisit", name(3)), (name(9), "revisit", name(3)), (name(4), "response", ""),
        (name("null"), "response", ""), (name(7), "revisit", name("null")), (name(6), "response", ""), (name(8), "revisit", name(6)),
    ])
    small = warc.archive_pages(spark.createDataFrame(rows, SCHEMA), at_least=5)
    assert {r["record_id"] for r in warc.read_archive(small).collect() if r["record_type"] == "revisit"} == {name(7)}


def test_empty_table_and_bad_bundle(spark, tmp_path):
    index = warc.archive_pages(spark.createDataFrame([], SCHEMA))
    assert index.count() == 0 and warc.read_archive(index).count() == 0
    path = tmp_path / "x.zst"
    path.write_bytes(b"no bundle at all, but long enough for a footer")
    with pytest.raises(ValueError):
        warc.seek_table(str(path))
