"""WARC archives: exact round trip of payloads, record types, and normalising of foreign streams."""

import gzip
import hashlib
import io

import pytest

from panelloom.llm import warc

LONG = "<p>long é</p>\r\n\r\n" * 20


@pytest.fixture(scope="module")
def rows():
    return [(1, "http://a/1", "<html>one</html>"), (2, None, None), (3, "http://a/ 3\n", ""), (4, "u", LONG),
            (9, "u", LONG), (7, "v", LONG), (None, "w", LONG), (7, "v", LONG), (11, "x", "<html>one</html>"),
            (12, "y", "z" * 700_000), (None, None, "q" * 200), (None, "", "q" * 200), (13, "b", "\r\n\r\nWARC/1.1\r\n")]


def plain(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        least = min((p for p, _, h in rows if (h or "").encode() == raw and p is not None), default=None)
        again = len(raw) >= 100 and least is not None and page != least
        out.append((page, "revisit" if again else "response", len(raw), hashlib.sha256(raw).hexdigest(),
                    least if again else None, None if again else raw))
    return sorted(out, key=repr)


@pytest.mark.parametrize("file_bytes", [200, 1 << 30])
def test_roundtrip(spark, monkeypatch, rows, file_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int")
    got = warc.roundtrip(pages.repartition(3), keep_payload=True).collect()
    assert sorted(((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"],
                    None if r["payload"] is None else bytes(r["payload"])) for r in got), key=repr) == plain(rows)


def test_light_payloads_meet_by_digest(spark, monkeypatch, rows):
    monkeypatch.setattr(warc, "HEAVY_SHARE", 0)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.roundtrip(pages).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted(
        ((p, t, f) for p, t, _, _, f, _ in plain(rows)), key=repr)


def test_foreign_archives_of_one_or_many_members(spark, tmp_path):
    records = [warc.record(i, f"http://b/{i}", b"x" * n, hashlib.sha256(b"x" * n).hexdigest(), None)
               for i, n in enumerate([0, 5, 600_000, 1])]
    whole, several = tmp_path / "whole.warc.gz", tmp_path / "several.warc.gz"
    whole.write_bytes(gzip.compress(b"".join(records)))
    several.write_bytes(gzip.compress(records[0] + records[1][:30]) + gzip.compress(records[1][30:] + records[2] + records[3]))
    files = spark.createDataFrame([(str(whole),), (str(several),)], "file string")
    index = warc.normalise(files, str(tmp_path / "out")).collect()
    assert len(index) == 8
    for line in index:
        with open(line["file"], "rb") as archive:
            archive.seek(line["offset"])
            member = gzip.decompress(archive.read(line["length"]))
        assert member in records
    for name in {line["file"] for line in index}:
        assert io.BytesIO(gzip.open(name).read()).getvalue() == b"".join(records)
        assert sum(1 for _ in open(name + ".idx")) == 4


def test_broken_stream_is_an_error(tmp_path):
    raw = gzip.compress(warc.record(1, "u", b"abc", "d", None)[:-3])
    reader = warc.Inflated(io.BytesIO(raw))
    head = reader.until(b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(reader.take(int(warc.headers(head)["content-length"]) + 4))


def test_empty_table(spark):
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
