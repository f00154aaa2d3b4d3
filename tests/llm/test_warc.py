import base64
import gzip
import hashlib

import pytest

from framelode.llm import warc


def plain(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and i < first.get(html or "", 1 << 62):
            first[html or ""] = i
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(html or "")
        again = i is not None and to != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://host.example/{i}?a=b c&é", f"<p>{i % 7} é</p>\r\n\r\n\n" * (i % 5)) for i in range(200)]
ROWS += [(500, None, None), (501, "", ""), (502, "x y\nz", "HTTP/1.1 200 OK\r\n\r\nnested WARC/1.0\r\n\r\n"), (503, "http://a/", "x" * 300_000), (3, "http://b/", ROWS[3][2]), (None, "http://c/", "only here"), (None, "http://c/", ROWS[3][2])]


@pytest.mark.parametrize(("share", "few"), [(1000, 250_000), (3, 250_000), (1000, 5)])
def test_pages_through_both_archives(spark, tmp_path, monkeypatch, share, few):
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    monkeypatch.setattr(warc, "FILE_RECORDS", 13)
    spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, refers_to string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((tuple(r) for r in warc.op7_warc(spark, str(tmp_path)).collect()), key=str) == plain(ROWS)


def test_files_are_gzip_of_whole_records(spark, tmp_path):
    warc.write(spark.createDataFrame(ROWS[:50], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    seen = {}
    for f in (tmp_path / "w").glob("*.gz"):
        for fields, block in warc.warc_records(gzip.decompress(f.read_bytes())):
            seen[int(fields["x-page-id"])] = fields, block
    assert len(seen) == 50
    fields, block = seen[8]
    assert fields["warc-type"] == "response" and block == b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + ROWS[8][2].encode()
    assert fields["warc-date"] == "2000-01-01T00:00:00Z" and fields["warc-target-uri"] == "http://host.example/8?a=b%20c&%C3%A9"
    assert len({f["warc-record-id"] for f, _ in seen.values()}) == 50


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_version(version):
    records = [("http://a/", b"HTTP/1.0 200 OK\r\n\r\nbody\n\n"), ("http://b/?q=x", b""), ("http://with space/", b"no head\nhttp://c/ 0.0.0.0 20000101000000 text/html 3\nabc")]
    data = warc.arc_file(version, records)
    found = list(warc.arc_records(data))
    assert [(f["URL"], c) for f, c in found] == records
    assert set(found[0][0]) == set(warc.ARC_FIELDS[version].split(" "))
    assert warc.payload_of(records[0][1])[1] == b"body\n\n" and warc.payload_of(b"plain") == (b"", b"plain")
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-20]))
    assert b"WARC-Type: resource" in warc.warc_record(found[2][0], found[2][1])


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == 0
