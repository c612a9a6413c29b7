import gzip
import hashlib
import io

from larder.llm import warc

SCHEMA = "page_id long, url string, html string, refers_to string, payload string"


def _pages():
    long = "<p>" + "é日" * 60 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://a", long), (3, "http://b\r\nX: y", long), (9, None, long), (7, "u", "short"), (8, "u", "short"), (10, "u", None), (11, "u", ""), (None, "u", long), (12, "u", "x" * 99), (13, "u", "x" * 99)]
    rows += [(20, "u", "y" * 300_000), (21, "u", "y" * 300_000), (21, "u", "y" * 300_000), (21, "u", "z" * 100), (-4, "u", "z" * 100)]
    return [(*r, "clash", "clash") for r in rows]


def _expected(rows):
    known = {}
    for page, _, html, *_ in rows:
        if html and len(html.encode()) >= 100 and page is not None:
            known[html] = min(known.get(html, page), page)
    out = []
    for page, _, html, *_ in rows:
        html = html or ""
        first = known.get(html)
        again = first is not None and page != first
        out.append((page, len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def test_round_trip(spark):
    rows = _pages()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [tuple(r) for r in warc.archive_pages(frame).collect()]
    assert sorted(found, key=str) == sorted(_expected(rows), key=str)


def test_payloads_survive(spark, tmp_path):
    rows = _pages()
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"), records_per_file=4)
    read = warc.read_archives(spark, str(tmp_path / "a"), keep_payload=True).collect()
    assert len(read) == len(rows)
    assert {r.payload for r in read if r.record_type == "response"} == {r[2] or "" for r in rows}
    assert all(r.stated_digest == r.payload_digest for r in read if r.record_type == "response")


def test_other_peoples_archives():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    members = gzip.compress(record) + gzip.compress(record)
    assert [b for _, b in warc.parse_records(gzip.GzipFile(fileobj=io.BytesIO(members)))] == [b"hello"] * 2


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
