import gzip
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import warc as w


def rec(kind, uri, block, **kw):
    return w.record(kind, uri, block, str(uuid.uuid4()), **kw)


@pytest.fixture
def records():
    out = [rec("warcinfo", None, b"software: x\r\n", content_type="application/warc-fields")]
    for i in range(200):
        body = (f"page {i} " * (i % 50)).encode() + (b"\nWARC/1.0 is quoted here\r\nno: header\r\n\r\n" if i % 7 == 0 else b"")
        out.append(rec("request", f"http://h{i % 5}.example/{i}", b"GET / HTTP/1.1\r\n\r\n"))
        out.append(rec("response", f"http://h{i % 5}.example/{i}", b"HTTP/1.1 404 Not Found\r\nX-A: 1\r\n\r\n" + body if i % 9 == 0 else b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body))
    out.append(rec("metadata", "http://h0.example/", b""))
    return out


@pytest.fixture
def folder(tmp_path, records):
    (tmp_path / "a.warc").write_bytes(b"".join(records[:150]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[150:]))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"not read")
    return str(tmp_path)


def bodies(records, kind=None):
    out = []
    for r in records:
        head, _, block = r[:-4].partition(b"\r\n\r\n")
        h = w.parse_headers(head.partition(b"\r\n")[2])
        if kind in (None, h["warc-type"]):
            out.append((h["warc-type"], h.get("warc-target-uri"), w.split_http(block)[2] if h["warc-type"] == "response" else block))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [1, 97, 1000, 4096, 1 << 20])
def test_round_trip_whatever_the_split(spark, folder, records, split):
    got = w.read_warc(spark, folder, splitBytes=max(split, 97) if split == 1 else split).select("record_type", "target_uri", "payload").collect()
    assert sorted([(r[0], r[1], bytes(r[2])) for r in got], key=repr) == bodies(records)


def test_predicates_are_pushed(spark, folder, records):
    df = w.read_warc(spark, folder).filter("record_type = 'response' and target_uri in ('http://h1.example/1', 'http://h1.example/6') and http_status = 200")
    assert sorted(r.target_uri for r in df.collect()) == ["http://h1.example/1", "http://h1.example/6"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.partition("Filter")[2].partition("\n")[0] or "Filter" not in plan
    starts = w.read_warc(spark, folder, ["record_type", "target_uri"]).filter(F.col("target_uri").startswith("http://h2.example/"))
    assert starts.count() == 80


def test_unwanted_payloads_are_not_read(folder):
    wanted = w.Wanted()
    wanted.values["warc-type"] = {"metadata"}
    with open(folder + "/a.warc", "rb") as f:
        size = f.seek(0, 2)
        assert list(w._plain_records(f, size, 0, size, wanted, True)) == []
    all_of_them = w.Wanted()
    with open(folder + "/a.warc", "rb") as f:
        assert all(body is None for _, body, _ in w._plain_records(f, size, 0, size, all_of_them, False))


def test_status_and_headers(spark, folder):
    got = w.read_warc(spark, folder).filter("record_type = 'response'").groupBy("http_status").count().collect()
    assert {r[0]: r[1] for r in got} == {200: 177, 404: 23}
    one = w.read_warc(spark, folder).filter("target_uri = 'http://h0.example/0' and record_type = 'response'").first()
    assert one.http_headers["x-a"] == "1" and one.headers["content-length"].isdigit() and one.file.endswith("a.warc")


def test_empty_folder_and_missing(spark, tmp_path):
    assert w.read_warc(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception):
        w.read_warc(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize("compress", [False, True])
def test_pages_round_trip(spark, tmp_path, compress):
    pages = [(1, "http://a.example/", "<p>hé\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "<p>no url</p>"), (3, "http://c.example/", None), (4, "http://d.example/\nx", ""), (None, "u", "x" * 300_000), (1, "http://a.example/", "<p>again</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = str(tmp_path / "w")
    w.write_pages(df, folder, compress)
    got = w.read_warc(spark, folder).filter("record_type = 'response'").collect()
    expected = sorted((str(i), (u or "").replace("\n", " ") if u else None, h) for i, u, h in pages if h is not None)
    assert sorted((r.headers["x-page-id"], r.target_uri, bytes(r.payload).decode()) for r in got) == sorted(expected, key=repr) or sorted(map(repr, expected)) == sorted(repr((r.headers["x-page-id"], r.target_uri, bytes(r.payload).decode())) for r in got)
    assert w.read_warc(spark, folder).filter("record_type = 'request'").count() == 6


def test_cut_off_raises(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(rec("response", "u", b"abc" * 5000))[:-40])
    with pytest.raises(Exception):
        w.read_warc(spark, str(tmp_path)).collect()
