import base64
import gzip
import hashlib

import pytest

from vectables.llm import warc
from vectables.llm.store import Workspace

ROWS = [(1, "http://a.example.org/x?q=1", "<p>é</p>"), (2, None, None), (3, "https://b.example.org", ""), (4, "x\r\ny://h/p", "<p>é</p>"),
        (5, "http://c/", "two\r\n\r\nlines WARC/1.1\r\n\r\n"), (None, "http://d/", "<p>é</p>"), (6, "http://e/", "z" * 300_000), (7, "http://f/", "z" * 300_000),
        (3, "https://b.example.org", "")]
PAGES = "page_id long, url string, html string, id long, uid string, digest string, capture string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 9, "u", "d", "c") for r in ROWS], PAGES).repartition(2)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(pages, least):
    got = warc.captures(pages, "page_id", "url", "html", least).collect()
    first = {}
    for i, _, html in ROWS:
        if i is not None and len((html or "").encode()) >= least:
            first[digest(html)] = min(i, first.get(digest(html), i))
    want = []
    for i, url, html in ROWS:
        f = first.get(digest(html)) if i is not None else None
        again = f is not None and f != i
        want.append((str(i), None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"), len((html or "").encode()), digest(html),
                     "revisit" if again else "response", f if again else None, None if again else (html or "").encode()))
    have = [(str(r["metadata"]["id"]), r["response"]["url"], r["response"]["payload_bytes"], r["response"]["payload_digest"], r["response"]["type"],
             r["response"]["refers_to"], None if r["response"]["payload"] is None else bytes(r["response"]["payload"])) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
    assert all(r["response"]["status"] == 200 and r["request"]["request"].startswith("GET /") for r in got)


def test_archives_are_records_ended_by_two_line_breaks(spark, pages):
    space = Workspace(spark, "warc-test")
    warc.write(pages, "page_id", "url", "html", space.path("archives"), space)
    raw = b"".join(gzip.decompress(bytes(r["content"])) for r in spark.read.format("binaryFile").load(space.path("archives")).collect())
    at = kinds = 0
    while at < len(raw):
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        at += len(head) + 4 + size
        assert raw[at: at + 4] == b"\r\n\r\n"
        at += 4
        kinds += 1
    assert kinds == 3 * len(ROWS)


def test_no_pages(spark):
    assert warc.captures(spark.createDataFrame([], PAGES), "page_id", "url", "html").collect() == []


def test_large_pages_are_few_to_a_file(spark):
    """Pages of 1 MB beside small ones: files are cut by bytes, and every capture comes back whole."""
    rows = [(i, f"http://h/{i}", f"{i} " + "ab" * (600_000 if i % 4 == 0 else 40_000 if i % 4 == 1 else 5)) for i in range(240)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    space = Workspace(spark, "warc-large")
    warc.write(pages, "page_id", "url", "html", space.path("archives"), space)
    files = spark.read.format("binaryFile").load(space.path("archives")).select("content").collect()
    sizes = [len(gzip.decompress(bytes(f["content"]))) for f in files]
    assert max(sizes) < 40 << 20 and len(sizes) >= 10
    got = {r["response"]["url"]: bytes(r["response"]["payload"]).decode() for r in warc.assemble(warc.read(spark, space.path("archives"))).collect()}
    assert got == {url: html for _, url, html in rows}


def test_inflating_holds_one_step(monkeypatch):
    import pyarrow as pa

    parts = [b"x" * 3_000_000, b"", b"\r\n\r\n" * 7, bytes(range(256)) * 5000]
    raw = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(p), p) for p in parts)
    for step in (1000, 1 << 20):
        monkeypatch.setattr(warc, "STEP", step)
        for content in (gzip.compress(raw), gzip.compress(raw[:1_234_567]) + gzip.compress(raw[1_234_567:])):
            pieces = list(warc._inflated(pa.py_buffer(content)))
            assert max(map(len, pieces)) <= step and [b for _, b in warc._records(iter(pieces))] == parts
    with pytest.raises(ValueError):
        list(warc._records(iter([raw[:-10]])))
