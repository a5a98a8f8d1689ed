import base64
import glob
import gzip
import hashlib

from llm.tables import shown

from offerlens.llm import warc
from offerlens.sources.scratch import scratch_dir

PAGES = "page_id bigint, url string, html string, digest string, file string"
WEIRD = [
    "", "\r\n\r\n", "ends\r\n", "ends\r\n\r\n", "\r\n\r\nstarts", "a\r\n\r\nb\r\n\r\n\r\n\r\nc", "\r", "\n", "lone \r\n\r",
    "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "ünï 中文 😀 \x00\x1c", "x" * 300_000,
]


def pages(spark):
    rows = [(i + 1, f"http://a.example/{i}", html) for i, html in enumerate(WEIRD)]
    rows += [(100 + i, "http://b.example/\r\nWARC-Type: x", "copied page") for i in range(30)]
    rows += [(50, None, "copied page"), (60, "http://c.example", None), (61, "http://c.example", "")]
    rows += [(None, "u", "no id"), (None, "u", "no id"), (70, "u", "no id"), (80, "r", "twice"), (80, "r", "twice")]
    return rows, spark.createDataFrame([(*row, "d", "f") for row in rows], PAGES)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least=0):
    first, out = {}, []
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        html = html or ""
        size = len(html.encode())
        revisit = size >= least and html in first
        refers = first[html] if revisit else None
        out.append((page_id, size, digest(html), "revisit" if revisit else "response", refers))
        if size >= least:
            first.setdefault(html, page_id)
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "digest", "kind", "refers_to")


def test_archives_come_back_with_equal_payloads_stored_once(spark):
    rows, df = pages(spark)
    headers, path = warc.archive_pages(df)
    assert shown(headers, *COLUMNS) == expected(rows)
    payloads = warc.read_archives(spark, path, payload=True).filter("kind = 'response'")
    stored = sorted(bytes(r.payload).decode() for r in payloads.collect())
    assert stored == sorted({html or "" for _, _, html in rows})
    headers, _ = warc.archive_pages(df, least_bytes=5)
    assert shown(headers, *COLUMNS) == expected(rows, 5)


def test_archives_follow_the_format(spark):
    _, df = pages(spark)
    _, path = warc.archive_pages(df.filter("page_id >= 100 OR page_id = 6"))
    seen = []
    for name in glob.glob(f"{path.removeprefix('file://')}/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size = int(fields["Content-Length"])
            block, data = rest[:size], rest[size:]
            assert data[:4] == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n")
            data = data[4:]
            seen.append(fields)
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n")
                assert fields["WARC-Refers-To"] == "<urn:x-page:100>" and "\r" not in fields["WARC-Refers-To-Target-URI"]
    assert sorted(f["WARC-Type"] for f in seen) == ["response"] * 2 + ["revisit"] * 29


def test_records_are_spread_over_bounded_files_and_empty_tables_work(spark):
    rows, df = pages(spark)
    path = scratch_dir(spark)
    warc.write_archives(df.coalesce(1), path, per_file=7)
    assert len(glob.glob(f"{path.removeprefix('file://')}/*.gz")) == -(-len(rows) // 7)
    assert warc.read_archives(spark, path).count() == len(rows)
    assert warc.archive_pages(df.limit(0))[0].count() == 0


def test_many_revisits_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 3)
    rows, df = pages(spark)
    assert shown(warc.archive_pages(df)[0], *COLUMNS) == expected(rows)
