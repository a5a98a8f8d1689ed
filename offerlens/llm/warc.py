"""WARC archives of pages, and revisit resolution by payload digest.

Archives are gzip files written by Spark, one record after the other. They are read as a stream of
bytes: a record's length comes from its header, so payloads may hold anything, line ends and whole
WARC records included. A gzip file is read by one task, as archives are; `per_file` bounds its
records.

Resolution shuffles headers alone. Of equal payloads the record of least page_id is the original;
minima are taken per task first, so a payload that a third of all pages share does not gather.
The others become revisit records, which refer to it, with headers of their own and no payload.

Defined results: a null html is an empty payload; a null url has no target URI; a null page_id
comes after all numbers; of repeated rows of one page the first written is the original, and the
others refer to the same page_id.
"""

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.sources.scratch import materialise, scratch_dir

LINE, GAP = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PAGE = "urn:x-page:"
#: Revisit rows that a broadcast may hold, at about 100 bytes each.
BROADCAST_REVISITS = 100_000

HEADER = "file string, at bigint, page_id bigint, uri string, kind string, digest string, payload_bytes bigint, refers_to bigint"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hex digits are 20 bits and give 4 letters."""
    digits = F.sha1(payload)
    letters = []
    for group in range(8):
        number = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(number, shift).bitwiseAND(F.lit(31))
            letters.append(F.substr(F.lit(BASE32), at + 1, F.lit(1)))
    return F.concat(*letters)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{PAGE}"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit("")) for name, value in fields])


def _record(kind: str, page_id: Column, uri: Column, digest: Column, length: Column, payload: Column, *more: tuple[str, Column]) -> Column:
    """One record without the gap that ends it."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        length.cast("string"),
        F.lit(GAP),
    )
    block = F.concat(http, payload)
    head = _lines(
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        *more,
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(F.lit(f"WARC/1.1{LINE}"), head, F.lit(LINE), block)


def _write(records: DataFrame, path: str, per_file: int) -> None:
    writer = records.write.option("lineSep", GAP).option("compression", "gzip")
    writer.option("maxRecordsPerFile", per_file).text(path)


def write_archives(pages: DataFrame, path: str, per_file: int = 20_000) -> None:
    """A response record per row of (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), uri.alias("uri"), payload.alias("payload"),
        base32_sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).alias("length"),
    )
    _write(rows.select(_record("response", *map(F.col, ("page_id", "uri", "digest", "length", "payload")))), path, per_file)


class _Stream:
    """Cuts the bytes of an archive into records."""

    def __init__(self, file: str):
        self.file, self.data, self.at = file, bytearray(), 0

    def records(self) -> Iterator[tuple]:
        start = 0
        while (end := self.data.find(b"\r\n\r\n", start)) >= 0:
            head = self.data[start:end].decode().split(LINE)
            if not head[0].startswith("WARC/"):
                raise ValueError(f"no record where one should start, in {self.file}")
            fields = dict(line.split(": ", 1) for line in head[1:])
            body = end + 4
            stop = body + int(fields["Content-Length"])
            if len(self.data) < stop + 4:
                break
            yield self._row(fields, bytes(self.data[body:stop]))
            start = stop + 4
        del self.data[:start]

    def _row(self, fields: dict[str, str], block: bytes) -> tuple:
        self.at += 1
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(http.rpartition(b"Content-Length: ")[2])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if found != digest or len(payload) != length:
                raise ValueError(f"damaged payload of {fields['WARC-Record-ID']} in {self.file}")
        return (
            self.file, self.at, _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"],
            digest, length, _page(fields.get("WARC-Refers-To")), payload,
        )

    def close(self) -> None:
        if self.data.strip(b"\r\n"):
            raise ValueError(f"the last record of {self.file} is cut off")


def _page(record_id: str | None) -> int | None:
    number = record_id.strip("<>").removeprefix(PAGE) if record_id else "none"
    return None if number == "none" else int(number)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The header of every record, and where it is; with the payload as text if asked for."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [part.split(" ")[0] for part in HEADER.split(", ")] + ["payload"]
    used = len(names) if payload else len(names) - 1

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = None
        for batch in batches:
            rows, size = [], 0
            for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist()):
                if stream is None or stream.file != file:
                    if stream:
                        stream.close()
                    stream = _Stream(file)
                stream.data += piece
                stream.data += b"\r\n\r\n"
                for row in stream.records():
                    rows.append(row[:used])
                    size += len(row[-1])
                if size > 16 << 20:
                    yield as_batch(rows)
                    rows, size = [], 0
            yield as_batch(rows)
        if stream:
            stream.close()

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * used
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names[:used])

    pieces = spark.read.option("lineSep", GAP).text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("piece")
    )
    return pieces.mapInArrow(parsed, HEADER + (", payload binary" if payload else ""))


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(file, at) of every record to be turned into a revisit, with page_id and URI of its original."""
    able = headers.filter(F.col("payload_bytes") >= least_bytes)
    order = F.struct(F.col("page_id").isNull(), "page_id", "file", "at", "uri").alias("first")
    originals = able.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    both = able.select("file", "at", "digest").join(originals, "digest")
    return both.filter("file <> first.file OR at <> first.at").select(
        "file", "at", F.col("first.page_id").alias("to_page"), F.col("first.uri").alias("to_uri")
    )


def deduplicate(spark: SparkSession, path: str, to: str, least_bytes: int = 0, per_file: int = 20_000) -> None:
    """Write the archives anew, with equal payloads stored once."""
    headers = materialise(read_archives(spark, path))
    revisits = materialise(resolve(headers, least_bytes).withColumn("again", F.lit(True)))
    # the number of revisits is known; more than fit a broadcast are joined by a shuffle
    side = F.broadcast(revisits) if revisits.count() <= BROADCAST_REVISITS else revisits
    rows = read_archives(spark, path, payload=True).join(side, ["file", "at"], "left")
    page_id, uri, digest, length = map(F.col, ("page_id", "uri", "digest", "payload_bytes"))
    revisit = _record(
        "revisit", page_id, uri, digest, length, F.lit(""),
        ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _record_id(F.col("to_page"))),
        ("WARC-Refers-To-Target-URI", F.col("to_uri")), ("WARC-Refers-To-Date", F.lit(DATE)),
    )
    response = _record("response", page_id, uri, digest, length, F.decode("payload", "UTF-8"))
    _write(rows.select(F.when(F.col("again"), revisit).otherwise(response)), to, per_file)


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Headers of the deduplicated archives of the pages, and the folder that holds them."""
    spark = pages.sparkSession
    first, second = scratch_dir(spark), scratch_dir(spark)
    write_archives(pages, first)
    deduplicate(spark, first, second, least_bytes)
    return read_archives(spark, second), second
