"""WARC archives: written by the text writer, read back and assembled into captures.

Every page becomes three records: the response (or, where an earlier page has the same payload, a
revisit of it), and a request and metadata that name it by WARC-Concurrent-To. A record is one row of a
text file whose line separator is the CRLF CRLF that ends a WARC record, so Spark's own writer makes
the archives, gzipped, in the shared folder. Pages are written by size, larger ones fewer to a file (``FILES``), so a file
holds at most ``FILE_BYTES`` of payload or a single page. A file is read whole as stored, inflated ``STEP`` bytes at a time and parsed by
Content-Length, so a task holds the file's gzip, the record it is in and one batch of parsed ones; the records of a capture meet by the identifier of
its response and become one nested row.

Payloads are compared by SHA-1 and length. The least page id is a partial minimum per digest, so a payload with a
third of all pages is neither a list nor one task's group; only the ids of pages that revisit another are joined
to the pages, and that join moves no payload while they are few.

Defined cases: a null payload is empty; a null id is kept and never revisited; a null url stays null; payloads
below ``least`` bytes are all responses; rows that repeat an id and a payload are judged alike (all responses, where theirs
is the least id); line breaks in a url are written percent-encoded; no rows give no captures.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectables.llm.store import Workspace

FILE_BYTES = 128 << 20
#: payloads up to so many bytes: records in a file, three a page
FILES = [(most, 3 * (FILE_BYTES // most)) for most in (64 << 10, 1 << 20, 16 << 20)] + [(None, 3)]
STEP = 1 << 20              # bytes inflated at once
DATE = "2000-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_N = "\r\n"

RECORD = ("kind string, record_id string, capture string, url string, id long, status int, payload_bytes long, "
          "payload_digest string, refers_to long, request string, payload binary")


def base32(hex40: Column) -> Column:
    """RFC 4648 base 32 of a 40-digit hexadecimal string: five digits are four letters."""
    letters = []
    for i in range(8):
        word = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.lit(_BASE32).substr(F.shiftright(word, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record(kind: Column, record_id: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.lit("WARC/1.1" + _N + "WARC-Type: "), kind, F.lit(_N + "WARC-Record-ID: <"), record_id, F.lit(">" + _N)]
    for name, value in [*fields, ("WARC-Date", F.lit(DATE)), ("Content-Length", F.octet_length(block).cast("string"))]:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_N)), F.lit("")))     # a null field is left out
    return F.concat(*head, F.lit(_N), block)


def write(pages: DataFrame, id_col: str, url_col: str, payload_col: str, path: str, space: Workspace, least: int = 0) -> None:
    """Write a request, response or revisit, and metadata record per page under ``path``."""
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.regexp_replace(
        F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"))
    page = page.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    ids = page.where(F.col("id").isNotNull() & (F.col("bytes") >= least)).select("id", "bytes", "digest")
    first = ids.groupBy("bytes", "digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    again = space.save(ids.join(first, ["bytes", "digest"]).where("id <> first").select("id", "digest", "first").distinct(), "again")
    size = F.lit(len(FILES) - 1)
    for i, (most, _) in reversed(list(enumerate(FILES[:-1]))):
        size = F.when(F.col("bytes") <= most, i).otherwise(size)
    sizes = {r["size"] for r in page.select(size.alias("size")).distinct().collect()}       # at most len(FILES) rows
    page = page.withColumn("size", size).join(again, ["id", "digest"], "left").withColumn(
        "uid", F.concat_ws("-", "size", F.monotonically_increasing_id()))

    capture = F.concat(F.lit("urn:capture:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("uid"))
    with_ = ("WARC-Concurrent-To", F.concat(F.lit("<"), capture, F.lit(">")))
    target = ("WARC-Target-URI", F.col("url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_N}Content-Type: text/html; charset=utf-8{_N}Content-Length: "), F.col("bytes").cast("string"), F.lit(_N + _N))
    revisit = F.col("first").isNotNull()
    answer = _record(
        F.when(revisit, F.lit("revisit")).otherwise("response"), capture,
        [target, ("Content-Type", F.lit("application/http;msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("digest")))),
         ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
         ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))))
    place = F.coalesce(F.nullif(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*(.*)", 1), F.lit("")), F.lit("/"))
    request = _record(
        F.lit("request"), F.concat(capture, F.lit(":request")), [with_, target, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), place, F.lit(f" HTTP/1.1{_N}Host: "), F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), F.lit(_N + _N)))
    metadata = _record(
        F.lit("metadata"), F.concat(capture, F.lit(":metadata")), [with_, target, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(_N)))
    for i in sorted(sizes | {0}):
        records = page.where(F.col("size") == i).select(F.explode(F.array(request, answer, metadata)).alias("value"))
        records.write.mode("append").option("lineSep", _N + _N).option("compression", "gzip").option("maxRecordsPerFile", FILES[i][1]).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(_N)
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _name(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _inflated(content: pa.Buffer) -> Iterator[bytes]:
    """What a gzip file of any number of members holds, at most ``STEP`` bytes at a time."""
    member = zlib.decompressobj(wbits=47)
    whole = memoryview(content)
    for lo in range(0, len(whole), 1 << 16):
        piece = whole[lo: lo + (1 << 16)]
        while len(piece):
            yield member.decompress(piece, STEP)
            piece = member.unconsumed_tail
            if member.eof:
                piece, member = member.unused_data, zlib.decompressobj(wbits=47)
    yield member.flush()


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    held, seen, fields, size = bytearray(), 0, None, 0
    for piece in pieces:
        held += piece
        while True:
            if fields is None:
                end = held.find(b"\r\n\r\n", seen)
                if end < 0:
                    seen = max(0, len(held) - 3)
                    break
                fields = _fields(bytes(held[:end]))
                size = int(fields["content-length"])
                del held[:end + 4]
            if len(held) < size + 4:
                break
            yield fields, bytes(memoryview(held)[:size])
            del held[:size + 4]
            fields, seen = None, 0
    if held or fields is not None:
        raise ValueError("a WARC archive ends within a record")


def _parse(with_payload: bool):
    def record(fields: dict[str, str], block: bytes) -> tuple:
        kind, record_id = fields.get("warc-type"), _name(fields.get("warc-record-id"))
        own = kind in ("response", "revisit")
        capture = record_id if own else _name(fields.get("warc-concurrent-to"))
        id_ = status = size = digest = refers = request = payload = None
        if own:
            head, _, payload = block.partition(b"\r\n\r\n")
            status = int(head.split(b" ", 2)[1])
            if kind == "response":
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            else:
                size, digest = int(_fields(head)["content-length"]), fields["warc-payload-digest"].partition(":")[2]
                refers, payload = int(_name(fields["warc-refers-to"]).rpartition(":")[2]), None
        elif kind == "metadata":
            id_ = _fields(b"\r\n" + block).get("page")
            id_ = int(id_) if id_ else None
        elif kind == "request":
            request = block.partition(b"\r\n")[0].decode("utf-8", "replace")
        return kind, record_id, capture, fields.get("warc-target-uri"), id_, status, size, digest, refers, request, payload if with_payload else None

    types = [pa.string()] * 4 + [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = re.findall(r"(\w+) \w+", RECORD)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for fields, block in _records(_inflated(content.as_buffer())):
                    out.append(record(fields, block))
                    held += len(block)
                    if held > 8 << 20:
                        yield batch_of(out)
                        out, held = [], 0
                if out:
                    yield batch_of(out)

    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``, a row each; see ``RECORD``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_parse(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata, met by WARC-Concurrent-To."""
    def of(kinds: list[str], *cols: str) -> Column:
        return F.first(F.when(F.col("kind").isin(kinds), F.struct(*cols)), ignorenulls=True)

    return records.groupBy("capture").agg(
        of(["metadata"], "record_id", "id").alias("metadata"),
        of(["request"], "record_id", "request").alias("request"),
        of(["response", "revisit"], "record_id", F.col("kind").alias("type"), "url", "status", "payload_bytes",
           "payload_digest", "refers_to", "payload").alias("response"))


def captures(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 0, with_payload: bool = True) -> DataFrame:
    """Write ``pages`` to WARC archives, read them back, and assemble the captures."""
    space = Workspace(pages.sparkSession, "warc")
    path = space.path("archives")
    write(pages, id_col, url_col, payload_col, path, space, least)
    return assemble(read(pages.sparkSession, path, with_payload))
