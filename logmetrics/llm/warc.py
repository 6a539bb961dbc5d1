"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC.

An ARC file begins with a ``filedesc`` record that names its version and the
fields of its header lines; each record is such a line, with the declared length
of the block last, and the block. A WARC file is a run of records with named
headers. The converter reads each archive by its own version's fields and
declared lengths and synthesises what WARC asks for: a record id (from the
record's place), a date (from the 14 digits), a type, and digests.

Of records with equal payloads one is a ``response`` and the others are
``revisit`` records without a payload that refer to it. Which one that is comes
from sums over digests; payloads stay in their archives, and an archive is
converted by one task. Archives hold a bounded number of bytes.

Files are written by Spark's text writer: one row is one record, and the row
separator is the format's own record separator, so archives can lie wherever
Spark can write.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logmetrics.llm.frames import col
from logmetrics.session import materialize, scratch_path, sized_broadcast

#: Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_END, WARC_END = "\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 32 << 20
DATE = "20240101000000"
_BLANK = re.compile(r"[\x00-\x20\x7f]")


def digest32(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_head(page_id: int | None, size: int) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {size}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def arc_start(version: int, name: str) -> bytes:
    """The first record of an archive."""
    body = f"{version} 0 logmetrics\n{ARC_FIELDS[version]}\n".encode()
    more = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain {more}{len(body)}\n".encode() + body


def arc_record(version: int, url: str, block: bytes, name: str) -> bytes:
    url = _BLANK.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-"
    more = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - 0 {name} "
    return f"{url} 0.0.0.0 {DATE} text/html {more}{len(block)}\n".encode() + block


def write_arc(
    pages: DataFrame,
    path: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
) -> str:
    """Write ``pages`` as archives of about ``archive_bytes`` each, of either version; returns the folder.

    A null page is an empty payload, a null url is '-', blanks in urls are
    percent-encoded, a page without an id has none in the archive, repeated rows
    are a record each, an empty table gives archives without records; other
    columns are not written. Archives are closed by the mean size of a page, so
    where long pages stand together one is larger.
    """
    path = path or scratch_path(pages.sparkSession, "arc")
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(col(html_col)), F.lit(0)) + 400).alias("m")).first()["m"] or 400.0
    each = max(1, int(archive_bytes / mean))
    rows = pages.select(
        F.spark_partition_id().alias("split"),
        col(id_col).cast("bigint").alias("id"),
        F.coalesce(col(url_col), F.lit("-")).alias("url"),
        F.coalesce(col(html_col), F.lit("")).cast("binary").alias("html"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            out: list[bytes] = []
            for split, page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = done // each
                version, name = 1 + (split + part) % 2, f"pages-{split}-{part}.arc"
                if done % each == 0:
                    out.append(arc_start(version, name))
                out.append(arc_record(version, url, http_head(page, len(html)) + html, name))
                done += 1
                if sum(map(len, out[-64:])) > 4 << 20 or len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # The writer opens a new file where the next archive's first record stands.
    records = rows.mapInArrow(write, "value binary").select(F.col("value").cast("string").alias("value"))
    options = {"lineSep": ARC_END, "compression": "gzip", "maxRecordsPerFile": each + 1}
    records.write.options(**options).text(path)
    return path


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def read_arc_bytes(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header fields, block) of each record of one archive, by its own version's fields."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace")
        size = int(line.rpartition(" ")[2])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"record at {at} declares {size} bytes and has {len(block)}")
        if fields is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an archive begins with a filedesc record")
            version = int(block.split(b" ", 1)[0])
            fields = block.decode().split("\n")[1].split(" ") if version not in ARC_FIELDS else ARC_FIELDS[version].split(" ")
        else:
            yield at, dict(zip(fields, line.rsplit(" ", len(fields) - 1), strict=True)), block
        at = end + 1 + size


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, head with its blank line, payload)."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    named = dict(line.split(": ", 1) for line in lines if ": " in line)
    return {k.lower(): v for k, v in named.items()}, head + blank, payload


def _page(headers: dict[str, str]) -> int | None:
    return int(headers["x-page-id"]) if "x-page-id" in headers else None


def record_id(archive: str, place: int) -> str:
    key = hashlib.sha256(f"{archive.rpartition('/')[2]}:{place}".encode()).digest()
    return f"urn:uuid:{uuid.UUID(bytes=key[:16], version=5)}"


def warc_date(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "place", "page", "digest", "size"]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for place, _, block in read_arc_bytes(content.as_py()):
                headers, _, payload = split_http(block)
                rows.append((path, place, _page(headers), digest32(payload), len(payload)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def warc_record(path: str, place: int, fields: dict[str, str], block: bytes, first: tuple[str, int] | None) -> bytes:
    """The WARC record of an ARC record: a response, or a revisit of the record at ``first``."""
    _, head, payload = split_http(block)
    body = block if first is None else head
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(path, place)}>",
        f"WARC-Date: {warc_date(fields['Archive-date'])}",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Block-Digest: sha1:{digest32(body)}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if first is not None:
        lines[7:7] = [f"WARC-Refers-To: <{record_id(*first)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body


def convert_arc(
    spark: SparkSession, source: str, path: str | None = None, least: int = 0, limit: int = 64 << 20
) -> str:
    """Convert all archives below ``source`` to WARC files; returns their folder.

    Of records with equal payloads of at least ``least`` bytes, the one with the
    largest page id is the response (none is lowest; of equal ids the later
    place); the others revisit it. Shorter payloads are all responses. Archives
    without records give empty files. A damaged or cut-off archive is an error
    that names the place, and nothing is read from it in part.
    """
    path = path or scratch_path(spark, "warc")
    places = materialize(files(spark, source).mapInArrow(_places, "path string, place bigint, page bigint, digest string, size bigint"), "places")
    best = places.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("page", "path", "place")).alias("best"), F.count("*").alias("n"))
    best = sized_broadcast(materialize(best.where("n > 1"), "best"))
    again = places.where(F.col("size") >= least).join(best, "digest")
    again = again.where((F.col("path") != F.col("best.path")) | (F.col("place") != F.col("best.place")))
    again = again.groupBy("path").agg(
        F.collect_list(F.struct("place", F.col("best.path").alias("to"), F.col("best.place").alias("at"))).alias("again")
    )
    again = materialize(again, "again")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py()
                first = {r["place"]: (r["to"], r["at"]) for r in batch.column(2)[k].as_py() or []}
                out, size = [], 0
                for place, fields, block in read_arc_bytes(batch.column(1)[k].as_py()):
                    out.append(warc_record(name, place, fields, block, first.get(place)))
                    size += len(out[-1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # Contents stay in the task that reads them: what is said about an archive comes to it.
    # Beyond ``limit`` bytes of that, archives are converted in several passes, each over its own files.
    said = again.agg(F.sum(F.size("again") * 64 + F.octet_length("path")).alias("bytes")).first()["bytes"] or 0
    rounds = -(-2 * said // limit) if said > limit else 1
    for k in range(rounds):
        content, own = files(spark, source), again
        if rounds > 1:
            mine = F.pmod(F.xxhash64("path"), F.lit(rounds)) == k
            paths = [r["path"] for r in places.where(mine).select("path").distinct().collect()]
            if not paths:
                continue
            content, own = files(spark, paths), again.where(mine)
        records = content.join(F.broadcast(own), "path", "left").mapInArrow(convert, "value binary")
        records = records.select(F.col("value").cast("string").alias("value"))
        records.write.mode("append").options(lineSep=WARC_END, compression="gzip").text(path)
    return path


def read_warc_bytes(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one WARC file."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["record_id", "record_type", "url", "date", "page_id", "payload_bytes", "payload_digest", "refers_to"]
    for batch in batches:
        for content in batch.column(1):
            rows = []
            for headers, block in read_warc_bytes(content.as_py()):
                http, _, payload = split_http(block)
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest32(payload) != digest:
                    raise ValueError(f"payload of {headers['warc-record-id']} has another digest")
                size = len(payload) if kind == "response" else int(http["content-length"])
                rows.append(
                    (headers["warc-record-id"], kind, headers["warc-target-uri"], headers["warc-date"], _page(http))
                    + (size, digest, headers.get("warc-refers-to"))
                )
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a WARC record; ``refers_to`` is the record id that a revisit names."""
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("record_id", "record_type", "url", "date")]
        + [T.StructField(n, T.LongType()) for n in ("page_id", "payload_bytes")]
        + [T.StructField(n, T.StringType()) for n in ("payload_digest", "refers_to")]
    )
    return files(spark, path).mapInArrow(_records, schema)
