"""WARC archives: writing captures with Spark, reading them back, and joining the records of a capture."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm.arrays import batch
from marram.sources.shared import materialise, pick, scratch

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 160-bit digest in hexadecimal: five hexadecimal digits make four letters."""
    letters = []
    for at in range(1, 41, 5):
        bits = F.conv(F.substring(digest, at, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, k).bitwiseAND(31) + 1, F.lit(1)) for k in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record(kind: str, number: Column, headers: list[tuple[str, Column]], block: Column, date: str) -> Column:
    """One record without the two line ends that close it. A header whose value is null is left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), number), F.lit(f"WARC-Date: {date}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Writes a request, a response or revisit, and a metadata record for every page, as gzipped WARC files.

    Of pages with equal payloads of at least min_bytes bytes, the one with the smallest page_id (null
    last; of repeated rows any one) is a response; the others are revisits that refer to it. A null html
    is an empty payload; a null url leaves the target out; an empty table writes no record; very long
    payloads are one value of a row each; other columns are ignored. A payload is moved once, however
    many pages have it: copies are joined without it. The text writer's line separator is the end of a
    WARC record, so Spark's own committer writes the files, wherever Spark can write (one gzip member a file).
    """
    rows = pick(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1("html"))
    large = rows.where(F.col("bytes") >= min_bytes)
    # Written once, so that a row's number is the same wherever it is read.
    captures = materialise(large.select("page_id", "url", "bytes", "digest", F.monotonically_increasing_id().alias("number")), "captures")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "number", "url")
    first = captures.groupBy("digest").agg(F.min(order).alias("origin"), F.first("bytes").alias("bytes"))
    payloads = large.groupBy("digest").agg(F.first("html").alias("html"))  # copies within a task are combined before the shuffle
    fields = ["page_id", "url", "bytes", "digest", "number"]
    responses = payloads.join(first, "digest").select("origin.page_id", "origin.url", "bytes", "digest", "origin.number", "html")
    if min_bytes > 0:
        small = rows.where(F.col("bytes") < min_bytes).withColumn("number", -1 - F.monotonically_increasing_id())
        responses = responses.union(small.select(*fields, "html"))
    again = captures.join(first.select("digest", "origin"), "digest").where(F.col("origin.number") != F.col("number")).select(*fields, "origin")

    name = lambda page, n, kind: F.concat(F.lit("<urn:x-capture:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), n.cast("string"), F.lit(f":{kind}>"))
    own = name(F.col("page_id"), F.col("number"), "response")
    target = ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest"))))
    status = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", own, [target, digest, http], F.concat(status, F.col("html")), date)
    origin = name(F.col("origin.page_id"), F.col("origin.number"), "response")
    revisit = _record("revisit", own, [target, digest, http, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", origin)], status, date)
    request = _record("request", name(F.col("page_id"), F.col("number"), "request"), [target, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], F.lit("GET / HTTP/1.1" + CRLF * 2), date)
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF + "payload-length: "), F.col("bytes").cast("string"), F.lit(CRLF))
    metadata = _record("metadata", name(F.col("page_id"), F.col("number"), "metadata"), [("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields, date)
    value = lambda main: F.concat_ws(CRLF * 2, request, main, metadata).alias("value")
    written = responses.select(value(response)).union(again.select(value(revisit)))
    written.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


_RECORD = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("stated_digest", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.string())]


class Archive:
    """The records of one archive from its lines, cut at CRLF. Record ends are found by Content-Length alone.

    Payloads are digested as they come; only headers and the fields of metadata records are held.
    """

    def __init__(self) -> None:
        self.headers: dict[str, str] | None = None
        self.left: int | None = None  # bytes of the block that are still to come
        self.ended = True  # whether a blank line came after the last block (a cut-off line can't be told otherwise)

    def feed(self, line: bytes) -> tuple | None:
        """Takes the next line; returns the record that it ends, if it ends one."""
        if self.left is None:
            if self.headers is None:
                if not line.strip():
                    self.ended = True
                    return None
                if not self.ended or not line.startswith(b"WARC/"):
                    raise ValueError(f"not a WARC record: {line[:40]!r}")
                self.headers = {}
            elif line.strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                self.headers[name.strip().lower()] = value.strip()
            else:
                return self._begin()
            return None
        ends = len(line) == self.left
        part = line if ends else line + b"\r\n"
        if len(part) > self.left:
            raise ValueError(f"a block is longer than its Content-Length: {self.headers}")
        self.left -= len(part)
        if self.in_http_head:
            self.in_http_head = bool(line)
        elif self.sha1 is not None:
            self.sha1.update(part)
            self.size += len(part)
        elif self.kind == "metadata":
            self.fields.append(part)
        return None if self.left else self._end()

    def _begin(self) -> tuple | None:
        h = self.headers
        self.left, self.kind = int(h.get("content-length", 0)), h.get("warc-type", "")
        response = self.kind == "response"
        self.in_http_head = response and h.get("content-type", "").startswith("application/http")
        self.sha1, self.size, self.fields = hashlib.sha1() if response else None, 0, []
        return None if self.left else self._end()

    def _end(self) -> tuple:
        h, self.headers, self.left, self.ended = self.headers, None, None, False
        digest = base64.b32encode(self.sha1.digest()).decode() if self.sha1 is not None else None
        fields = b"".join(self.fields).decode("utf-8", "replace") if self.kind == "metadata" else None
        stated = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        return (h.get("warc-record-id"), self.kind, h.get("warc-target-uri"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), stated, digest, None if digest is None else self.size, fields)

    def close(self) -> None:
        if self.headers is not None or not self.ended:
            raise ValueError(f"an archive ends within a record: {self.headers}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive, last, out = Archive(), None, []
    for rows in batches:
        files = rows.column("file").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(files[1:] != files[:-1]) + 1, [len(files)]]) if len(files) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if files[a] != last:
                archive.close()
                archive, last = Archive(), files[a]
                if rows.column("inside")[a].as_py():
                    raise ValueError("an archive that isn't gzipped is larger than spark.sql.files.maxPartitionBytes")
            for at in range(a, b, 4096):
                for line in rows.column("line").slice(at, min(4096, b - at)).to_pylist():
                    record = archive.feed(line)
                    if record is not None:
                        out.append(record)
                        if len(out) == 5000:
                            yield batch(_RECORD, list(zip(*out, strict=True)))
                            out = []
    archive.close()
    if out:
        yield batch(_RECORD, list(zip(*out, strict=True)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzipped or plain archives under a path. Payload digests and lengths are taken from the payload.

    The text reader decompresses a gzipped archive as a stream, so its size is not bounded by memory; a plain
    one must not be split (it raises ValueError if it is). A record whose block is not as long as stated raises too.
    """
    lines = spark.read.option("lineSep", CRLF).text(path)
    of = lines.select(F.xxhash64("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") > 0).alias("inside"), F.col("value").cast("binary").alias("line"))
    ddl = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in _RECORD)
    return of.mapInArrow(_read, ddl)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, and the requests and metadata concurrent to it.

    Requests and metadata meet their capture on WARC-Concurrent-To in one shuffle. A record that
    names no capture, or one that is absent, makes a capture of its own with a null response.
    """
    main = F.col("record_type").isin("response", "revisit")
    keyed = records.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
    response = F.struct("record_type", "target_uri", "refers_to", "stated_digest", "payload_digest", "payload_bytes")
    return keyed.groupBy("capture_id").agg(
        F.min(F.when(main, response)).alias("response"),
        F.array_sort(F.collect_list(F.when(F.col("record_type") == "request", F.struct("record_id", "target_uri")))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("record_type") == "metadata", F.struct("record_id", "fields")))).alias("metadata"),
    )


def round_trip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Writes the pages into the shared folder as archives, reads them back and returns page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes=min_bytes)
    captures = assemble(read_archives(spark, path)).where("response is not null")
    fields = F.col("metadata")[0]["fields"]
    stated = F.regexp_extract(fields, "payload-length: ([0-9]+)", 1).cast("long")
    page = lambda c: F.regexp_extract(c, "<urn:x-capture:(-?[0-9]+|null):", 1).try_cast("long")
    return captures.select(
        F.regexp_extract(fields, "page-id: (-?[0-9]*)", 1).try_cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", stated).alias("payload_bytes"),
        F.coalesce("response.payload_digest", "response.stated_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        page(F.col("response.refers_to")).alias("refers_to"),
    )
