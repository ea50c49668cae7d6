"""WARC archives: a writer made of column expressions, and a Python data source that reads them.

The writer makes each record's bytes with column expressions and stores them by Spark's text writer, so it reaches every
store that Spark does. Of records with equal payloads of at least MIN_REVISIT bytes, that with the smallest page_id is
the response; the others are revisits that keep the HTTP head and refer to it. Only (digest, page_id) are shuffled to
find them.

The reader plans a partition for each file, takes predicates on the record type and on other header fields, parses a
record's head first, and passes over the payload of records that nobody wants: it seeks past them, or, in compressed
files, drops the bytes undecoded. Where the wanted schema has no payload, a payload is only held against its digest.

Nulls and edge cases: a null payload is empty; a null page_id is never a revisit; rows that repeat the response's page_id
are responses too; a payload of any length is written whole and held by itself when read; control characters and blanks in a URL are percent-encoded, a null URL has no header; an empty table
writes no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith

from girder.llm.common import scratch_path

MIN_REVISIT = 100
CRLF = "\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:girder:page:"
SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _clean(url: Column) -> Column:
    """No byte of a URL may end its header line."""
    clean = url
    for c in [*range(33), 127]:
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike("[\\x00-\\x20\\x7f]"), clean).otherwise(url)


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, first): records that revisit the response `first`."""
    own = pages.where(F.octet_length("payload") >= least).select("page_id", F.sha2("payload", 256).alias("digest"))
    first = own.groupBy("digest").agg(F.min("page_id").alias("first"))
    return own.join(first, "digest").where("page_id > first").select("page_id", "digest", "first").distinct()


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """One record for each row of pages(page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    again = revisits(pages).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first")
    found = pages.withColumn("digest", F.sha2("payload", 256)).join(again, (F.col("page_id") == F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left")
    size = F.octet_length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), _line("Content-Length", size), F.lit(CRLF))
    repeat = F.col("first").isNotNull()
    block = F.when(repeat, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(repeat, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit(f"<{_PAGE}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _clean(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.concat(F.lit(f"<{_PAGE}"), F.col("first").cast("string"), F.lit(">"))),
        _line("WARC-Profile", F.when(repeat, SAME_PAYLOAD)),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
    )
    # the writer ends each value with the line feed that is the record's last byte
    record = F.concat(head, block, F.lit("\r\n\r"))
    found.select(record.alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)


@dataclass
class _File(InputPartition):
    path: str


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def _head_row(head: dict[str, str]) -> dict:
    """What the header fields say, by column."""
    page = lambda v: _number((v or "").strip("<>").removeprefix(_PAGE))
    return {
        "page_id": page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"),
        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:") or None, "refers_to": page(head.get("warc-refers-to")),
    }


_TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b),
}


class _Reader(DataSourceReader):
    ROWS = 512  # rows of a batch, or fewer if their payloads are large
    BYTES = 8 << 20

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in ("page_id", "url", "record_type", "payload_digest", "refers_to") and type(f) in (*_TESTS, IsNull, IsNotNull):
                self.filters.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for name, kind, value in self.filters:
            own = row[name]
            if kind is IsNull or kind is IsNotNull:
                if (own is None) != (kind is IsNull):
                    return False
            elif own is None or not _TESTS[kind](own, value):
                return False
        return True

    def partitions(self) -> list[_File]:
        store, at = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path)] or [_File("")]

    def read(self, part: _File) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if ":" in self.path else fs.LocalFileSystem()
        rows: list[dict] = []
        held = 0
        with store.open_input_file(part.path) as raw:
            plain = not part.path.endswith(".gz")
            stream = io.BufferedReader(raw if plain else gzip.GzipFile(fileobj=raw), 1 << 20)
            while (row := self._next(stream, plain)) is not None:
                if row:
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                if len(rows) >= self.ROWS or held >= self.BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in self.names], self.names)

    @staticmethod
    def _head(stream: io.BufferedReader, first: bytes) -> dict[str, str]:
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        return head

    @staticmethod
    def _pass(stream: io.BufferedReader, size: int, plain: bool) -> None:
        if plain:
            stream.seek(size, io.SEEK_CUR)
        else:
            while size > 0 and (got := len(stream.read(min(size, 1 << 20)))):
                size -= got

    def _next(self, stream: io.BufferedReader, plain: bool) -> dict | None:
        """The next record, {} for one that nobody wants, None at the end."""
        first = stream.readline()
        if not first:
            return None
        head = self._head(stream, first)
        size, row = int(head["content-length"]), _head_row(head)
        if not self._wanted(row):
            self._pass(stream, size + 4, plain)
            return {}
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record ends early")
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = [int(v) for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if n.strip().lower() == b"content-length"]
        if row["record_type"] == "response":
            if hashlib.sha256(payload).hexdigest() != row["payload_digest"]:
                raise ValueError(f"the payload of page {row['page_id']} does not match its digest")
            row["payload_bytes"] = len(payload)
            if "payload" in self.names:
                row["payload"] = payload
        else:
            row["payload_bytes"] = stated[0] if stated else None
        return row


class WarcFiles(DataSource):
    """format("girder_warc"): reads archives; the wanted columns are given as the schema."""

    @classmethod
    def name(cls) -> str:
        return "girder_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], schema.fieldNames())


def read_archives(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcFiles)
    return spark.read.format("girder_warc").schema(columns).load(path)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, read back from archives in the shared folder."""
    path = scratch_path(pages.sparkSession, "op3-warc")
    write_archives(pages, path)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # two scans, each with its predicate: the one for revisits passes over the responses' payloads
    kinds = [read_archives(pages.sparkSession, path, columns).where(F.col("record_type") == kind) for kind in ("response", "revisit")]
    return kinds[0].unionByName(kinds[1])


ORACLE = """
WITH own AS (SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS digest FROM pages),
first AS (SELECT digest, min(page_id) AS first FROM own WHERE strlen(payload) >= 100 GROUP BY digest)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM own LEFT JOIN first USING (digest)"""
