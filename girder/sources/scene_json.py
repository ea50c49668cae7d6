"""Scene documents: the top-level arrays of one JSON text, record by record, and manifests.

A text is read in spans of bytes, each by a task of its own. Whether a span begins within a string, and how deep, depends on
all before it; so a first pass counts, for either case, the quotes and brackets of each span, and sums over the spans before,
given by ranges, tell each how it begins: a table of states, of which a task gets its own row. A second pass finds the top-level members, a third cuts their arrays into records at the
commas of their level; the record that a span's last comma begins is read on beyond its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators.ranking import dense_rank_all, within
from girder.tables import cut

SPAN = 16 << 20
_MARKS = np.zeros(256, bool)
_MARKS[np.frombuffer(b"{}[],:", np.uint8)] = True
_STEP = np.zeros(256, np.int64)
_STEP[np.frombuffer(b"{[", np.uint8)] = 1
_STEP[np.frombuffer(b"}]", np.uint8)] = -1
_WHITE = b" \t\r\n"


class _Text:
    """A file's bytes, from any store that pyarrow opens."""

    def __init__(self, path: str):
        self.store, self.at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        self.size = self.store.get_file_info(self.at).size

    def read(self, start: int, stop: int) -> bytes:
        with self.store.open_input_file(self.at) as f:
            f.seek(max(start, 0))
            return f.read(max(min(stop, self.size) - max(start, 0), 0))

    def backslashes(self, at: int) -> int:
        """How many stand right before a place."""
        count = 0
        while at > 0:
            block = self.read(at - 4096, at)
            left = len(block.rstrip(b"\\"))
            count += len(block) - left
            if left:
                break
            at -= len(block)
        return count

    def key_before(self, colon: int) -> str:
        """The string in front of a colon."""
        import json

        size = 256
        while True:
            block = self.read(colon - size, colon)
            end = block.rfind(b'"')
            begin = end
            while begin > 0:
                begin = block.rfind(b'"', 0, begin)
                if begin < 0:
                    break
                before = block[:begin]
                slashes = len(before) - len(before.rstrip(b"\\"))
                if slashes < len(before) and slashes % 2 == 0 or size >= colon:
                    return json.loads(block[begin : end + 1])
            if size >= colon:
                raise ValueError("a member has no key")
            size *= 4


def _quotes(raw: np.ndarray, slashes: int) -> np.ndarray:
    """Places of the quotes that no backslash escapes; `slashes` backslashes stand before the first byte."""
    q = np.flatnonzero(raw == 0x22)
    plain = np.maximum.accumulate(np.where(raw != 0x5C, np.arange(len(raw)), -1))
    last = np.where(q > 0, plain[q - 1], -1)
    return q[(q - 1 - last + np.where(last < 0, slashes, 0)) % 2 == 0]


def _marks(raw: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    """Places of brackets, commas and colons outside strings."""
    at = np.flatnonzero(_MARKS[raw])
    return at[(np.searchsorted(quotes, at) + inside) % 2 == 0]


def _each_span(spans: DataFrame, count: int, path: str, work: Callable[..., dict[str, list]], schema: pa.Schema, ddl: str) -> DataFrame:
    """work(text, *row) for each row of `spans`, its number first, each in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _Text(path)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_pydict(work(text, *row), schema)

    return spans.repartition(count).mapInArrow(run, ddl)


def _summary(span: int) -> Callable:
    def work(text: _Text, i: int) -> dict[str, list]:
        raw = np.frombuffer(text.read(i * span, (i + 1) * span), np.uint8)
        quotes = _quotes(raw, text.backslashes(i * span))
        deeper = [int(_STEP[raw[_marks(raw, quotes, inside)]].sum()) for inside in (False, True)]
        return {"span": [i], "odd": [len(quotes) % 2 == 1], "outside": [deeper[0]], "inside": [deeper[1]]}

    return work


def _members(span: int) -> Callable:
    """What happens at the top level of a span: ':' with the key before it, ',' and '}', and '!' for bytes behind the document."""

    def work(text: _Text, i: int, inside: bool, depth: int) -> dict[str, list]:
        raw = np.frombuffer(text.read(i * span, (i + 1) * span), np.uint8)
        quotes = _quotes(raw, text.backslashes(i * span))
        at = _marks(raw, quotes, inside)
        before = depth + np.cumsum(_STEP[raw[at]]) - _STEP[raw[at]]
        found = [(int(p) + i * span, chr(raw[p])) for p in at[(before == 1) & np.isin(raw[at], np.frombuffer(b":,}", np.uint8))]]
        ended = next((p + 1 - i * span for p, c in found if c == "}"), 0 if i and depth <= 0 and not inside else None)
        if ended is not None and raw[ended:].tobytes().strip(_WHITE):
            found.append((i * span + ended, "!"))
        return {"at": [p for p, _ in found], "kind": [c for _, c in found], "key": [text.key_before(p) if c == ":" else None for p, c in found]}

    return work


def _records(span: int, members: list[tuple[str, int, int]]) -> Callable:
    """The records that begin in a span: elements of arrays, and other members whole."""

    def work(text: _Text, i: int, inside: bool, depth: int) -> dict[str, list]:
        low, high = i * span, min((i + 1) * span, text.size)
        raw = np.frombuffer(text.read(low, high), np.uint8)

        def borders(raw: np.ndarray, base: int, inside: bool, depth: int) -> tuple[list[int], bool, int]:
            """Places in the document where an element begins or ends, and how the bytes leave off."""
            quotes = _quotes(raw, text.backslashes(base))
            at = _marks(raw, quotes, inside)
            step = _STEP[raw[at]]
            before = depth + np.cumsum(step) - step
            own = (before == 2) & ((raw[at] == 0x2C) | (step < 0)) | (before == 1) & (step > 0)
            return (at[own] + base).tolist(), (len(quotes) + inside) % 2 == 1, depth + int(step.sum())

        found, inside, depth = borders(raw, low, inside, depth)

        def beyond() -> int:
            """The first border behind the span."""
            at, state = high, (inside, depth)
            while at < text.size:
                more, *state = borders(np.frombuffer(text.read(at, at + (1 << 20)), np.uint8), at, *state)
                if more:
                    return more[0]
                at += 1 << 20
            raise ValueError("the document ends early")

        out: dict[str, list] = {"collection": [], "part": [], "turn": [], "record": []}
        for name, value, stop in members:
            if stop <= low or value >= high:
                continue
            records: list[bytes] = []
            if text.read(value, value + 1) != b"[":
                records = [text.read(value, stop)] if value >= low else []
            elif own := [p for p in found if value <= p < stop]:
                if raw[own[-1] - low] != 0x5D:
                    own.append(beyond())
                records = [text.read(a + 1, b) for a, b in zip(own, own[1:])]
                if own[0] == value and len(own) == 2 and not records[0].strip(_WHITE) and text.read(own[1], own[1] + 1) == b"]":
                    records = []
            for turn, record in enumerate(records):
                for k, v in zip(out, (name, i, turn, record.decode().strip())):
                    out[k].append(v)
        return out

    return work


_SUMMARY = pa.schema([("span", pa.int64()), ("odd", pa.bool_()), ("outside", pa.int64()), ("inside", pa.int64())])
_MEMBERS = pa.schema([("at", pa.int64()), ("kind", pa.string()), ("key", pa.string())])
_RECORDS = pa.schema([("collection", pa.string()), ("part", pa.int64()), ("turn", pa.int64()), ("record", pa.string())])


def _span_count(path: str, span: int) -> int:
    return max(1, -(-_Text(path).size // span))


def states(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """(span, inside, depth): whether each span of bytes begins in a string, and how deep."""
    count = _span_count(path, span)
    sums = cut(_each_span(spark.range(count), count, path, _summary(span), _SUMMARY, "span long, odd boolean, outside long, inside long"), "spans")
    begun = dense_rank_all(sums.withColumn("flips", F.col("odd").cast("long")), ["span"], "flipped", value="flips").withColumn("begins", F.col("flipped") % 2 == 1)
    deeper = begun.withColumn("deeper", F.when(F.col("begins"), F.col("inside")).otherwise(F.col("outside")))
    found = dense_rank_all(deeper.select("span", "odd", "begins", "deeper"), ["span"], "depth", value="deeper")
    end = found.agg(F.max_by(F.struct((F.col("begins") != F.col("odd")).alias("inside"), (F.col("depth") + F.col("deeper")).alias("depth")), "span").alias("s")).first().s
    if end.inside or end.depth:
        raise ValueError("the document ends early")
    return cut(found.select("span", F.col("begins").alias("inside"), "depth"), "span-states")


def top_level(spans: DataFrame, path: str, span: int = SPAN) -> list[tuple[str, int, int]]:
    """The members as (key, first byte of the value, end), given the states of the spans. A repeated key counts with its last
    member; bytes behind the document are an error. The names of the top level, and where they stand, reach the driver."""
    found = cut(_each_span(spans, _span_count(path, span), path, _members(span), _MEMBERS, "at long, kind string, key string"), "scene-members")
    if not found.where("kind = '!'").isEmpty():
        raise ValueError("bytes behind the document")
    events = sorted((r.at, r.kind, r.key) for r in found.collect())
    text, members = _Text(path), {}
    for (at, kind, key), (stop, _, _) in zip(events, events[1:]):
        if kind == ":":
            head = text.read(at + 1, min(stop, at + 4097))
            members[key] = (at + 1 + len(head) - len(head.lstrip(_WHITE)), stop)
    return [(k, a, b) for k, (a, b) in members.items()]


def read_scene(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """(collection, position, record) of each top-level array's elements (S06); any other member is one record."""
    spans = states(spark, path, span)
    members = top_level(spans, path, span)
    rows = cut(_each_span(spans, _span_count(path, span), path, _records(span, members), _RECORDS, "collection string, part long, turn long, record string"), "scene-records")
    counts = rows.groupBy("collection", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each span of a collection
    before = within(counts, ["collection"], ["part"], "before", value="n")
    return rows.join(before.drop("n"), ["collection", "part"]).select("collection", (F.col("before") + F.col("turn")).alias("position"), "record")


def only_file(spark: SparkSession, path: str) -> str:
    """The one file with content in a folder that Spark wrote."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path").first().path


WORKSPACE = "version int, name string, packageDigest string, hidden array<string>, isolated string"
KEYS = ("version", "name", "packageDigest", "hidden", "isolated")


def parsed_manifests(texts: DataFrame, column: str) -> DataFrame:
    """The manifest, and its problem: unreadable, an unknown key, or an unknown version."""
    doc = F.from_json(column, WORKSPACE)
    keys = F.json_object_keys(column)
    problem = F.when(keys.isNull(), "unreadable").when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS]))) > 0, "unknown-key").when(F.coalesce(doc["version"], F.lit(0)) != 1, "version")
    return texts.select("*", doc.alias("manifest"), problem.alias("problem"))


def canonical(manifest: F.Column) -> F.Column:
    """One text for equal manifests: keys in a fixed order, hidden ids sorted, absent values left out."""
    return F.to_json(F.struct(*[(F.array_sort(manifest[k]) if k == "hidden" else manifest[k]).alias(k) for k in KEYS]))
