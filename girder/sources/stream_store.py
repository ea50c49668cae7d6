"""Typed streams of meshes and property columns as a data source (S07, S11, S12, K03 and K04 by content).

A table with keys and array or binary columns is written as parts: each task appends the arrays to a binary file, every stream
at a multiple of 8 bytes, and lists in a Parquet index where each lies. The manifest, written last, says which parts count.

Reading plans a partition for each row group of an index, leaves out those whose statistics exclude the pushed-down keys, and
fetches from the binary only the streams of rows that pass and of columns that the given schema names; streams that lie
together are fetched at once. Each is checked on the way: a known encoding, whole elements, the declared number of them,
and a place inside its file. With `strict` (the default) a fault is an error; else the row has its first fault as `problem`.
The driver handles one entry a part and one a row group, never a row.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, ByteType, DoubleType, FloatType, IntegerType, StructType

ALIGN = 8
ROW_GROUP = 4096  # index rows planned as one partition
HELD = 32 << 20  # bytes of streams that a reader holds
GAP = 64 << 10  # bytes between two wanted streams that are fetched rather than skipped

# fixed values: encodings of streams
ENCODINGS = {"f64le": ("<f8", pa.float64()), "f32le": ("<f4", pa.float32()), "u32le": ("<i4", pa.int32()), "u8": ("u1", pa.int8())}
_OF_TYPE = {DoubleType: "f64le", FloatType: "f32le", IntegerType: "u32le", ByteType: "u8"}


def encoding_of(kind: object) -> str | None:
    """The encoding of a column's type, or None for a key."""
    if isinstance(kind, BinaryType):
        return "u8"
    return _OF_TYPE[type(kind.elementType)] if isinstance(kind, ArrayType) else None


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    parts: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        self.path, self.streams, self.keys = path, {f.name: e for f in schema if (e := encoding_of(f.dataType))}, [f.name for f in schema if not encoding_of(f.dataType)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        name, index, place = uuid.uuid4().hex, None, 0
        out = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                out = store.open_output_stream(f"{at}/{name}.bin", compression=None)
            columns = {k: batch.column(k) for k in self.keys}
            for column, encoding in self.streams.items():
                spans = []
                for value in batch.column(column):
                    if not value.is_valid:
                        spans.append(None)
                        continue
                    raw = value.as_buffer().to_pybytes() if pa.types.is_binary(value.type) or pa.types.is_large_binary(value.type) else value.values.to_numpy(zero_copy_only=False).astype(ENCODINGS[encoding][0]).tobytes()
                    out.write(raw + bytes(-len(raw) % ALIGN))
                    spans.append({"at": place, "bytes": len(raw), "elements": len(raw) // np.dtype(ENCODINGS[encoding][0]).itemsize, "encoding": encoding})
                    place += len(raw) + -len(raw) % ALIGN
                columns[column] = pa.array(spans, pa.struct([("at", pa.int64()), ("bytes", pa.int64()), ("elements", pa.int64()), ("encoding", pa.string())]))
            table = pa.table(columns)
            if index is None:
                index = pq.ParquetWriter(store.open_output_stream(f"{at}/{name}.parquet", compression=None), table.schema)
            index.write_table(table, row_group_size=ROW_GROUP)
        if out is None:
            return _Written([])
        index.close()
        out.close()
        return _Written([name])

    def commit(self, messages: list[_Written | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/manifest.json", compression=None) as f:
            f.write(json.dumps(sorted(p for m in messages if m for p in m.parts)).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, at = _store(self.path)
        for part in (p for m in messages if m for p in m.parts):
            store.delete_file(f"{at}/{part}.bin")
            store.delete_file(f"{at}/{part}.parquet")


@dataclass
class Group(InputPartition):
    part: str
    group: int


class StreamReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, strict: bool):
        self.path, self.schema, self.strict = path, schema, strict
        self.wanted = {f.name: e for f in schema if (e := encoding_of(f.dataType))}
        self.tests: list[tuple[str, str, object]] = []  # (key, "in", values) or (key, ">=" or "<=", value)
        self.fetched = 0  # bytes of streams that this reader has fetched

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] not in self.wanted:
                self.tests.append((f.attribute[0], "in", (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            elif isinstance(f, (GreaterThanOrEqual, LessThanOrEqual)) and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], ">=" if isinstance(f, GreaterThanOrEqual) else "<=", f.value))
            else:
                yield f

    def partitions(self) -> list[Group]:
        store, at = _store(self.path)
        with store.open_input_file(f"{at}/manifest.json") as f:
            parts = json.loads(f.read())
        found = []
        for part in parts:
            with store.open_input_file(f"{at}/{part}.parquet") as f:
                meta = pq.read_metadata(f)
            place = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
            found += [Group(part, g) for g in range(meta.num_row_groups) if self._may_hold(meta.row_group(g), place)]
        return found or [Group("", 0)]

    def _may_hold(self, group: pq.RowGroupMetaData, place: dict[str, int]) -> bool:
        for key, how, value in self.tests:
            stats = group.column(place[key]).statistics if key in place else None
            if stats is not None and stats.has_min_max:
                if how == "in" and not any(v is not None and stats.min <= v <= stats.max for v in value) or how == ">=" and stats.max < value or how == "<=" and stats.min > value:
                    return False
        return True

    def _passes(self, table: pa.Table) -> np.ndarray:
        fits = np.ones(table.num_rows, bool)
        for key, how, value in self.tests:
            own = table.column(key).to_pylist()
            fits &= np.array([v is not None and (v in value if how == "in" else v >= value if how == ">=" else v <= value) for v in own], bool)
        return fits

    def read(self, group: Group) -> Iterator[pa.RecordBatch]:
        if not group.part:
            return
        store, at = _store(self.path)
        keys = [f.name for f in self.schema if f.name not in self.wanted and f.name != "problem"]
        with store.open_input_file(f"{at}/{group.part}.parquet") as f:
            index = pq.ParquetFile(f)
            known = set(index.schema_arrow.names)
            if missing := (set(keys) | set(self.wanted)) - known:
                raise ValueError(f"the store has no column {min(missing)}")
            table = index.read_row_group(group.group, columns=sorted(set(keys) | set(self.wanted) | {t[0] for t in self.tests}))
        table = table.filter(pa.array(self._passes(table)))
        spans = {c: table.column(c).to_pylist() for c in self.wanted}
        with store.open_input_file(f"{at}/{group.part}.bin") as f:
            size = f.size()
            problems = [next((p for c in self.wanted if (p := self._problem(spans[c][i], self.wanted[c], size))), None) for i in range(table.num_rows)]
            if self.strict and any(problems):
                raise ValueError(f"{group.part}: {next(p for p in problems if p)}")
            spans = {c: [None if p else s for p, s in zip(problems, own)] for c, own in spans.items()}
            weight = np.cumsum([sum(spans[c][i]["bytes"] for c in self.wanted if spans[c][i]) for i in range(table.num_rows)])
            a = 0
            while a < table.num_rows:  # at most HELD bytes of streams at a time, or one row
                b = max(a + 1, int(np.searchsorted(weight, (weight[a - 1] if a else 0) + HELD, side="right")))
                raw = self._fetch(f, sorted((s["at"], s["bytes"]) for own in spans.values() for s in own[a:b] if s))
                arrays = []
                for field in self.schema:
                    if field.name == "problem":
                        arrays.append(pa.array(problems[a:b], pa.string()))
                    elif field.name in self.wanted:
                        own = [raw[s["at"], s["bytes"]] if s else None for s in spans[field.name][a:b]]
                        arrays.append(self._typed(own, self.wanted[field.name], isinstance(field.dataType, BinaryType)))
                    else:
                        arrays.append(pa.concat_arrays(table.column(field.name).slice(a, b - a).chunks))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in self.schema])
                a = b

    @staticmethod
    def _problem(span: dict | None, encoding: str, size: int) -> str | None:
        if span is None:
            return None
        width = np.dtype(ENCODINGS[encoding][0]).itemsize
        if span["encoding"] != encoding:
            return "encoding"
        if span["at"] < 0 or span["bytes"] < 0 or span["bytes"] % width or span["at"] % ALIGN:
            return "alignment"
        if span["elements"] * width != span["bytes"]:
            return "elements"
        return "range" if span["at"] + span["bytes"] > size else None

    def _fetch(self, f: pa.NativeFile, spans: list[tuple[int, int]]) -> dict[tuple[int, int], bytes]:
        """Each span's bytes; spans at most GAP apart are one request."""
        out, i = {}, 0
        while i < len(spans):
            j, end = i + 1, spans[i][0] + spans[i][1]
            while j < len(spans) and spans[j][0] <= end + GAP:
                end = max(end, spans[j][0] + spans[j][1])
                j += 1
            f.seek(spans[i][0])
            block = f.read(end - spans[i][0])
            self.fetched += len(block)
            for at, n in spans[i:j]:
                out[at, n] = block[at - spans[i][0] : at - spans[i][0] + n]
            i = j
        return out

    @staticmethod
    def _typed(own: list[bytes | None], encoding: str, binary: bool) -> pa.Array:
        if binary:
            return pa.array(own, pa.binary())
        kind, arrow = ENCODINGS[encoding]
        width = np.dtype(kind).itemsize
        offsets = np.concatenate(([0], np.cumsum([len(x or b"") // width for x in own]))).astype(np.int32)
        values = np.frombuffer(b"".join(x or b"" for x in own), kind)
        values = pa.array(values.view(np.int8) if encoding == "u8" else values, arrow)
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in own]))


class StreamStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "girder_streams"

    def schema(self) -> StructType:
        raise ValueError("give the wanted columns as the schema")

    def reader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], schema, self.options.get("strict", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema)


def write(df: DataFrame, path: str) -> None:
    """Keys and streams of df to a new store; rows that are read together should stand together."""
    spark = df.sparkSession
    spark.dataSource.register(StreamStore)
    df.write.format(StreamStore.name()).mode("append").save(path)


def read(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """The wanted keys and streams, and `problem` if it is named; equality, membership and closed bounds of keys are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StreamStore)
    return spark.read.format(StreamStore.name()).schema(schema).option("path", path).option("strict", str(strict).lower()).load()
