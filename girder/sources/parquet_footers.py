"""Evidence of Parquet data from its footers.

Tasks read the magic and the footer of each file and nothing else: rows, row groups, columns, and what the statistics tell of
nulls and of columns with one value. Data is read for what no footer tells, such as whether identities repeat, and then only
the columns in question.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.tables import cut, listed, opened_store

# fixed values: a file's first and last bytes
MAGIC = b"PAR1"

_DDL = "path string, bytes long, fetched long, problem string, rows long, row_groups long, column string, type string, nulls long, only string"
_SCHEMA = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("bytes", "fetched")), ("problem", pa.string()), *((n, pa.int64()) for n in ("rows", "row_groups")), ("column", pa.string()), ("type", pa.string()), ("nulls", pa.int64()), ("only", pa.string())])


def _leaves(kind: pa.DataType) -> int:
    return sum(_leaves(kind.field(i).type) for i in range(kind.num_fields)) if pa.types.is_nested(kind) else 1


def _column(meta: pq.FileMetaData, leaf: int, kind: pa.DataType) -> tuple[int | None, str | None]:
    """(nulls, the one integer or string) of a flat column, each None unless the statistics of all row groups tell it. Statistics that were
    shortened have different ends, so equal ends are a whole value."""
    nulls, values = 0, set() if pa.types.is_integer(kind) or pa.types.is_string(kind) else {None}
    for g in range(meta.num_row_groups):
        s = meta.row_group(g).column(leaf).statistics
        nulls = nulls + s.null_count if nulls is not None and s is not None and s.has_null_count else None
        if values == {None}:
            continue
        if s is not None and s.has_min_max:
            values |= {s.min, s.max}
        elif s is None or not s.has_null_count or s.null_count < meta.row_group(g).num_rows:
            values |= {None}
        if len(values) > 1:
            values = {None}
    value = values.pop() if values else None
    return nulls, str(value) if isinstance(value, str | int) else None


def _inspect(path: str, size: int) -> list[dict]:
    """A row for each top-level column of a file, or one with the file's problem."""
    store, at = opened_store(path)
    row = {"path": path, "bytes": size, "fetched": 0, **dict.fromkeys(_SCHEMA.names[3:])}
    if size < 12:
        return [row | {"problem": "short"}]
    with store.open_input_file(at) as f:
        head, end = f.read_at(4, 0), f.read_at(8, size - 8)
        if head != MAGIC or end[4:] != MAGIC:
            return [row | {"problem": "magic", "fetched": 12}]
        length = int.from_bytes(end[:4], "little")
        if length > size - 12:
            return [row | {"problem": "footer", "fetched": 12}]
        row["fetched"] = 12 + length
        try:
            file = pq.ParquetFile(pa.BufferReader(MAGIC + f.read_at(length, size - 8 - length) + end))
            meta, fields = file.metadata, list(file.schema_arrow)
        except (pa.ArrowException, OSError):
            return [row | {"problem": "footer"}]
    row |= {"rows": meta.num_rows, "row_groups": meta.num_row_groups}
    out, leaf = [], 0
    for field in fields:
        nulls, only = (None, None) if pa.types.is_nested(field.type) else _column(meta, leaf, field.type)
        leaf += _leaves(field.type)
        out.append(row | {"column": field.name, "type": str(field.type), "nulls": nulls, "only": only})
    return out or [row]


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each column of each Parquet file at or under a path: bytes, those fetched, rows, row_groups, column, type,
    nulls, and the only value. nulls and only are null where the statistics do not tell, which nested columns' never do. A file
    that is no Parquet file has one row with its problem: short, magic or footer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                yield pa.RecordBatch.from_pylist(_inspect(path, size), _SCHEMA)

    return listed(spark, path, ".parquet", deep=True).mapInArrow(run, _DDL)


def evidence(spark: SparkSession, path: str, payload: str, identity: str, single: tuple[str, ...] = ()) -> DataFrame:
    """One row for the data at a path: files, bytes, rows, row_groups, columns (sorted, comma-joined), payloads and identities
    (not null), unique_identities, generators (for each column of `single`, whether it has one value everywhere) and problem: a
    file's, else columns (files differ, or one asked for is missing), payload, identity or the name of a column of `single`.

    Identities are read, without other columns, as no footer tells repeats apart. Payloads and single columns are read only where
    their statistics are missing, nested, or differ. One row of the footers reaches the driver."""
    wanted = list(dict.fromkeys((payload, identity, *single)))
    found = cut(footers(spark, path), "footers")
    of = lambda c, value: F.max(F.when(F.col("column") == c, value))
    told = [x for i, c in enumerate(wanted) for x in (of(c, F.col("nulls")).alias(f"n{i}"), of(c, F.col("only")).alias(f"o{i}"))]
    by_file = found.groupBy("path").agg(F.first("bytes").alias("bytes"), F.first("problem").alias("problem"), F.first("rows").alias("rows"), F.first("row_groups").alias("row_groups"), F.array_join(F.sort_array(F.collect_list("column")), ",").alias("columns"), *told)
    full = F.col("rows") > 0  # a file without rows has no values
    known = [x for i in range(len(wanted)) for x in (F.sum(f"n{i}").alias(f"n{i}"), F.bool_and(F.col(f"n{i}").isNotNull()).alias(f"nk{i}"), F.count_distinct(F.when(full, F.col(f"o{i}"))).alias(f"o{i}"), F.bool_and(~full | F.col(f"o{i}").isNotNull()).alias(f"ok{i}"))]
    s = by_file.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.min("problem").alias("problem"), F.sum("rows").alias("rows"), F.sum("row_groups").alias("row_groups"), F.min("columns").alias("columns"), F.max("columns").alias("most"), *known).first()
    held = set((s["columns"] or "").split(","))
    if not s["files"]:
        raise FileNotFoundError(f"no Parquet file under {path}")
    problem = s["problem"] or ("columns" if s["columns"] != s["most"] or not held.issuperset(wanted) else None)
    counted = {c: F.lit(s["rows"] - s[f"n{i}"]) for i, c in enumerate(wanted) if s[f"nk{i}"]}
    alone = {c: F.lit(s[f"o{i}"] == 1 and s[f"n{i}"] == 0) for i, c in enumerate(wanted) if c in single and s[f"nk{i}"] and s[f"ok{i}"]}
    fixed = [F.lit(s[n]).cast("long").alias(n) for n in ("files", "bytes", "rows", "row_groups")]
    if problem:
        nothing = [F.lit(None).cast("long").alias(n) for n in ("payloads", "identities", "unique_identities")]
        return spark.range(1).select(*fixed, F.lit(s["columns"]).alias("columns"), *nothing, F.lit(None).cast("map<string,boolean>").alias("generators"), F.lit(problem).alias("problem"))
    name = lambda c: F.col(f"`{c}`")
    one = lambda c: F.coalesce((F.min(name(c)) == F.max(name(c))) & (F.count(name(c)) == F.lit(s["rows"])), F.lit(False))
    data = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path)
    sums = data.agg(counted.get(payload, F.count(name(payload))).cast("long").alias("payloads"), counted.get(identity, F.count(name(identity))).cast("long").alias("identities"), F.count_distinct(name(identity)).alias("unique_identities"), *[alone.get(c, one(c)).alias(f"_{i}") for i, c in enumerate(single)])
    generators = F.create_map(*[x for i, c in enumerate(single) for x in (F.lit(c), F.col(f"_{i}"))]).cast("map<string,boolean>")
    wrong = F.when(F.col("payloads") < s["rows"], "payload").when((F.col("identities") < s["rows"]) | (F.col("unique_identities") < s["rows"]), "identity")
    for i, c in enumerate(single):
        wrong = wrong.when(~F.col(f"_{i}"), c)
    return sums.select(*fixed, F.lit(s["columns"]).alias("columns"), "payloads", "identities", "unique_identities", generators.alias("generators"), wrong.alias("problem"))
