"""Part-21 exchange files: header inspection, entity scans, unsupported entities, raw keyword counts."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.tables import listed, opened_store

# fixed values: accepted schemas and what their names start with
IFC_SCHEMAS = ("IFC4X3", "IFC4", "IFC2X3")
STEP_SCHEMAS = {"AP242": ("AP242", 242), "AP214": ("AUTOMOTIVE_DESIGN", 214), "AP203": ("CONFIG_CONTROL_DESIGN", 203)}
ENTITY = r"^\s*#(\d+)\s*=\s*(?:\(\s*)?([A-Za-z]\w*)\s*\("
HEADER_BYTES = 256 * 1024
BLOCK = 4 << 20
_NEW = re.compile(rb"\r\n?|\n")
_FILES = {"path": pa.string(), "name": pa.string(), "byte_length": pa.int64(), "sha256": pa.string(), "head": pa.string()}


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, name, byte_length, sha256 and the first HEADER_BYTES as text of the files at or right under some paths. Each file
    streams through a task that holds a block of it, so files may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = opened_store(path)
                digest, size, head = hashlib.sha256(), 0, b""
                with store.open_input_stream(at, compression=None) as f:
                    while block := f.read(BLOCK):
                        digest.update(block)
                        size += len(block)
                        head += block[: HEADER_BYTES - len(head)]
                row = (path, path.rsplit("/", 1)[-1], size, digest.hexdigest(), head.decode("latin-1"))
                yield pa.RecordBatch.from_pylist([dict(zip(_FILES, row))], pa.schema(list(_FILES.items())))

    return listed(spark, paths).mapInArrow(run, "path string, name string, byte_length long, sha256 string, head string")


def write_files(lines: DataFrame, folder: str) -> DataFrame:
    """Writes lines(name, place, value) as a file for each name, its lines in order of place; (name, byte_length) of each file.
    Lines are sorted by Spark and stream into the file. A file appears under its name when it is whole, so that a repeated task
    does no harm; the caller evaluates the result once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened_store(folder)
        store.create_dir(base, recursive=True)
        name, out, part = None, None, ""

        def close() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            store.move(part, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "byte_length": [size]})

        for batch in batches:
            for own, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                if own != name:
                    if out is not None:
                        yield close()
                    name, part = own, f"{base}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                out.write(((value or "") + "\n").encode())
        if out is not None:
            yield close()

    named = lines.where("name is not null").select("name", "place", "value")
    return named.repartition("name").sortWithinPartitions("name", "place", "value").mapInArrow(run, "name string, byte_length long")


def _own_lines(f: pa.NativeFile, begin: int, end: int, size: int) -> Iterator[bytes]:
    """The lines that begin from `begin` to before `end` of a file; they end with a line feed, a carriage return or both."""
    at = max(begin - 1, 0)
    f.seek(at)
    data = f.read(min(end, size) - at)
    while (at + len(data)) < size and (data[-1:] == b"\r" or not _NEW.search(data, max(end - 1 - at, 0))):
        data += f.read(BLOCK)
    place = 0 if not begin else m.end() if (m := _NEW.search(data)) else len(data)
    while place < len(data) and at + place < end:
        m = _NEW.search(data, place)
        yield data[place : m.start() if m else len(data)]
        place = m.end() if m else len(data)


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, value of the lines of the files at or right under some paths. Tasks list the files and read them by splits of BLOCK bytes, so
    neither their number nor their size is the driver's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: tuple[list, list] = [], []
            for path, begin, size in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "length"))):
                store, at = opened_store(path)
                with store.open_input_file(at) as f:
                    for line in _own_lines(f, begin, begin + BLOCK, size):
                        own[0].append(path)
                        own[1].append(line.decode("utf-8", "replace"))
                        if len(own[0]) == 10_000:
                            yield pa.RecordBatch.from_pydict({"path": own[0], "value": own[1]})
                            own = [], []
            yield pa.RecordBatch.from_pydict({"path": own[0], "value": own[1]}, pa.schema([("path", pa.string()), ("value", pa.string())]))

    splits = listed(spark, paths).where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(BLOCK).cast("long"))).alias("begin"))
    return splits.repartition("path", "begin").mapInArrow(run, "path string, value string")


def census(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name, lines, instances, types and the largest id of each exchange file (S04), in one pass by splits of the files."""
    rows = lines(spark, paths)
    kind = F.when(F.col("value").rlike(ENTITY), F.upper(F.regexp_extract("value", ENTITY, 2)))
    number = F.when(kind.isNotNull(), F.regexp_extract("value", ENTITY, 1).cast("long"))
    by_type = rows.groupBy("path", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"), F.max(number).alias("last_id"))
    own = F.col("type").isNotNull()
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return by_type.groupBy("path").agg(F.sum("n").alias("lines"), F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("instances"), F.count("type").alias("types"), F.max("last_id").alias("last_id")).select(name, "lines", "instances", "types", "last_id")


def schema_names(head: Column) -> Column:
    """All strings of the FILE_SCHEMA declaration in upper case, joined by blanks; null where none is declared."""
    declared = F.regexp_extract(head, r"(?is)FILE_SCHEMA\s*\(\s*\((.*?)\)\s*\)", 1)
    return F.nullif(F.upper(F.array_join(F.regexp_extract_all(declared, F.lit("'([^']+)'"), F.lit(1)), " ")), F.lit(""))


def ifc_schema(head: Column) -> Column:
    """IFC4X3, IFC4 or IFC2X3, whichever of them is named first in this order, or null."""
    names, out = schema_names(head), F.lit(None).cast("string")
    for schema in reversed(IFC_SCHEMAS):
        out = F.when(names.rlike(rf"\b{schema}(_|\b)"), schema).otherwise(out)
    return out


def step_schema(head: Column) -> Column:
    """AP242, AP214, AP203 or UNKNOWN (S03): by name, or by the number of its part of the standard."""
    names, out = schema_names(head), F.lit("UNKNOWN")
    for ap, (name, number) in reversed(STEP_SCHEMAS.items()):
        out = F.when(F.contains(names, F.lit(name)) | names.rlike(rf"10303\s+{number}\b"), ap).otherwise(out)
    return out


def _inspected(found: DataFrame, extension: str, schema: Column, accepted: tuple[str, ...]) -> DataFrame:
    """name, byte_length, sha256, schema and problem: extension, magic, declaration and schema are checked in this order."""
    problem = (
        F.when(~F.lower("name").rlike(extension), "extension").when(~F.col("head").rlike(r"^[\s\xA0]*ISO-10303-21;"), "magic")
        .when(schema_names(F.col("head")).isNull(), "undeclared").when(~F.coalesce(schema.isin(*accepted), F.lit(False)), "schema")
    )
    return found.select("name", "byte_length", "sha256", schema.alias("schema"), problem.alias("problem"))


def inspected_ifc(found: DataFrame) -> DataFrame:
    """Headers of exchange files of the building schemas (S01). found(name, byte_length, sha256, head)."""
    return _inspected(found, r"\.ifc$", ifc_schema(F.col("head")), IFC_SCHEMAS)


def inspected_step(found: DataFrame) -> DataFrame:
    """The same of product files, for AP214 and AP242 only."""
    return _inspected(found, r"\.(step|stp)$", step_schema(F.col("head")), ("AP214", "AP242"))


def inspect_ifc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return inspected_ifc(files(spark, paths))


def inspect_step(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return inspected_step(files(spark, paths))


def entities(lines: DataFrame, column: str = "value") -> DataFrame:
    """entity_id, type of every line that begins an instance."""
    found = lines.where(F.col(column).rlike(ENTITY))
    return found.select(F.regexp_extract(column, ENTITY, 1).cast("long").alias("entity_id"), F.upper(F.regexp_extract(column, ENTITY, 2)).alias("type"))


def histogram(lines: DataFrame, column: str = "value") -> DataFrame:
    """type, n and the largest entity id."""
    return entities(lines, column).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("entity_id").alias("last_id"))


# fixed values: the entity types that a scan counts by name
INDICATORS = {
    "mapped_items": "IFCMAPPEDITEM", "representation_maps": "IFCREPRESENTATIONMAP", "projects": "IFCPROJECT", "sites": "IFCSITE", "buildings": "IFCBUILDING", "storeys": "IFCBUILDINGSTOREY",
    "spaces": "IFCSPACE", "property_sets": "IFCPROPERTYSET", "single_value_properties": "IFCPROPERTYSINGLEVALUE",
}


def readiness(lines: DataFrame, place: str, column: str = "value") -> DataFrame:
    """One row (S04): lines, instances, the largest id, relations (types that begin with IFCREL), the types of INDICATORS, and
    whether the text is enclosed as it should be: its first and last lines with content, and HEADER; before DATA;. `place`
    orders the lines. One pass; what reaches the last task is a row for each task."""
    text, at = F.trim(column), F.col(place)
    own = F.when(F.col(column).rlike(ENTITY), F.upper(F.regexp_extract(column, ENTITY, 2)))
    full = F.when(text != "", at)
    sums = lines.agg(
        F.count(F.lit(1)).alias("lines"), F.count(own).alias("instances"), F.max(F.when(own.isNotNull(), F.regexp_extract(column, ENTITY, 1).cast("long"))).alias("last_id"),
        F.count_if(own.startswith("IFCREL")).alias("relations"), *[F.count_if(own == kind).alias(name) for name, kind in INDICATORS.items()],
        F.min_by(text, full).alias("_first"), F.max_by(text, full).alias("_last"),
        F.min(F.when(text == "DATA;", at)).alias("_data"), F.min(F.when(F.contains(column, F.lit("HEADER;")), at)).alias("_header"),
    )
    enclosed = (F.col("_first") == "ISO-10303-21;") & (F.col("_last") == "END-ISO-10303-21;") & (F.col("_header") <= F.col("_data"))
    return sums.withColumn("enclosed", F.coalesce(enclosed, F.lit(False))).drop("_first", "_last", "_data", "_header")


def unsupported(lines: DataFrame, supported: DataFrame, column: str = "value") -> DataFrame:
    """source_ref, type, diagnostic of instances that no capability covers (S10). supported(type)."""
    return entities(lines, column).join(supported.select("type").distinct(), "type", "left_anti").select(F.concat(F.lit("source:"), F.col("entity_id").cast("string")).alias("source_ref"), "type", F.concat(F.lit("UNSUPPORTED_ENTITY:"), "type").alias("diagnostic"))


def keyword_counts(texts: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Occurrences of each word over all texts, by raw text."""
    counts = [F.sum(F.coalesce(F.regexp_count(column, F.lit(rf"\b{w}\b")), F.lit(0))).cast("long").alias(w) for w in words]
    return texts.agg(*counts)
