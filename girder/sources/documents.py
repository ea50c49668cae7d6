"""Scenes and packages as JSON texts, a row each: hydration, shape checks, single members, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what a compiled package must hold, and how much of it
PARTS = ("scenes", "nodes", "meshes", "materials", "buffers", "bufferViews", "accessors")
CEILINGS = {"nodes": 4_000_000, "meshes": 4_000_000, "accessors": 4_000_000, "bufferViews": 4_000_000}

_REPRESENTATION = (
    "array<struct<id:string,purpose:string,surface:struct<positions:array<double>,indices:array<int>,normals:array<float>>,"
    "edges:struct<positions:array<double>,segments:array<int>,classes:array<tinyint>>>>"
)


def member(text: Column, key: str) -> Column:
    """One top-level member of a JSON text, as text, without parsing the others into rows (S27); null where it is absent."""
    return F.get_json_object(text, f"$['{key}']")


def package_problem(text: Column, ceilings: dict[str, int] | None = None) -> Column:
    """What is wrong with a package's document, or null (S11): unreadable, version, a missing part, no buffer, or more of a part
    than its ceiling allows; checked in this order, before any part is built."""
    keys = F.json_object_keys(text)
    problem = F.when(keys.isNull(), "unreadable").when(F.coalesce(F.get_json_object(text, "$.asset.version"), F.lit("")) != "2.0", "version")
    size = lambda part: F.json_array_length(member(text, part))
    for part in PARTS:
        problem = problem.when(size(part).isNull(), f"missing-{part}")
    problem = problem.when(size("buffers") < 1, "no-buffer")
    for part, most in (CEILINGS | (ceilings or {})).items():
        problem = problem.when(size(part) > most, f"too-many-{part}")
    return problem


def representations(texts: DataFrame, column: str, by: str) -> DataFrame:
    """by, representation_id, purpose, vertices, triangles and problem (S22): a scene's representations with their arrays typed.
    A scene without such an array gives one row with a problem."""
    found = texts.select(by, F.from_json(F.get_json_object(column, "$.representations"), _REPRESENTATION).alias("all"))
    each = found.select(by, F.explode_outer("all").alias("r"), F.col("all").isNull().alias("odd"))
    return each.where("odd or r is not null").select(
        by, F.col("r.id").alias("representation_id"), F.col("r.purpose").alias("purpose"), (F.size("r.surface.positions") / 3).cast("long").alias("vertices"),
        (F.size("r.surface.indices") / 3).cast("long").alias("triangles"), F.when(F.col("odd"), "no-representations").alias("problem"),
    )


def hydrated(bags: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """bag_id, key, value and problem: a split scene's property rows under their keys (S07). A row that names no set or has
    another number of values than its set has keys gives one row with a problem. bags(bag_id, set_id, row), sets(set_id,
    key_ids), keys(key_id, key)."""
    both = bags.join(sets, "set_id", "left")
    problem = F.when(F.col("key_ids").isNull(), "no-set").when(F.size("key_ids") != F.size("row"), "arity")
    told = both.withColumn("problem", problem)
    none = F.lit(None).cast("string")
    odd = told.where("problem is not null").select("bag_id", none.alias("key"), none.alias("value"), "problem")
    cells = told.where("problem is null").select("bag_id", F.explode(F.arrays_zip(F.col("key_ids").alias("key_id"), F.col("row").alias("value"))).alias("c"))
    return cells.select("bag_id", F.col("c.key_id").alias("key_id"), F.col("c.value").alias("value")).join(keys, "key_id").select("bag_id", "key", "value", none.alias("problem")).unionByName(odd)


def stream_problem(offset: Column, length: Column, element_bytes: Column, total: Column) -> Column:
    """What is wrong with a slice of a geometry file (S07): numbers that are no sizes, a length that holds no whole elements, or
    a slice that leaves the file."""
    return F.when((offset < 0) | (length < 0) | (length % element_bytes != 0), "alignment").when(offset + length > total, "range")


def write_lines(rows: DataFrame, path: str) -> None:
    """Each row as a line of JSON, nulls left out (K02, K09): lifecycle events, or the records of a document."""
    rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("value")).write.text(path)


def write_package(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table under its name, and then a report of their rows and digests (K01); the report is what says that all is there."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{path}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        digest = F.coalesce(F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")
        rows.append(back.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), digest.alias("digest")))
    report = rows[0]
    for r in rows[1:]:
        report = report.unionByName(r)
    write_lines(report.coalesce(1), f"{path}/report")
    return spark.read.schema(report.schema).json(f"{path}/report")
