"""Meshes, bases and instances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from girder.operators.digests import streamed
from girder.operators.hierarchy import multiply, transformed_bounds
from girder.operators.ranking import bounds_union


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """mesh_id, vertex, nx, ny, nz: the sum of the face normals around a vertex, each as long as twice its face is large,
    brought to length 1; where they cancel out, (0, 0, 1) (A30). faces(mesh_id, a, b, c), vertices(mesh_id, vertex, x, y, z)."""
    out = faces
    for c in "abc":
        out = out.join(vertices.select("mesh_id", F.col("vertex").alias(c), *[F.col(a).cast("double").alias(f"{c}{a}") for a in "xyz"]), ["mesh_id", c])
    u, v = ({a: F.col(f"{c}{a}") - F.col(f"a{a}") for a in "xyz"} for c in "bc")
    cross = [u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"], u["x"] * v["y"] - u["y"] * v["x"]]
    corners = out.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vertex"), *[n.alias(f"n{a}") for a, n in zip("xyz", cross)])
    summed = corners.groupBy("mesh_id", "vertex").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return summed.select("mesh_id", "vertex", *[F.when(length > 0, F.col(f"n{a}") / length).otherwise(F.lit(1.0 if a == "z" else 0.0)).alias(f"n{a}") for a in "xyz"])


def edge_records(edges: DataFrame) -> DataFrame:
    """edges(id, indices, classes, sources) with `table`, the distinct sources in order, `places`, each edge's index into it,
    and `problem` (P22): two indices an edge, a class and a source for each, classes 0 to 6, positive sources."""
    n = F.size("classes")
    problem = (
        F.when(F.size("indices") != 2 * n, "INVALID_EDGE_LAYOUT").when(F.exists("classes", lambda c: (c < 0) | (c > 6)), "UNKNOWN_EDGE_CLASS")
        .when(F.size("sources") != n, "SOURCE_MAP_COUNT_MISMATCH").when(F.exists("sources", lambda s: s <= 0), "SOURCE_MAP_OUT_OF_RANGE")
    )
    with_table = edges.withColumn("table", F.array_sort(F.array_distinct("sources")))
    return with_table.withColumns({"places": F.transform("sources", lambda s: F.array_position("table", s) - 1), "problem": problem})


def up_axis_basis(axis: Column) -> Column:
    """The column-major change of basis that makes the named axis Y and keeps handedness (P07): X by a cyclic turn of all three
    axes, Z by a quarter turn around X."""
    images = {"Y": (0, 1, 2), "Z": (0, 2, 1), "X": (2, 0, 1)}
    signs = {"Y": (1, 1, 1), "Z": (1, 1, -1), "X": (1, 1, 1)}

    def cells(a: str) -> Column:
        m = [0.0] * 16
        for row, (source, sign) in enumerate(zip(images[a], signs[a])):
            m[source * 4 + row] = float(sign)
        m[15] = 1.0
        return F.array(*[F.lit(v) for v in m])

    return F.when(F.upper(axis) == "X", cells("X")).when(F.upper(axis) == "Z", cells("Z")).otherwise(cells("Y"))


@F.pandas_udf(ArrayType(DoubleType()))
def inverse(m: pd.Series) -> pd.Series:
    """The inverse of column-major 4x4 matrices; null where there is none. Spark has no built-in for it."""

    def one(a: np.ndarray | None) -> np.ndarray | None:
        if a is None or len(a) != 16:
            return None
        try:
            return np.linalg.inv(np.asarray(a, float).reshape(4, 4).T).T.ravel()
        except np.linalg.LinAlgError:
            return None

    return m.map(one)


def local_transforms(nodes: DataFrame) -> DataFrame:
    """nodes(node_id, parent_id, world) with `local` = inverse(parent's world) x world."""
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("world").alias("above"))
    joined = nodes.join(parents, "parent_id", "left")
    made = joined.withColumn("turned", inverse("above"))
    return made.withColumn("local", F.when(F.col("above").isNull(), F.col("world")).otherwise(multiply(F.col("turned"), F.col("world")))).drop("above", "turned")


def box_instances(boxes: DataFrame) -> DataFrame:
    """boxes(id, world, min_x..max_z) with `instance`, the matrix that puts a unit cube around the origin there:
    world x T(centre) x S(size), made without the products by cells that are always 0 (G11). An array among the factors would be
    built anew for every product, in code that Spark cannot compile."""
    world = lambda r, c: F.col("world")[c * 4 + r]
    centre, size = ([f(F.col(f"min_{a}"), F.col(f"max_{a}")).cast("double") for a in "xyz"] for f in (lambda lo, hi: (lo + hi) / 2, lambda lo, hi: hi - lo))
    turned = [world(r, c) * size[c] for c in range(3) for r in range(4)]
    moved = [world(r, 0) * centre[0] + world(r, 1) * centre[1] + world(r, 2) * centre[2] + world(r, 3) for r in range(4)]
    return boxes.withColumn("instance", F.array(*turned, *moved))


def chunk_bounds(instances: DataFrame) -> DataFrame:
    """chunk, min_x..max_z: the box around the chunk's transformed boxes (G12). instances(chunk, world, min_x..max_z)."""
    moved = instances.select("chunk", *[c.alias(n) for n, c in transformed_bounds(F.col("world")).items()])
    return bounds_union(moved, ["chunk"])


def representation_digest(streams: DataFrame) -> DataFrame:
    """representation_id, digest: the labelled streams of a representation in label order, each with its type; an absent one
    is told from an empty one (A32). streams(representation_id, label, kind, content)."""
    part = F.concat_ws("\x1f", F.col("label"), F.col("kind"), F.coalesce(F.sha2(F.col("content").cast("binary"), 256), F.lit("absent")))
    return streamed(streams.select("representation_id", "label", part.alias("piece")), ["representation_id"], ["label", "piece"], "\x1e")


def display(value: Column, levels: int = 4) -> Column:
    """A property's JSON text as shown to a user (P20): strings bare, quantities with their unit, tagged values by value,
    arrays joined by commas, at most `levels` of them one in another."""
    kind = F.get_json_object(value, "$.type")
    items = F.from_json(F.get_json_object(value, "$.values"), "array<string>")
    items = F.transform(items, lambda v: display(v, levels - 1)) if levels > 1 else items
    plain = F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
    return (
        F.when(kind == "quantity", F.concat_ws(" ", F.get_json_object(value, "$.value"), F.get_json_object(value, "$.unit")))
        .when(kind.isin("enum", "uri"), F.get_json_object(value, "$.value")).when(kind == "array", F.array_join(items, ", ")).otherwise(plain)
    )
