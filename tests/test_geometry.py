"""Meshes, instances, row rules and sidecars on literal inputs."""

import re

import numpy as np
from pyspark.sql import functions as F

from girder.operators import geometry, hierarchy, rules
from girder.sources import columnar, federation


def test_degenerate_normals_point_up(spark):  # A30
    v = spark.createDataFrame([("m", i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (2, 0)])], "mesh_id string, vertex long, x double, y double, z double")
    f = spark.createDataFrame([("m", 0, 2, 1), ("m", 0, 1, 3)], "mesh_id string, a long, b long, c long")
    got = {r.vertex: (r.nx, r.ny, r.nz) for r in geometry.vertex_normals(f, v).collect()}
    assert got == {0: (0, 0, -1), 1: (0, 0, -1), 2: (0, 0, -1), 3: (0, 0, 1)}


def test_local_transforms_invert_world_transforms(spark):  # G01, G02
    r = np.random.default_rng(1)

    def matrix():
        m = np.eye(4)
        m[:3] = r.integers(-3, 4, (3, 4)) + 5 * np.eye(4)[:3]
        return [float(x) for x in m.T.ravel()]

    df = spark.createDataFrame([("a", None, matrix()), ("b", "a", matrix()), ("c", "b", matrix())], "node_id string, parent_id string, local array<double>")
    world = hierarchy.world_transforms(df)
    back = {x.node_id: x.local for x in geometry.local_transforms(world.drop("local", "depth")).collect()}
    for x in df.collect():
        assert np.allclose(back[x.node_id], x.local)


def test_basis_and_instances(spark):  # P07, G11
    for axis in "XYZ":
        m = np.array(spark.range(1).select(geometry.up_axis_basis(F.lit(axis)).alias("m")).first().m).reshape(4, 4).T
        up = np.zeros(4)
        up["XYZ".index(axis)] = 1
        assert (m @ up)[1] == 1 and round(np.linalg.det(m)) == 1
    df = spark.createDataFrame([([1.0 if i % 5 == 0 else 0.0 for i in range(16)], 0.0, 4.0, 2.0, 3.0, -1.0, 1.0)], "world array<double>, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    m = np.array(geometry.box_instances(df).first().instance).reshape(4, 4).T
    assert (m @ [0.5, 0.5, 0.5, 1]).tolist() == [4, 3, 1, 1] and (m @ [-0.5, -0.5, -0.5, 1]).tolist() == [0, 2, -1, 1]


def test_instances_are_compiled(spark, capsys):  # G11: what Spark cannot compile, and methods over 8,000 bytes, are interpreted row by row
    sides = {f"{s}_{a}": (F.col("id") * k + n).cast(kind) for k, (a, kind) in enumerate((("x", "long"), ("y", "double"), ("z", "int")), 2) for n, s in enumerate(("min", "max"))}
    given = spark.range(5).withColumns(sides).withColumns({"cells": F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.col("id") * i - 7) / 4)})
    literal = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 0, 0, 1)])
    for world in (literal, F.col("cells")):
        made = geometry.box_instances(given.withColumn("world", world)).withColumn("corner", F.element_at("instance", 1))
        made.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(-?\d+)", capsys.readouterr().out)]
        assert sizes and all(0 < n < 8000 for n in sizes)
        for r in made.collect():
            centre, size = ([f(r[f"min_{a}"], r[f"max_{a}"]) for a in "xyz"] for f in (lambda lo, hi: (lo + hi) / 2, lambda lo, hi: hi - lo))
            box = np.diag([*size, 1.0])
            box[:3, 3] = centre
            assert (np.array(r.instance).reshape(4, 4).T == np.array(r.world).reshape(4, 4).T @ box).all()


def test_edges(spark):  # P22
    df = spark.createDataFrame([(1, [0, 1, 1, 2], [0, 6], [9, 4]), (2, [0], [0], [1]), (3, [0, 1], [7], [1]), (4, [0, 1], [1], [1, 2]), (5, [0, 1], [1], [0])], "id int, indices array<int>, classes array<int>, sources array<int>")
    got = {r.id: r for r in geometry.edge_records(df).collect()}
    assert (got[1].table, got[1].places, got[1].problem) == ([4, 9], [1, 0], None)
    assert [got[i].problem for i in (2, 3, 4, 5)] == ["INVALID_EDGE_LAYOUT", "UNKNOWN_EDGE_CLASS", "SOURCE_MAP_COUNT_MISMATCH", "SOURCE_MAP_OUT_OF_RANGE"]


def test_digest_and_display(spark):  # A32, P20
    schema = "representation_id string, label string, kind string, content string"
    d = lambda rows: geometry.representation_digest(spark.createDataFrame(rows, schema)).first().digest
    rows = [("r", "positions", "f64", "1"), ("r", "indices", "u32", None)]
    assert d(rows) == d(rows[::-1]) != d([rows[0], ("r", "indices", "u32", "")])
    shown = {'"a b"': "a b", "1.5": "1.5", "null": "null", '{"type":"quantity","unit":"m","value":1.5}': "1.5 m", '{"type":"uri","value":"x:y"}': "x:y", '{"type":"array","values":[1,"x"]}': "1, x"}
    df = spark.createDataFrame([(k,) for k in shown], "v string")
    assert {r.v: r.s for r in df.select("v", geometry.display(F.col("v")).alias("s")).collect()} == shown


def test_row_rules(spark):  # section 2.12
    nodes = spark.createDataFrame([("a", None, None, 0, None, 1), ("b", [1.0], [1.0, 2.0, 3.0], 5, -1, 1), ("c", None, [float("nan"), 0.0, 0.0], None, None, 1)], "id string, matrix array<double>, translation array<double>, mesh int, coarse_mesh int, meshes int")
    assert {(r.code, r.path) for r in rules.check("nodes", nodes, "id").collect()} == {("NODE_MATRIX", "b"), ("NODE_TRANSFORM", "b"), ("NODE_MESH", "b"), ("NODE_COARSE_MESH", "b"), ("NODE_TRANSLATION", "c")}
    data = spark.createDataFrame([("x", "ifc", "a" * 40, "MIT", "MIT"), ("y", "zip", "1", None, "MIT")], "id string, kind string, revision string, licence string, expected_licence string")
    assert {(r.code, r.path) for r in rules.check("datasets", data, "id").collect()} == {(c, "y") for c in ("DATASET_KIND", "DATASET_REVISION", "DATASET_LICENCE")}
    scene = spark.createDataFrame([("s", 1, "r"), (" ", 1, "r"), ("s", 0, "r")], "scene_id string, schema_version int, revision string")
    assert rules.check("scene", scene, "scene_id").count() == 2


def test_sidecars(spark):  # S12, S13, S14
    df = spark.createDataFrame([("a", [1, 2], ["x", "y"]), ("b", [1], ["x", "y"]), ("c", [], [])], "doc string, i array<int>, s array<string>")
    rows = columnar.unpacked(df, "doc", ["i", "s"])
    assert [tuple(r) for r in rows.orderBy("position").collect()] == [("a", 0, 1, "x"), ("a", 1, 2, "y")]
    assert [r.doc for r in columnar.uneven(df, "doc", ["i", "s"]).collect()] == ["b"]
    assert columnar.packed(rows, "doc", "position", ["i", "s"]).first() == ("a", [1, 2], ["x", "y"])
    heap = spark.createDataFrame([("a", "1é2".encode()), ("b", b"12"), ("c", b"")], "doc string, heap binary")
    table = spark.createDataFrame([("a", [0, 1, 3, 4]), ("b", [0, 2, 1]), ("c", [0])], "doc string, offsets array<int>")
    assert [(r.doc, r.value_id, r.value) for r in columnar.sliced(heap, table).orderBy("value_id").collect()] == [("a", 0, "1"), ("a", 1, "é"), ("a", 2, "2")]
    assert [r.doc for r in columnar.odd_offsets(heap, table).collect()] == ["b"]


def test_staged_emission(spark, tmp_path):  # ST06, K06
    rows = [("d1", i, i == 2) for i in range(3)] + [("d2", 0, False)]
    spark.createDataFrame(rows, "document_id string, entry int, last boolean").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("document_id string, entry int, last boolean").parquet(f"file://{tmp_path}/in")
    federation.staged(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert [tuple(r)[:2] for r in spark.read.parquet(f"file://{tmp_path}/out/index").collect()] == [("d1", 3)]
    assert spark.read.parquet(f"file://{tmp_path}/out/trees").count() == 4
