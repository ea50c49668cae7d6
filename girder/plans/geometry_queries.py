"""Queries of meshes, instances, row rules and sidecars over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder import fixtures as fx
from girder.operators import geometry, hierarchy
from girder.operators.ranking import dense_rank_all
from girder.sources import columnar, federation, stream_store
from girder.tables import load, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_MESH = """v AS (SELECT p_partkey % 40 AS mesh_id, p_partkey // 40 AS vertex, p_size AS x, p_partkey % 7 AS y, p_partkey % 5 AS z FROM part),
f AS (SELECT mesh_id, vertex AS a, vertex + 1 AS b, vertex + 2 AS c FROM v WHERE vertex + 2 <= (SELECT max(vertex) FROM v w WHERE w.mesh_id = v.mesh_id))"""


@query(f"""WITH {_MESH}, n AS (SELECT f.mesh_id, a, b, c, (q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y) AS nx, (q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z) AS ny, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) AS nz
  FROM f JOIN v p ON p.mesh_id = f.mesh_id AND p.vertex = a JOIN v q ON q.mesh_id = f.mesh_id AND q.vertex = b JOIN v r ON r.mesh_id = f.mesh_id AND r.vertex = c),
s AS (SELECT mesh_id, vertex, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT *, unnest([a, b, c]) AS vertex FROM n) GROUP BY 1, 2), l AS (SELECT *, sqrt((nx * nx + ny * ny + nz * nz)::DOUBLE) AS len FROM s)
SELECT mesh_id, vertex, round(CASE WHEN len > 0 THEN nx / len ELSE 0 END, 6)::DOUBLE AS nx, round(CASE WHEN len > 0 THEN ny / len ELSE 0 END, 6)::DOUBLE AS ny, round(CASE WHEN len > 0 THEN nz / len ELSE 1 END, 6)::DOUBLE AS nz FROM l""")
def vertex_normals(spark, d):  # A30
    k = F.col("p_partkey")
    v = load(spark, d, "part").select((k % 40).alias("mesh_id"), F.floor(k / 40).alias("vertex"), F.col("p_size").alias("x"), (k % 7).alias("y"), (k % 5).alias("z"))
    last = v.groupBy("mesh_id").agg(F.max("vertex").alias("last"))
    faces = v.join(last, "mesh_id").where("vertex + 2 <= last").select("mesh_id", F.col("vertex").alias("a"), (F.col("vertex") + 1).alias("b"), (F.col("vertex") + 2).alias("c"))
    # adding 0.0 turns minus zero into zero
    return geometry.vertex_normals(faces, v).select("mesh_id", "vertex", *[(F.round(f"n{a}", 6) + 0.0).alias(f"n{a}") for a in "xyz"])


@query(f"""WITH {fx.OCCURRENCES_SQL} SELECT substr(prototype_id, 8, 3) AS chunk, min(min_x + 10) AS min_x, min(2 * min_y) AS min_y, min(-max_z) AS min_z, max(max_x + 10) AS max_x, max(2 * max_y) AS max_y, max(-min_z) AS max_z FROM occ GROUP BY 1""")
def chunk_bounds(spark, d):  # G03, G12
    world = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 2, 0, 0, 0, 0, -1, 0, 10, 0, 0, 1)])
    o = fx.occurrences(spark, d).withColumns({"chunk": F.substring("prototype_id", 8, 3), "world": world})
    return geometry.chunk_bounds(o).select("chunk", *[F.col(c).cast("long").alias(c) for c in ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")])


@query("""SELECT l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS sources, CASE WHEN max(l_linenumber) > 6 THEN 'UNKNOWN_EDGE_CLASS' WHEN min(l_suppkey) <= 0 THEN 'SOURCE_MAP_OUT_OF_RANGE' END AS problem FROM lineitem GROUP BY 1""")
def edge_records(spark, d):  # P22
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("sources"), F.collect_list("l_linenumber").alias("classes"))
    found = geometry.edge_records(rows.withColumn("indices", F.sequence(F.lit(1), 2 * F.size("classes"))))
    return found.select("l_orderkey", F.array_join(F.array_sort(F.transform("table", lambda s: s.cast("string"))), ",").alias("sources"), "problem")


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, o_orderkey, o_orderstatus FROM orders""")
def sidecar_round_trip(spark, d):  # S13, S14: rows to arrays and back
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    arrays = columnar.packed(rows.withColumn("turn", F.col("o_orderkey")), "o_custkey", "turn", ["o_orderkey", "o_orderstatus"])
    return columnar.unpacked(arrays, "o_custkey", ["o_orderkey", "o_orderstatus"]).select("o_custkey", F.col("position").cast("long").alias("position"), "o_orderkey", "o_orderstatus")


_SLUG = "coalesce(nullif(trim(both '-' from regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g')), ''), 'unnamed')"


@query(f"""WITH {fx.TREE_SQL}, t AS (SELECT node_id, parent_id, {_SLUG} AS slug FROM tree)
SELECT slug AS occurrence_id FROM t WHERE parent_id IS NULL UNION ALL SELECT a.slug || '/' || b.slug FROM t a JOIN t b ON b.parent_id = a.node_id WHERE a.parent_id IS NULL
UNION ALL SELECT a.slug || '/' || b.slug || '/' || c.slug FROM t a JOIN t b ON b.parent_id = a.node_id JOIN t c ON c.parent_id = b.node_id WHERE a.parent_id IS NULL""")
def slug_paths(spark, d):  # W16: paths of slugs from the root
    from girder.functions.scalars import slug

    tree = fx.tree(spark, d).withColumn("slug", slug(F.col("name")))
    return hierarchy.descend(tree, {"occurrence_id": F.col("slug")}, {"occurrence_id": F.concat_ws("/", "_occurrence_id", "slug")}).select("occurrence_id")


@query("""SELECT s_name AS input, CASE WHEN s_suppkey % 5 = 0 THEN 'malformed' WHEN s_suppkey % 5 = 1 THEN 'duplicate-discipline' END AS problem FROM supplier""")
def federated_inputs(spark, d):  # S18
    k = F.col("s_suppkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("nothing"), k)).when(k % 5 == 1, F.concat(F.lit("same="), k)).otherwise(F.concat(F.lit("d"), k, F.lit("=path"), k))
    return federation.parsed_inputs(load(spark, d, "supplier").select(F.col("s_name").alias("name"), text.alias("input"))).select(F.col("name").alias("input"), "problem")


# ---- meshes in a store of streams ------------------------------------------------------------------------------------

_VERTICES = 64  # of a mesh
_MESHES = f"""WITH {fx.OCCURRENCES_SQL}, v AS (SELECT place // {_VERTICES} AS mesh_id, place % {_VERTICES} AS k, min_x, min_y, min_z FROM (SELECT *, row_number() OVER (ORDER BY occurrence_id) - 1 AS place FROM occ)),
m AS (SELECT 'd' || lpad((mesh_id % 25)::VARCHAR, 2, '0') AS document_id, mesh_id, count(*) AS vertices, sum(min_x + min_y + min_z)::DOUBLE AS total FROM v GROUP BY ALL)"""


def _meshes(spark: SparkSession, d: str) -> DataFrame:
    """document_id, mesh_id, positions, indices (a strip of triangles) and, of even meshes, normals."""
    placed = dense_rank_all(fx.occurrences(spark, d).select("occurrence_id", "min_x", "min_y", "min_z"), ["occurrence_id"], "place")
    own = placed.groupBy(F.expr(f"place DIV {_VERTICES}").alias("mesh_id")).agg(F.array_sort(F.collect_list(F.struct("place", "min_x", "min_y", "min_z"))).alias("v"))  # _VERTICES a mesh
    doubles = F.flatten(F.transform("v", lambda p: F.array(*[p[f"min_{a}"].cast("double") for a in "xyz"])))
    strip = F.when(F.size("v") > 2, F.flatten(F.transform(F.sequence(F.lit(0), F.size("v") - 3), lambda i: F.array(i, i + 1, i + 2)))).otherwise(F.expr("array()").cast("array<int>"))
    even = F.when(F.col("mesh_id") % 2 == 0, F.flatten(F.transform("v", lambda p: F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))).cast("array<float>"))
    return own.select(F.concat(F.lit("d"), F.lpad((F.col("mesh_id") % 25).cast("string"), 2, "0")).alias("document_id"), "mesh_id", doubles.alias("positions"), strip.cast("array<int>").alias("indices"), even.alias("normals"))


def _stored(spark: SparkSession, d: str) -> str:
    at = shared_path(spark, "meshes")
    stream_store.write(_meshes(spark, d).repartitionByRange("document_id", "mesh_id").sortWithinPartitions("document_id", "mesh_id"), at)
    return at


@query(f"""{_MESHES} SELECT document_id, mesh_id, vertices, total, greatest(vertices - 2, 0) AS triangles, CASE WHEN mesh_id % 2 = 0 THEN vertices END AS normals FROM m""")
def mesh_store(spark, d):  # S07, S11, K03, K04: written and read back whole
    back = stream_store.read(spark, _stored(spark, d), "document_id string, mesh_id long, positions array<double>, indices array<int>, normals array<float>")
    third = lambda c: F.floor(F.size(c) / 3)
    total = F.aggregate("positions", F.lit(0.0), lambda a, v: a + v)
    return back.select("document_id", "mesh_id", third("positions").alias("vertices"), total.alias("total"), third("indices").alias("triangles"), F.when(F.col("normals").isNotNull(), third("normals")).alias("normals"))


@query(f"""{_MESHES} SELECT mesh_id, greatest(vertices - 2, 0) AS triangles, CASE WHEN vertices > 2 THEN (3 * (vertices - 2) * (vertices - 1) // 2)::BIGINT ELSE 0 END AS index_sum FROM m WHERE document_id IN ('d03', 'd17') AND mesh_id >= 10""")
def mesh_subset(spark, d):  # S07: two documents' indices, and no other stream
    back = stream_store.read(spark, _stored(spark, d), "document_id string, mesh_id long, indices array<int>")
    found = back.where(F.col("document_id").isin("d03", "d17") & (F.col("mesh_id") >= 10))
    return found.select("mesh_id", F.floor(F.size("indices") / 3).alias("triangles"), F.aggregate("indices", F.lit(0).cast("long"), lambda a, v: a + v).alias("index_sum"))
