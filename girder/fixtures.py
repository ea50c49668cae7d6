"""The driver's tables as scene tables; ids are zero-padded lower-case ASCII, so all collations agree on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.tables import load


def padded(prefix: str, column: str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), width, "0"))


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prototype_id, document_id (the part's brand), payload_bytes, triangles."""
    part = load(spark, sf_dir, "part")
    return part.select(padded("p:", "p_partkey", 8).alias("prototype_id"), F.lower("p_brand").alias("document_id"), (F.col("p_size") * 4096).cast("long").alias("payload_bytes"), (F.col("p_size") * 12).cast("long").alias("triangles"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occurrence_id, order_id, prototype_id and an integer box; a line's place among its order's lines makes the id."""
    line = load(spark, sf_dir, "lineitem")
    turn = Window.partitionBy("l_orderkey").orderBy(*[F.col(c) for c in line.columns if c != "l_orderkey"])
    rows = line.withColumn("turn", F.row_number().over(turn)).join(load(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    half = F.col("p_size").cast("long")
    return rows.select(
        F.concat(F.lit("l:"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit(":"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("occurrence_id"),
        padded("o:", "l_orderkey", 10).alias("order_id"), padded("p:", "l_partkey", 8).alias("prototype_id"),
        *[(cents(c) + s * half).alias(n + a) for a, c in (("x", "l_quantity"), ("y", "l_extendedprice"), ("z", "l_discount")) for n, s in (("min_", -1), ("max_", 1))],
    )


OCCURRENCES_SQL = """occ AS (
  SELECT 'l:' || lpad(l_orderkey::VARCHAR, 10, '0') || ':' || lpad(turn::VARCHAR, 4, '0') AS occurrence_id, 'o:' || lpad(l_orderkey::VARCHAR, 10, '0') AS order_id,
    'p:' || lpad(l_partkey::VARCHAR, 8, '0') AS prototype_id,
    round(l_quantity * 100)::BIGINT - p_size AS min_x, round(l_quantity * 100)::BIGINT + p_size AS max_x,
    round(l_extendedprice * 100)::BIGINT - p_size AS min_y, round(l_extendedprice * 100)::BIGINT + p_size AS max_y,
    round(l_discount * 100)::BIGINT - p_size AS min_z, round(l_discount * 100)::BIGINT + p_size AS max_z
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS turn FROM lineitem)
  JOIN part ON l_partkey = p_partkey)"""

PROTOTYPES_SQL = """proto AS (SELECT 'p:' || lpad(p_partkey::VARCHAR, 8, '0') AS prototype_id, lower(p_brand) AS document_id, (p_size * 4096)::BIGINT AS payload_bytes, (p_size * 12)::BIGINT AS triangles FROM part)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, parent_id, name, renderable: regions, nations and customers."""
    region, nation, customer = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    none = F.lit(None).cast("string")
    return (
        region.select(padded("r:", "r_regionkey", 2).alias("node_id"), none.alias("parent_id"), F.col("r_name").alias("name"), F.lit(False).alias("renderable"))
        .unionByName(nation.select(padded("n:", "n_nationkey", 2).alias("node_id"), padded("r:", "n_regionkey", 2).alias("parent_id"), F.col("n_name").alias("name"), F.lit(False).alias("renderable")))
        .unionByName(customer.select(padded("c:", "c_custkey", 8).alias("node_id"), padded("n:", "c_nationkey", 2).alias("parent_id"), F.col("c_name").alias("name"), F.lit(True).alias("renderable")))
    )


TREE_SQL = """tree AS (
  SELECT 'r:' || lpad(r_regionkey::VARCHAR, 2, '0') AS node_id, NULL::VARCHAR AS parent_id, r_name AS name, false AS renderable FROM region
  UNION ALL SELECT 'n:' || lpad(n_nationkey::VARCHAR, 2, '0'), 'r:' || lpad(n_regionkey::VARCHAR, 2, '0'), n_name, false FROM nation
  UNION ALL SELECT 'c:' || lpad(c_custkey::VARCHAR, 8, '0'), 'n:' || lpad(c_nationkey::VARCHAR, 2, '0'), c_name, true FROM customer)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bag_id, key, value (JSON text): parts' columns; odd parts have no type and every third no size."""
    part = load(spark, sf_dir, "part")
    bag = padded("s:", "p_partkey", 8)
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    key = F.col("p_partkey")
    pairs = F.array(
        F.struct(F.lit("ifc.Brand").alias("key"), text("p_brand").alias("value")),
        F.struct(F.lit("Type").alias("key"), F.when(key % 2 == 0, text("p_type")).alias("value")),
        F.struct(F.lit("size").alias("key"), F.when(key % 3 != 0, F.col("p_size").cast("string")).alias("value")),
    )
    return part.select(bag.alias("bag_id"), F.explode(pairs).alias("e")).where("e.value is not null").select("bag_id", "e.key", "e.value")


ENTRIES_SQL = """entries AS (
  SELECT 's:' || lpad(p_partkey::VARCHAR, 8, '0') AS bag_id, 'ifc.Brand' AS key, '"' || p_brand || '"' AS value FROM part
  UNION ALL SELECT 's:' || lpad(p_partkey::VARCHAR, 8, '0'), 'Type', '"' || p_type || '"' FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT 's:' || lpad(p_partkey::VARCHAR, 8, '0'), 'size', p_size::VARCHAR FROM part WHERE p_partkey % 3 <> 0)"""
