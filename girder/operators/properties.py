"""Property bags: interning of keys, key sets and values, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators.ranking import dense_rank_all


def key_index(entries: DataFrame) -> DataFrame:
    """key_id, key in code-point order."""
    return dense_rank_all(entries.select("key").distinct(), ["key"], "key_id")


def key_sets(bags: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set_id, key_ids) in lexicographic order, and (bag_id, set_id); a bag without entries has the empty set."""
    keyed = entries.join(key_index(entries), "key").groupBy("bag_id").agg(F.array_sort(F.collect_set("key_id")).alias("key_ids"))
    empty = F.expr("array()").cast("array<bigint>")
    own = bags.select("bag_id").join(keyed, "bag_id", "left").withColumn("key_ids", F.coalesce("key_ids", empty))
    sets = dense_rank_all(own.select("key_ids").distinct(), ["key_ids"], "set_id")
    return sets, own.join(sets, "key_ids").select("bag_id", "set_id")


def value_heap(entries: DataFrame) -> DataFrame:
    """value, value_id, offset, byte_length: distinct JSON texts in byte order, and where each starts in the heap."""
    values = entries.select("value").distinct().withColumn("byte_length", F.octet_length("value").cast("long"))
    numbered = dense_rank_all(values, ["value"], "value_id")
    return dense_rank_all(numbered, ["value_id"], "offset", "byte_length")


def lookup(entries: DataFrame, bags: DataFrame) -> DataFrame:
    """The entries of some bags."""
    return entries.join(bags.select("bag_id").distinct(), "bag_id", "left_semi")


def flattened(nested: DataFrame, column: str) -> DataFrame:
    """bag_id, key, value: leaves of a variant with dotted keys, any depth; keys that are "id" in any case go."""
    from girder.tables import cut

    level = nested.select("bag_id", F.lit("").alias("key"), F.col(column).alias("v"))
    done = None
    while True:
        object_ = F.expr("schema_of_variant(v) LIKE 'OBJECT%'")
        leaves = level.where(~object_ & (F.col("key") != "")).select("bag_id", "key", F.to_json("v").alias("value"))
        done = leaves if done is None else done.unionByName(leaves)
        members = level.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("name"), F.col("value").alias("own"))
        inner = level.where(object_).lateralJoin(members).where(F.lower("name") != "id")
        below = cut(inner.select("bag_id", F.concat_ws(".", F.nullif(F.col("key"), F.lit("")), "name").alias("key"), F.to_json("own").alias("j")), "level")
        if below.isEmpty():
            return done
        level = below.select("bag_id", "key", F.parse_json("j").alias("v"))
