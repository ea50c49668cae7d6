"""Payload chunks: coalescing under a byte budget, priorities and residency cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators.ranking import dense_rank_all, within
from girder.operators.segments import coalesce_ranges

BUDGET = 512 * 1024


def offsets(df: DataFrame, by: str, order: str, size: str, align: int = 4) -> DataFrame:
    """byte_offset of each row in its group, sizes padded to `align`."""
    padded = df.withColumn("_padded", (F.ceil(F.col(size) / align) * align).cast("long"))
    return within(padded, [by], [order], "byte_offset", value="_padded").drop("_padded")


def target_chunks(ranges: DataFrame, counts: DataFrame, by: str = "document_id", budget: int = BUDGET) -> DataFrame:
    """Chunks with their priority: more occurrences first, then more bytes, then the first prototype's id."""
    grouped = coalesce_ranges(ranges, by, budget).join(counts, "prototype_id")
    chunks = grouped.groupBy(by, "group").agg(
        F.min("byte_offset").alias("byte_offset"), F.sum("byte_length").alias("byte_length"), F.count(F.lit(1)).alias("prototype_count"),
        F.sum("occurrences").alias("occurrence_count"), F.min("prototype_id").alias("first_prototype"),
    )
    keyed = chunks.withColumns({"k1": -F.col("occurrence_count"), "k2": -F.col("byte_length")})
    ranked = dense_rank_all(keyed, ["k1", "k2", "first_prototype"], "priority").drop("k1", "k2")
    number = F.col("priority").cast("string")
    wide = F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))  # lpad would cut longer ones
    return ranked.withColumn("chunk_id", F.concat(F.lit("target:"), wide, F.lit(":"), F.col("first_prototype")))


def residency_cost(batches: DataFrame, by: str) -> DataFrame:
    """decoded_bytes and gpu_bytes of each group; a vertex pool shared by several batches is charged once, GPU buffers are
    padded to four bytes and take four at least (A18)."""
    pad = lambda c: F.greatest(F.lit(4), F.ceil(F.col(c) / 4) * 4)
    pools = batches.groupBy(by, "pool_id").agg(F.max("vertex_bytes").alias("vertex_bytes")).groupBy(by).agg(F.sum("vertex_bytes").alias("pool_bytes"), F.sum(pad("vertex_bytes")).alias("pool_gpu"))
    own = batches.groupBy(by).agg(F.sum("index_bytes").alias("own_bytes"), F.sum(pad("index_bytes") + F.col("instances") * 96).alias("own_gpu"))
    return own.join(pools, by).select(by, (F.col("own_bytes") + F.col("pool_bytes")).cast("long").alias("decoded_bytes"), (F.col("own_gpu") + F.col("pool_gpu")).cast("long").alias("gpu_bytes"))


def dominant(demand: DataFrame) -> DataFrame:
    """For each prototype the leaf that shows it most often, the lowest of equals."""
    counted = demand.groupBy("prototype_id", "leaf").agg(F.count(F.lit(1)).alias("uses"))
    best = counted.groupBy("prototype_id").agg(F.min(F.struct((-F.col("uses")).alias("less"), F.col("leaf"))).alias("b"))
    return best.select("prototype_id", F.col("b.leaf").alias("leaf"), (-F.col("b.less")).alias("uses"))
