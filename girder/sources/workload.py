"""A deterministic synthetic workload: many occurrences of few prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALES = {"small": 1_000, "medium": 10_000, "large": 100_000}


def workload(spark: SparkSession, n: int, prototypes: int = 4) -> DataFrame:
    """index, prototype, x, y, z. With 4 prototypes 12 of 20 slots are the first, then 4, 3 and 1; with 256 they are mixed."""
    # fixed values: the shares of four prototypes, and how 256 are mixed
    i = F.col("index")
    slot = i % 20
    few = F.when(slot < 12, 0).when(slot < 16, 1).when(slot < 19, 2).otherwise(3)
    many = (i * 73 + F.floor(i / 17) * 19) % 256
    side = int(n ** (1 / 3)) + 1
    return spark.range(n).withColumnRenamed("id", "index").select("index", (few if prototypes == 4 else many).cast("int").alias("prototype"), (i % side).alias("x"), (F.floor(i / side) % side).alias("y"), F.floor(i / (side * side)).alias("z"))
