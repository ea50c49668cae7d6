"""The session that tests and the benchmark use; on a cluster the caller brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.adaptive.enabled": True,
        "spark.sql.adaptive.skewJoin.enabled": True,
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": False,
        "spark.ui.showConsoleProgress": False,
    }
    spark = SparkSession.builder.master(master).appName("girder").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
