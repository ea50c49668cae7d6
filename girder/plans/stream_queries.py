"""Queries that run as streams over the given tables; batch SQL says what they must give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.streaming import snapshots
from girder.tables import load, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


@query("""WITH RECURSIVE sample AS (
  SELECT user_id AS machine, floor(epoch(ts) / 259200)::BIGINT AS snapshot, event_id, 1 + event_id % 7 AS pid, (1 + event_id % 7) // 2 AS parent, round(value * 100)::BIGINT AS bytes,
    row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 259200), 1 + event_id % 7 ORDER BY ts DESC, event_id DESC) AS age FROM events
), within AS (
  SELECT DISTINCT machine, snapshot, pid FROM sample WHERE pid = 1
  UNION SELECT s.machine, s.snapshot, s.pid FROM within w JOIN sample s ON s.machine = w.machine AND s.snapshot = w.snapshot AND s.parent = w.pid
), snap AS (
  SELECT s.machine, s.snapshot, count(w.pid) FILTER (s.pid > 1 OR age = 1) AS processes, sum(bytes) FILTER (w.pid IS NOT NULL AND (s.pid > 1 OR age = 1)) AS bytes
  FROM sample s LEFT JOIN within w USING (machine, snapshot, pid) GROUP BY 1, 2)
SELECT machine, count(*) AS samples, count(*) FILTER (processes > 0) AS tree_samples, max(processes) AS processes, max(bytes) FILTER (processes > 0)::BIGINT AS peak_bytes FROM snap GROUP BY 1""")
def process_peaks(spark, d):  # S24, A24, G13: a user's events of three days are a snapshot
    at = shared_path(spark, "snapshots")
    events = spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    pid = 1 + F.col("event_id") % 7
    samples = events.select(F.col("user_id").alias("machine"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("sequence"), pid.alias("pid"), F.floor(pid / 2).alias("parent"), F.round(F.col("value") * 100).cast("long").alias("bytes"))
    snapshots.write(snapshots.snapshots(samples, "3 days", "30 days"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return snapshots.peaks(snapshots.read(spark, f"{at}/out"))
