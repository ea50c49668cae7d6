"""Process snapshots as a stream: memory of a process tree in each snapshot, then the peaks over snapshots.

A snapshot is what a machine reports within one interval of event time. Its rows are state until the watermark has passed its end;
rows that come later than that are dropped, as a closed snapshot is not opened again. Rows that come late but before that correct
their snapshot: each micro-batch writes the snapshots that it changed, and the last one that was written counts. State and
rows of a task are those of a machine's snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SHAPE = "machine long, begin timestamp, processes long, bytes long"


def tree(rows: list[tuple[int, int | None, int]], root: int) -> tuple[int, int]:
    """(processes, bytes) of the root and all below it; rows are (pid, parent, bytes). Of several rows of the root the last counts,
    of other processes all; a process that is its own ancestor is followed once."""
    below: dict[int | None, list[tuple[int, int]]] = {}
    top = None
    for pid, parent, size in rows:
        below.setdefault(parent, []).append((pid, size))
        if pid == root:
            top = size
    if top is None:
        return 0, 0
    count, total, open_, seen = 1, top, [root], set()
    while open_:
        pid = open_.pop()
        if pid in seen:
            continue
        seen.add(pid)
        for child, size in below.get(pid, ()):
            count, total = count + 1, total + size
            open_.append(child)
    return count, total


def snapshots(samples: DataFrame, interval: str, delay: str, root: int = 1) -> DataFrame:
    """(machine, begin, processes, bytes) of each snapshot, from samples(machine, ts, sequence, pid, parent, bytes), a table or a stream;
    processes is 0 where the root is missing."""
    row = F.struct("ts", "sequence", "pid", "parent", "bytes")
    held = samples.withWatermark("ts", delay).groupBy("machine", F.window("ts", interval).alias("w")).agg(F.collect_list(row).alias("rows"))
    listed = held.select(F.col("machine").cast("long").alias("machine"), F.col("w.start").alias("begin"), F.array_sort("rows").alias("rows"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [tree([(r["pid"], r["parent"], r["bytes"]) for r in rows], root) for rows in b.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("machine"), b.column("begin"), *[pa.array(x, pa.int64()) for x in (zip(*sums) if sums else ([], []))]], names=["machine", "begin", "processes", "bytes"])

    return listed.mapInArrow(walk, SHAPE)


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream of snapshots over all there is: a folder of `path` for each micro-batch. A batch that is run again after a failure
    writes its folder anew."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The snapshots as last written."""
    kept = spark.read.schema(f"{SHAPE}, batch long").parquet(path)
    last = F.max_by(F.struct("processes", "bytes"), "batch").alias("last")
    return kept.groupBy("machine", "begin").agg(last).select("machine", "begin", "last.processes", "last.bytes")


def peaks(found: DataFrame) -> DataFrame:
    """machine, samples, tree_samples (with the root), most processes and peak bytes over a machine's snapshots."""
    has = F.col("processes") > 0
    return found.groupBy("machine").agg(F.count(F.lit(1)).alias("samples"), F.count_if(has).alias("tree_samples"), F.max("processes").alias("processes"), F.max(F.when(has, F.col("bytes"))).alias("peak_bytes"))
