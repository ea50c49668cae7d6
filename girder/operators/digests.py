"""Content digests, verified restores and atomic publishing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def streamed(pieces: DataFrame, by: list[str], order: list[str], between: str = "") -> DataFrame:
    """by, digest: SHA-256 of each group's `piece` strings in order, joined. Sorted rows stream through a task that holds a running
    digest, so a group may be of any size; it is one task's, as its digest is defined over the whole in order."""
    keys = pieces.select(*by).schema
    glue = between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, hash_ = None, None
        for batch in batches:
            ended: list[tuple] = []
            own = zip(*[batch.column(b).to_pylist() for b in by]) if by else ((),) * batch.num_rows
            for key, piece in zip(own, batch.column("piece").to_pylist()):
                if hash_ is None or key != owner:
                    if hash_ is not None:
                        ended.append((*owner, hash_.hexdigest()))
                    owner, hash_ = key, hashlib.sha256()
                else:
                    hash_.update(glue)
                hash_.update(piece.encode())
            yield given(ended, batch.schema)
        if hash_ is not None:
            yield given([(*owner, hash_.hexdigest())], batch.schema)

    def given(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in range(len(by) + 1)]
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(b).type) for c, b in zip(columns, [*by, "piece"])], names=[*by, "digest"])

    dealt = pieces.select(*by, *[c for c in order if c not in (*by, "piece")], "piece")
    dealt = (dealt.repartition(*by) if by else dealt.repartition(1)).sortWithinPartitions(*by, *order)
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keys], "digest string"])
    return dealt.mapInArrow(run, shape)


def ordered_digest(df: DataFrame, by: list[str], parts: list[str], order: str) -> DataFrame:
    """SHA-256 of each group's lines in order (A29). Each row is first reduced to its own digest, so what is sorted and streamed is
    64 characters a row."""
    line = F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(p).cast("string"), F.lit("\x01")) for p in parts]), 256)
    return streamed(df.select(*by, F.col(order).alias("_order"), line.alias("piece")), by, ["_order", "piece"], "\n")


def fingerprint(files: DataFrame, by: list[str]) -> DataFrame:
    """by, digest: of the lines name, digest of each folder's files in name order (S25). files(by, name, d)."""
    lines = F.concat("name", F.lit("\n"), "d", F.lit("\n"))
    return streamed(files.select(*by, F.col("name").alias("_name"), lines.alias("piece")), by, ["_name", "piece"])


def folder_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """The fingerprint of one folder."""
    files = spark.read.format("binaryFile").load(path)
    return fingerprint(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("d")), [])


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name, ok: whether each resource of the manifest is there with its length and digest."""
    seen = files.select("name", F.col("byte_length").alias("seen_length"), F.col("digest").alias("seen"))
    same = (F.col("seen_length") == F.col("byte_length")) & (F.col("seen") == F.col("digest"))
    return manifest.join(seen, "name", "left").select("name", F.coalesce(same, F.lit(False)).alias("ok"))


def publish(df: DataFrame, path: str, digest: Column) -> str:
    """Write under a key once (K05): 'created', 'same' if it holds the same content, else an error. Each writer has a stage of
    its own; of two that write one key at once, the one that comes late finds the other's."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, stage = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.stage")
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    total = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64(digest).cast("decimal(38,0)"))).first()
    if store.exists(target):
        if total(spark.read.parquet(path)) != total(df):
            raise ValueError(f"{path} holds other content")
        return "same"
    df.write.parquet(stage.toString())
    if not store.exists(target) and store.rename(stage, target):
        return "created"
    store.delete(stage, True)
    if store.exists(target):
        return publish(df, path, digest)
    raise OSError(f"{path} could not be published")
