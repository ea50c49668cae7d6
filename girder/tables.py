"""Scratch tables and local constants shared by the scene operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_temporary: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one becomes it if all runs in one process
    (tests); on a cluster that would lose data, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _temporary.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="girder-")
        _temporary[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def opened_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark names it, and the place there. Names of local files may hold blanks and signs."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def listed(spark: SparkSession, paths: str | list[str], ending: str = "", deep: bool = False) -> DataFrame:
    """(path, length) of the files at or under some paths, those without bytes included, which Spark's own readers leave out.
    Names that begin with a dot or an underscore are skipped. A task lists a path; only names pass through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = opened_store(path)
                own, base = store.get_file_info(at), path.rstrip("/")
                if own.type == fs.FileType.NotFound:
                    raise FileNotFoundError(path)
                found = [(base, own)] if own.is_file else [(base + i.path[len(at.rstrip("/")) :], i) for i in store.get_file_info(fs.FileSelector(at, recursive=deep))]
                kept = [(p, i.size) for p, i in found if i.is_file and p.endswith(ending) and not re.search(r"(^|/)[._]", p[len(base) :])]
                yield pa.RecordBatch.from_pydict({"path": [p for p, _ in kept], "length": [n for _, n in kept]}, pa.schema([("path", pa.string()), ("length", pa.int64())]))

    given = spark.createDataFrame([(p,) for p in ([paths] if isinstance(paths, str) else paths)], "path string")
    return given.mapInArrow(run, "path string, length long").repartition("path")


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, so that loops have a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of `cut` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop(df))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
