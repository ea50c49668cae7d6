"""What the corpus operators share: scratch tables in the shared folder, word hashing on numpy buffers, components.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Those bytes never occur inside a multi-byte UTF-8
character, so words are found on the encoded text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_CHUNK = 4 << 20  # bytes of text that one numpy pass handles; a longer single text is a pass of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_temporary: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a temporary one becomes it if all runs in one
    process (tests); on a cluster that would lose data, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _temporary.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="girder-")
        _temporary[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


_open: list[list[str]] = []  # paths made within each `scratch` that has not ended


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is written to scratch paths within is deleted at the end, but for the paths put into the list. Without it, tables that
    a lazy result reads stay until the caller clears the folder."""
    made: list[str] = []
    kept: list[str] = []
    _open.append(made)
    try:
        yield kept
    finally:
        _open.remove(made)
        discard(spark, *(p for p in made if p not in kept))


def save(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def read_saved(path: str) -> pa.Table | None:
    """A small table that `save` or a writer left in the shared folder, as a task reads it: any store that pyarrow opens.
    None where nothing was written."""
    store, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    files = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read() for f in sorted(files)])


def discard(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = TEXT_CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes in `column`, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---- hashing -------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums and products of its results look random."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _PIECE)
            made = []
            for b in (self.base, self.inverse):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_OVER_BYTES, _OVER_WORDS = _Powers(0xD6E8FEB86659FD93), (_Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB))


class Words:
    """The words of several texts: `first[i]:first[i+1]` are those of text i; `hash` is 64 bits of each."""

    def __init__(self, texts: list[bytes], lower: bool = False, space: np.ndarray = _SPACE):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        edge = np.diff(np.concatenate(([True], space[self.buf])).view(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(self.ends) < len(self.starts):
            self.ends = np.append(self.ends, len(self.buf))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.starts, at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.starts)

    def _hashes(self) -> np.ndarray:
        out, at, n = np.empty(len(self.starts), np.uint64), 0, len(self.starts)
        while at < n:
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + _PIECE, side="right")))
            stop = self.ends[to - 1]
            up, down = _OVER_BYTES.get(int(stop - base) + 1)
            sums = np.empty(int(stop - base) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[self.buf[base:stop]] * up[:-1], out=sums[1:])
            s, e = self.starts[at:to] - base, self.ends[at:to] - base
            out[at:to] = (sums[e] - sums[s]) * down[s]
            at = to
        return mix(out)

    def grams(self, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of all runs of n words within one text, in order."""
        total = len(self)
        if total < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        up, down = _OVER_WORDS[salt & 1].get(total + 1)
        sums = np.empty(total + 1, np.uint64)
        sums[0] = 0
        np.cumsum(mix(self.hash, salt + 1) * up[:total], out=sums[1:])
        inside = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        return inside, mix((sums[inside + n] - sums[inside]) * down[inside], n)


# ---- connected components ------------------------------------------------------------------------------------


def components(links: DataFrame, label: str = "components") -> tuple[DataFrame, str]:
    """(id, component) for every id of links(a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps, so that chains shorten in logarithmically many rounds. Each round
    is a written table; only its row count and a checksum reach the driver.
    """
    spark = links.sparkSession
    edges, path = save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label)
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").union(least.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        after, new = save(small, label)
        count, total = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        edges, path = after, new
        if (count, total) == before:
            break
        before = (count, total)
    nodes = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return nodes.union(roots).toDF("id", "component"), path
