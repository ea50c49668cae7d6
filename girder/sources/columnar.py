"""Sidecars that hold a table as one row of parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unpacked(packed: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """by, position and the columns' elements (S13, S14); arrays of different lengths are left out, see `uneven`."""
    same = packed.where(~_uneven(columns))
    return same.select(by, F.posexplode(F.arrays_zip(*columns)).alias("position", "e")).select(by, "position", *[F.col(f"e.{c}").alias(c) for c in columns])


def _uneven(columns: list[str]) -> F.Column:
    first, out = F.size(columns[0]), F.lit(False)
    for c in columns[1:]:
        out = out | (F.size(c) != first)
    return F.coalesce(out, F.lit(True))


def uneven(packed: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Sidecars whose arrays differ in length."""
    return packed.where(_uneven(columns)).select(by)


def packed(rows: DataFrame, by: str, position: str, columns: list[str]) -> DataFrame:
    """The inverse of `unpacked`; a row of arrays for each document."""
    ordered = F.array_sort(F.collect_list(F.struct(position, *columns)))
    one = rows.groupBy(by).agg(ordered.alias("r"))
    return one.select(by, *[F.col("r").getField(c).alias(c) for c in columns])


BLOCK = 4096  # values of a heap


def heaps(values: DataFrame) -> DataFrame:
    """doc, block, heap (the values' UTF-8) and offsets (n + 1 of them) from values(doc, value_id, value): BLOCK values a row, however many
    a document has (S12). Offsets are running sums within a block."""
    own = Window.partitionBy("doc", "block").orderBy("value_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    block = values.withColumn("block", F.expr(f"value_id DIV {BLOCK}")).withColumn("upto", F.sum(F.octet_length("value")).over(own).cast("int"))
    rows = block.groupBy("doc", "block").agg(F.array_sort(F.collect_list(F.struct("value_id", "value", "upto"))).alias("v"))
    return rows.select("doc", "block", F.encode(F.array_join("v.value", ""), "UTF-8").alias("heap"), F.concat(F.array(F.lit(0)), F.col("v.upto")).alias("offsets"))


def sliced(heap: DataFrame, offsets: DataFrame) -> DataFrame:
    """value_id, value: slices of a heap by an offsets table of n + 1 numbers (S12). heap(doc, heap binary),
    offsets(doc, offsets array); a table that falls or leaves the heap gives no rows, see `odd_offsets`."""
    good = heap.join(offsets, "doc").where(~_odd())
    spans = F.sequence(F.lit(1), F.size("offsets") - 1)
    each = good.where(F.size("offsets") > 1).select("doc", "heap", "offsets", F.explode(spans).alias("i"))
    start, stop = F.get("offsets", F.col("i") - 1), F.get("offsets", F.col("i"))
    return each.select("doc", (F.col("i") - 1).alias("value_id"), F.decode(F.substring("heap", (start + 1).cast("int"), (stop - start).cast("int")), "UTF-8").alias("value"))


def _odd() -> F.Column:
    falls = F.exists(F.arrays_zip(F.slice("offsets", 1, F.greatest(F.size("offsets") - 1, F.lit(0))).alias("a"), F.slice("offsets", 2, F.greatest(F.size("offsets") - 1, F.lit(0))).alias("b")), lambda p: p["a"] > p["b"])
    return F.coalesce(falls | (F.size("offsets") < 1) | (F.get("offsets", F.lit(0)) != 0) | (F.element_at("offsets", -1) != F.octet_length("heap")), F.lit(True))


def odd_offsets(heap: DataFrame, offsets: DataFrame) -> DataFrame:
    return heap.join(offsets, "doc").where(_odd()).select("doc")
