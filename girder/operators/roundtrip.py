"""Comparison of two packages' trees by a tree of digests.

Every node has a digest of itself (identity and transform) and of all below it: children's digests are summed up, so no node's
children are gathered. The comparison starts at the roots and opens only nodes whose digests differ, so the rows that it
touches follow the differences. Occurrences are told by their id under their parent; several with one id there are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators.hierarchy import descend
from girder.tables import cut, drop


def digests(tree: DataFrame, values: list[str]) -> DataFrame:
    """parent_id, node_id, copies, own and whole: of tree(node_id, parent_id, *values), a row for each id under a parent. `own` is a
    digest of the copies' values, `whole` of them and of all below. Levels are summed from the deepest to the root."""
    placed = cut(descend(tree.select("node_id", "parent_id").distinct(), {}, {}).select("node_id", "parent_id", "depth"), "tree-depths")
    own = F.sha2(F.concat_ws("\x00", "node_id", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in values]), 256)
    number = lambda c: F.conv(F.substring(c, 1, 15), 16, 10).cast("decimal(38,0)")
    rows = tree.select("node_id", "parent_id", number(own).alias("d")).groupBy("parent_id", "node_id").agg(F.count(F.lit(1)).alias("copies"), F.sum("d").alias("own"))
    known = cut(rows.join(placed.select(F.col("node_id").alias("n"), F.col("parent_id").alias("p"), "depth"), (F.col("node_id") == F.col("n")) & F.col("parent_id").eqNullSafe(F.col("p"))).drop("n", "p"), "tree-own")
    deepest = known.agg(F.max("depth")).first()[0]
    done: list[DataFrame] = []
    below: DataFrame | None = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = known.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("sum", F.lit(0).cast("decimal(38,0)"))
        else:
            sums = below.groupBy(F.col("parent_id").alias("p")).agg(F.sum(number(F.sha2(F.col("whole"), 256))).alias("sum"))
            level = level.join(sums, F.col("node_id") == F.col("p"), "left").drop("p").withColumn("sum", F.coalesce("sum", F.lit(0).cast("decimal(38,0)")))
        whole = F.sha2(F.concat_ws(":", "node_id", F.col("copies").cast("string"), F.col("own").cast("string"), F.col("sum").cast("string")), 256)
        below = cut(level.select("parent_id", "node_id", "copies", "own", whole.alias("whole")), "tree-digests")
        done.append(below)
    return reduce(DataFrame.union, done) if done else known.select("parent_id", "node_id", "copies", "own", F.lit("").alias("whole"))


def compare(one: DataFrame, other: DataFrame) -> tuple[DataFrame, int]:
    """((kind, node_id, parent_id) of the differences between two tables of `digests`, rows opened).

    kind is `changed` (identity or transform), `copies` (another number of them), `lost` or `added` (with all below, which is not
    opened), or `moved`: lost under one parent and added under one other with the same digest; parent_id is the new one."""
    names = ["node_id", "copies", "own", "whole"]
    left, right = (df.select(F.col("parent_id").alias(f"{s}_parent"), *[F.col(c).alias(f"{s}_{c}") for c in names]) for s, df in (("a", one), ("b", other)))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b, F.col("a_parent").eqNullSafe(F.col("b_parent")) & (F.col("a_node_id") == F.col("b_node_id")), "full")
        return both.select(F.coalesce("a_node_id", "b_node_id").alias("node_id"), F.when(F.col("a_node_id").isNotNull(), F.col("a_parent")).otherwise(F.col("b_parent")).alias("parent_id"), *[f"{s}_{c}" for s in "ab" for c in names[1:]])

    front = met(left.where("a_parent is null"), right.where("b_parent is null"))
    found, opened = [], 0
    while True:
        now = cut(front.where("NOT (a_whole <=> b_whole)"), "compare")
        n = now.count()
        if not n:
            drop(now)
            break
        opened += n
        found.append(now)
        inner = now.where("a_whole IS NOT NULL AND b_whole IS NOT NULL").select(F.col("node_id").alias("up"))
        front = met(left.join(inner, F.col("a_parent") == F.col("up"), "left_semi"), right.join(inner, F.col("b_parent") == F.col("up"), "left_semi"))
    if not found:
        return one.sparkSession.createDataFrame([], "kind string, node_id string, parent_id string"), 0
    rows = reduce(DataFrame.union, found)
    kind = F.when(F.col("b_whole").isNull(), "lost").when(F.col("a_whole").isNull(), "added").when(F.col("a_copies") != F.col("b_copies"), "copies").when(F.col("a_own") != F.col("b_own"), "changed")
    told = cut(rows.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", "node_id", "parent_id", F.coalesce("a_whole", "b_whole").alias("whole")), "compare-told")
    # one place lost and one gained, with the same content
    ends = told.where("kind IN ('lost', 'added')").groupBy("node_id", "whole").agg(F.count_if(F.col("kind") == "lost").alias("l"), F.count_if(F.col("kind") == "added").alias("g"), F.max(F.when(F.col("kind") == "added", F.col("parent_id"))).alias("to"))
    moved = cut(ends.where("l = 1 AND g = 1").select(F.col("node_id").alias("m"), F.col("whole").alias("w"), "to"), "compare-moved")
    rest = told.join(moved, (F.col("node_id") == F.col("m")) & (F.col("whole") == F.col("w")) & F.col("kind").isin("lost", "added"), "left_anti").select("kind", "node_id", "parent_id")
    return rest.union(moved.select(F.lit("moved").alias("kind"), F.col("m").alias("node_id"), F.col("to").alias("parent_id"))), opened
