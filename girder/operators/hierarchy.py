"""Trees given as (node_id, parent_id, ...): levels, preorder, search, transforms, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.scalars import has_all_tokens
from girder.operators.ranking import dense_rank_all
from girder.tables import cut, drop

MAX_DEPTH = 64


def descend(tree: DataFrame, root: dict[str, Column], step: dict[str, Column]) -> DataFrame:
    """Every node reached from the roots, level by level, with values made from the node (root) and from the parent's
    values, named with a leading underscore (step). A cycle is never reached; deeper than MAX_DEPTH is an error."""
    level = cut(tree.where("parent_id is null").withColumns({"depth": F.lit(0), **root}), "level")
    levels = [level]
    for depth in range(1, MAX_DEPTH + 2):
        above = level.select(F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"_{c}") for c in root])
        below = tree.join(above, "parent_id").withColumns({"depth": F.lit(depth), **step}).select(*level.columns)
        level = cut(below, "level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        if depth > MAX_DEPTH:
            raise ValueError(f"the tree is deeper than {MAX_DEPTH}")
        levels.append(level)
    raise AssertionError


def preorder(tree: DataFrame) -> DataFrame:
    """The tree with depth, path (ids from the root) and node_index in depth-first order, siblings by id."""
    mark = "\x01"
    paths = descend(tree, {"path": F.col("node_id")}, {"path": F.concat(F.col("_path"), F.lit(mark), F.col("node_id"))})
    return dense_rank_all(paths, ["path"], "node_index")


def search(ordered: DataFrame, query: str, haystack: Column) -> DataFrame:
    """node_index, matching, first: what stays visible for a query (P12, W07-W09): matches, their ancestors, and all below
    matched assemblies; `first` marks the first renderable match, else the first visible renderable node."""
    matched = ordered.withColumn("matching", has_all_tokens(haystack, query))
    if not query.split():
        return matched.select("node_index", "matching", F.lit(False).alias("first"))
    mark = "\x01"
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("path", mark))), lambda k: F.array_join(F.slice(F.split(F.col("path"), mark), F.lit(1), k), mark))
    above = matched.where("matching").select(F.explode(prefixes).alias("path")).distinct()
    assemblies = matched.where("matching and not renderable").select(F.col("path").alias("root")).distinct()
    below = matched.select("path", F.explode(prefixes).alias("root")).join(assemblies, "root", "left_semi").select("path").distinct()
    shown = matched.join(above.union(below).distinct(), "path", "left_semi")
    firsts = shown.where("renderable").agg(F.coalesce(F.min(F.when(F.col("matching"), F.col("node_index"))), F.min("node_index")).alias("at"))
    return shown.join(firsts, F.col("node_index") == F.col("at"), "left").select("node_index", "matching", F.col("at").isNotNull().alias("first"))


def multiply(a: Column, b: Column) -> Column:
    """Column-major 4x4 product; each sum runs over k in order, as the order decides the last bit."""
    cell = lambda r, c: reduce(lambda s, k: s + F.element_at(a, k * 4 + r + 1) * F.element_at(b, c * 4 + k + 1), range(1, 4), F.element_at(a, r + 1) * F.element_at(b, c * 4 + 1))
    return F.array(*[cell(r, c) for c in range(4) for r in range(4)])


def world_transforms(tree: DataFrame) -> DataFrame:
    """The tree with `world`, the product of the local transforms from the root down."""
    return descend(tree, {"world": F.col("local")}, {"world": multiply(F.col("_world"), F.col("local"))})


def transformed_bounds(m: Column) -> dict[str, Column]:
    """The box around the eight transformed corners of min_x..max_z."""
    out = {}
    for row, name in enumerate("xyz"):
        corners = [sum((F.element_at(m, k * 4 + row + 1) * F.col(f"{side}_{axis}") for k, (side, axis) in enumerate(zip(sides, "xyz"))), F.element_at(m, 12 + row + 1)) for sides in ((a, b, c) for a in ("min", "max") for b in ("min", "max") for c in ("min", "max"))]
        out |= {f"min_{name}": F.least(*corners), f"max_{name}": F.greatest(*corners)}
    return out


def checks(tree: DataFrame) -> DataFrame:
    """code, node_id: nodes with several parents, whose parent is unknown, and that lead into a cycle."""
    several = tree.groupBy("node_id").agg(F.count_distinct("parent_id").alias("n")).where("n > 1").select(F.lit("NODE_PARENT").alias("code"), "node_id")
    ids = tree.select(F.col("node_id").alias("known")).distinct()
    missing = tree.where("parent_id is not null").join(ids, F.col("parent_id") == F.col("known"), "left_anti").select(F.lit("MISSING_REFERENCE").alias("code"), "node_id")
    return several.unionByName(missing.distinct()).unionByName(cycles(tree))


def cycles(tree: DataFrame, code: str = "OCCURRENCE_CYCLE") -> DataFrame:
    """Nodes from which following parents never ends (G04): pointers are doubled until no chain is left to follow."""
    step = cut(tree.where("parent_id is not null").select("node_id", F.col("parent_id").alias("up")).distinct(), "up")
    count = None
    while True:
        jump = step.join(step.select(F.col("node_id").alias("up"), F.col("up").alias("next")), "up").select("node_id", F.col("next").alias("up"))
        jump = cut(jump.distinct(), "up")
        left = jump.agg(F.count_distinct("node_id")).first()[0]
        drop(step)
        if left == count or left == 0:
            return jump.select(F.lit(code).alias("code"), "node_id").distinct()
        step, count = jump, left
