"""Reuse, distributions and rankings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.tables import cut


def reuse(occurrences: DataFrame, key: str = "prototype_id") -> DataFrame:
    """Prototypes that occur more than once, with the count."""
    return occurrences.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in a total order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def at_ranks(df: DataFrame, by: list[str], column: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, and the values at some ranks (1 is the least) of each group, each given as a function of the group's size.

    A group may be the whole table, so no task sees one whole: equal values are counted first, the counts are dealt by ranges of
    (group, value), and a range starts at the counts of the group's ranges before. Nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c"))
    dealt = cut(counts.repartitionByRange(*by, column).withColumn("_part", F.spark_partition_id()), "ranks")
    group = Window.partitionBy(*by)
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_c").alias("_s"))  # a row for each range of a group
    sums = sums.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(group).alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by], F.col("_part") == F.col("_p"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_part").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = dealt.join(sums, same).withColumn("_to", upto)
    at = lambda r: F.max(F.when((F.col("_to") - F.col("_c") < r(F.col("_n"))) & (r(F.col("_n")) <= F.col("_to")), F.col(column)))
    return placed.groupBy(*by).agg(*[at(r).alias(name) for name, r in ranks.items()])


def nearest_rank(fraction: float) -> Callable[[Column], Column]:
    """Rank ceil(n * fraction) (A06), in whole thousandths so that no rounding error lifts it."""
    return lambda n: F.greatest(F.lit(1), F.ceil(n * round(fraction * 1000) / 1000))


def _joined(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Groups of both, null keys being equal; a group without values has null ranks."""
    right = other.withColumnsRenamed({b: f"_{b}" for b in by})
    return df.join(right, reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]), "left").drop(*[f"_{b}" for b in by])


def distribution(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """count, least, p50, p95, p99, most and mean of each group."""
    plain = df.groupBy(*by).agg(F.count(column).alias("samples"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"))
    return _joined(plain, at_ranks(df, by, column, {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95), "p99": nearest_rank(0.99)}), by)


def medians(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The lower median (A09), the interpolated one (A10), and the sample deviation, 0 for a single value."""
    plain = df.groupBy(*by).agg(F.when(F.count(column) == 1, 0.0).otherwise(F.stddev_samp(column)).alias("deviation"))
    ranks = at_ranks(df, by, column, {"lower_median": lambda n: F.floor((n + 1) / 2), "upper": lambda n: F.floor(n / 2) + 1})
    return _joined(plain, ranks, by).withColumn("median", (F.col("lower_median") + F.col("upper")) / 2).drop("upper")


def paired(df: DataFrame, pair: list[str], side: str, one: str, other: str, column: str) -> DataFrame:
    """Both sides of each pair and their ratio, where both exist."""
    of = lambda s: F.sum(F.when(F.col(side) == s, F.col(column)))
    both = df.groupBy(*pair).agg(of(one).alias("one"), of(other).alias("other"))
    return both.where("one is not null and other is not null").withColumn("ratio", F.col("one") / F.nullif(F.col("other"), F.lit(0.0)))


def bounds_union(df: DataFrame, by: list[str]) -> DataFrame:
    """The box around the boxes of each group."""
    return df.groupBy(*by).agg(*[F.min(f"min_{a}").alias(f"min_{a}") for a in "xyz"], *[F.max(f"max_{a}").alias(f"max_{a}") for a in "xyz"])


def runs(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Runs of equal neighbours in each group: number, value, length."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = df.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*by, "run", value).agg(F.count(F.lit(1)).alias("length"))


def first_seen(df: DataFrame, key: str, place: str) -> DataFrame:
    """key and its number in order of first appearance.

    Only distinct keys are ranked: in each range of first places first, then by the ranges' counts, so no single task ranks all.
    """
    return dense_rank_all(df.groupBy(key).agg(F.min(place).alias("first")), ["first"], "number").drop("first")


def dense_rank_all(df: DataFrame, order: list[str], name: str, value: str | None = None) -> DataFrame:
    """Number all rows from 0 in a total order, or with `value` give the sum of the values before (W03), without one task
    seeing every row: rows are dealt by ranges and sorted there, and each range starts at the sums of the ranges before."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part = cut(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    own = F.col(value).cast("long") if value else F.lit(1).cast("long")
    totals = part.groupBy("_range").agg(F.sum(own).alias("_total"))
    before = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return part.withColumn("_inside", F.sum(own).over(inside) - own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def within(df: DataFrame, by: list[str], order: list[str], name: str, value: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 in a total order, or with `value`, of which none is below 0, give the sum before in the group: numbers over
    all groups in turn, less the group's first, so that no group is one task's. Null keys are equal."""
    placed = dense_rank_all(df, [*by, *[o for o in order if o not in by]], "_all", value)
    first = placed.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.min("_all").alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    return placed.join(first, same).select(*df.columns, (F.col("_all") - F.col("_first")).alias(name))


def corpus_evidence(rows: DataFrame, by: list[str], payload: str, identity: str, generator: str, licence: str) -> DataFrame:
    """by, records, payloads, identities, generators, licences and problem (S20): a corpus has a payload in every record, an identity
    that no other record has, and one generator and one licence."""
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("records"), F.count(payload).alias("payloads"), F.count_distinct(identity).alias("identities"), F.count_distinct(generator).alias("generators"), F.count_distinct(licence).alias("licences"))
    problem = F.when(F.col("payloads") < F.col("records"), "payload").when(F.col("identities") < F.col("records"), "identity").when(F.col("generators") != 1, "generator").when(F.col("licences") != 1, "licence")
    return found.withColumn("problem", problem)


def makespan(df: DataFrame, by: str, duration: str, lanes: int) -> DataFrame:
    """Longest-first assignment to the least loaded lane: the busiest lane's sum (A25). Lanes are few; durations stream in order."""
    import heapq

    def fold(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        group, loads = None, [0] * lanes
        for pdf in batches:
            for g, d in zip(pdf[by], pdf[duration]):
                if g != group:
                    if group is not None:
                        yield pd.DataFrame({by: [group], "makespan": [max(loads)]})
                    group, loads = g, [0] * lanes
                heapq.heapreplace(loads, loads[0] + int(d))
        if group is not None:
            yield pd.DataFrame({by: [group], "makespan": [max(loads)]})

    kind = dict(df.dtypes)[by]
    return df.select(by, duration).repartition(by).sortWithinPartitions(by, F.desc(duration)).mapInPandas(fold, f"{by} {kind}, makespan long")
