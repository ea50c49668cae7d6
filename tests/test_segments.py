"""Greedy segmentation against the plain loop, whatever the ranges."""

import random

import pytest

from girder.operators.segments import coalesce_ranges


def plain(rows, budget):
    """group of each row of (owner, i, offset, length), in order."""
    out, owner, group, total, end = {}, object(), 0, 0, None
    for o, i, at, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2] is not None, r[2] or 0, r[3] is not None, r[3] or 0)):
        if o != owner:
            owner, group, total = o, 0, 0
        elif None in (at, size, end) or at != end or total + size > budget:
            group, total = group + 1, 0
        known = at is not None and size is not None
        total, end = (total + size, at + size) if known else (0, None)
        out[i] = group
    return out


def made(seed, owners, count, sizes, gaps):
    r, rows = random.Random(seed), []
    for o in owners:
        at = 0
        for _ in range(count):
            at += r.choice([0] * 40 + [7]) if gaps else 0
            size = r.choice(sizes)
            rows.append((o, len(rows), at, size))
            at += size
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [[10, 40, 90, 250], [1], [7], [0, 0, 30, 100, 101]])
@pytest.mark.parametrize("owners", [["d"], ["a", "b", "c", None]])
def test_equals_the_loop(spark, sizes, owners):
    for seed, gaps in ((1, False), (2, True)):
        rows = made(seed, owners, 700 // len(owners), sizes, gaps)
        if sizes == [0, 0, 30, 100, 101]:  # rows of no bytes at one place cannot be told apart by order
            rows = list({(o, at, size): (o, i, at, size) for o, i, at, size in rows}.values())
        df = spark.createDataFrame(rows, "doc string, i int, byte_offset long, byte_length long")
        old = spark.conf.get("spark.sql.shuffle.partitions")
        try:
            for parts in ("1", "23"):
                spark.conf.set("spark.sql.shuffle.partitions", parts)
                spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
                assert {x.i: x.group for x in coalesce_ranges(df, "doc", 100).collect()} == plain(rows, 100)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_batches_and_spread(spark):
    """One owner meets all ranges; a range that comes in many batches is numbered the same."""
    rows = made(5, ["d"], 3000, [3, 20, 60], True)
    df = spark.createDataFrame(rows, "doc string, i int, byte_offset long, byte_length long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = coalesce_ranges(df, "doc", 100).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {x.i: x.group for x in got} == plain(rows, 100)


def test_nulls_clashing_names_and_no_rows(spark):
    rows = [("a", 0, None, 5), ("a", 1, 0, 5), ("a", 2, 5, None), ("a", 3, 5, 5), ("a", 4, 10, 5), (None, 5, 0, 5), (None, 6, 5, 5), ("b", 7, None, None)]
    df = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], "doc string, i int, byte_offset long, byte_length long, part int, row int, Group int")
    got = coalesce_ranges(df, "doc", 100)
    assert got.columns == ["doc", "i", "byte_offset", "byte_length", "part", "row", "group"]
    assert {x.i: x.group for x in got.collect()} == plain(rows, 100) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 0, 6: 0, 7: 0}
    assert coalesce_ranges(df.where("i < 0"), "doc", 100).collect() == []


def test_numbers_beside_columns_of_common_names(spark):
    from girder.operators.ranking import dense_rank_all, within

    rows = [(i, i % 3, -i, i * 2, i + 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, part long, inside long, before long, total long").repartition(5)
    assert sorted(map(tuple, dense_rank_all(df, ["k"], "n").collect())) == [(*r, i) for i, r in enumerate(rows)]
    assert {r.k: r.n for r in within(df, ["part"], ["k"], "n").collect()} == {k: k // 3 for k in range(50)}
