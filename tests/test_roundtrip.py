"""Round trips of packages by digests; digests and offsets of large groups as streams and sums."""

import hashlib
import random

from girder.operators import chunks, digests, roundtrip

SCHEMA = "node_id string, parent_id string, name string, x double"


def forest():
    r = random.Random(9)
    rows = [("r0", None, "root", 0.0), ("r1", None, "root", 1.0)]
    for k in range(120):
        rows.append((f"n{k}", rows[r.randrange(len(rows))][0], f"name{k % 7}", k / 3))
    return rows


def found(spark, a, b):
    differences, opened = roundtrip.compare(*(roundtrip.digests(spark.createDataFrame(x, SCHEMA), ["name", "x"]) for x in (a, b)))
    return sorted((r.kind, r.node_id, r.parent_id) for r in differences.collect()), opened


def test_round_trip(spark):  # J27
    a = forest()
    below = {p for _, p, _, _ in a}
    leaves = [k for k, r in enumerate(a) if r[0] not in below]
    first, second, third, fourth = (a[k] for k in leaves[:4])
    assert found(spark, a, random.Random(1).sample(a, len(a))) == ([], 0)
    b = [r for r in a if r is not second]  # lost
    b[b.index(first)] = (*first[:3], 99.0)  # changed
    b[b.index(third)] = (third[0], "r0" if third[1] != "r0" else "r1", *third[2:])  # moved
    b += [fourth, ("new", fourth[1], "n", 0.0)]  # doubled, and one more beside it
    got, opened = found(spark, a, b)
    assert got == sorted([("lost", second[0], second[1]), ("changed", first[0], first[1]), ("moved", third[0], b[leaves[2] - (leaves[2] > leaves[1])][1]), ("copies", fourth[0], fourth[1]), ("added", "new", fourth[1])])
    assert opened < len(a) / 2
    top = next(r for r in a if r[0] in below and r[1] is not None)
    gone, seen = {top[0]}, None
    while seen != gone:
        seen, gone = gone, gone | {n for n, p, _, _ in a if p in gone}
    got, opened = found(spark, a, [r for r in a if r[0] not in gone])
    assert got == [("lost", top[0], top[1])] and opened < 10  # a lost subtree is not opened
    assert found(spark, a, [])[0] == [("lost", "r0", None), ("lost", "r1", None)]


def test_digests_of_a_large_group(spark):  # A29, S25
    rows = [("a", k, f"é{k}") for k in range(30_000)] + [(None, 1, "x"), ("b", 2, "")]
    df = spark.createDataFrame(rows, "g string, k long, piece string").repartition(7)
    got = {r.g: r.digest for r in digests.streamed(df, ["g"], ["k"], "\n").collect()}
    sha = lambda *parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    assert got == {"a": sha(*[p for g, _, p in rows if g == "a"]), None: sha("x"), "b": sha("")}
    assert digests.streamed(df.where("1 = 0"), ["g"], ["k"]).count() == 0


def test_offsets(spark):  # W03, K04
    rows = [(g, k, s) for g in ("a", "b", None) for k, s in enumerate((3, 4, 9, 1))]
    got = {(r.g, r.k): r.byte_offset for r in chunks.offsets(spark.createDataFrame(rows, "g string, k int, s int"), "g", "k", "s").collect()}
    assert got == {(g, k): at for g in ("a", "b", None) for k, at in enumerate((0, 4, 8, 20))}
