"""The tree of boxes as tables: frames against its nodes, its flat form and the proof; process snapshots as a stream."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from girder.operators import spatial, spatial_index
from girder.streaming import snapshots

COLUMNS = "id string, chunk int, min_x long, max_x long, min_y long, max_y long, min_z long, max_z long"


@pytest.fixture(scope="module")
def boxes():
    r = random.Random(5)
    return [(f"b{i:03d}", r.randrange(9), *[v for _ in range(3) for a in [r.randint(-50, 50)] for v in (a, a + r.randint(0, 4))]) for i in range(230)]


@pytest.fixture(scope="module")
def placed(spark, boxes):
    return spatial.leaves(spark.createDataFrame(boxes, COLUMNS), 8)


def views():
    """Matrices: orthographic, and two with perspective from different eyes; one frame sees nothing."""
    flat = [0.02 if i in (0, 5) else 0.01 if i == 10 else 0.0 for i in range(16)]
    flat[14], flat[15] = 0.5, 1.0
    deep = [0.0] * 16
    deep[0], deep[9], deep[6], deep[7], deep[14] = 1.5, 1.5, 1.1, 1.0, -2.0
    return [(1, *flat, 0.0, 0.0, 0.0), (2, *deep, 3.0, -60.0, 1.0), (3, *deep, -10.0, 5.0, 7.0), (4, *flat, 5000.0, 0.0, 0.0)]


def look(m, o, box):
    """visible, distance, coverage of one box, corner by corner."""
    side = [(box[2 * k] - o[k], box[2 * k + 1] - o[k]) for k in range(3)]
    points = [[m[r] * x + m[4 + r] * y + m[8 + r] * z + m[12 + r] for r in range(4)] for x in side[0] for y in side[1] for z in side[2]]
    out = [all(p[0] < -p[3] for p in points), all(p[0] > p[3] for p in points), all(p[1] < -p[3] for p in points), all(p[1] > p[3] for p in points), all(p[2] < 0 for p in points), all(p[2] > p[3] for p in points)]
    c = [sum(s) / 2 for s in side]
    x, y, _, w = [m[r] * c[0] + m[4 + r] * c[1] + m[8 + r] * c[2] + m[12 + r] for r in range(4)]
    distance = (x / w) ** 2 + (y / w) ** 2 if w else math.inf
    if any(p[3] <= 0 for p in points):
        return not any(out), distance, 4.0
    spans = [max(0.0, min(max(p[k] / p[3] for p in points), 1) - max(min(p[k] / p[3] for p in points), -1)) for k in range(2)]
    return not any(out), distance, spans[0] * spans[1]


def around(rows):
    return [f(r[i] for r in rows) for k in range(3) for i, f in ((2 + 2 * k, min), (3 + 2 * k, max))]


@pytest.mark.parametrize("top", [16, 3])
def test_frames(spark, boxes, placed, top, monkeypatch):  # J24, G09, A15, T06; also with levels that meet by paths
    monkeypatch.setattr(spatial_index, "TOP", top)
    monkeypatch.setattr(spatial_index, "PAIRS", 3)
    leaf = {r.id: r.leaf for r in placed.collect()}
    frames = spark.createDataFrame(views(), "frame long, " + ", ".join(f"{c} double" for c in spatial_index.MATRIX + spatial_index.ORIGIN))
    seen = spatial_index.see(spatial_index.nodes(placed), frames)
    stats = {r.frame: tuple(r)[1:] for r in seen.stats().collect()}
    demand = {(r.frame, r.chunk): r for r in seen.demand(placed.select("leaf", "chunk").distinct()).collect()}
    for frame, *rest in views():
        m, o = rest[:16], rest[16:]
        visited = leaves = items = 0
        want, stack = {}, [""]
        while stack:
            path = stack.pop()
            visited += 1
            own = [b for b in boxes if leaf[b[0]].startswith(path)]
            visible, distance, coverage = look(m, o, around(own))
            if not visible:
                continue
            if all(leaf[b[0]] == path for b in own):
                leaves, items = leaves + 1, items + len(own)
                for c in {b[1] for b in own}:
                    d, v = want.get(c, (math.inf, 0.0))
                    want[c] = min(d, distance), max(v, coverage)
            else:
                stack += [path + "0", path + "1"]
        if visited > 1 or leaves:
            assert stats[frame] == (visited, leaves, items)
        else:
            assert frame not in stats
        assert {c: pytest.approx((r.distance, r.coverage)) for (f, c), r in demand.items() if f == frame} == want
        near, wide = (sorted((r for (f, _), r in demand.items() if f == frame), key=k) for k in (lambda r: (r.distance, r.chunk), lambda r: (-r.coverage, r.distance, r.chunk)))
        assert [r.by_distance for r in near] == [r.by_coverage for r in wide] == list(range(1, len(near) + 1))
    assert sum(v for v, _, _ in stats.values()) < len(stats) * spatial_index.nodes(placed).count() * 0.8
    none = spatial_index.see(spatial_index.nodes(placed.where("1 = 0")), frames)
    assert none.stats().count() == none.demand(placed.select("leaf", "chunk")).count() == 0


def test_flat_and_proof(spark, placed):  # G14
    flat = spatial_index.flatten(placed)
    flat = spatial_index.Flat(*[spark.createDataFrame(t.collect(), t.schema).cache() for t in (flat.nodes, flat.boxes, flat.chunks)])
    rows = {r.node: r for r in flat.nodes.collect()}
    inner, leaves = [n for n, r in rows.items() if r.left_node is not None], sorted(n for n, r in rows.items() if r.left_node is None)
    depth = lambda n: 1 + max(depth(rows[n].left_node), depth(rows[n].right_node)) if n in inner else 0
    assert all(rows[n].left_node == n + 1 for n in inner)
    found = lambda f, **more: sorted(tuple(r) for r in spatial_index.proof(f, 8, **more).collect())
    assert found(flat, leaves=len(leaves), depth=depth(0)) == []
    assert found(flat, leaves=len(leaves) + 1) == found(flat, depth=depth(0) + 1) == [("STATISTICS", 0)]

    def broken(*changes):
        put = {}
        for node, columns in changes:
            for c, v in columns.items():
                put[c] = F.when(F.col("node") == node, F.lit(v)).otherwise(put.get(c, F.col(c))).cast(flat.nodes.schema[c].dataType)
        return set(found(replace(flat, nodes=flat.nodes.withColumns(put))))

    (p, q, r, s), (a, b, c, d, e, f) = [n for n in inner if rows[n].left_node in leaves and rows[n].right_node in leaves][:4], leaves[-12:-2:2] + leaves[-1:]
    after = lambda n: leaves[leaves.index(n) + 1]
    got = broken(
        (p, {"right_node": None}), (q, {"right_node": 10**6}), (r, {"right_node": rows[r].left_node}), (s, {"boxes": 1}),
        (a, {"boxes": 1}), (b, {"boxes": 0}), (c, {"boxes": 9}), (d, {"boxes": rows[d].boxes + 1}), (e, {"first_chunk": rows[e].first_chunk + 1}), (f, {"boxes": rows[f].boxes + 1, "chunks": rows[f].chunks + 1}),
    )
    assert got >= {
        ("CHILDREN", p), ("NODE_UNREACHABLE", rows[p].right_node), ("NODE_MISSING", 10**6), ("NODE_UNREACHABLE", rows[q].right_node), ("CHILDREN", r), ("NODE_REPEATED", rows[r].left_node),
        ("NODE_UNREACHABLE", rows[r].right_node), ("INNER_REFERENCES", s), ("BOX_OMITTED", rows[a].first_box + 1), ("LEAF_COUNTS", b), ("BOX_OMITTED", rows[b].first_box), ("LEAF_COUNTS", c),
        ("BOX_OWNERS", rows[after(d)].first_box), ("CHUNK_OMITTED", rows[e].first_chunk), ("CHUNK_OWNERS", rows[after(e)].first_chunk), ("BOX_RANGE", f), ("CHUNK_RANGE", f),
    }
    assert {n for code, n in got if code in ("CHILDREN", "INNER_REFERENCES", "BOX_RANGE", "CHUNK_RANGE", "BOUNDS")} == {p, r, s, f}
    got = broken((s, {"left_node": 0, "max_z": -1000}))  # a cycle through the root ends
    assert got >= {("NODE_REPEATED", 0), ("BOUNDS", s), ("NODE_UNREACHABLE", rows[s].left_node)}
    swapped = flat.chunks.withColumn("chunk", F.when(F.col("place") == rows[a].first_chunk, 100).otherwise(F.col("chunk")))
    assert {("CHUNK_ORDER", a), ("CHUNK_EXTRA", a), ("CHUNK_LACKING", a)} == set(found(replace(flat, chunks=swapped)))


def test_tree_sums():  # G13
    rows = [(1, 0, 10), (2, 1, 5), (3, 2, 7), (9, 8, 100), (2, 1, 6), (1, 3, 11)]
    assert snapshots.tree(rows, 1) == (5, 11 + 5 + 6 + 7 + 11)  # the root is below its own descendant, and counted there again
    assert snapshots.tree(rows, 4) == (0, 0)


def test_snapshot_stream(spark, tmp_path):  # S24, A24
    schema = "machine long, ts timestamp, sequence long, pid long, parent long, bytes long"
    at = lambda minute: f"2024-01-01 00:{minute:02d}:00"
    first = [(1, at(0), 1, 1, 0, 10), (1, at(1), 2, 2, 1, 5), (2, at(2), 3, 2, 1, 5), (1, at(12), 4, 1, 0, 3)]
    second = [(1, at(3), 5, 3, 2, 100), (1, at(31), 6, 1, 0, 1)]  # late, but within the delay
    third = [(1, at(4), 7, 4, 1, 10_000), (2, at(33), 8, 1, 0, 2)]  # too late for its closed snapshot
    for k, rows in enumerate((first, second, third)):
        spark.createDataFrame([(m, t, *rest) for m, t, *rest in rows], schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/*")
        snapshots.write(snapshots.snapshots(stream, "10 minutes", "15 minutes"), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    found = {(r.machine, r.begin.minute): (r.processes, r.bytes) for r in snapshots.read(spark, f"file://{tmp_path}/out").collect()}
    assert found == {(1, 0): (3, 115), (2, 0): (0, 0), (1, 10): (1, 3), (1, 30): (1, 1), (2, 30): (1, 2)}
    peaks = {r.machine: tuple(r)[1:] for r in snapshots.peaks(snapshots.read(spark, f"file://{tmp_path}/out")).collect()}
    assert peaks == {1: (3, 3, 3, 115), 2: (2, 1, 1, 2)}
    # without what came too late, the batch answer is the same
    batch = spark.createDataFrame([r for r in first + second + third[1:]], schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    assert {r.machine: tuple(r)[1:] for r in snapshots.peaks(snapshots.snapshots(batch, "10 minutes", "15 minutes")).collect()} == peaks


def test_pairs_are_not_kept(spark, boxes, placed, monkeypatch):  # J24: tables grow with frames, not with what they see; equal views are walked once
    rows = {}

    def kept(df, label, cut=spatial_index.cut):
        out = cut(df, label)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(spatial_index, "cut", kept)
    views_ = [(10 * k + f, *rest) for k in range(3) for f, *rest in views()]
    frames = spark.createDataFrame(views_, "frame long, " + ", ".join(f"{c} double" for c in spatial_index.MATRIX + spatial_index.ORIGIN))
    stats = {r.frame: tuple(r)[1:] for r in spatial_index.see(spatial_index.nodes(placed), frames).stats().collect()}
    assert sum(rows["index-seen"]) <= 4
    assert all(stats.get(10 * k + f) == stats.get(f) for k in range(3) for f in range(1, 5)) and len(stats) % 3 == 0 < len(stats)


def test_nothing_is_broadcast_but_a_few_rows(spark, placed, monkeypatch):  # G14: tables that grow with the tree don't pass through the driver
    plans = []

    def seen(df, label, cut=spatial_index.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, label)

    monkeypatch.setattr(spatial_index, "cut", seen)
    found = spatial_index.proof(spatial_index.flatten(placed), 8)
    assert found.collect() == []
    joins = [line for plan in [*plans, found._jdf.queryExecution().executedPlan().toString()] for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert all("[_range" in line for line in joins), joins


@pytest.mark.parametrize("kind", ["int", "string"])
def test_demand_in_tasks_and_by_windows(spark, placed, monkeypatch, kind):  # A15, T06: frames with the same view, few views, chunks listed several times
    monkeypatch.setattr(spatial_index, "TOP", 3)
    views_ = [(10 * k + f, *rest) for k in range(5) for f, *rest in views()]
    frames = spark.createDataFrame(views_, "frame long, " + ", ".join(f"{c} double" for c in spatial_index.MATRIX + spatial_index.ORIGIN))
    own = placed.withColumn("chunk", (F.col("chunk") * 3).cast(kind))
    listed = own.select("leaf", "chunk").union(own.select("leaf", F.lit(None).cast(kind)))
    got = []
    for names, few, rows, cells in ((0, 256, 1 << 16, 1 << 20), (1 << 12, 256, 1 << 16, 1 << 20), (1 << 12, 1, 2, 9)):
        for name, value in (("NAMES", names), ("FEW", few), ("ROWS", rows), ("CELLS", cells)):
            monkeypatch.setattr(spatial_index, name, value)
        seen = spatial_index.see(spatial_index.nodes(own), frames)
        got.append(sorted(tuple(r) for r in seen.demand(listed).collect()))
        rounded = sorted(tuple(r) for r in seen.demand(listed, 1).collect())
        assert [(f, c, pytest.approx(round(d, 1), abs=0.11), b, w) for f, c, d, _, b, w in got[-1]] == [(f, c, d, b, w) for f, c, d, _, b, w in rounded]
    assert got[0] == got[1] == got[2] and len({r[0] for r in got[0]}) == 15


def test_demand_is_not_joined_with_frames(spark, placed, monkeypatch):  # rows of a view are repeated for its frames where they are made, on several tasks
    monkeypatch.setattr(spatial_index, "FEW", 1)
    views_ = [(10 * k + f, *rest) for k in range(50) for f, *rest in views()]
    frames = spark.createDataFrame(views_, "frame long, " + ", ".join(f"{c} double" for c in spatial_index.MATRIX + spatial_index.ORIGIN))
    found = spatial_index.see(spatial_index.nodes(placed), frames).demand(placed.select("leaf", "chunk"))
    above = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Join" not in above and "Window" not in above and "Exchange" not in above, above
    assert found.rdd.getNumPartitions() == 4  # before: one for all views below FRAMES
