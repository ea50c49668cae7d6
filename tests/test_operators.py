"""Operators on literal inputs and against plain Python."""

import heapq
import random
from math import inf, nan

import pytest
from pyspark.sql import functions as F

from girder.functions import scalars
from girder.operators import changes, chunks, digests, hierarchy, properties, ranking, spatial, validation
from girder.sources import part21, scene_json, workload
from girder.streaming import folds


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_distribution(spark):  # A06
    df = spark.createDataFrame([(0, float(v)) for v in (5, 1, 3, 4, 2, 100)], "g long, v double")
    r = ranking.distribution(df, ["g"], "v").first()
    assert (r.samples, r.p50, r.p95, r.most) == (6, 3, 100, 100)


def test_medians(spark):  # A08, A09, A10
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 4.0), (0, 9.0), (1, 7.0)], "g long, v double")
    r = {x.g: x for x in ranking.medians(df, ["g"], "v").collect()}
    assert (r[0].lower_median, r[0].median, r[1].deviation) == (2, 3, 0)


def test_key_index_and_sets(spark):  # A12
    entries = spark.createDataFrame([("0", "b", "1"), ("0", "a", "1"), ("1", "a", "1"), ("1", "b", "1"), ("2", "b", "1")], "bag_id string, key string, value string")
    bags = spark.createDataFrame([(str(i),) for i in range(4)], "bag_id string")
    sets, own = properties.key_sets(bags, entries)
    assert {r.set_id: r.key_ids for r in sets.collect()} == {0: [], 1: [0, 1], 2: [1]}
    assert {r.bag_id: r.set_id for r in own.collect()} == {"0": 1, "1": 1, "2": 2, "3": 0}
    names = spark.createDataFrame([("0", k, "1") for k in ("alpha", "ifc.Tag", "Zeta")], "bag_id string, key string, value string")
    assert [r.key for r in properties.key_index(names).orderBy("key_id").collect()] == ["Zeta", "alpha", "ifc.Tag"]


def test_value_heap(spark):  # A13
    values = ['"first"', "2233332", "null", '"first"', "true", "1.5", '{"type":"array","values":[1,"x"]}', '"Dëck famïly"']
    heap = properties.value_heap(spark.createDataFrame([("0", str(i), v) for i, v in enumerate(values)], "bag_id string, key string, value string"))
    got = heap.orderBy("value_id").collect()
    assert [r.value.encode() for r in got] == sorted({v.encode() for v in values}) and len(got) == 7
    assert [r.offset for r in got] == [sum(x.byte_length for x in got[:i]) for i in range(7)]


def test_flattened(spark):  # P03
    df = spark.createDataFrame([("b", '{"A":{"x":1,"ID":2,"c":{"d":"e"}},"z":[1]}')], "bag_id string, j string").select("bag_id", F.parse_json("j").alias("v"))
    assert {(r.key, r.value) for r in properties.flattened(df, "v").collect()} == {("A.x", "1"), ("A.c.d", '"e"'), ("z", "[1]")}


PLANT = [("plant", None, "Plant", False, "plant", "assembly:plant", None), ("plant/a", "plant", "Pump train", False, "plant/pump-train", "assembly:pump-train", None), ("plant/a/b", "plant/a", "Impeller A", True, "plant/pump-train/impeller-a", "part:impeller", "source:part:PX-100"), ("plant/m", "plant", "Motor", True, "plant/motor", "part:motor", "source:part:M-200")]


@pytest.mark.parametrize("query,matching,shown,first", [("  ", [], [0, 1, 2, 3], None), ("px-100 IMPELLER", [2], [0, 1, 2], 2), ("prototype:assembly:pump-train", [1], [0, 1, 2], 2), ("compressor", [], [], None)])
def test_search(spark, query, matching, shown, first):  # P12, W07-W09
    tree = spark.createDataFrame(PLANT, "node_id string, parent_id string, name string, renderable boolean, occurrence string, prototype string, ref string")
    text = F.lower(F.concat_ws("\n", "name", F.concat(F.lit("occurrence:"), "occurrence"), F.concat(F.lit("prototype:"), "prototype"), "ref"))
    rows = hierarchy.search(hierarchy.preorder(tree), query, text).collect()
    assert sorted(r.node_index for r in rows if r.matching) == matching and sorted(r.node_index for r in rows) == shown
    assert [r.node_index for r in rows if r.first] == ([] if first is None else [first])


def test_tree_checks(spark):  # G04, G05
    rows = [("a", None), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "c"), ("f", "nowhere")]
    got = {(r.code, r.node_id) for r in hierarchy.checks(spark.createDataFrame(rows, "node_id string, parent_id string")).collect()}
    assert got == {("NODE_PARENT", "b"), ("MISSING_REFERENCE", "f"), *(("OCCURRENCE_CYCLE", n) for n in "bcde")}


def test_world_and_bounds(spark):  # G01, G03
    def matrix(tx, s):
        return [s, 0.0, 0.0, 0.0, 0.0, s, 0.0, 0.0, 0.0, 0.0, s, 0.0, tx, 0.0, 0.0, 1.0]

    df = spark.createDataFrame([("a", None, matrix(1.0, 2.0)), ("b", "a", matrix(3.0, -1.0))], "node_id string, parent_id string, local array<double>")
    world = hierarchy.world_transforms(df).where("node_id = 'b'").withColumns({f"{s}_{a}": F.lit(v) for a in "xyz" for s, v in (("min", 0.0), ("max", 1.0))})
    got = world.select(*[c.alias(n) for n, c in hierarchy.transformed_bounds(F.col("world")).items()]).first()
    assert (got.min_x, got.max_x, got.min_y, got.max_y) == (5.0, 7.0, -2.0, 0.0)


def brute_leaves(boxes, capacity, path=""):
    if len(boxes) <= capacity:
        return {b[0]: path for b in boxes}
    width = [max(b[2 + 2 * k] for b in boxes) - min(b[1 + 2 * k] for b in boxes) for k in range(3)]
    k = width.index(max(width))
    boxes = sorted(boxes, key=lambda b: (b[1 + 2 * k] + b[2 + 2 * k], b[0]))
    half = len(boxes) // 2
    return brute_leaves(boxes[:half], capacity, path + "0") | brute_leaves(boxes[half:], capacity, path + "1")


@pytest.mark.parametrize("in_a_task,about", [(1, 0.005), (20, 0.005), (20, 0.4), (1 << 16, 0.005)])
def test_leaves(spark, monkeypatch, in_a_task, about):  # G08; brackets that hold few rows, or miss the middle, or hold nearly all
    monkeypatch.setattr(spatial, "TASK_BOXES", in_a_task)
    monkeypatch.setattr(spatial, "ABOUT", about)
    r = random.Random(3)
    boxes = [(f"id{i:03d}", *[v for _ in range(3) for a in [r.randint(0, 9)] for v in (a, a + r.randint(0, 3))]) for i in range(60)]
    columns = "id string, min_x long, max_x long, min_y long, max_y long, min_z long, max_z long"
    for rows in (boxes, boxes[::-1]):
        got = {x.id: x.leaf for x in spatial.leaves(spark.createDataFrame(rows, columns), 5).collect()}
        assert got == brute_leaves(boxes, 5)


def test_leaves_of_several_levels(spark, monkeypatch):  # G08: levels along one axis cost one round; equal centres are told by id
    labels, write = [], spatial.cut
    monkeypatch.setattr(spatial, "TASK_BOXES", 8)
    monkeypatch.setattr(spatial, "cut", lambda df, label: labels.append(label) or write(df, label))
    r = random.Random(4)
    boxes = [(f"id{i:03d}", *[v for size in (5000, 3, 3) for a in [r.randint(0, size) // 40 * 40] for v in (a, a + r.randint(0, 1))]) for i in range(130)]
    columns = "id string, min_x long, max_x long, min_y long, max_y long, min_z long, max_z long"
    got = {x.id: x.leaf for x in spatial.leaves(spark.createDataFrame(boxes, columns), 5).collect()}
    assert got == brute_leaves(boxes, 5)
    assert labels.count("bvh") == 1


IDENTITY = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]


def test_frustum():  # P13, G16
    assert spatial.frustum_planes(IDENTITY) == [(1, 0, 0, 1), (-1, 0, 0, 1), (0, 1, 0, 1), (0, -1, 0, 1), (0, 0, 1, 0), (0, 0, -1, 1)]


def test_demand(spark):  # G09, P14, A15: touching a plane is visible
    boxes = spark.createDataFrame([("0", -2.0, -1.0, -1.0, 1.0, -1.0, 1.0), ("1", 5.0, 6.0, 0.0, 1.0, 0.0, 1.0)], "leaf string, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    links = spark.createDataFrame([("0", 0), ("1", 1)], "leaf string, chunk int")
    assert [tuple(r) for r in spatial.demand(boxes, links, IDENTITY, (0.0, 0.0, 0.0)).collect()] == [(0, 1.0, 1)]


def test_snapshot_changes(spark):  # J07
    schema = "discipline string, digest string, uri string"
    before = spark.createDataFrame([("architecture", "aaa", "a"), ("plumbing", "ccc", "p"), ("structure", "bbb", "s")], schema)

    def got(rows):
        return {tuple(r) for r in changes.snapshot_changes(before, spark.createDataFrame(rows, schema)).collect()}

    assert got([("architecture", "changed", "a"), ("plumbing", "ccc", "p"), ("structure", "bbb", "s")]) == {("changed", "architecture", None)}
    assert got([("architecture", "aaa", "a"), ("structure-core", "bbb", "s")]) == {("deleted", "plumbing", None), ("renamed", "structure-core", "structure")}
    assert got([("architecture", "aaa", "new"), ("plumbing", "ccc", "p"), ("structure", "bbb", "s")]) == {("renamed", "architecture", "architecture")}


def test_invalidation(spark):  # G06, G07
    owns = spark.createDataFrame([(d, f"chunk-{d}") for d in ("architecture", "plumbing", "structure")], "document string, target string")
    edges = spark.createDataFrame([("architecture", "structure")], "a string, b string")
    got = changes.invalidated(spark.createDataFrame([("architecture",)], "document string"), edges, owns)
    assert {r.document for r in got.collect()} == {"architecture", "structure"}


def test_reopen(spark):  # J08, J09, A20
    expected = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "k string, digest string")
    seen = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None)], "k string, digest string")
    status = changes.reopened(expected, seen, "k")
    assert {r.k: r.status for r in status.collect()} == {"a": "verified", "b": "changed", "c": "unverifiable", "d": "missing"}
    assert changes.worst(status.withColumn("g", F.lit(1)), ["g"]).first().status == "missing"


def test_coalesce(spark):  # W05
    r = random.Random(1)
    rows, want, at = [], [], 0
    group = total = 0
    for i in range(200):
        size, gap = r.choice([10, 40, 90, 200]), 8 if r.random() < 0.1 else 0
        at += gap
        if i and (gap or total + size > 100):
            group, total = group + 1, 0
        total += size
        rows.append(("d", i, at, size))
        want.append(group)
        at += size
    got = chunks.coalesce_ranges(spark.createDataFrame(rows, "doc string, i int, byte_offset long, byte_length long"), "doc", 100)
    assert [x.group for x in got.orderBy("i").collect()] == want


def test_makespan(spark):  # A25
    r = random.Random(2)
    rows = [(g, r.randint(1, 50)) for g in ("a", "b") for _ in range(40)]
    for g, got in ranking.makespan(spark.createDataFrame(rows, "g string, ms long"), "g", "ms", 3).collect():
        lanes = [0, 0, 0]
        for d in sorted((d for k, d in rows if k == g), reverse=True):
            heapq.heapreplace(lanes, lanes[0] + d)
        assert got == max(lanes)


def test_runs(spark):  # A19
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate("aabba")] + [(0, 5, None), (0, 6, None)], "g long, i long, v string")
    assert [(r.v, r.length) for r in ranking.runs(df, ["g"], [F.col("i")], "v").orderBy("run").collect()] == [("a", 2), ("b", 2), ("a", 1), (None, 2)]


def test_scalars(spark):
    assert [one(spark, scalars.slug(F.lit(s))) for s in ("Pump  Train #1", "--", "É")] == ["pump-train-1", "unnamed", "unnamed"]
    assert [one(spark, scalars.rounded(F.lit(v))) for v in (1.5, -0.0, inf, nan)] == ["1.5", "0.0", "inf", "nan"]
    assert one(spark, scalars.redacted(F.lit(r"at C:\a\b and /home/u/x in /known/p"), ["/known/p"])) == "at <path> and <path> in <path>"
    assert one(spark, scalars.basename(F.lit(r"a/b\c.ifc"))) == "c.ifc"
    assert one(spark, scalars.nfkc_lower(F.lit("ﬁＡ"))) == "fia"
    unit = F.array(*[F.lit(v) for v in IDENTITY])
    assert one(spark, scalars.transform_kind(unit)) == "identity"
    moved = F.array(*[F.lit(2.0 if i == 12 else v) for i, v in enumerate(IDENTITY)])
    assert one(spark, scalars.transform_kind(moved)) == "translation"
    assert one(spark, scalars.finite_matrix(F.array(*[F.lit(nan)] * 16))) == IDENTITY


def test_validation(spark):
    box = "id string, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
    rows = [("ok", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("nan", nan, 0.0, 0.0, 1.0, 1.0, 1.0), ("turned", 2.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    codes = lambda df: {(r.code, r.path) for r in df.collect()}
    assert codes(validation.bounds(spark.createDataFrame(rows, box), "id")) == {("NON_FINITE_BOUNDS", "nan"), ("INVERTED_BOUNDS", "turned")}
    assert codes(validation.property_keys(spark.createDataFrame([(0, "a"), (1, " "), (2, "a")], "key_id long, key string"))) == {("EMPTY_PROPERTY_KEY", "1"), ("DUPLICATE_PROPERTY_KEY", "2")}
    sets = spark.createDataFrame([(0, [0, 1]), (1, [1, 1]), (2, [0, 9]), (3, [])], "set_id long, key_ids array<long>")
    assert codes(validation.property_sets(sets, 3)) == {("PROPERTY_SET_NOT_ASCENDING", "1"), ("PROPERTY_KEY_OUT_OF_RANGE", "2")}
    assert codes(validation.property_rows(spark.createDataFrame([("a", 0, 2), ("b", 0, 1), ("c", 7, 0)], "bag_id string, set_id long, n_values long"), sets)) == {("PROPERTY_VALUE_ARITY", "b"), ("PROPERTY_SET_OUT_OF_RANGE", "c")}
    meshes = spark.createDataFrame([("ok", 9, 3, 2, 9), ("bad", 8, 4, 5, 6)], "mesh_id string, n_position_values long, n_indices long, max_index long, n_normal_values long")
    assert {c for c, _ in codes(validation.meshes(meshes))} == {"INVALID_POSITION_COUNT", "INVALID_TRIANGLE_COUNT", "INDEX_OUT_OF_RANGE", "ATTRIBUTE_COUNT_MISMATCH"}
    assert codes(validation.ranges(spark.createDataFrame([("a", 0, 8), ("b", 6, 1), ("c", 8, 8)], "view_id string, byte_offset long, byte_length long"), 12)) == {("BUFFER_ALIGNMENT", "b"), ("BUFFER_RANGE", "c")}


def test_digest_does_not_depend_on_order(spark):  # A29
    rows = [("d", i, f"v{i}") for i in range(30)]
    a, b = (digests.ordered_digest(spark.createDataFrame(r, "d string, i long, v string"), ["d"], ["i", "v"], "i").first().digest for r in (rows, rows[::-1]))
    assert a == b


def test_publish(spark, tmp_path):  # K05
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    path, digest = f"file://{tmp_path}/entry", F.concat_ws(":", "k", "v")
    assert digests.publish(df, path, digest) == "created" and digests.publish(df, path, digest) == "same"
    with pytest.raises(ValueError):
        digests.publish(df.where("k = 1"), path, digest)


def test_fingerprint(spark, tmp_path):  # S25
    from hashlib import sha256

    for n in ("b.txt", "a.txt"):
        (tmp_path / n).write_text(n)
    want = sha256("".join(f"{n}\n{sha256(n.encode()).hexdigest()}\n" for n in ("a.txt", "b.txt")).encode()).hexdigest()
    assert digests.folder_fingerprint(spark, f"file://{tmp_path}").first().digest == want


PART21 = "ISO-10303-21;\nHEADER;\nFILE_SCHEMA(('IFC4'));\nENDSEC;\nDATA;\n#1=IFCWALL('a');\n #2 = ( IFCDOOR('b'));\nnot #3=X(\n#40=ifcwall();\nENDSEC;\n"


def test_part21(spark, tmp_path):  # S01-S04
    for name in ("w.ifc", "w.txt"):
        (tmp_path / name).write_text(PART21)
    (tmp_path / "s.step").write_text(PART21.replace("IFC4", "AUTOMOTIVE_DESIGN { 1 0 10303 214 }"))
    got = {r.name: (r.schema, r.problem) for r in part21.inspect_ifc(spark, f"file://{tmp_path}").collect()}
    assert got["w.ifc"] == ("IFC4", None) and got["w.txt"][1] == "extension"
    assert {r.name: r.problem for r in part21.inspect_step(spark, f"file://{tmp_path}").collect()}["s.step"] is None
    lines = spark.read.text(f"file://{tmp_path}/w.ifc")
    assert {r.type: (r.n, r.last_id) for r in part21.histogram(lines).collect()} == {"IFCWALL": (2, 40), "IFCDOOR": (1, 2)}


def test_scene_json(spark, tmp_path):  # S06: spans end in strings, behind backslashes, in keys and between records
    import json

    doc = {"a": [{"x": 'q"]}\\'}, {"y": [1, {"z": "é"}]}, 5, "s\\\\"], "meta": {"k": [1]}, 'em"p\\ty': [], "n": 3, "b": [[1, 2], []], "a2": [None]}
    for indent in (1, None):
        text = json.dumps(doc, indent=indent, ensure_ascii=False)
        path = tmp_path / f"scene{indent}.json"
        path.write_text(text.replace('"n": 3', '"n": [7],\n"n": 3'))
        for span in (1 << 20, 11, 64) if indent is None else (5, 1 << 20):
            got = scene_json.read_scene(spark, f"file://{path}", span).collect()
            for name, value in doc.items():
                own = [json.loads(r.record) for r in sorted(got, key=lambda r: r.position) if r.collection == name]
                assert own == (value if isinstance(value, list) else [value]), (span, name)
            assert len(got) == sum(len(v) if isinstance(v, list) else 1 for v in doc.values())
    for odd in ('{"a":1} x', '{"a":[1', '{"a":"b'):
        path.write_text(odd)
        with pytest.raises(ValueError):
            scene_json.read_scene(spark, f"file://{path}", 4)


def test_workload(spark):  # S23
    df = workload.workload(spark, 1000)
    assert {r.prototype: r["count"] for r in df.groupBy("prototype").count().collect()} == {0: 600, 1: 200, 2: 150, 3: 50}


def test_job_lifecycle():  # ST01, ST02
    def run(*events):
        state = folds.job_start()
        return [folds.job_step(state, 1, e, t) for t, e in enumerate(events)]

    assert [r["verdict"] for r in run("queued", "extracting", "inspecting", "extracting", "publishing", "cancelled", "failed")] == ["accepted", "accepted", "backwards", "repeated", "accepted", "accepted", "after-end"]
    assert run("queued", "extracting", "publishing", "cancelled")[-1]["published_before"]
    assert [r["total"] for r in run("queued", "inspecting", "verifying", "completed")] == [None, None, 3, 3]
    assert run("queued", "verifying", "publishing")[-1]["verdict"] == "off-plan"


def test_job_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(4)
    rows = [(j, t, t, r.choice([*folds.STATES, *folds.TERMINAL]), t) for j in range(5) for t in range(12)]
    df = spark.createDataFrame(rows, "job_id long, ts long, event_id long, event string, elapsed long")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = folds.job_stream(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("jobs").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("jobs").collect())) == sorted(map(str, folds.job_lifecycle(df).collect()))


def test_residency():  # ST03, ST04
    room = folds.Residency(100, 100)
    assert room.request("a", (60, 60), 5) == ("admitted", []) and room.request("b", (30, 30), 6) == ("admitted", [])
    assert room.request("c", (60, 60), 7)[0] == "rejected" and room.used == [90, 90]
    assert room.request("c", (60, 60), 1) == ("admitted", ["b", "a"]) and room.request("d", (101, 1), 0)[0] == "rejected"
    assert room.request("c", (60, 60), 1, pin=True)[0] == "touched" and room.request("e", (90, 90), 0)[0] == "rejected"
    r = random.Random(6)
    room, cost = folds.Residency(200, 150), {f"c{i}": (r.randint(1, 90), r.randint(1, 90)) for i in range(20)}
    for _ in range(500):
        c = f"c{r.randrange(20)}"
        room.request(c, cost[c], r.randrange(5), r.random() < 0.02)
        assert room.used == [sum(cost[h][k] for h in room.held) for k in (0, 1)] and all(u <= b for u, b in zip(room.used, room.budget))


def test_scheduler():  # ST05
    s = folds.Scheduler(100, 100)
    wanted = [("a", 60, 60), ("b", 60, 60), ("c", 10, 10)]
    assert s.frame(wanted) == ("a", [], []) and s.frame(wanted) == ("c", ["a"], ["b"]) and s.frame(wanted) == (None, ["a", "c"], ["b"])
    assert s.frame(wanted[1:]) == ("b", [], [])
