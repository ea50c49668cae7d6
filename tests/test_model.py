"""Relations of scenes and packages, ranks and windows on literal inputs and against plain Python."""

import random
from math import ceil

from pyspark.sql import functions as F

from girder.functions import scalars
from girder.operators import changes, model, ranking
from girder.sources import documents, part21
from girder.streaming import folds


def test_ranks_equal_sorting(spark):  # A06, A09, A10: groups with many equal values, null groups and null values
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.5, 1.5, 1.5, r.random()])) for _ in range(700)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    groups = {g: sorted(v for k, v in rows if k == g and v is not None) for g, _ in rows}
    for x in ranking.distribution(df, ["g"], "v").collect():
        own = groups[x.g]
        assert (x.samples, x.p50, x.p95, x.p99) == (len(own), *[own[ceil(len(own) * f) - 1] if own else None for f in (0.5, 0.95, 0.99)])
    for x in ranking.medians(df, ["g"], "v").collect():
        own = groups[x.g]
        assert (x.lower_median, x.median) == ((own[(len(own) - 1) // 2], (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2) if own else (None, None))


def test_windows_equal_a_loop(spark):  # ST09
    r = random.Random(2)
    points, windows = [(r.randint(-50, 50),) for _ in range(80)], [(i, a, a + r.randint(0, 40)) for i in range(30) for a in [r.randint(-60, 50)]]
    found = model.within_windows(spark.createDataFrame(points, "x long"), "x", spark.createDataFrame(windows, "w long, a long, b long"), 7)
    assert sorted((x.x, x.w) for x in found.collect()) == sorted((x, w) for (x,) in points for w, a, b in windows if a <= x <= b)


def test_rows_without_a_key_are_one_key(spark):  # ST01, ST03, ST05
    events = spark.createDataFrame([(j, t, t, "queued", 5) for j in (None, 2**60 + 1) for t in (0, 1)], "job_id long, ts long, event_id long, event string, elapsed long")
    got = folds.job_lifecycle(events).collect()
    assert sorted((r.job_id or 0, r.verdict) for r in got) == [(0, "accepted"), (0, "repeated"), (2**60 + 1, "accepted"), (2**60 + 1, "repeated")]
    requests = spark.createDataFrame([(None, 0, "a", 5, 5, 1, None), (None, 1, "a", 5, 5, 1, None)], "session long, seq long, chunk string, decoded_bytes long, gpu_bytes long, priority long, pin boolean")
    assert sorted(r.outcome for r in folds.residency(requests, 10, 10).collect()) == ["admitted", "touched"]
    frames = spark.createDataFrame([(None, f, [("a", 5, 5)]) for f in (0, 1)], "session long, frame long, wanted array<struct<chunk:string,decoded:long,gpu:long>>")
    assert {(r.frame, r.loaded, r.skipped) for r in folds.scheduled(frames, 10, 10).collect()} == {(0, "a", ""), (1, None, "a")}


def test_equal_documents_take_equal_sources_in_turn(spark):  # J06
    documents_ = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "x"), (4, "b", "y")], "document long, discipline string, digest string")
    sources = spark.createDataFrame([(11, "a", "x"), (12, "a", "x"), (13, "c", "y"), (14, "c", "x")], "source long, discipline string, digest string")
    assert sorted(map(tuple, changes.matched_sources(documents_, sources).collect())) == [(1, 11), (2, 12), (3, 14), (4, 13)]


def test_sources_claim_in_order(spark):  # J06, against the loop
    r = random.Random(4)
    docs = [(i, r.choice("abcd"), r.choice("uvwxyz") if i % 9 else None, -i) for i in range(60)]
    sources = [(100 + i, r.choice(["a", "b", "c", "d", "e", None]), r.choice("uvwxyz")) for i in range(60)]
    docs += [(90, "z", "one", 0), (91, "a", "two", 0), (92, "b", "two", 0)]
    sources += [(200, "a", "one"), (201, "z", "one"), (202, "b", "two"), (203, "a", "two"), (204, "c", "two"), (205, "q", "none")]
    claimed = {}
    for source, discipline, digest in sorted(sources, key=lambda s: (s[1] is not None, s[1] or "", s[0])):
        left = [d for d in sorted(docs, key=lambda d: d[3]) if d[2] == digest and d[0] not in claimed]
        own = [d for d in left if d[1] == discipline]
        for d in own[:1] or (left if len(left) == 1 else []):
            claimed[d[0]] = source
    got = changes.matched_sources(
        spark.createDataFrame(docs, "document long, discipline string, digest string, place long"), spark.createDataFrame(sources, "source long, discipline string, digest string"), "place"
    ).collect()
    assert len(got) == len(claimed) and dict(map(tuple, got)) == claimed and claimed[90] == 200 and claimed[91] == 203


def test_redaction(spark):  # P18
    one = lambda s, known=(): spark.range(1).select(scalars.redacted(F.lit(s), list(known)).alias("x")).first().x
    assert one(r"open \\srv\share\x.ifc, then D:/a b") == "open <path>, then <path> b"
    assert one("x:y/z/w and /tmp/x/y.z) but /single and a/b/c") == "x:y/z/w and <path>) but /single and a/b/c"
    assert one(r"in C:\job\1 or C:/job/1 and C:\job", [r"C:\job", r"C:\job\1"]) == "in <path> or <path> and <path>"


def test_headers(spark):  # S01-S03
    heads = {"a.ifc": " ISO-10303-21; FILE_SCHEMA (('A','IFC4X3_ADD2'));", "b.ifc": "ISO-10303-21;", "c.step": "ISO-10303-21; FILE_SCHEMA(('X','AP242 { 1 }'));"}
    found = spark.createDataFrame([(n, len(h), "", h) for n, h in heads.items()], "name string, byte_length long, sha256 string, head string")
    assert {r.name: (r.schema, r.problem) for r in part21.inspected_ifc(found).collect()} == {"a.ifc": ("IFC4X3", None), "b.ifc": (None, "undeclared"), "c.step": (None, "extension")}
    assert {r.name: r.problem for r in part21.inspected_step(found).collect()}["c.step"] is None


def test_demand_without_a_list_or_a_length(spark):  # A34
    views = spark.createDataFrame([("a", "x,,y,x"), ("b", ""), ("c", None), ("d", "x,z")], "view string, demand string")
    sizes = spark.createDataFrame([("x", 5), ("y", 7)], "chunk_id string, byte_length long")
    assert {r.view: (r.bytes, r.missing) for r in model.demanded_bytes(views, sizes).collect()} == {"a": (17, None), "b": (0, None), "c": (0, None), "d": (None, "z")}


def test_keys_that_are_taken_get_their_place(spark):  # W15
    rows = [(0, "a", "x"), (1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, "a:z", "q")]
    got = model.assigned_keys(spark.createDataFrame(rows, "position long, preferred string, label string")).orderBy("position").collect()
    assert [r.key for r in got] == ["a:x", "a:x#1", "b", "a:z", "a:z#4"]


def test_packages(spark):  # K01, S11, S22
    shape = lambda t: spark.range(1).select(documents.package_problem(F.lit(t)).alias("x")).first().x
    assert shape("[") == "unreadable" and shape('{"asset":{}}') == "version" and shape('{"asset":{"version":"2.0"}}') == "missing-scenes"
    texts = spark.createDataFrame([(1, '{"representations":[{"id":"r","surface":{"positions":[0,0,0],"indices":[]}}]}'), (2, '{"representations":[]}'), (3, "{}")], "k long, t string")
    assert {(r.k, r.representation_id, r.vertices, r.problem) for r in documents.representations(texts, "t", "k").collect()} == {(1, "r", 1, None), (3, None, None, "no-representations")}
