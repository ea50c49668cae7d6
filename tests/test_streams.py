"""The store of typed streams: round trips, what is read for a predicate, faults, property heaps."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In
from pyspark.sql.types import StructType

from girder.sources import columnar, stream_store

SCHEMA = "document_id string, mesh_id long, positions array<double>, indices array<int>, normals array<float>, classes array<tinyint>, raw binary"


def rows():
    out = [(f"d{k % 5}", k, [k + 0.5] * (3 * (k % 7)), list(range(k % 4)), None if k % 3 else [0.25, -1.0], [1, -1, 127], bytes(range(k % 9))) for k in range(200)]
    return out + [("d9", 900, None, None, None, None, None), (None, 901, [1e300] * 40_000, [], [], [], b"")]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('streams')}/s"
    stream_store.write(spark.createDataFrame(rows(), SCHEMA).repartitionByRange(4, "document_id", "mesh_id").sortWithinPartitions("document_id", "mesh_id"), at)
    return at


def plain(found):
    return sorted(((r.document_id, r.mesh_id, r.positions, r.indices, r.normals, r.classes, None if r.raw is None else bytes(r.raw)) for r in found), key=str)


@pytest.mark.parametrize("held,gap", [(32 << 20, 64 << 10), (100, 0)])
def test_round_trip(spark, store, monkeypatch, held, gap):  # S07, S11
    monkeypatch.setattr(stream_store, "HELD", held)
    monkeypatch.setattr(stream_store, "GAP", gap)
    assert plain(stream_store.read(spark, store, SCHEMA).collect()) == sorted(rows(), key=str)


def test_only_wanted_streams_are_fetched(spark, store):
    def fetched(schema, *filters):
        reader = stream_store.StreamReader(store, StructType.fromDDL(schema), True)
        assert list(reader.pushFilters(list(filters))) == []
        found = [b for g in reader.partitions() for b in reader.read(g)]
        return reader.fetched, sum(b.num_rows for b in found), len(reader.partitions())

    everything, n, groups = fetched(SCHEMA)
    assert n == len(rows()) and everything > 320_000
    small, n, _ = fetched("mesh_id long, indices array<int>")
    assert n == len(rows()) and small < everything / 3
    own, n, fewer = fetched(SCHEMA, EqualTo(("document_id",), "d1"))
    assert n == 40 and own < everything / 10 and fewer < groups
    _, n, fewer = fetched("mesh_id long", In(("document_id",), ("d0", "d4")), GreaterThanOrEqual(("mesh_id",), 100))
    assert n == 40 and fewer <= groups
    assert fetched("mesh_id long", EqualTo(("document_id",), "zz"))[:2] == (0, 0)
    back = stream_store.read(spark, store, "document_id string, mesh_id long, indices array<int>").where((F.col("document_id") == "d2") & (F.col("mesh_id") <= 50))
    assert sorted((r.mesh_id, r.indices) for r in back.collect()) == [(k, list(range(k % 4))) for k in range(2, 51, 5)]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "= d2" not in plan and "<= 50" not in plan  # both are the store's work


def test_faults(spark, tmp_path):
    at = f"{tmp_path}/s"
    stream_store.write(spark.createDataFrame([(k, [1.0, 2.0, 3.0]) for k in range(5)], "mesh_id long, positions array<double>").coalesce(1), f"file://{at}")
    index = next(tmp_path.glob("s/*.parquet"))
    table = pq.read_table(index).to_pylist()
    for row, change in zip(table, ({"encoding": "f32le"}, {"bytes": 23}, {"elements": 4}, {"at": 1 << 30}, {})):
        row["positions"] |= change
    schema = pq.read_schema(index)
    pq.write_table(pa.Table.from_pylist(table, schema), index)
    got = {r.mesh_id: (r.positions, r.problem) for r in stream_store.read(spark, f"file://{at}", "mesh_id long, positions array<double>, problem string", strict=False).collect()}
    assert got == {0: (None, "encoding"), 1: (None, "alignment"), 2: (None, "elements"), 3: (None, "range"), 4: ([1.0, 2.0, 3.0], None)}
    with pytest.raises(Exception, match="encoding"):
        stream_store.read(spark, f"file://{at}", "mesh_id long, positions array<double>").collect()
    with pytest.raises(Exception, match="no column"):
        stream_store.read(spark, f"file://{at}", "other long").collect()


def test_empty_store(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    stream_store.write(spark.createDataFrame([], SCHEMA), at)
    assert stream_store.read(spark, at, SCHEMA).count() == 0


def test_heaps(spark, monkeypatch):  # S12
    monkeypatch.setattr(columnar, "BLOCK", 4)
    values = [("a", i, "é" * (i % 3) + str(i)) for i in range(11)] + [("b", 0, "")]
    made = columnar.heaps(spark.createDataFrame(values, "doc string, value_id long, value string")).cache()
    assert sorted((r.doc, r.block, len(r.offsets)) for r in made.collect()) == [("a", 0, 5), ("a", 1, 5), ("a", 2, 4), ("b", 0, 2)]
    heap = made.select(F.struct("doc", "block").alias("doc"), "heap", "offsets")
    back = columnar.sliced(heap.select("doc", "heap"), heap.select("doc", "offsets")).select("doc.doc", F.col("doc.block") * 4 + F.col("value_id"), "value")
    assert sorted(map(tuple, back.collect())) == values
