"""Parquet evidence: what footers tell, what is read beside them, and files that are no Parquet files."""

import pyarrow as pa
import pyarrow.parquet as pq

from girder.sources import parquet_footers


def write(folder, name, table, **options):
    folder.mkdir(exist_ok=True)
    pq.write_table(table, folder / name, **options)


def table(ids, texts, versions):
    return pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "version": pa.array(versions, pa.string()), "tags": [[str(i), None] for i in range(len(ids))]})


def test_footers(spark, tmp_path):
    many = list(range(20_000))
    write(tmp_path / "a", "1.parquet", table(many, ["t" * 50 + str(i) if i % 10 else None for i in many], ["v1"] * len(many)), row_group_size=5000)
    write(tmp_path / "a", "2.parquet", table([1], ["x"], ["v2"]), write_statistics=False)
    (tmp_path / "a" / "short.parquet").write_bytes(b"PAR1")
    (tmp_path / "a" / "none.parquet").write_bytes(b"")
    (tmp_path / "a" / "_SUCCESS").write_bytes(b"")
    (tmp_path / "a" / "other.parquet").write_bytes(b"PK" + b"0" * 100)
    (tmp_path / "a" / "broken.parquet").write_bytes(b"PAR1" + b"0" * 100 + (20).to_bytes(4, "little") + b"PAR1")
    (tmp_path / "a" / "cut.parquet").write_bytes(b"PAR1" + b"0" * 100 + (2000).to_bytes(4, "little") + b"PAR1")
    rows = parquet_footers.footers(spark, f"file://{tmp_path}/a").collect()
    of = lambda name: [r for r in rows if r.path.endswith(f"/{name}.parquet")]
    assert {r.column: (r.rows, r.row_groups, r.nulls, r.only) for r in of("1")} == {"id": (20_000, 4, 0, None), "text": (20_000, 4, 2000, None), "version": (20_000, 4, 0, "v1"), "tags": (20_000, 4, None, None)}
    assert all(r.fetched < r.bytes / 10 for r in of("1"))
    assert {(r.column, r.nulls, r.only) for r in of("2")} == {("id", None, None), ("text", None, None), ("version", None, None), ("tags", None, None)}
    assert {n: [r.problem for r in of(n)] for n in ("short", "none", "other", "broken", "cut")} == {"none": ["short"], "short": ["short"], "other": ["magic"], "broken": ["footer"], "cut": ["footer"]}


def one(spark, path, payload="text", single=("version",)):
    return parquet_footers.evidence(spark, f"file://{path}", payload, "id", single)


def test_evidence_reads_what_footers_leave_open(spark, tmp_path):
    write(tmp_path / "a", "1.parquet", table([1, 2, 3], ["x", "y", None], ["v1"] * 3))
    write(tmp_path / "a", "2.parquet", table([3, 4], ["x", "y"], ["v1", "v1"]))
    df = one(spark, tmp_path / "a")
    r = df.first()
    assert (r.files, r.rows, r.row_groups, r.columns, r.payloads, r.identities, r.unique_identities, r.generators, r.problem) == (2, 5, 2, "id,tags,text,version", 4, 5, 4, {"version": True}, "payload")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    write(tmp_path / "b", "1.parquet", table([1, 2], ["x", "y"], ["v1", "v1"]), write_statistics=False)
    write(tmp_path / "b", "2.parquet", table([3], ["x"], ["v2"]))
    r = one(spark, tmp_path / "b").first()
    assert (r.payloads, r.unique_identities, r.generators, r.problem) == (3, 3, {"version": False}, "version")
    r = one(spark, tmp_path / "b", "tags", ()).first()  # a nested payload
    assert (r.payloads, r.generators, r.problem) == (3, {}, None)
    write(tmp_path / "c", "1.parquet", table([1, 1], ["x", "y"], ["v1", None]))
    assert one(spark, tmp_path / "c").first().problem == "identity"
    write(tmp_path / "c", "1.parquet", table([1, 2], ["x", "y"], ["v1", None]))
    assert one(spark, tmp_path / "c").first().problem == "version"  # one value, but not in every row


def test_evidence_of_odd_folders(spark, tmp_path):
    write(tmp_path / "a", "1.parquet", table([], [], []))
    r = one(spark, tmp_path / "a").first()
    assert (r.rows, r.payloads, r.unique_identities, r.generators, r.problem) == (0, 0, 0, {"version": False}, "version")
    write(tmp_path / "a", "2.parquet", table([1], ["x"], ["v"]))
    assert one(spark, tmp_path / "a").first().problem is None
    write(tmp_path / "a", "3.parquet", pa.table({"id": [1]}))
    assert one(spark, tmp_path / "a").first().problem == "columns"
    (tmp_path / "a" / "4.parquet").write_bytes(b"PK" + b"0" * 100)
    assert one(spark, tmp_path / "a").first().problem == "magic"
    write(tmp_path / "d", "1.parquet", table([1], ["x"], ["v"]))
    assert one(spark, tmp_path / "d", "absent").first().problem == "columns"
