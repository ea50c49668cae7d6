"""Exchange files on disk: written in order, inspected by streams, scanned by splits."""

import hashlib

import pyarrow as pa

from girder.sources import part21


def test_files_stream(spark, tmp_path):
    big = b"\n ISO-10303-21;" + b" " * part21.HEADER_BYTES + b"FILE_SCHEMA(('IFC4'));" + b"#1=IFCWALL();\n" * 400_000
    texts = {"a b+c%.ifc": b"ISO-10303-21;FILE_SCHEMA(('IFC4'));\n#7=IFCWALL();\n#9 = ( IfcDoor ();\n#x=\n", "big.IFC": big, "empty.ifc": b"", "c.ifc.gz": b"no archive"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    found = {r.name: r for r in part21.inspect_ifc(spark, f"file://{tmp_path}").collect()}
    assert {n: (r.byte_length, r.sha256) for n, r in found.items()} == {n: (len(t), hashlib.sha256(t).hexdigest()) for n, t in texts.items()}
    assert {n: (r.schema, r.problem) for n, r in found.items()} == {"a b+c%.ifc": ("IFC4", None), "big.IFC": (None, "undeclared"), "empty.ifc": (None, "magic"), "c.ifc.gz": (None, "extension")}
    (tmp_path / "c.ifc.gz").unlink()
    scanned = {r.name: tuple(r)[1:] for r in part21.census(spark, f"file://{tmp_path}").collect()}
    assert scanned == {"a b+c%.ifc": (4, 2, 2, 9), "big.IFC": (400_001, 399_999, 1, 1)}


def test_written_files(spark, tmp_path):
    lines = [("a.ifc", i, f"#{i}=X();") for i in (3, 1, 2)] + [("b.ifc", 1, None), ("b.ifc", 0, "é"), (None, 1, "lost")]
    folder = f"file://{tmp_path}/out"
    got = part21.write_files(spark.createDataFrame(lines, "name string, place long, value string").repartition(3), folder).collect()
    assert {(r.name, r.byte_length) for r in got} == {("a.ifc", 24), ("b.ifc", 4)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.ifc", "b.ifc"]
    assert (tmp_path / "out/a.ifc").read_text() == "#1=X();\n#2=X();\n#3=X();\n" and (tmp_path / "out/b.ifc").read_text() == "é\n\n"
    assert part21.write_files(spark.createDataFrame([], "name string, place long, value string"), folder).collect() == []


def test_lines_by_splits(spark, tmp_path, monkeypatch):  # each line once wherever splits fall; the driver lists no files
    text = b"ab\r\nc\r\r\n\n" + "é".encode() + b"\nlast"
    (tmp_path / "a").write_bytes(text)
    with pa.OSFile(str(tmp_path / "a")) as f:
        for n in range(1, len(text) + 2):
            got = [line for k in range(0, len(text), n) for line in part21._own_lines(f, k, k + n, len(text))]
            assert got == [b"ab", b"c", b"", b"", "é".encode(), b"last"], n
    census = part21.census(spark, f"file://{tmp_path}")
    assert "FileScan text" not in census._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in census.collect()] == [("a", 6, 0, 0, None)]
