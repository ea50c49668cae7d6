"""The byte census of JSON texts, and ids over several relations."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from girder.operators import validation
from girder.sources import json_bytes

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=20)


def plain(value, path="$"):
    """The same from the parsed value, for texts without spaces."""
    size = lambda x: len(json.dumps(x, ensure_ascii=False).encode())
    out = {}

    def add(key, n):
        out[key] = out.get(key, 0) + n

    if isinstance(value, dict):
        add((path, "punctuation"), 2 + 2 * len(value) - bool(value))
        for k, v in value.items():
            name = f"{path}.{json.dumps(k, ensure_ascii=False)[1:-1]}"
            add((name, "key"), size(k))
            for key, n in plain(v, name).items():
                add(key, n)
    elif isinstance(value, list):
        add((path, "punctuation"), 2 + len(value) - bool(value))
        for v in value:
            for key, n in plain(v, path + "[]").items():
                add(key, n)
    else:
        add((path, "value"), size(value))
    return out


@given(VALUES)
@settings(max_examples=200, deadline=None)
def test_parts(value):
    text = json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()
    assert {k: n for k, (n, _) in json_bytes.parts(text).items()} == plain(value)
    for indent in (None, 2):
        wide = json.dumps(value, ensure_ascii=indent is None, indent=indent).encode()
        assert sum(n for n, _ in json_bytes.parts(wide).values()) == len(wide)


@given(st.text('{}[],:"a1 ntrue\\', max_size=12))
@settings(max_examples=300, deadline=None)
def test_what_is_no_document(text):
    try:
        json.loads(text)
        good = True
    except ValueError:
        good = False
    assert (json_bytes.parts(text.encode()) is not None) == good or "\\" in text


def test_census(spark):
    rows = [("a", '{"k": [1, 2.5, null], "s": "x\\"y"}'), ("a", '{"k": []}'), ("b", "{"), ("b", None), (None, "7"), ("b", "")]
    got = {(r.owner, r.path, r.kind): (r.bytes, r.tokens) for r in json_bytes.census(spark.createDataFrame(rows, "owner string, text string"), "text", "owner").collect()}
    assert got == {
        ("a", "$", "punctuation"): (8, 8), ("a", "$", "space"): (4, 4), ("a", "$.k", "key"): (6, 2), ("a", "$.k", "punctuation"): (6, 6), ("a", "$.k", "space"): (2, 2), ("a", "$.k[]", "value"): (8, 3),
        ("a", "$.s", "key"): (3, 1), ("a", "$.s", "value"): (6, 1), ("b", "", "unreadable"): (1, 2), (None, "$", "value"): (1, 1),
    }


@pytest.mark.parametrize("order", [("nodes", "parts"), ("parts", "nodes")])
def test_the_first_declaration_wins(spark, order):
    tables = {"nodes": [(2, "b"), (1, "a"), (3, "a"), (4, None)], "parts": [(1, "a"), (2, "c"), (3, "b")]}
    relations = [(name, spark.createDataFrame(tables[name], "n int, id string"), "id", ["n"]) for name in order]
    got = {(r.path, r.message.rsplit(" ", 1)[-1]) for r in validation.repeated_declarations(relations).collect()}
    assert got == ({("nodes[2].id", "nodes[0].id"), ("parts[0].id", "nodes[0].id"), ("parts[2].id", "nodes[1].id")} if order[0] == "nodes" else {("nodes[0].id", "parts[0].id"), ("nodes[1].id", "parts[2].id"), ("nodes[2].id", "parts[0].id")})
