"""Where the bytes of JSON texts go (A23): every byte belongs to a path, so the parts add up to the texts.

A path is `$` and, below it, `.key` or `[]` for each level. A scalar's bytes are its path's `value`; a member's key with its quotes is
the member's `key`; brackets, braces, commas and colons are the `punctuation` of their container, white space is its `space`
(outside all of them the root's). A text that is no balanced document is `unreadable` as a whole, on the path ''.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[ \t\r\n]+|[^\s{}\[\],:"]+', re.DOTALL)
_SCALAR = re.compile(rb'"(?:[^"\\\x00-\x1f]|\\.)*"|true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?', re.DOTALL)


def parts(text: bytes) -> dict[tuple[str, str], list[int]] | None:
    """(path, kind) -> [bytes, tokens]; None if the text is no document."""
    found: dict[tuple[str, str], list[int]] = {}

    def add(path: str, kind: str, n: int) -> None:
        own = found.setdefault((path, kind), [0, 0])
        own[0], own[1] = own[0] + n, own[1] + 1

    open_: list[tuple[str, bool]] = []  # path of each container, whether it is an object
    at, want, key = 0, "value", "$"  # what may come next: value, key, colon, comma (or an end), nothing
    empty = False  # whether the container has just begun
    for m in _TOKEN.finditer(text):
        token = m[0]
        if m.start() != at:
            return None
        at, first = m.end(), token[:1]
        here = open_[-1][0] if open_ else "$"
        if first in b" \t\r\n":
            add(here, "space", len(token))
            continue
        if first in b"{[" and want == "value":
            open_.append((key, first == b"{"))
            add(key, "punctuation", 1)
            want, empty = ("key" if first == b"{" else "value"), True
            key = key if first == b"{" else key + "[]"
            continue
        if first in b"}]" and open_ and open_[-1][1] == (first == b"}") and (want == "comma" or empty):
            add(here, "punctuation", 1)
            open_.pop()
            want, empty = ("comma" if open_ else "nothing"), False
            continue
        empty = False
        if first == b":" and want == "colon":
            add(here, "punctuation", 1)
            want = "value"
        elif first == b"," and want == "comma":
            add(here, "punctuation", 1)
            want, key = ("key", key) if open_[-1][1] else ("value", here + "[]")
        elif want == "key" and first == b'"' and _SCALAR.fullmatch(token):
            key = f"{here}.{token[1:-1].decode()}"
            add(key, "key", len(token))
            want = "colon"
        elif want == "value" and _SCALAR.fullmatch(token):
            add(key, "value", len(token))
            want = "comma" if open_ else "nothing"
        else:
            return None
    return found if want == "nothing" and at == len(text) else None


def census(texts: DataFrame, column: str, by: str) -> DataFrame:
    """by, path, kind, bytes and tokens; null texts have none. A task sums up what its batch holds before anything is shuffled."""
    kind_of = dict(texts.dtypes)[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, list[int]] = {}
            for owner, text in zip(b.column(by).to_pylist(), b.column(column).to_pylist()):
                if text is None:
                    continue
                raw = text.encode()
                found = parts(raw)
                for (path, kind), (n, tokens) in (found if found is not None else {("", "unreadable"): [len(raw), 1]}).items():
                    own = sums.setdefault((owner, path, kind), [0, 0])
                    own[0], own[1] = own[0] + n, own[1] + tokens
            keys = list(zip(*sums)) if sums else [[], [], []]
            values = list(zip(*sums.values())) if sums else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], b.column(by).type), *[pa.array(k, pa.string()) for k in keys[1:]], *[pa.array(v, pa.int64()) for v in values]], names=[by, "path", "kind", "bytes", "tokens"])

    each = texts.select(by, column).mapInArrow(run, f"`{by}` {kind_of}, path string, kind string, bytes long, tokens long")
    return each.groupBy(by, "path", "kind").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"))
