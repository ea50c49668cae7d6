"""Greedy segmentation of ordered rows under a budget, in parallel.

A group takes the next row while it follows without a gap and the bytes fit; where a group ends depends on where it began, and so on
all rows before. Rows are dealt by ranges of their order. How a range leaves off is a step function of the bytes that the group
before it has room for, with a step for each row that may be the first not to fit; each range finds its steps by itself, by
searches on sums of sizes and doubled pointers. One pass over the steps, range by range, tells how each range begins, and a
second pass over the rows numbers the groups.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.tables import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package on their path


class _Rows:
    """Sums and borders of some rows in order. `borders` are rows that begin a group whatever came before, but for row 0."""

    def __init__(self, owner: pa.Array, offset: pa.Array, length: pa.Array, budget: int):
        self.n, self.budget = len(owner), budget
        known = np.asarray(pc.and_(offset.is_valid(), length.is_valid()).to_numpy(zero_copy_only=False), bool)
        self.at = pc.fill_null(offset, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.known, self.end = known, self.at + size
        self.sums = np.concatenate([[0], np.cumsum(size)])
        codes = owner.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        self.other = np.flatnonzero(codes[1:] != codes[:-1]) + 1  # another owner's first rows
        gap = (codes[1:] != codes[:-1]) | (self.at[1:] != self.end[:-1]) | ~known[1:] | ~known[:-1]
        self.borders = np.flatnonzero(gap) + 1

    def following(self) -> np.ndarray:
        """For each row the next group's first row, were this row a group's first; n behind the last row."""
        rows = np.arange(self.n)
        full = np.searchsorted(self.sums[1:], self.sums[:-1] + self.budget, "right")
        stop = np.append(self.borders, self.n)[np.searchsorted(self.borders, rows, "right")]
        return np.minimum(np.maximum(full, rows + 1), stop)

    def first_break(self, room: int | None) -> int:
        """The first row that begins a group, if the open group has room for so many bytes; None: no group is open."""
        if room is None:
            return 0
        stop = self.borders[0] if len(self.borders) else self.n
        return int(min(np.searchsorted(self.sums[1:], room, "right"), stop))

    def numbers(self, room: int | None, groups: int) -> tuple[np.ndarray, int]:
        """Each row's group, numbered by owner after `groups` of the first one, and the first row of the last group, -1 if it is
        the open one."""
        starts = np.zeros(self.n + 1, bool)
        starts[self.borders] = True
        follow, front = self.following(), np.append(self.borders, self.first_break(room))
        while len(front := front[front < self.n]):
            starts[front] = True
            front = follow[front]
            front = front[~starts[front]]
        starts = starts[:-1]
        count = np.cumsum(starts)
        base = np.zeros(self.n, np.int64)
        base[self.other] = np.diff(np.append(0, count[self.other] - 1))
        number = count - np.cumsum(base)
        number[: self.other[0] if len(self.other) else self.n] += groups
        found = np.flatnonzero(starts)
        return number, int(found[-1]) if len(found) else -1

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(room below which a step holds, first row of the last group, groups that the last owner begins): the first step is also
        that of rows which continue nothing, the last has no bound, and its row is n where the open group takes all."""
        follow = np.append(self.following(), self.n)
        last, hops = np.arange(self.n + 1), np.ones(self.n + 1, np.int64)
        hops[self.n] = 0
        to = follow
        while (to < self.n).any():
            hops = hops + hops[to]
            last = np.where(to < self.n, last[to], last)
            to = to[to]
        stop = int(self.borders[0]) if len(self.borders) else self.n
        rows = np.arange(min(stop, int(np.searchsorted(self.sums[:-1], self.budget, "right"))))
        rows = np.append(rows, stop)
        end, groups = last[rows], hops[rows]
        if len(self.other):  # groups of the first owner are of no use behind it
            groups = np.full(len(rows), hops[self.other[-1]])
        upto = self.sums[1:][np.minimum(rows, self.n - 1)]
        first = np.append(True, upto[1:] > upto[:-1])  # rows without bytes are never the first that do not fit
        first[-1] = True
        upto, end, groups = upto[first], end[first], groups[first]
        keep = np.append((end[1:] != end[:-1]) | (groups[1:] != groups[:-1]), True)
        return upto[keep], end[keep], groups[keep]


def _by_part(work: Callable[[int, pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """work(part, its rows) for batches sorted by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if held and a < b and held[0].column("part")[0].as_py() != parts[a]:
                    yield from work(held[0].column("part")[0].as_py(), pa.Table.from_batches(held))
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from work(held[0].column("part")[0].as_py(), pa.Table.from_batches(held))

    return run


def coalesce_ranges(ranges: DataFrame, by: str, budget: int) -> DataFrame:
    """Adds `group`, from 0 in each owner: neighbours in order of byte_offset share one while there is no gap or overlap and their
    bytes fit the budget; a larger member stands alone (W05). Rows of one offset come by length. A row without an offset or a
    length stands alone; rows without an owner are one owner's. A column `group` of the input is replaced.
    Lengths are not negative.

    An owner of any size is spread over all tasks. A task holds the offsets and lengths of its range; steps, at most one for each
    row in a range's first `budget` bytes and mostly far fewer, stream through one task that holds one group's end."""
    kept = [f"`{c}`" for c in ranges.columns if c.lower() != "group"]
    order = ["_owner", "_at", "_size"]
    keyed = ranges.select(F.struct(*kept).alias("row"), F.col(by).alias("_owner"), F.col("byte_offset").cast("long").alias("_at"), F.col("byte_length").cast("long").alias("_size"))
    dealt = cut(keyed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "segments")
    owner_type = dealt.schema["_owner"].dataType.simpleString()

    def steps_of(part: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        owner, at, size = (rows.column(c).combine_chunks() for c in order)
        r = _Rows(owner, at, size, budget)
        upto, end, groups = r.steps()
        n = len(end)
        passing = end == r.n
        opened = pa.array(r.at[np.minimum(end, r.n - 1)], pa.int64(), mask=passing)
        bound = pa.array(upto, pa.int64(), mask=np.arange(n) == n - 1)
        ends = int(r.end[-1]) if r.known[-1] else None
        begins = int(r.at[0]) if r.known[0] else None
        names = ["part", "upto", "open", "groups", "first_owner", "last_owner", "one", "begins", "ends"]
        repeat = lambda value, kind: pa.array([value] * n, kind)
        fixed = [repeat(owner[0].as_py(), owner.type), repeat(owner[-1].as_py(), owner.type), repeat(not len(r.other), pa.bool_()), repeat(begins, pa.int64()), repeat(ends, pa.int64())]
        yield pa.RecordBatch.from_arrays([repeat(part, pa.int32()), bound, opened, pa.array(groups, pa.int64()), *fixed], names)

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = opened = ended = None
        groups, state = 0, None
        part, joined, room, done = None, False, 0, False
        out: list[tuple] = []
        for batch in batches:
            for s in batch.to_pylist():
                if s["part"] != part:
                    if state is not None:
                        owner, opened, ended, groups = state
                    same = part is not None and s["first_owner"] == owner
                    joined = same and ended is not None and ended == s["begins"]
                    room = budget - (s["begins"] - opened) if joined else None
                    part, done, base = s["part"], False, groups if same else 0
                    out.append((part, room, base))
                if not done and (room is None or s["upto"] is None or room < s["upto"]):
                    done = True
                    through = s["open"] is None
                    state = (s["last_owner"], opened if through else s["open"], s["ends"], s["groups"] + (base if s["one"] else 0))
            yield pa.RecordBatch.from_pydict({"part": [o[0] for o in out], "room": [o[1] for o in out], "groups": [o[2] for o in out]}, pa.schema([("part", pa.int32()), ("room", pa.int64()), ("groups", pa.int64())]))
            out = []

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, opened, last = None, None, None
        for batch in batches:
            parts = batch.column("part").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                owner, at, size = (piece.column(c) for c in order)
                r = _Rows(owner, at, size, budget)
                if parts[a] != part:
                    part, room, groups = parts[a], piece.column("room")[0].as_py(), piece.column("groups")[0].as_py()
                    opened = r.at[0] + room - budget if room is not None else None
                else:
                    same = owner[0].as_py() == last[0]
                    joined = same and last[1] is not None and r.known[0] and last[1] == int(r.at[0])
                    room, groups = budget - (int(r.at[0]) - opened) if joined else None, last[2] if same else 0
                number, begun = r.numbers(room, groups)
                opened = int(r.at[begun]) if begun >= 0 else opened
                last = (owner[-1].as_py(), int(r.end[-1]) if r.known[-1] else None, int(number[-1]))
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(number - 1, pa.int64())], ["row", "group"])

    steps_ddl = f"part int, upto long, open long, groups long, first_owner {owner_type}, last_owner {owner_type}, one boolean, begins long, ends long"
    steps = dealt.select("part", *order).repartition("part").sortWithinPartitions("part", *order).mapInArrow(_by_part(steps_of), steps_ddl)
    entries = steps.repartition(1).sortWithinPartitions("part", F.col("upto").asc_nulls_last()).mapInArrow(entries_of, "part int, room long, groups long")
    placed = dealt.join(F.broadcast(entries), "part").repartition("part").sortWithinPartitions("part", *order)  # a row for each range
    row_type = dealt.schema["row"].dataType.simpleString()
    return placed.select("row", *order, "part", "room", "groups").mapInArrow(numbered, f"row {row_type}, `group` long").select("row.*", "group")
