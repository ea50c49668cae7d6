"""Conversation structure repair by shortest paths.

A conversation is well formed if its role initials read `(s?(ua)+)?`. Edits: keep a row (0), give it the role user or
assistant (3), delete it (4; blank and repeated rows must go), insert an empty user or assistant row anywhere (3); a
truncated row that stays costs 3 more. The cheapest edits are a shortest path through the nodes (rows read, what the output
ends with), of which there are four a row, over arcs of small integer costs. Dial's bucket queue gives every node its
distance to the end; a walk from the start that always takes the tight arc with the least letter (D, I, K, R) gives the
ASCII-least of the cheapest edits. From a node each letter has one arc, so the letters determine the repaired rows.

Rows are sorted by (conv_id, turn, role, text) in ranges and numbered. The paths read one letter a row, in segments of
`SEGMENT` rows. A conversation of one segment is solved at once. A longer one is cut: each segment gives its costs between
the nodes at its two ends, those tables (16 numbers a segment) are added up from the end of the conversation, and each
segment is then solved by itself against the distances at its end, so that no task holds a conversation. What remains is one
stream of the sorted rows, which follows the arcs, hashes the repaired rows as they pass and holds one letter a row, as the
audit is one value of the result. Only that last stream takes a conversation in one task, as its digest is defined over the
whole; it holds no rows.

Nulls and edge cases: a null role or text is one space; a null turn sorts first and has no part in the gaps; a null conv_id
is one conversation; rows that repeat (with the same turn) stand side by side and the later ones are duplicates; rows of one
turn are taken by role, then text; a role is known by its first character, as it stands; an empty role has none; a very long
text is one row of a batch; a conversation without rows has zeros, an empty audit and the digest of the empty string; an empty
table gives an empty result; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import save

SEGMENT = 4096  # rows of one search
NONE = 1 << 40  # no path

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # what the output ends with; it may end at START and ASSISTANT
TAKES = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]  # by state: role initial -> next state
ADDS = [USER, USER, ASSISTANT, USER]  # by state: the role that may be made there
NAMES = {USER: "user", ASSISTANT: "assistant"}
AT_END = [0, 2 * INSERT, INSERT, 0]  # by state: cost of the rows inserted after the last
GOAL = tuple(AT_END)



def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of `conv_id:turn`."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), (F.crc32(key) % 20).alias("harm"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("harm") == 3, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


# ---- paths over the letters of a segment ------------------------------------------------------------------------
# A letter a row: s, u, a or x (any other initial) where the row may stay, in capitals if it is truncated; b where it is blank
# and d where it repeats an earlier one.


def arcs(letter: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the arcs that read a row."""
    out = [("D", DELETE, state)]
    if letter not in "bd":
        more = TRUNCATED if letter.isupper() else 0
        to = TAKES[state].get(letter.lower())
        if to is not None:
            out.append(("K", KEEP + more, to))
        out.append(("R", REROLE + more, ADDS[state]))
    return out


def distances(letters: str, ends: tuple[int, ...]) -> list[int]:
    """The cost from each node (4 * row + state) to the end, where the nodes after the last row begin with `ends`: Dial's
    queue, a bucket for each cost, as no arc costs more than REROLE + TRUNCATED."""
    into: list[list[tuple[int, int]]] = [[] for _ in range(4)]  # by state: (state before, cost) of insertions
    for state, to in enumerate(ADDS):
        into[to].append((state, INSERT))
    back = {x: [[] for _ in range(4)] for x in set(letters)}  # by letter and state after: (state before, cost)
    for x, lists in back.items():
        for state in range(4):
            for _, cost, to in arcs(x, state):
                lists[to].append((state, cost))
    base = min(ends)
    far = [NONE] * (4 * len(letters) + 4)
    buckets: list[list[int]] = [[]]
    done = bytearray(len(far))

    def reach(node: int, cost: int) -> None:
        if cost < far[node]:
            far[node] = cost
            while len(buckets) <= cost - base:
                buckets.append([])
            buckets[cost - base].append(node)

    for state, cost in enumerate(ends):
        if cost < NONE:
            reach(4 * len(letters) + state, cost)
    at = 0
    while at < len(buckets):
        for node in buckets[at]:  # grows while arcs of no cost are followed
            if done[node]:
                continue
            done[node] = 1
            row, state = divmod(node, 4)
            for before, cost in into[state]:
                reach(4 * row + before, far[node] + cost)
            if row:
                for before, cost in back[letters[row - 1]][state]:
                    reach(4 * row - 4 + before, far[node] + cost)
        buckets[at] = []
        at += 1
    return far


@lru_cache(1 << 14)
def crossing(letters: str) -> tuple[int, ...]:
    """The cost from each state before the segment to each after it, row by row, as 16 numbers."""
    by_end = [distances(letters, tuple(0 if r == q else NONE for r in range(4))) for q in range(4)]
    return tuple(by_end[r][q] for q in range(4) for r in range(4))


@lru_cache(1 << 14)
def plan(letters: str, ends: tuple[int, ...]) -> str:
    """Four letters a row, one for each state before it: how many rows the walk inserts there and what it does with the row."""
    far = distances(letters, ends)
    out = []
    for row, letter in enumerate(letters):
        for state in range(4):
            added, at = 0, state
            while True:
                here = far[4 * row + at]
                tight = sorted(e for e, cost, to in arcs(letter, at) if cost + far[4 * row + 4 + to] == here)
                adds = INSERT + far[4 * row + ADDS[at]] == here
                if here >= NONE or not tight and not adds:
                    out.append("-")  # no path comes here
                    break
                if adds and (not tight or "I" < tight[0]):
                    added, at = added + 1, ADDS[at]
                    continue
                out.append(chr(ord("a") + 3 * added + "DKR".index(tight[0])))
                break
    return "".join(out)


def kind() -> Column:
    """The letter of a row, but for d."""
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     ")), -1, 1)
    return F.when(last == "", "b").when(last.isin(".", "!", "?"), known).otherwise(F.upper(known))


PLANS = "conv_id long, segment long, first long, letters string, plan string"


def _map(frame: DataFrame, schema: str, f) -> DataFrame:  # noqa: ANN001
    """A row for each row of a small table, by a function of its values."""
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f(*row) for row in zip(*[batch.column(c).to_pylist() for c in names])]
            if made:
                types = [{"long": pa.int64(), "string": pa.string()}.get(x.split()[1], pa.list_(pa.int64())) for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types)], names=[x.split()[0] for x in schema.split(", ")])

    return frame.mapInArrow(run, schema)


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, first, letters, plan) from rows(conv_id, id, letter)."""
    numbered = rows.select("conv_id", "id", "letter", F.expr(f"id DIV {SEGMENT}").alias("segment"))  # within a task's numbers, as they are 2**33 apart
    letters = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("id", "letter"))), lambda x: x["letter"]))
    segments, _ = save(numbered.groupBy("conv_id", "segment").agg(F.min("id").alias("first"), letters.alias("letters")), "op13-segments")
    long = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id")
    key = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    short = segments.join(long, key(segments, long), "left_anti")
    solved = _map(short, PLANS, lambda c, s, f, x: (c, s, f, x, plan(x, GOAL)))
    if not long.head(1):
        return solved
    cut = segments.join(long, key(segments, long), "left_semi")
    tables = _map(cut.select("conv_id", "segment", "letters"), "conv_id long, segment long, costs array<long>", lambda c, s, x: (c, s, list(crossing(x))))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distances at each segment's end, from a conversation's last segment to its first."""
        before, ends, seen = None, GOAL, False
        for batch in batches:
            made = []
            for conv, segment, costs in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if not seen or conv != before:
                    before, ends, seen = conv, GOAL, True
                made.append((conv, segment, list(ends)))
                ends = tuple(min(NONE, *(costs[4 * q + r] + ends[r] for r in range(4))) for q in range(4))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["conv_id", "segment", "ends"])

    ends = tables.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment")).mapInArrow(sweep, "conv_id long, segment long, ends array<long>")
    met = cut.join(ends.withColumnsRenamed({"conv_id": "c", "segment": "s"}), cut["conv_id"].eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    parts = _map(met.select("conv_id", "segment", "first", "letters", "ends"), PLANS, lambda c, s, f, x, e: (c, s, f, x, plan(x, tuple(e))))
    return solved.union(parts)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long, n_repaired long"
RESULT_TYPES = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int64()] * 2
REPAIRED = "conv_id long, position long, edit string, role string, text string"
REPAIRED_TYPES = [pa.int64()] * 2 + [pa.string()] * 3


class _Repair:
    """One conversation as its rows pass; `kept` collects (conv_id, position, edit, role, text) of the repaired rows, if given."""

    def __init__(self, conv: int | None, kept: list | None):
        self.conv, self.kept, self.rows, self.out = conv, kept, 0, 0
        self.lowest = self.highest = None
        self.turns = self.blank = self.again = self.cut = self.illegal = self.cost = 0
        self.audit, self.hash, self.state, self.before = bytearray(), hashlib.sha256(), START, None
        self.letters = self.plan = ""
        self.first = 0

    def _emit(self, role: str, text: str, edit: str) -> None:
        self.hash.update((b"\n" if self.out else b"") + role.encode() + b":" + text.encode())
        if self.kept is not None:
            self.kept.append((self.conv, self.out, edit, role, text))
        self.out += 1

    def _insert(self) -> None:
        self.state = ADDS[self.state]
        self.audit += b"I"
        self.cost += INSERT
        self._emit(NAMES[self.state], "", "I")

    def row(self, place: int, turn: int | None, role: str, text: str) -> None:
        self.rows += 1
        if turn is not None and turn != self.highest:  # turns ascend
            self.turns += 1
            self.lowest, self.highest = turn if self.lowest is None else self.lowest, turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        letter = self.letters[place - self.first]
        truncated = letter.isupper()
        self.blank, self.again, self.cut = self.blank + (letter == "b"), self.again + (letter == "d"), self.cut + truncated
        added, edit = divmod(ord(self.plan[4 * (place - self.first) + self.state]) - ord("a"), 3)
        for _ in range(added):
            self._insert()
        edit = "DKR"[edit]
        self.audit += edit.encode()
        if edit == "D":
            self.cost += DELETE
            return
        if edit == "R":
            self.state = ADDS[self.state]
            role = NAMES[self.state]
        else:
            self.state = TAKES[self.state][initial]
        self.cost += (edit == "R") * REROLE + truncated * TRUNCATED
        self._emit(role, text, edit)

    def end(self) -> tuple:
        while AT_END[self.state]:
            self._insert()
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.turns
        return (self.conv, gaps, self.blank, self.again, self.cut, self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest(), self.rows, self.out)


def _stream(conversations: DataFrame) -> DataFrame:
    """What the last pass reads, by conversation: a row for every original conv_id, then before each segment its letters and its
    plan, then its rows."""
    conv, turn = F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    # rows that are equal in every column may stand in any order, so their places in the input deal them out over the ranges
    rows = damaged(conversations).withColumns({"same": same, "salt": F.monotonically_increasing_id()})
    ranges = rows.repartitionByRange(conv, turn, "role", "text", "salt").sortWithinPartitions(conv, turn, "role", "text", "salt")
    placed, _ = save(ranges.drop("salt").withColumn("id", F.monotonically_increasing_id()), "op13-rows")
    firsts = placed.groupBy("conv_id", "same").agg(F.min("id").alias("first")).select("first")
    # places are unique, so this join has no hot key however often a text repeats
    marked = placed.select("conv_id", "id", kind().alias("kind")).join(firsts, F.col("id") == F.col("first"), "left")
    letters, _ = save(marked.select("conv_id", "id", F.when((F.col("kind") != "b") & F.col("first").isNull(), "d").otherwise(F.col("kind")).alias("letter")), "op13-letters")
    wanted = {"id": "long", "tag": "int", "turn": "long", "role": "string", "text": "string", "plan": "string"}

    def shape(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select("conv_id", *[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in wanted.items()])

    ids = shape(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), id=F.lit(-1), tag=F.lit(0))
    steps = shape(plans(letters), id=F.col("first"), tag=F.lit(1), text=F.col("letters"), plan=F.col("plan"))
    texts = shape(placed, id=F.col("id"), tag=F.lit(2), turn=F.col("turn"), role=F.col("role"), text=F.col("text"))
    return ids.union(steps).union(texts).repartition("conv_id").sortWithinPartitions(conv, "id", "tag")


def _follow(stream: DataFrame, schema: str, rows_wanted: bool) -> DataFrame:
    types = REPAIRED_TYPES if rows_wanted else RESULT_TYPES
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repair | None = None
        made: list[tuple] = []

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), types)], names=names)
            made.clear()
            return out

        for batch in batches:
            for conv, place, tag, turn, role, text, plan_ in zip(*[batch.column(i).to_pylist() for i in range(7)]):
                if tag == 0:
                    if now is not None and (ended := now.end()) and not rows_wanted:
                        made.append(ended)
                    now = _Repair(conv, made if rows_wanted else None)
                elif tag == 1:
                    now.first, now.letters, now.plan = place, text, plan_
                else:
                    now.row(place, turn, role, text)
            if made:
                yield given()
        if now is not None:
            ended = now.end()
            if not rows_wanted:
                made.append(ended)
            if made:
                yield given()

    return stream.mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """A row for every original conv_id: what was wrong, the cheapest edits and the digest of the repaired rows."""
    return _follow(_stream(conversations), RESULT, False)


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """The repaired rows themselves with the edit that each comes from; `position` counts from 0 in a conversation."""
    return _follow(_stream(conversations), REPAIRED, True)


def _oracle() -> str:
    """The same by recursion over the rows from the last to the first: the least (cost, audit) from each state."""
    least = lambda *options: f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"
    made = lambda source, state, cost, edit, line: f"{{'c': {cost} + {source}[{state + 1}].c, 'a': '{edit}' || {source}[{state + 1}].a, 't': {f'list_prepend({line}, {source}[{state + 1}].t)' if line else f'{source}[{state + 1}].t'}}}"

    def reads(state: int) -> str:
        takes = " ".join(f"WHEN '{i}' THEN {made('f', to, 'more', 'K', "role || ':' || text")}" for i, to in TAKES[state].items())
        to = ADDS[state]
        keep, rerole = f"CASE WHEN NOT gone THEN CASE initial {takes} END END", f"CASE WHEN NOT gone THEN {made('f', to, f'{REROLE} + more', 'R', f"'{NAMES[to]}:' || text")} END"
        return least(made("f", state, DELETE, "D", None), keep, rerole)

    inserts = lambda source: "[" + ", ".join(least(f"{source}[{q + 1}]", made(source, ADDS[q], INSERT, "I", f"'{NAMES[ADDS[q]]}:'")) for q in range(4)) + "]"
    empty = "{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    end = f"[{empty}, {{'c': {2 * INSERT}::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}}, {{'c': {INSERT}::BIGINT, 'a': 'I', 't': ['assistant:']}}, {empty}]"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS harm FROM conversations, crc
), rows_ AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, LATERAL (SELECT unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows_
), seen AS (
  SELECT *, substr(role, 1, 1) AS initial, regexp_extract(text, '([^ \x09-\x0D])[ \x09-\x0D]*$', 1) AS last,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed
), known AS (
  SELECT *, last = '' AS blank, last <> '' AND again AS duplicate, last NOT IN ('', '.', '!', '?') AND NOT again AS truncated, last = '' OR again AS gone,
    CASE WHEN last NOT IN ('', '.', '!', '?') AND NOT again THEN {TRUNCATED} ELSE 0 END AS more FROM seen
), totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM known GROUP BY conv_id
), walk AS (
  SELECT conv_id, n, {end} AS f FROM totals
  UNION ALL
  SELECT conv_id, n - 1, {inserts("g")} FROM (
    SELECT conv_id, n, {inserts("e")} AS g FROM (
      SELECT w.conv_id, w.n, [{", ".join(reads(q) for q in range(4))}] AS e FROM walk w JOIN known k ON w.conv_id IS NOT DISTINCT FROM k.conv_id AND w.n = k.n))
), best AS (SELECT conv_id, f[1] AS b FROM walk WHERE n = 0
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256,
  coalesce(t.n, 0)::BIGINT AS n_rows, coalesce(len(b.t), 0)::BIGINT AS n_repaired
FROM ids i LEFT JOIN totals t ON i.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN best ON i.conv_id IS NOT DISTINCT FROM best.conv_id"""


ORACLE = _oracle()
