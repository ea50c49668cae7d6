"""Conversation repair: against enumeration of all edits, against SQL, and in cut conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from girder.llm import turn_repair
from girder.llm.queries import op13_conversation_repair

GOOD = re.compile("(s?(ua)+)?")


def all_edits(letters):
    """(cost, audit) of the cheapest edits, by trying them all with up to two insertions in each place."""
    best = None
    options = [["D"] if x in "bd" else ["D", "K", "Ru", "Ra"] for x in letters]
    gaps = ["", "u", "a", "ua", "au"]
    for edits in product(*options):
        for put in product(gaps, repeat=len(letters) + 1):
            out, audit, cost = put[0], "I" * len(put[0]), 3 * len(put[0])
            for x, e, p in zip(letters, edits, put[1:]):
                out += {"D": "", "K": x.lower()}.get(e, e[1:]) + p
                audit += e[0] + "I" * len(p)
                cost += {"D": 4, "K": 0}.get(e, 3) + (3 if x.isupper() and e != "D" else 0) + 3 * len(p)
            if (best is None or (cost, audit) < best) and GOOD.fullmatch(out):
                best = cost, audit
    return best


def walked(letters, ends_at=None):
    """(cost, audit) by the plan, or by plans of the parts before and after a cut."""
    parts, state, audit, cost = [letters] if ends_at is None else [letters[:ends_at], letters[ends_at:]], 0, "", 0
    goal = turn_repair.GOAL
    ends = [goal]
    for part in reversed(parts[1:]):
        costs = turn_repair.crossing(part)
        ends.append(tuple(min(costs[4 * q + r] + ends[-1][r] for r in range(4)) for q in range(4)))
    for part, end in zip(parts, reversed(ends)):
        plan = turn_repair.plan(part, end)
        for i, x in enumerate(part):
            added, edit = divmod(ord(plan[4 * i + state]) - 97, 3)
            for _ in range(added):
                state = turn_repair.ADDS[state]
            to = {e: (c, t) for e, c, t in turn_repair.arcs(x, state)}["DKR"[edit]]
            audit, cost, state = audit + "I" * added + "DKR"[edit], cost + 3 * added + to[0], to[1]
    return cost + goal[state], audit + "I" * (goal[state] // 3)


@given(st.text("suaxSUAXbd", max_size=3))
@settings(max_examples=60, deadline=None)
def test_the_walk_is_the_least_of_all_edits(letters):
    assert walked(letters) == all_edits(letters)


@given(st.text("suaxSUAXbd", max_size=40), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_a_cut_changes_nothing(letters, at):
    assert walked(letters) == walked(letters, min(at, len(letters)))


def plain(rows):
    """The contract by a program over (cost, audit, lines) of suffixes."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            convs[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        count, seen, marked = [0, 0, 0], set(), []
        for _, role, text in found:
            body = text.strip(" \t\n\x0b\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                count[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        takes, adds = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}], [2, 2, 3, 2]
        name = {2: "user", 3: "assistant"}
        add = lambda f: [min(f[q], (f[adds[q]][0] + 3, "I" + f[adds[q]][1], [name[adds[q]] + ":", *f[adds[q]][2]])) for q in range(4)]
        f = add(add([(0, "", []), (10**9, "", []), (10**9, "", []), (0, "", [])]))
        for role, text, fault in reversed(marked):
            e = []
            for q in range(4):
                options = [(f[q][0] + 4, "D" + f[q][1], f[q][2])]
                if fault not in (0, 1):
                    more = 3 if fault == 2 else 0
                    if (to := takes[q].get(role[:1])) is not None:
                        options.append((f[to][0] + more, "K" + f[to][1], [f"{role}:{text}", *f[to][2]]))
                    to = adds[q]
                    options.append((f[to][0] + 3 + more, "R" + f[to][1], [f"{name[to]}:{text}", *f[to][2]]))
                e.append(min(options))
            f = add(add(e))
        cost, audit, lines = f[0]
        yield conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def awkward():
    r = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "user", "a."), (2, 0, "", "x."), (3, 0, "tool", "é ß 🙂."), (4, 5, "user", " \t\n\x0b\f\r"), (5, -3, "assistant", "long " * 200_000), (6, 0, "system", "S.")]
    for conv in range(10, 90):
        for turn in range(r.randint(0, 12)):
            rows.append((conv, turn + 3 * (r.random() < 0.1), r.choice(["user", "assistant"] * 4 + ["system", "tool", None]), r.choice(["Yes.", "No!", "What? ", "cut off", "", None, "\x85.", "a "])))
    rows += [(7, t % 400, "ua"[t % 2].replace("u", "user").replace("a", "assistant"), f"turn {t % 900}.") for t in range(1500)] + [(8, 1, "user", "same.")] * 300
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, ID string, letter string").repartition(3)


@pytest.mark.parametrize("segment", [4096, 8])
def test_against_a_plain_program(spark, monkeypatch, segment):
    """Also with segments so short that long conversations are cut in many; 2**33 must be a multiple of the length."""
    monkeypatch.setattr(turn_repair, "SEGMENT", segment)
    got = sorted((tuple(r)[:9] for r in turn_repair.repair(frame(spark, awkward())).collect()), key=str)
    assert got == sorted(plain(awkward()), key=str)


def test_repaired_rows_have_the_digest(spark):
    df = frame(spark, awkward())
    lines = {}
    for r in sorted(turn_repair.repaired_rows(df).collect(), key=lambda r: r.position):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in turn_repair.repair(df).collect():
        own = lines.get(r.conv_id, [])
        assert (len(own), hashlib.sha256("\n".join(own).encode()).hexdigest()) == (r.n_repaired, r.repaired_sha256)
        assert GOOD.fullmatch("".join(x[0] for x in own))


def test_an_empty_table(spark):
    assert turn_repair.repair(frame(spark, awkward()).where("1 = 0")).count() == 0
    assert turn_repair.repaired_rows(frame(spark, awkward()).where("1 = 0")).count() == 0


def test_sql_on_awkward_rows(spark):
    duck = duckdb.connect()
    duck.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    rows = [r for r in awkward() if r[0] not in (7, 8)]
    duck.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = duck.sql(turn_repair.ORACLE)
    got = turn_repair.repair(frame(spark, rows)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_query_over_the_given_table(spark):
    rows = duckdb.sql("select conv_id, turn, role, text from '/root/testdata/sf0.001/conversations.parquet'").fetchall()
    got = op13_conversation_repair(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r)[:9] for r in got), key=str) == sorted(plain(rows), key=str)
