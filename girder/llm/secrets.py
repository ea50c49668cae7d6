"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is read as a Boolean query over trigrams that any match must hold: any of some sets, whole.
The index has a posting for each document and trigram that occurs in some query, made in one pass over the texts. A set's
postings are intersected by counting them by document; rules whose query holds for a document are verified by running
their expressions once. Rules without a mandatory trigram run over every text. A match's place comes from the lengths of
the pieces between the matches and of the matches, summed up in blocks, so the work on a text grows in proportion to it.

Nulls and edge cases: a null text is empty; a null doc_id is scanned like any other; rows that share a doc_id are
candidates for the rules of any of them, which verification settles; very long texts and texts of many matches are scanned
whole; touching matches of different rules stay apart in `spans` and are merged when redacted, where of several that start
together the rule listed first names it; rows that repeat are scanned each; an empty table gives an empty result; columns
beyond doc_id and text are kept by `redact`, whatever their names, and ignored by `secret_scan`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1  # characters that this group must have
    fold: bool = False  # letters of either case

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.fold else self.pattern


BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # maximal runs, so shorter ones need not be matched to be dropped
]
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("login", r"[a-z]{2,16}://[^\s:@/]{1,256}:[^\s:@/]{1,256}@"),  # bounded, or a long run of letters takes quadratic time
]
RULES = BASE + MORE
_MANY = 64  # strings that a part of an expression may stand for before it is cut into trigrams

Query = frozenset[frozenset[str]]  # any of these sets, whole
ANY: Query = frozenset([frozenset()])


def _both(x: Query, y: Query) -> Query:
    return _least(frozenset(a | b for a in x for b in y))


def _least(x: Query) -> Query:
    return frozenset(a for a in x if not any(b < a for b in x))


def _of(strings: frozenset[str]) -> Query:
    """What the occurrence of any one of the strings asks for."""
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _strings(node: tuple) -> frozenset[str] | None:
    """The strings that one parsed element stands for, if they are few."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return frozenset([chr(value).lower()])
    if kind == "IN" and all(str(k) == "LITERAL" for k, _ in value):
        return frozenset(chr(v).lower() for _, v in value)
    if kind == "SUBPATTERN":
        return _all(list(value[3]))
    if kind == "BRANCH":
        found = [_all(list(b)) for b in value[1]]
        return None if any(f is None for f in found) else frozenset().union(*found)
    if kind == "MAX_REPEAT" and value[1] <= 2 and (own := _all(list(value[2]))) is not None:
        return frozenset("".join(p) for n in range(value[0], int(value[1]) + 1) for p in product(own, repeat=n))
    return None


def _all(nodes: list) -> frozenset[str] | None:
    out = frozenset([""])
    for n in nodes:
        own = _strings(n)
        if own is None or len(out) * len(own) > _MANY:
            return None
        out = frozenset(a + b for a in out for b in own)
    return out


def _query(nodes: list) -> Query:
    """Runs of elements with few strings are joined before they are cut; the others ask for what their parts ask for."""
    query, run = ANY, frozenset([""])
    for n in nodes:
        own = _strings(n)
        if own is not None and len(run) * len(own) <= _MANY:
            run = frozenset(a + b for a in run for b in own)
            continue
        query, run = _both(query, _of(run)), own if own is not None else frozenset([""])
        if own is None:
            kind, value = str(n[0]), n[1]
            if kind == "SUBPATTERN":
                query = _both(query, _query(list(value[3])))
            elif kind == "MAX_REPEAT" and value[0] > 0:
                query = _both(query, _query(list(value[2])))
            elif kind == "BRANCH":
                query = _both(query, _least(frozenset().union(*(_query(list(b)) for b in value[1]))))
    return _both(query, _of(run))


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams: a text with a match holds all of at least one set. ANY if nothing is mandatory."""
    return _query(list(re._parser.parse(pattern)))


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id), each once, of the given trigrams."""
    # what starts at each place: the classes of the three letters turn most places down, then the trigrams are tried by first letter
    classes = "".join("[" + "".join(sorted({re.escape(t[k]) for t in trigrams})) + "]" for k in range(3))
    by_first = {c: [re.escape(t[1:]) for t in trigrams if t[0] == c] for c in sorted({t[0] for t in trigrams})}
    pattern = f"(?={classes})(?=({'|'.join(f'{re.escape(c)}(?:{chr(124).join(rest)})' for c, rest in by_first.items())}))"
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1)))
    return docs.select("doc_id", F.explode(held).alias("trigram")).distinct()


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """key_id (the doc_id) and `which`, the numbers of the rules whose query its postings satisfy; rules that ask for nothing are left out."""
    sets = [(i, need) for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANY for need in sorted(q, key=sorted)]
    trigrams = sorted({t for _, need in sets for t in need})
    named = {t: F.array(*[F.lit(k) for k, (_, need) in enumerate(sets) if t in need]) for t in trigrams}
    asking = F.create_map(*[x for t, ks in named.items() for x in (F.lit(t), ks)])
    each = index(docs, trigrams).select("doc_id", F.explode(asking[F.col("trigram")]).alias("set"))
    whole = each.groupBy("doc_id", "set").agg(F.count(F.lit(1)).alias("n"))
    size, rule = (F.array(*map(F.lit, values)) for values in ([len(need) for _, need in sets], [i for i, _ in sets]))
    return whole.where(F.col("n") == F.get(size, F.col("set"))).groupBy(F.col("doc_id").alias("key_id")).agg(F.collect_set(F.get(rule, F.col("set"))).alias("which"))


SUMS = 128  # numbers that are summed up one after another


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """The fold (a sum or a greatest of numbers from 0 on) up to each number. Appending copies an array, so it is done in
    blocks of SUMS, then over the blocks."""
    zero = F.lit(0)

    def block(b: Column) -> Column:
        return F.aggregate(b, F.expr("array()").cast("array<int>"), lambda a, x: F.array_append(a, fold(F.coalesce(F.get(a, F.size(a) - 1), zero), x)))

    def joined(blocks: Column) -> Column:
        base = F.aggregate(blocks, F.array(zero), lambda a, b: F.array_append(a, fold(F.element_at(a, -1), F.element_at(b, -1))))
        return let(base, lambda t: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x: fold(F.get(t, k), x)))))

    cut = let(values, lambda v: F.transform(F.sequence(zero, F.floor((F.size(v) - 1) / SUMS).cast("int")), lambda k: block(F.slice(v, k * SUMS + 1, F.lit(SUMS)))))
    return let(cut, joined)


SPOT = "struct<start:int,turn:int,kind:string,end:int>"


def places(i: int, r: Rule) -> Column:
    """The spots of rule i, from the columns m<i>, its matches, and p<i>, the pieces of the text between them."""
    match, piece = F.col(f"m{i}"), F.col(f"p{i}")
    # a match by itself is matched as it was in the text, as no expression looks beyond its match
    own = F.transform(match, lambda m: F.length(m if r.group == 0 else F.regexp_extract(m, r.regex, r.group)))
    steps = F.zip_with(F.slice(piece, F.lit(1), F.size(match)), match, lambda p, m: F.length(p) + F.length(m))
    spots = let(running(steps, lambda a, b: a + b), lambda ends: F.transform(match, lambda m, k: F.struct((F.get(ends, k) - F.length(m)).alias("start"), F.lit(i).alias("turn"), F.lit(r.kind).alias("kind"), F.get(ends, k).alias("end"))))
    long_enough = let(own, lambda g: F.filter(spots, lambda s, k: F.get(g, k) >= r.least))
    return F.when(F.size(match) > 0, long_enough.cast(f"array<{SPOT}>")).otherwise(F.expr("array()").cast(f"array<{SPOT}>"))


def scan(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """All columns of docs, and `found`: array of (start, turn of the rule, kind, end) in code points, sorted."""
    text = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    open_ = {i for i, r in enumerate(rules) if trigram_query(r.pattern) == ANY}
    joined = text.join(candidates(text, rules), F.col("doc_id").eqNullSafe(F.col("key_id")), "left").drop("key_id")
    none = F.expr("array()").cast("array<string>")
    run = lambda i: F.lit(True) if i in open_ else F.coalesce(F.array_contains("which", i), F.lit(False))
    kept, turns = docs.columns, range(len(rules))
    matched = joined.select(*kept, *[F.when(run(i), F.regexp_extract_all("text", F.lit(r.regex), F.lit(0))).otherwise(none).alias(f"m{i}") for i, r in enumerate(rules)])
    pieces = matched.select(*kept, *[f"m{i}" for i in turns], *[F.when(F.size(f"m{i}") > 0, F.split("text", r.regex, -1)).otherwise(none).alias(f"p{i}") for i, r in enumerate(rules)])
    return pieces.select(*kept, F.array_sort(F.concat(*[places(i, r) for i, r in enumerate(rules)])).alias("found"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda i: F.size(F.filter("found", lambda x: x["turn"] == i)).cast("long")
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter("found", lambda x: x["turn"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


LETTERS = 1024  # of the blocks that a text is cut into, as a place in a string is found by counting from its start


def masked(text: Column, found: Column) -> Column:
    """The text with its spots replaced by their kinds. A spot that begins within an earlier one is part of it."""
    letters = F.lit(LETTERS)

    def made(blocks: Column, spots: Column, ends: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            i, j = F.floor(a / letters).cast("int"), F.floor(b / letters).cast("int")
            head = F.substring(F.get(blocks, i), a - i * letters + 1, F.least(b - a, letters))
            tail = F.concat(head, F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(blocks, j), F.lit(1), b - j * letters), F.lit("")))
            return F.when(a >= b, F.lit("")).when(i == j, head).otherwise(tail)

        def one(s: Column, k: Column) -> Column:
            before = F.coalesce(F.get(ends, k - 1), F.lit(0))
            return F.when(s["start"] >= before, F.concat(piece(before, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")

        return F.concat(F.array_join(F.transform(spots, one), ""), piece(F.element_at(ends, -1), F.length(text)))

    ends = running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % LETTERS), F.lit(0))
    return let(blocks, lambda b: let(ends, lambda e: made(b, found, e)))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret's characters replaced by its kind in square brackets; overlapping secrets are one."""
    whole = F.struct(*[docs[c] for c in docs.columns])  # apart from the columns made here, whatever their names
    found = scan(docs.select(whole.alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")))
    text = F.when(F.size("found") > 0, masked(F.col("text"), F.col("found"))).otherwise(F.col("row")["text"])
    return found.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _oracle() -> str:
    def one(i: int, r: Rule) -> str:
        p = r.regex.replace("'", "''")
        return f"""SELECT rid, {i} AS turn, '{r.kind}' AS kind, m, g, list_transform(p, lambda x: length(x)) AS p FROM (
  SELECT rid, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS g, regexp_split_to_array(text, '{p}') AS p FROM base) WHERE len(m) > 0"""

    least = " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(RULES))
    return f"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(one(i, r) for i, r in enumerate(RULES))}),
each AS (SELECT rid, turn, kind, i, length(m[i]) AS size, length(g[i]) AS own, list_sum(p[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM hits, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)),
spans AS (SELECT rid, turn, s, kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT AS t FROM each WHERE own >= CASE turn {least} END)
SELECT doc_id, count(*) FILTER (turn = 0) AS n_assign, count(*) FILTER (turn = 1) AS n_access, count(*) FILTER (turn = 2) AS n_hex,
  sha256(coalesce(string_agg(t, ',' ORDER BY s, turn) FILTER (turn < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(t, ',' ORDER BY s, turn), '') AS spans
FROM base LEFT JOIN spans USING (rid) GROUP BY rid, doc_id"""


ORACLE = _oracle()
