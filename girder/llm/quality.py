"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base rules are fixed. Beyond them each rule holds one rate of a document against a cutoff from a fixed grid. Labelled
documents (quality 1 is good) are dealt in two by a digest of their doc_id: a third proposes, the rest is held out and
decides. In each stratum (language) a rule's proposal is its lowest cutoff up to which at most RISK / rules of the
proposing good documents are rejected. The settings to test form a ladder: at step j each rule has the j-th of its
cutoffs from the loosest, but none below its proposal, so each step rejects whatever the one before does.

The steps are tested in that order on the held-out good documents: a step passes if the exact binomial tail
P(X <= false rejections | held-out good documents, RISK) is at most the stratum's level, and the first that fails ends the
ladder. A fixed order needs no correction along the ladder. Over the strata the level is LEVEL / strata (Bonferroni), so with
probability 1 - LEVEL no stratum loses more than RISK of its good documents to all rules together. The last step
that passed is used; a stratum whose first step fails gets no cutoffs and keeps its documents.

Nulls and edge cases: a null or empty text has no words and fails the base rules; a very long text is counted whole; a null
language is a stratum of its own; documents without labels only get verdicts; of several labels of a doc_id the best
counts; null labels are ignored; rows that repeat are judged each, and rows of one doc_id by their own text and language;
a rate equal to its cutoff is rejected; an empty table gives an empty result; only doc_id, text and lang are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import save

MIN_WORDS, REPEAT_PERCENT, SPAN = 20, 30, 8
RISK, LEVEL = 0.05, 0.05
TAIL_TERMS = 20_000
FEW = 10_000  # strata whose cutoffs are broadcast, about 200 bytes each
WHITE, SYMBOLS, CAPITALS = " \t\n\x0b\f\r", "#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = "[\\x20\\x09-\\x0D]+"

# rule: (rate in whole thousandths, as SQL over the features; cutoffs, rejected from there on)
RULES: dict[str, tuple[str, list[int]]] = {
    "symbols": ("1000 * n_symbols DIV word_chars", [10, 20, 50, 100, 200, 300]),
    "capitals": ("1000 * n_capitals DIV word_chars", [150, 200, 300, 400, 500, 700]),
    "exclaims": ("1000 * n_exclaims DIV word_chars", [10, 20, 50, 100, 200, 300]),
    "repeats": ("1000 * n_repeat_words DIV n_words", [50, 100, 150, 200, 250, 300]),
    "lines": ("1000 * n_dup_lines DIV n_words", [5, 10, 20, 30, 50, 100]),
}
STEPS = max(len(cuts) for _, cuts in RULES.values())


def less(column: str, letters: str) -> Column:
    """Characters of `column` that are among `letters`."""
    return F.length(column) - F.length(F.translate(F.col(column), letters, ""))


def features(docs: DataFrame) -> DataFrame:
    """Counts of each text, and a digest of it as `key`. Each step is a projection of its own, as arrays used in lambdas must stand as columns."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = base.select(
        "doc_id", "stratum", F.xxhash64("text").alias("key"),
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("lines"),
        F.length(F.translate(F.col("text"), WHITE, "")).alias("word_chars"),
        less("text", SYMBOLS).alias("n_symbols"), less("text", CAPITALS).alias("n_capitals"), less("text", "!").alias("n_exclaims"),
    )
    spans = F.transform(F.sequence(F.lit(1), F.size("words") - (SPAN - 1)), lambda i: F.xxhash64(F.slice("words", i, SPAN)))
    hashed = split.select(
        "doc_id", "stratum", "key", F.size("words").alias("n_words"), "word_chars", "n_symbols", "n_capitals", "n_exclaims",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("words") > SPAN, spans).alias("spans"),
    )
    again = F.size("spans") > F.size(F.array_distinct("spans"))
    counted = ["doc_id", "stratum", "key", "n_words", "word_chars", "n_symbols", "n_capitals", "n_exclaims", "n_dup_lines"]
    ordered = hashed.select(*counted, F.when(again, F.array_sort(F.transform("spans", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda e, k: (F.get("s", k - 1)["h"] == e["h"]) | (F.get("s", k + 1)["h"] == e["h"])
    places = ordered.select(*counted, F.array_sort(F.transform(F.filter("s", lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"])).alias("at"))
    # each span adds the words that the one before it did not cover
    start = F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("sum"))
    cover = F.aggregate("at", start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(SPAN), p - a["last"])).alias("sum")), lambda a: a["sum"])
    longs = [F.col(c).cast("long").alias(c) for c in counted[3:]]
    return places.select("doc_id", "stratum", "key", *longs, F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series eight numbers further on; good to 12 digits."""
    z = x.cast("double") + 9
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5)))
    shift = F.log(z - 1)
    for k in range(2, 9):
        shift = shift + F.log(z - k)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), and 1 from k >= n p on, where no test can pass; the last TAIL_TERMS terms are summed."""
    log_last = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    step = lambda i: (k - i + 1) * F.lit(1 - p) / ((n - k + i) * F.lit(p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * step(i)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1), F.least(k, F.lit(TAIL_TERMS)).cast("int"))).otherwise(F.expr("array()").cast("array<int>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_last) * F.aggregate(terms, start, add, lambda a: a["sum"]))


def rates() -> dict[str, Column]:
    return {r: F.expr(f"CASE WHEN n_words > 0 THEN {rate} ELSE 0 END") for r, (rate, _) in RULES.items()}


def proposes() -> Column:
    """Whether a labelled doc_id is of the third that proposes, by the first byte of its digest."""
    return F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2), 16, 10).cast("int") % 3 == 0


def calibrate(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum and the cutoffs (map from rule to cutoff) of its last step that passed, by labelled documents."""
    best = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    good = measured.join(best.where("quality = 1").select("doc_id"), "doc_id").select("stratum", proposes().alias("proposing"), *[r.alias(f"r_{name}") for name, r in rates().items()])

    # each rule's proposal, as a place in its grid: the lowest cutoff that spares enough of the proposing documents
    rejected = [F.sum((F.col("proposing") & (F.col(f"r_{r}") >= c)).cast("long")).alias(f"{r}_{k}") for r, (_, cuts) in RULES.items() for k, c in enumerate(cuts)]
    seen = good.groupBy("stratum").agg(F.count_if("proposing").alias("n"), *rejected)

    def proposal(r: str) -> Column:
        spared = [F.col(f"{r}_{k}") * len(RULES) <= F.col("n") * RISK for k in range(len(RULES[r][1]))]
        place = F.lit(len(spared))  # none
        for k in reversed(range(len(spared))):
            place = F.when(spared[k], k).otherwise(place)
        return place

    proposed = seen.select("stratum", *[proposal(r).alias(f"p_{r}") for r in RULES])
    steps = proposed.select("stratum", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"), *[f"p_{r}" for r in RULES])
    place = lambda r, cuts: F.greatest(F.lit(len(cuts) - 1) - F.col("step"), F.col(f"p_{r}"))
    cutoff = lambda r, cuts: F.get(F.array(*map(F.lit, cuts)), place(r, cuts))
    ladder = steps.select("stratum", "step", *[f(r, cuts).alias(f"{n}_{r}") for r, (_, cuts) in RULES.items() for n, f in (("c", cutoff), ("i", place))])

    # documents are counted by how many cutoffs of each rule they reach, so what meets a stratum's ladder is bounded by the grids
    reached = lambda r, cuts: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(f"r_{r}") >= c)).alias(f"l_{r}")
    held_out = good.where("not proposing").groupBy("stratum", *[reached(r, cuts) for r, (_, cuts) in RULES.items()]).agg(F.count(F.lit(1)).alias("docs"))
    any_ = F.lit(False)
    for r in RULES:
        any_ = any_ | F.coalesce(F.col(f"l_{r}") > F.col(f"i_{r}"), F.lit(False))
    tests = held_out.join(ladder, "stratum").groupBy("stratum", "step", *[f"c_{r}" for r in RULES]).agg(F.sum("docs").alias("n"), F.sum(F.when(any_, F.col("docs")).otherwise(0)).alias("k"))
    strata = tests.agg(F.count_distinct("stratum").alias("strata"))
    passed = tests.crossJoin(strata).withColumn("passes", binomial_tail(F.col("k"), F.col("n"), RISK) <= F.lit(LEVEL) / F.col("strata"))  # strata is one row
    failed = passed.where("not passes").groupBy(F.col("stratum").alias("s")).agg(F.min("step").alias("stop"))
    last = passed.join(failed, F.col("stratum") == F.col("s"), "left").where("stop is null or step < stop")
    cuts = F.create_map(*[x for r in RULES for x in (F.lit(r), F.col(f"c_{r}"))])
    return last.groupBy("stratum").agg(F.max_by(cuts, "step").alias("cutoffs"))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measured, _ = save(features(docs), "op9-features")
    cutoffs, _ = save(calibrate(measured, labels), "op9-cutoffs")
    # a row for each stratum: broadcast while they are few, as a frequent stratum would else be one task's
    found = measured.join(F.broadcast(cutoffs) if cutoffs.count() <= FEW else cutoffs, "stratum", "left")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rejects = F.lit(False)
    for rule, rate in rates().items():
        rejects = rejects | F.coalesce(rate >= F.col("cutoffs")[rule], F.lit(False))
    return found.withColumns({"base_failed": base, "kept": ~base & ~rejects})


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of docs."""
    return verdicts(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    kept = verdicts(docs, labels).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("stratum").alias("kept_stratum"), F.col("key").alias("kept_key")).distinct()
    key, stratum = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))), F.coalesce(docs["lang"].cast("string"), F.lit(""))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (stratum == kept["kept_stratum"]) & (key == kept["kept_key"]), "left_semi")


def _oracle() -> str:
    rate = {r: e.replace("DIV", "//") for r, (e, _) in RULES.items()}
    rejected = ", ".join(f"count(*) FILTER (proposing AND r_{r} >= {c}) AS {r}_{k}" for r, (_, cuts) in RULES.items() for k, c in enumerate(cuts))
    place = lambda r, n: "CASE " + " ".join(f"WHEN {r}_{k} * {len(RULES)} <= n * {RISK} THEN {k}" for k in range(n)) + f" ELSE {n} END"
    cut = lambda r, cuts: f"list_extract([{', '.join(map(str, cuts))}], 1 + greatest({len(cuts) - 1} - step, {place(r, len(cuts))})::INT) AS c_{r}"
    any_ = lambda a: " OR ".join(f"coalesce({a}r_{r} >= c_{r}, false)" for r in RULES)
    rates_ = ", ".join(f"CASE WHEN n_words > 0 THEN {e} ELSE 0 END AS r_{r}" for r, e in rate.items())
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM base
), spans AS (
  SELECT rid, i, list_slice(words, i, i + 7) AS span, len(words) AS n FROM cut, LATERAL (SELECT unnest(range(1, len(words) - 6)) AS i)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, span) AS c FROM spans) WHERE c > 1
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM again, (SELECT unnest(range(0, 8)) AS j) GROUP BY rid
), f AS (
  SELECT doc_id, stratum, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[ 	-
]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
    length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclaims, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM cut LEFT JOIN covered USING (rid)
), rated AS (SELECT *, {rates_} FROM f
), good AS (
  SELECT rated.*, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::INT % 3 = 0 AS proposing
  FROM rated JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1) USING (doc_id)
), seen AS (SELECT stratum, count(*) FILTER (proposing) AS n, {rejected} FROM good GROUP BY 1
), ladder AS (SELECT stratum, step, {", ".join(cut(r, cuts) for r, (_, cuts) in RULES.items())} FROM seen, (SELECT unnest(range(0, {STEPS})) AS step)
), tests AS (
  SELECT stratum, step, count(*) AS n, count(*) FILTER ({any_('')}) AS k FROM good JOIN ladder USING (stratum) WHERE NOT proposing GROUP BY 1, 2
), failed AS (
  SELECT stratum, min(step) FILTER (NOT passes) AS stop FROM (SELECT *, k < n * {RISK} AND list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) <= {LEVEL} / (SELECT count(DISTINCT stratum) FROM tests) AS passes FROM tests) GROUP BY 1
), used AS (
  SELECT l.* FROM ladder l JOIN failed USING (stratum) WHERE step = coalesce(stop, {STEPS}) - 1
), verdict AS (
  SELECT rated.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, used.stratum IS NOT NULL AND ({any_('')}) AS rejected FROM rated LEFT JOIN used USING (stratum)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM verdict"""


ORACLE = _oracle()
