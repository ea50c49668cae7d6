"""Quality classifier: a sparse ensemble of rules.

Statistics of a whole text are column expressions. A forest of shallow trees is fitted on them for labelled documents; every
path from a root to a node below it is a rule, a conjunction of bounds on statistics. A logistic regression with a lasso
penalty over the rules, each true or false, keeps a few of them, and what is kept is compiled into one column expression: the
score is computed where the statistics are, without a model in the plan.

Only labelled rows whose digest of the doc_id is not held out are learned from, at most TRAIN of them: where there are more,
those with the least hashes, as more would not move a few dozen weights. Everything else covers all rows. Labels, lang, source
and doc_id are no inputs of a score. Trees and weights reach the driver, at most TREES * 2**(DEPTH + 1) rules.

Nulls and edge cases: a null or empty text has statistics of 0 and gets a score; a very long text is counted whole; a null doc_id
counts as held out, as it meets no label; of several labels of a doc_id the highest counts; null labels are ignored; rows that
repeat are scored each, and a doc_id with several texts teaches with each; with labels of one kind or none the score is their
share among the labels, (good + 1) / (all + 2); an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import save

FOLDS = 5  # one is held out
TRAIN = 32_768  # labelled rows that are learned from at most
TREES, DEPTH, LASSO, SEED = 24, 3, 0.0005, 12
CUT = 0.3  # predicted good from this score on
SPACE = "[\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\f\r"
SYMBOLS, DIGITS, CAPITALS, MARKS = "#*$%&<>@^~_=+{}[]\\", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".?,;:"

STATISTICS = ["words", "word_length", "longest_word", "distinct", "twice_running", "words_a_line", "lines_again", "symbols", "digits", "capitals", "exclaims", "bars", "marks"]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of each row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bare = F.length(F.translate("text", WHITE, ""))
    count = lambda letters: F.length("text") - F.length(F.translate("text", letters, ""))
    split = base.select(
        "doc_id", F.filter(F.split("text", SPACE), lambda w: w != "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("lines"), bare.alias("chars"),
        *[count(x).alias(n) for n, x in (("symbols", SYMBOLS), ("digits", DIGITS), ("capitals", CAPITALS), ("exclaims", "!"), ("bars", "|"), ("marks", MARKS))],
    )
    n = F.size("w")
    next_ = F.expr("slice(w, 2, size(w))")
    running = F.size(F.filter(F.zip_with("w", next_, lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False))))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return split.select(
        "doc_id", F.log1p(n.cast("double")).alias("words"), over(F.col("chars"), n).alias("word_length"), F.coalesce(F.array_max(F.transform("w", lambda w: F.length(w))), F.lit(0)).cast("double").alias("longest_word"),
        over(F.size(F.array_distinct("w")), n).alias("distinct"), over(running, n).alias("twice_running"), over(n, F.size("lines")).alias("words_a_line"),
        over(F.size("lines") - F.size(F.array_distinct("lines")), F.size("lines")).alias("lines_again"),
        *[over(F.col(c), F.col("chars")).alias(c) for c in STATISTICS[7:]],
    )


@dataclass(frozen=True, order=True)
class Rule:
    """All of the bounds: (statistic, above, at most)."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        out = None
        for name, above, most in self.bounds:
            for part in ([F.col(name) > F.lit(above)] if above > -math.inf else []) + ([F.col(name) <= F.lit(most)] if most < math.inf else []):
                out = part if out is None else out & part
        return out


def rules_of(trees: list[str], names: list[str] = STATISTICS) -> list[Rule]:
    """The rules of the paths of trees, each as its description in indented lines."""
    found: set[Rule] = set()
    for text in trees:
        path: list[tuple[int, str, bool, float]] = []  # indent, statistic, whether at most, bound
        for line in text.splitlines():
            m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
            if not m:
                continue
            indent = len(m[1])
            path = [p for p in path if p[0] < indent] + [(indent, names[int(m[2])], m[3] == "<=", float(m[4]))]
            bounds: dict[str, tuple[float, float]] = {}
            for _, name, at_most, value in path:
                above, most = bounds.get(name, (-math.inf, math.inf))
                bounds[name] = (above, min(most, value)) if at_most else (max(above, value), most)
            found.add(Rule(tuple((k, *v) for k, v in sorted(bounds.items()))))
    return sorted(found)


@dataclass
class Ensemble:
    """score = 1 / (1 + exp(-(bias + the weights of the rules that hold)))."""

    bias: float
    weights: list[tuple[float, Rule]]

    def column(self) -> Column:
        total = F.lit(self.bias)
        for weight, rule in self.weights:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, the heaviest first."""
        say = lambda name, above, most: (f"{above:g} < " if above > -math.inf else "") + name + (f" <= {most:g}" if most < math.inf else "")
        return [f"{weight:+.3f} if " + " and ".join(say(*b) for b in rule.bounds) for weight, rule in sorted(self.weights, key=lambda x: -abs(x[0]))]


def fit(measured: DataFrame, labels: DataFrame) -> Ensemble:
    """From statistics of documents and labels(doc_id, quality)."""
    best = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg((F.max("quality") > 0).cast("double").alias("label"))
    known = best.where(~held_out(F.col("labelled")))
    shared = measured.join(known, measured["doc_id"] == known["labelled"]).drop("labelled")
    total = shared.count()
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, TRAIN / max(total, 1)) * (1 << 30))
    # in the order of doc_id, so that the same rows give the same trees
    rows, _ = save(shared.where(near).repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id", *STATISTICS), "op12-train")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    good, bad = counts.get(1.0, 0), counts.get(0.0, 0)
    if not good or not bad:
        return Ensemble(math.log((good + 1) / (bad + 1)), [])
    vectors = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("x"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5, seed=SEED).fit(vectors)
    rules = rules_of([t.toDebugString for t in forest.trees])
    if not rules:
        return Ensemble(math.log((good + 1) / (bad + 1)), [])
    held = rows.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("x"))
    line = LogisticRegression(featuresCol="x", labelCol="label", regParam=LASSO, elasticNetParam=1.0, maxIter=80).fit(held)
    weights = [(float(w), r) for w, r in zip(line.coefficients.toArray(), rules) if w]
    return Ensemble(float(line.intercept), weights)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    measured, _ = save(statistics(docs), "op12-statistics")
    scored = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), fit(measured, labels).column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
