"""The quality classifier: statistics and compiled rules against plain Python, held-out accuracy, edge cases."""

import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from girder.llm import rule_ensemble
from girder.llm.queries import op12_quality_classifier
from girder.llm.rule_ensemble import STATISTICS, Ensemble, Rule

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", " \n\t ", "one", "a a a b b", "THE!! CAT!! sat.", "x | y | z\nx | y | z\n\nlast 12", "Größe é 🙂 ist, gut; ja: nein?", "w " * 50_000, "\x85 \xa0 #*$%&<>@^~_=+{}[]\\", "l1\nl1\nl1\n \nl2"]


def plain(text):
    text = text or ""
    w = re.findall(r"[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
    n, chars, over = len(w), sum(map(len, w)), lambda a, b: a / b if b else 0.0
    share = lambda letters: over(sum(c in letters for c in text), chars)
    return {
        "words": math.log1p(n), "word_length": over(chars, n), "longest_word": float(max(map(len, w), default=0)), "distinct": over(len(set(w)), n),
        "twice_running": over(sum(a == b for a, b in zip(w, w[1:])), n), "words_a_line": over(n, len(lines)), "lines_again": over(len(lines) - len(set(lines)), len(lines)),
        "symbols": share("#*$%&<>@^~_=+{}[]\\"), "digits": share("0123456789"), "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "exclaims": share("!"), "bars": share("|"), "marks": share(".?,;:"),
    }


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "l", "s", "k") for i, t in enumerate(texts)], "doc_id long, text string, words string, LABEL string, score string")


def test_statistics(spark):
    for r in rule_ensemble.statistics(frame(spark, TEXTS)).collect():
        assert {c: r[c] for c in STATISTICS} == pytest.approx(plain(TEXTS[r.doc_id]), abs=1e-12), TEXTS[r.doc_id]


def test_rules_of_a_tree():
    text = """DecisionTree
  If (feature 0 <= 0.5)
   If (feature 1 <= 1.5E-5)
    Predict: 0.0
   Else (feature 1 > 1.5E-5)
    If (feature 0 <= -2.0)
     Predict: 1.0
    Else (feature 0 > -2.0)
     Predict: 0.0
  Else (feature 0 > 0.5)
   Predict: 1.0"""
    inf = math.inf
    assert set(rule_ensemble.rules_of([text, text], ["a", "b"])) == {
        Rule((("a", -inf, 0.5),)), Rule((("a", 0.5, inf),)), Rule((("a", -inf, 0.5), ("b", -inf, 1.5e-5))), Rule((("a", -inf, 0.5), ("b", 1.5e-5, inf))),
        Rule((("a", -inf, -2.0), ("b", 1.5e-5, inf))), Rule((("a", -2.0, 0.5), ("b", 1.5e-5, inf))),
    }


def test_compiled_column(spark):
    e = Ensemble(0.3, [(2.0, Rule((("a", 0.0, 1.0),))), (-1.5, Rule((("a", -math.inf, 0.5), ("b", 2.0, math.inf))))])
    rows = [(x / 4, y / 2) for x in range(-2, 8) for y in range(8)]
    for r in spark.createDataFrame(rows, "a double, b double").withColumn("score", e.column()).collect():
        z = 0.3 + 2.0 * (0 < r.a <= 1) - 1.5 * (r.a <= 0.5 and r.b > 2)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))
    assert e.describe()[0] == "+2.000 if 0 < a <= 1"


def test_held_out_accuracy_and_contract(spark):
    got = op12_quality_classifier(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    rows = got.collect()
    assert len(rows) == duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    right = {0: [], 1: []}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            right[labels[r.doc_id]].append(r.predicted == labels[r.doc_id])
    assert all(len(x) > 5 and sum(x) >= 0.9 * len(x) for x in right.values())


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.withColumn("quality", F.when(rule_ensemble.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    want = {r.doc_id: r.score for r in rule_ensemble.score(docs, labels).collect()}
    got = {r.doc_id: r.score for r in rule_ensemble.score(docs.withColumns({"lang": F.lit("q"), "source": F.lit(None).cast("string")}), changed).collect()}
    assert got == want


def test_edges(spark):
    docs = frame(spark, TEXTS).union(spark.createDataFrame([(None, "a b", "", "", ""), (3, "other", "", "", "")], "doc_id long, text string, words string, LABEL string, score string"))
    for rows, want in (([], 0.5), ([(3, 1), (8, 1), (4, None), (None, 0)], None), ([(i, i % 2) for i in range(11)] + [(3, 0)], None)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        got = rule_ensemble.score(docs, labels).collect()
        assert len(got) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [True]
        if want:
            assert {r.score for r in got} == {want}
    assert rule_ensemble.score(docs.where("1 = 0"), labels).count() == 0
