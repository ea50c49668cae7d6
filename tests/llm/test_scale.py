"""What must hold however large or uneven the input: hot keys, buckets beyond one deal, scratch tables, and the pipeline as a whole."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from girder.llm import common, near_dedup, piece_codec, quality, secrets, sharding, substring_dedup
from tests.llm.test_edges import brute_components

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute_removed(texts):
    seen = Counter(tuple(w[i : i + 35]) for t in texts for w in [t.split()] for i in range(len(w) - 34))
    out = []
    for t in texts:
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        out.append(sum(gone))
    return out


def passages(seed, n):
    """Every text holds one passage, a third are copies, and a few words make windows that repeat within a text."""
    r = np.random.default_rng(seed)
    hot = " ".join(f"hot{i}" for i in range(40))
    copy = " ".join(f"copy{x}" for x in r.integers(0, 9, 120))
    texts = []
    for i in range(n):
        own = " ".join(f"w{x}" for x in r.integers(0, 3 if i % 7 == 0 else 5000, r.integers(0, 90)))
        texts.append(copy if i % 3 == 0 else f"{own} {hot} {own[: i % 50]}")
    return texts


@pytest.mark.parametrize("wide,bucket,held", [(1 << 16, 16 << 20, 32 << 20), (8, 200, 100), (3, 50, 1)])
def test_substring_dedup_of_a_passage_in_every_text(spark, monkeypatch, wide, bucket, held):
    """Also with so many buckets that texts are dealt twice; chunks hold a few texts each."""
    texts = passages(1, 300)
    monkeypatch.setattr(substring_dedup, "WIDE", wide)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(substring_dedup, "HELD", held)
    monkeypatch.setattr(substring_dedup, "CHUNK", 4000)
    docs = spark.createDataFrame([(i if i % 4 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == sorted((i if i % 4 else -1, n) for i, n in enumerate(brute_removed(texts)))


def test_memory_with_many_buckets():
    """Dealt to 65,536 buckets, as a terabyte is, chunks stay small and several share a row."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(3)
    texts = [" ".join(np.char.add("w", r.integers(0, 10**6, 4000).astype(str))) for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"rid": pa.array(range(600), pa.int64()), "text": texts})
    tracemalloc.start()
    rows = hashes = 0
    for made in substring_dedup._probes(1 << 16, 100)(iter([batch])):
        rows, hashes = rows + made.num_rows, hashes + sum(len(x.as_py()) for x in made.column("hashes")) // 4
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hashes > 2_000_000 and hashes > 16 * rows and peak < 500 << 20


def test_a_frequent_passage_is_dealt_seldom():
    """What a chunk sends for a window that all of its texts hold does not grow with them."""
    hot = " ".join(f"hot{i}" for i in range(60)).encode()
    words = common.Words([hot] * 400)
    at, g = words.grams(substring_dedup.BLOCK)
    key = g
    hit, deal = substring_dedup._settled(key, (at - words.first[words.doc[at]]) % substring_dedup.BLOCK == 0)
    assert deal.sum() < 20_000 * 0.9 and hit.sum() >= 3 * 400 and deal[~hit].sum() == (~hit).sum()
    shifted = common.Words([b" ".join(hot.split()[k % 18 :]) for k in range(400)])
    at, g = shifted.grams(substring_dedup.BLOCK)
    hit, deal = substring_dedup._settled(g, (at - shifted.first[shifted.doc[at]]) % substring_dedup.BLOCK == 0)
    assert deal.sum() < 0.05 * len(at)


def test_near_dedup_of_one_large_group(spark):
    """All texts are near copies of one."""
    r = np.random.default_rng(3)
    base = [f"b{i}" for i in range(80)]
    data = []
    for i in range(150):
        w = list(base)
        for k in r.choice(80, 2, replace=False):
            w[k] = f"n{r.integers(1 << 30)}"
        data.append((i, " ".join(w)))
    _, label = brute_components(data)
    got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == label


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    with common.scratch(spark) as kept:
        _, gone = common.save(spark.range(3), "gone")
        df, path = common.save(spark.range(5), "stays")
        kept.append(path)
    local = lambda p: Path(p.removeprefix("file://"))
    assert df.count() == 5 and local(path).exists() and not local(gone).exists()
    common.discard(spark, path)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        @staticmethod
        def get(*_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "x"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i % 40, f"t{i}") for i in range(80)], "doc_id long, text string")
    sharding.write_shards(docs, f"file://{tmp_path}/shards", shards=5)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == 80 and back.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    placed = {r.doc_id: r.shard for r in sharding.place(docs, shards=5).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == placed


def test_units_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(piece_codec.PieceCodec, "MOST", 20)
    codec = piece_codec.PieceCodec(PIECES)
    r = np.random.default_rng(5)
    for _ in range(40):
        text = " ".join(f"w{x}" for x in r.integers(0, 60, 15))
        assert codec.encode([text.encode()])[0][0] == codec.model.encode(text, add_eos=True)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def leaks(texts, items):
    """Documents with an item: at least 70% of its words in order within twice its length, by plain dynamic programming."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.translate({c: c + 32 for c in range(65, 91)}))
    out, own = set(), [w for t in items for w in [words(t)] if len(w) >= 8]
    for i, t in texts.items():
        w = words(t)
        for item in own:
            n = len(item)
            if len(set(w) & set(item)) >= 0.7 * len(set(item)) and any(plain_lcs(item, w[k : k + 2 * n]) >= 0.7 * n for k in range(0, max(1, len(w) - n), max(1, n // 4))):
                out.add(i)
                break
    return out


def redacted(text):
    spots = []
    for turn, rule in enumerate(secrets.RULES):
        pattern = re.compile(rule.pattern, re.A | (re.I if rule.fold else 0))
        spots += [(m.start(), turn, rule.kind, m.end()) for m in pattern.finditer(text) if len(m.group(rule.group)) >= rule.least]
    out, at = "", 0
    for a, _, kind, b in sorted(spots):
        out += text[at:a] + f"[{kind}]" if a >= at else ""
        at = max(at, b)
    return out + text[at:]


def test_pipeline_against_plain_programs(spark, tmp_path):
    """Every stage by other means: SQL, all pairs, plain subsequences, Python's expressions and the library."""
    import sentencepiece

    duck = duckdb.connect()
    secret = "CASE WHEN doc_id % 5 = 0 THEN text || ' token = 12345678 AKIA' || repeat('Z', 16) || ' ' || repeat('0f', 12 + doc_id::INT % 3) ELSE text END"
    duck.execute(f"copy (select * replace ({secret} as text) from '{SF}/documents.parquet') to '{tmp_path}/documents.parquet'")
    for t in ("labels", "benchmark"):
        duck.execute(f"copy (from '{SF}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
    for t in ("documents", "labels", "benchmark"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    kept = {r[0] for r in duck.sql(f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept").fetchall()}
    texts = {i: t or "" for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall() if i in kept}
    _, label = brute_components(list(texts.items()))
    alone = {i: texts[i] for i, c in label.items() if i == c}
    bad = leaks(alone, [t for (t,) in duck.sql("SELECT text FROM benchmark WHERE text IS NOT NULL").fetchall()])
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {}
    for i in alone.keys() - bad:
        ids = library.encode(redacted(alone[i]), add_eos=True)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert bad and got == want
    assert any(redacted(t) != t for t in alone.values())


def test_last_stage(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "two words", "b"), (3, "", None)], "doc_id long, text string, found string")
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.sentencepiece_encoding(spark, docs, SF).collect()}
    assert got[1] == got[3] == 1 and got[None] > 1
    assert corpus_pipeline.sentencepiece_encoding(spark, docs.where("1 = 0"), SF).count() == 0
