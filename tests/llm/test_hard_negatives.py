"""Hard negatives: against all scores in plain Python, with ties, copies, clusters, wide and short vectors, and small blocks."""

import math

import numpy as np
import pytest

from girder.llm import hard_negatives
from girder.llm.queries import op11_hard_negatives


def plain(rows):
    live = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        live.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x]))
    out = []
    for i, (a, label, q) in enumerate(live):
        if a % 100:
            continue
        scored = sorted((-sum(u * v for u, v in zip(q, x)), b, j, other) for j, (b, other, x) in enumerate(live) if j != i)
        for ps, p, _, _ in [r for r in scored if r[3] == label][:5]:
            fits = [r for r in scored if r[3] != label and 80 * -ps <= 100 * -r[0] <= 100 * -ps][:5]
            out += [(a, p, k + 1, r[1], -ps, -r[0]) for k, r in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, label, "k", "s") for i, x, label in rows], "vec_id long, embedding array<float>, label int, block string, SCORE string").repartition(4)


def table(seed, n, width, scale=0.2, clusters=12):
    r = np.random.default_rng(seed)
    centres = r.normal(0, scale, (clusters, width))
    return [(int(i), [float(v) for v in centres[r.integers(clusters)] + r.normal(0, scale / 3, width)], int(r.integers(0, 10))) for i in range(n)]


def awkward():
    rows = table(1, 900, 12)
    rows += [(1000 + i, [0.25] * 12, i % 3) for i in range(400)]  # one frequent vector
    rows += [(100, [0.25] * 12, 1)] * 3 + [(200, [0.5] * 5, 2), (300, [], 3), (400, [0.0] * 12, 1), (500, [-0.3] * 12, 4), (-700, [0.1] * 12, 4)]
    bad = [(None, [0.1] * 12, 1), (600, None, 1), (700, [0.1, None] * 6, 1), (800, [0.1] * 12, None), (900, [float("nan")] * 12, 1), (1, [float("inf")] + [0.0] * 11, 1)]
    return rows + bad + rows[:120]  # repeats


@pytest.mark.parametrize("block,group,sample,tile", [(16_384, 4_096, 2048, 64), (50, 3, 40, 2), (200, 16, 1, 5)])
def test_against_all_scores(spark, monkeypatch, block, group, sample, tile):
    for name, value in (("BLOCK", block), ("GROUP", group), ("SAMPLE", sample), ("TILE", tile)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = awkward()
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows)).collect())
    want = plain(rows)
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("scale", [0.02, 40.0, 300_000.0])
def test_small_and_large_components(spark, scale):
    """Products in 32 and 64 bit floats and in whole numbers."""
    rows = table(2, 400, 6, scale)
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows)).collect()) == plain(rows)


def test_brackets_hold_and_exclude():
    r = np.random.default_rng(3)
    x = np.floor(r.normal(0, 50, (5, 16))[r.integers(0, 5, 600)] + r.normal(0, 3, (600, 16))).astype(np.int64)
    space = hard_negatives.Space(hard_negatives.spread(x, 16), float((x**2).sum(axis=1).max()), 16)
    ids = np.arange(600)
    tile = hard_negatives.Tile(space, x, space.of_rows(x).astype(np.float32), ids % 3, ids, ids)
    q, far = x[:50], space.of_anchors(x[:50]).astype(np.float32)
    exact = q @ x.T
    lo, hi = np.full(50, 0.9) * np.diag(exact[:, :50]), np.full(50, np.inf)
    rows, scores, survive = tile.scores(q, far, lo, hi)
    assert (scores == exact[:, rows]).all()
    whole = np.zeros(exact.shape, bool)
    whole[:, rows] = survive
    assert whole[exact >= lo[:, None]].all()  # no score that is asked for is excluded
    assert whole.mean() < 0.6  # and clusters elsewhere are


def test_groups_and_blocks_apart_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "GROUP", 16)
    met = []
    plain_pairs = hard_negatives.pairs
    monkeypatch.setattr(hard_negatives, "pairs", lambda g, b, w, s: met.append((plain_pairs(g, b, w, s).count(), g.count() * b.count())) or plain_pairs(g, b, w, s))
    rows = [(i, [float(v) for v in np.eye(8)[i % 8] * 2 + np.random.default_rng(i).normal(0, 0.02, 8)], i // 8 % 10) for i in range(2000)]
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows)).collect()) == plain(rows)
    assert met[1][0] < met[1][1] / 2


def test_edges(spark):
    none = frame(spark, awkward()).where("1 = 0")
    assert hard_negatives.hard_negatives(none).count() == 0
    few = [(1, [0.5, 0.5], 1), (2, [0.5, 0.25], 2)]
    assert hard_negatives.hard_negatives(frame(spark, few)).count() == 0  # no anchor
    few.append((100, [0.5, 0.5], 1))
    assert sorted(map(tuple, hard_negatives.hard_negatives(frame(spark, few)).collect())) == plain(few)
    with pytest.raises(ValueError, match="64 bits"):
        hard_negatives.hard_negatives(frame(spark, [(100, [1e30], 1), (101, [1e30], 1)]))


def test_query_over_the_given_table(spark):
    import duckdb

    rows = duckdb.sql("select vec_id, embedding, label from '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    assert sorted(map(tuple, op11_hard_negatives(spark, "/root/testdata/sf0.01").collect())) == plain(rows)
