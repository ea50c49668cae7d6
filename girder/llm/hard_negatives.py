"""Hard negatives by a pivot table.

Rows become integer vectors x. With M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and an anchor q' = (q, 0), so that
|q' - x'|^2 = M^2 + |q|^2 - 2 q.x: the largest inner product is the least distance. A table holds each row's distances to PIVOTS
of these points. By the triangle inequality the largest difference and the least sum of an anchor's and a row's distances
bracket their distance, and so their score; only rows whose bracket meets the scores that an anchor asks for are multiplied.

Rows are dealt by their nearest pivot and the distance to it into blocks of at most BLOCK rows, anchors likewise into groups of at
most GROUP. Blocks and groups know the least and the largest distance to each pivot. A pair of them whose brackets exclude each
other is not dealt at all; the others meet as one task each, which tests row by row in tiles and multiplies the survivors,
so what a task holds is bounded however frequent a vector or a label is. Each pair sends at most POSITIVES (then NEGATIVES) rows
an anchor (a positive), its first ones in the final order, and their first ones are taken over all pairs; nothing is dropped.

Two searches follow each other: positives ask for scores above a floor, then negatives for those between SHARE percent of the
positive's score and that score. Both floors start from what a sample of at most SAMPLE rows already gives, which shortens the
search and decides nothing.

Nulls and edge cases: rows with a null vec_id, label or vector or a null or non-finite component take no part; components
missing at the end of a shorter vector are 0, so an empty vector scores 0 with all; rows that repeat are rows of their own (two
anchors of one vec_id each get their results); ties go to the smaller vec_id; vectors whose products leave 2**62 are an
error; an empty table gives an empty result; a positive without negatives in its range gives none; only vec_id, embedding and
label are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from girder.llm.common import save

EVERY, RELABELLED, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES, SHARE = 5, 5, 80
PIVOTS, SAMPLE = 16, 2048
BLOCK, GROUP, TILE, DEALS = 16_384, 4_096, 64, 16

CELLS = 1 << 21  # numbers of a block or group at most, for wide vectors
INT = pa.list_(pa.int64())


def rows_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, x, norm2) of the rows that take part."""
    x, whole = F.col("embedding"), F.col("vec_id").cast("long")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col("label").cast("long")
    valid = embeddings.where(whole.isNotNull() & label.isNotNull() & x.isNotNull() & finite)
    relabelled = F.when(whole % RELABELLED == 0, (label + 1) % LABELS).otherwise(label)
    floored = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    out = valid.select(whole.alias("vec_id"), relabelled.alias("label"), floored.alias("x"))
    return out.withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v))


def flat(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    """A matrix of the lists, filled with zeros where they are shorter."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(column), width).astype(dtype)
    out = np.zeros((len(column), width), dtype)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """a.b^T as whole numbers; `most` bounds every partial sum, so floats that hold it exactly do."""
    if most < 2**24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Space:
    """The pivots, which all tasks know: bounded by PIVOTS and the width of a vector."""

    def __init__(self, points: np.ndarray, most2: float, width: int):
        self.points, self.most2, self.width = points, most2, width
        self.last = np.sqrt(np.maximum(0, most2 - (points.astype(np.float64) ** 2).sum(axis=1)))
        self.slack = 1 + 1e-5 * most2  # distances are kept in 32 bits

    def _to(self, x: np.ndarray, own2: np.ndarray, last: np.ndarray) -> np.ndarray:
        d2 = own2[:, None] + self.most2 - 2 * (x.astype(np.float64) @ self.points.T.astype(np.float64) + last[:, None] * self.last)
        return np.sqrt(np.maximum(0, d2))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        n2 = (x.astype(np.float64) ** 2).sum(axis=1)
        return self._to(x, np.full(len(x), self.most2), np.sqrt(np.maximum(0, self.most2 - n2)))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return self._to(x, (x.astype(np.float64) ** 2).sum(axis=1), np.zeros(len(x)))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows far from one another: each the farthest from those before it."""
    x = x.astype(np.float64)
    chosen = [int((x**2).sum(axis=1).argmax())]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def pivot_table(rows: DataFrame, space: Space, anchors: bool, size: int, label: str) -> DataFrame:
    """Rows with their distances `far` and their block of at most `size` rows with close distances, written."""
    spark = rows.sparkSession

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = flat(b.column("x"), space.width, np.float64)
                far = (space.of_anchors if anchors else space.of_rows)(x)
                near = far.argmin(axis=1)
                far32 = pa.ListArray.from_arrays(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32), far.astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([*b.columns, far32, pa.array(near, pa.int32()), pa.array(far.min(axis=1))], names=[*b.schema.names, "far", "near", "depth"])

    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    found, _ = save(rows.mapInArrow(measured, f"{fields}, far array<float>, near int, depth double"), f"op11-{label}-far")
    count, size = found.count(), max(1, min(size, CELLS // max(1, space.width)))
    parts = max(-(-count // size) * 2, 1 if anchors else min(spark.sparkContext.defaultParallelism, -(-count // 512)), 1)
    ordered = found.repartitionByRange(parts, "near", "depth", "rid").sortWithinPartitions("near", "depth", "rid").withColumn("place", F.monotonically_increasing_id())
    placed, _ = save(ordered.drop("near", "depth"), f"op11-{label}")
    # a row's number over all ranges: the rows of the ranges before it, a number for each range, are added
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    numbered = placed.withColumn("part", part).join(F.broadcast(before), "part")
    return numbered.withColumn("block", F.expr(f"(before + (place & {(1 << 33) - 1})) DIV {size}")).drop("part", "before", "place")


def extent(table: DataFrame, key: str, prefix: str) -> DataFrame:
    """The least and the largest distance to each pivot over each block: lists of PIVOTS numbers."""
    each = table.select(key, F.posexplode("far").alias("p", "d"), "norm2").groupBy(key, "p").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("norm2").alias("n2"))
    ordered = F.array_sort(F.collect_list(F.struct("p", "lo", "hi")))
    return each.groupBy(key).agg(F.transform(ordered, lambda s: s["lo"]).alias(f"{prefix}lo"), F.transform(ordered, lambda s: s["hi"]).alias(f"{prefix}hi"), F.max("n2").alias(f"{prefix}n2"))


def pairs(groups: DataFrame, blocks: DataFrame, wanted: DataFrame, space: Space) -> DataFrame:
    """(grp, block) that may hold scores between a group's least floor and largest ceiling; the stated anchors against all
    rows, in blocks. `wanted` has floor and ceiling by anchor."""
    asked = wanted.groupBy("grp").agg(F.min("floor").alias("floor"), F.max("ceiling").alias("ceiling")).join(groups, "grp")
    listed = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    dealt = blocks.withColumn("deal", F.pmod("block", F.lit(DEALS)).cast("int"))
    met = listed.join(dealt, "deal")
    apart = F.zip_with(F.zip_with("glo", "bhi", lambda a, b: a - b), F.zip_with("blo", "ghi", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
    least = F.greatest(F.lit(0.0), F.array_max(apart).cast("double"))
    most = F.array_min(F.zip_with("ghi", "bhi", lambda a, b: a + b)).cast("double")
    top = (F.lit(space.most2) + F.col("gn2") - least * least) / 2 + space.slack
    bottom = F.lit(space.most2) / 2 - most * most / 2 - space.slack  # the least |q|^2 is not below 0
    return met.where((top >= F.col("floor")) & (bottom <= F.col("ceiling"))).select("grp", "block")


class Tile:
    """A block of rows, in the order of vec_id, and what tells which of them a few anchors need."""

    def __init__(self, space: Space, x: np.ndarray, far: np.ndarray, label: np.ndarray, rid: np.ndarray, vec_id: np.ndarray):
        order = np.lexsort((rid, vec_id))  # so that of equal scores the first is the smaller vec_id
        self.space, self.x, self.far, self.label, self.rid, self.vec_id = space, x[order], far[order].T.copy(), label[order], rid[order], vec_id[order]

    def scores(self, q: np.ndarray, far: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, their scores by anchor, whether the bracket of that pair meets floor and ceiling)."""
        least, most = np.zeros((len(q), self.x.shape[0]), np.float32), np.full((len(q), self.x.shape[0]), np.inf, np.float32)
        for p in range(self.far.shape[0]):
            a, b = far[:, p, None], self.far[p]
            np.maximum(least, np.abs(a - b), out=least)
            np.minimum(most, a + b, out=most)
        n2 = (q.astype(np.float64) ** 2).sum(axis=1)
        base = self.space.most2 + n2[:, None]
        survive = ((base - least.astype(np.float64) ** 2) / 2 + self.space.slack >= floor[:, None]) & ((base - most.astype(np.float64) ** 2) / 2 - self.space.slack <= ceiling[:, None])
        rows = np.flatnonzero(survive.any(axis=0))
        bound = np.sqrt(n2.max(initial=0) * self.space.most2)
        return rows, products(q, self.x[rows], bound), survive[:, rows]


def first(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores, in order; of equal ones those that stand first."""
    if len(scores) > 8 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = np.flatnonzero(scores >= least)
        return near[np.argsort(-scores[near], kind="stable")[:n]]
    return np.argsort(-scores, kind="stable")[:n]


def positives_in(tile: Tile, q: np.ndarray, far: np.ndarray, label: np.ndarray, rid: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows of the tile, scores) of each anchor's first positives there."""
    for at in range(0, len(q), TILE):
        to = slice(at, at + TILE)
        rows, s, survive = tile.scores(q[to], far[to], floor[to], np.full(len(q[to]), np.inf))
        asked = survive & (s >= floor[to][:, None]) & (tile.label[rows] == label[to][:, None]) & (tile.rid[rows] != rid[to][:, None])
        for i in np.flatnonzero(asked.any(axis=1)):
            has = np.flatnonzero(asked[i])
            best = first(s[i, has], POSITIVES)
            yield at + i, rows[has[best]], s[i, has[best]]


def negatives_in(tile: Tile, q: np.ndarray, far: np.ndarray, label: np.ndarray, positive: list[np.ndarray], floors: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, which of its positives, rows, scores) of each positive's first negatives there; floors are at least SHARE percent of the
    positive's score."""
    lowest, highest = np.array([f.min() for f in floors], np.float64), np.array([p.max() for p in positive], np.float64)
    for at in range(0, len(q), TILE):
        to = slice(at, at + TILE)
        rows, s, survive = tile.scores(q[to], far[to], lowest[to], highest[to])
        asked = survive & (s >= lowest[to][:, None]) & (s <= highest[to][:, None]) & (tile.label[rows] != label[to][:, None])
        for i in np.flatnonzero(asked.any(axis=1)):
            has = np.flatnonzero(asked[i])
            own = s[i, has]
            for k, (p, floor) in enumerate(zip(positive[at + i], floors[at + i])):
                fits = np.flatnonzero((own <= p) & (own >= floor))
                if len(fits):
                    best = fits[first(own[fits], NEGATIVES)]
                    yield at + i, k, rows[has[best]], own[best]


def numbers(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return batch.column(name).to_numpy() if isinstance(batch, pa.Table) else batch.column(name).to_numpy(zero_copy_only=False)


def lists(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def tile_of(space: Space, table: pa.Table) -> Tile:
    return Tile(space, flat(lists(table, "x"), space.width, np.int64), flat(lists(table, "far"), len(space.points), np.float32), numbers(table, "label"), numbers(table, "rid"), numbers(table, "vec_id"))


def merged(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows of each key by score, vec_id and place; each pair of blocks has sent its first ones."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = embeddings.sparkSession
    rows, _ = save(rows_of(embeddings).withColumn("rid", F.monotonically_increasing_id()), "op11-rows")
    most2, width, count = rows.agg(F.max("norm2"), F.max(F.size("x")), F.count(F.lit(1))).first()
    if not count:
        return spark.createDataFrame([], schema)
    if most2 >= 2**62:
        raise ValueError("vectors are so long that their products do not fit 64 bits")
    # pivots and first floors come from a bounded sample, the least digests; it is at most SAMPLE vectors
    sample = rows.orderBy(F.xxhash64("vec_id", "rid"), "rid").limit(SAMPLE).toArrow()
    known = flat(lists(sample, "x"), width, np.int64)
    space = Space(spread(known, PIVOTS), float(most2), width)
    seeds = Tile(space, known, space.of_rows(known).astype(np.float32), numbers(sample, "label"), numbers(sample, "rid"), numbers(sample, "vec_id"))
    inf = float("inf")

    table = pivot_table(rows, space, False, BLOCK, "rows")
    anchors = pivot_table(rows.where(F.col("vec_id") % EVERY == 0), space, True, GROUP, "anchors").withColumnRenamed("block", "grp").withColumnRenamed("rid", "anchor_rid").withColumnRenamed("vec_id", "anchor_id")
    blocks, _ = save(extent(table, "block", "b").drop("bn2"), "op11-blocks")
    groups, _ = save(extent(anchors, "grp", "g"), "op11-groups")

    def anchor_parts(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches([t]) if isinstance(t, pa.RecordBatch) else t
        return flat(lists(t, "x"), width, np.int64), flat(lists(t, "far"), len(space.points), np.float32), numbers(t, "label"), numbers(t, "anchor_rid")

    def first_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, far, label, rid = anchor_parts(b)
                floor = np.full(len(q), -inf)
                for i, _, s in positives_in(seeds, q, far, label, rid, floor.copy()):
                    if len(s) == POSITIVES:
                        floor[i] = s[-1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floor)], names=[*b.schema.names, "floor"])

    fields = ", ".join(f"{n} {t}" for n, t in anchors.dtypes)
    asked, _ = save(anchors.mapInArrow(first_floor, f"{fields}, floor double"), "op11-asked")

    def meet(wanted: DataFrame, f, out: str) -> DataFrame:  # noqa: ANN001
        chosen, _ = save(pairs(groups, blocks, wanted, space), "op11-pairs")
        a, d = wanted.join(chosen, "grp"), table.join(chosen, "block")
        return a.groupBy("grp", "block").cogroup(d.groupBy("grp", "block")).applyInArrow(f, out)

    def positive(a: pa.Table, d: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if a.num_rows and d.num_rows:
            tile, (q, far, label, rid) = tile_of(space, d), anchor_parts(a)
            for i, r, s in positives_in(tile, q, far, label, rid, numbers(a, "floor")):
                for column, values in zip(out, (np.full(len(r), rid[i]), tile.rid[r], tile.vec_id[r], s)):
                    column.append(values)
        return pa.table({n: np.concatenate(c) if c else np.empty(0, np.int64) for n, c in zip(("anchor_rid", "rid", "vec_id", "score"), out)})

    near = meet(asked.withColumn("ceiling", F.lit(inf)), positive, "anchor_rid long, rid long, vec_id long, score long")
    best, _ = save(merged(near, ["anchor_rid"], POSITIVES), "op11-positives")
    listed = best.groupBy("anchor_rid").agg(F.array_sort(F.collect_list(F.struct("rank", "rid", "vec_id", "score"))).alias("p"))  # at most POSITIVES an anchor
    columns = [F.col(f"p.{c}").alias(n) for c, n in (("rid", "p_rid"), ("vec_id", "p_id"), ("score", "p_score"))]
    with_positives = anchors.join(listed, "anchor_rid").select(*anchors.columns, *columns)

    def split(t: pa.Table, name: str) -> list[np.ndarray]:
        column = lists(t, name)
        return np.split(column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()[1:-1] - column.offsets.to_numpy()[0])

    def next_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, far, label, _ = anchor_parts(b)
                scores = split(pa.Table.from_batches([b]), "p_score")
                floors = [-(-SHARE * s // 100) for s in scores]
                for i, k, _, s in negatives_in(seeds, q, far, label, scores, [f.copy() for f in floors]):
                    if len(s) == NEGATIVES:
                        floors[i][k] = max(floors[i][k], s[-1])
                lows = pa.array([f.tolist() for f in floors], INT)
                yield pa.RecordBatch.from_arrays([*b.columns, lows, pa.array([float(f.min()) for f in floors]), pa.array([float(s.max()) for s in scores])], names=[*b.schema.names, "floors", "floor", "ceiling"])

    fields = ", ".join(f"{n} {t}" for n, t in with_positives.dtypes)
    asked, _ = save(with_positives.mapInArrow(next_floor, f"{fields}, floors array<long>, floor double, ceiling double"), "op11-asked")

    def negative(a: pa.Table, d: pa.Table) -> pa.Table:
        names = ("anchor_rid", "anchor_id", "p_rid", "positive_id", "positive_score", "rid", "vec_id", "score")
        out = [[] for _ in names]
        if a.num_rows and d.num_rows:
            tile, (q, far, label, rid) = tile_of(space, d), anchor_parts(a)
            ids, p_rid, p_id, p_score, floors = numbers(a, "anchor_id"), split(a, "p_rid"), split(a, "p_id"), split(a, "p_score"), split(a, "floors")
            for i, k, r, s in negatives_in(tile, q, far, label, p_score, floors):
                same = [np.full(len(r), v) for v in (rid[i], ids[i], p_rid[i][k], p_id[i][k], p_score[i][k])]
                for column, values in zip(out, (*same, tile.rid[r], tile.vec_id[r], s)):
                    column.append(values)
        return pa.table({n: np.concatenate(c) if c else np.empty(0, np.int64) for n, c in zip(names, out)})

    found = meet(asked, negative, "anchor_rid long, anchor_id long, p_rid long, positive_id long, positive_score long, rid long, vec_id long, score long")
    return merged(found, ["anchor_rid", "p_rid"], NEGATIVES).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
WITH valid AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % {RELABELLED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), padded AS (SELECT rid, vec_id, label, list_resize(x, greatest(1, (SELECT max(len(x)) FROM valid)), 0.0) AS x FROM valid
), scores AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM padded a JOIN padded b ON a.rid <> b.rid WHERE a.vec_id % {EVERY} = 0
), positives AS (
  SELECT anchor, anchor_id, rid AS positive, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id, rid)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor = s.anchor AND NOT same AND {SHARE} * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id, rid) <= {NEGATIVES}"""
