"""MinHash near-dedup with odd sketches.

A document's set holds its distinct 5-word shingles (64-bit hashes; A-Z lower-cased). 128 MinHash samples make 32 bands
of 4, which give candidates, and are folded into a 512-bit parity bitmap (odd sketch); these and 512 more samples make a
4096-bit one. The population count of the XOR of two bitmaps estimates how many samples differ: the small one discards
candidates far below the threshold, the large one those below about 0.67. The rest are confirmed on the full sets of both
texts. A pair at the threshold of 0.75 shares no band with probability 5e-6, and is discarded by its sketches with about
the same probability.

Documents of one set are one node (their smallest doc_id stands for them), so exact copies never meet. In each band's
bucket all members are held against its smallest member only, and confirmed links are joined to components. Only where a
bucket still holds several components, its members outside the main one are held against all members of other
components; the sketch tests are part of that join, so pairs of one component are never made, and a pair comes from the
first band that it shares only.

Nulls and edge cases: null and empty texts have an empty set and are linked with nothing; a text of 1 to 4 words is one
shingle; a very long text is a chunk of its own and compared whole; a null doc_id is never linked, has a null component_id
and is kept; rows of one doc_id are one document, also where their texts differ; of equal sets the smallest doc_id stands
for all; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm import common
from girder.llm.common import Words, as_bytes, chunks, components, discard, mix, save

SHINGLE, PERCENT = 5, 75
SAMPLES, ROWS, BITS = 128, 4, 512
MORE_SAMPLES, FINE_BITS = 512, 4096
BANDS = SAMPLES // ROWS
MAX_APART = 110  # bits of two small sketches that may differ; at a similarity of 0.75 it is 57 on average, with a deviation below 10
FINE_APART = 386  # the same of large ones: 296 on average, with a deviation of 20

_MULTIPLY = np.random.default_rng(75).integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY_MORE = np.random.default_rng(76).integers(0, 2**31, MORE_SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts of n + 1 sets, all sets one after another), each set sorted."""
    words = Words(texts, lower=True)
    at, h = words.grams(SHINGLE)
    cuts = np.searchsorted(words.doc[at], np.arange(len(texts) + 1))
    sizes = np.diff(words.first)
    sets = []
    for i in range(len(texts)):
        if sizes[i] >= SHINGLE:
            sets.append(np.unique(h[cuts[i] : cuts[i + 1]]))
        elif sizes[i]:
            own = words.hash[words.first[i] : words.first[i + 1]]
            value = np.uint64(0)
            for x in own:
                value = mix(np.array([x ^ value], np.uint64), 11 + len(own))[0]
            sets.append(np.array([value], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))), np.concatenate(sets) if sets else np.empty(0, np.uint64)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps, as bits / 64 numbers each, of columns of samples."""
    k, n = samples.shape
    bit = mix(samples + np.arange(k, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15), 5) % np.uint64(bits)
    odd = np.zeros(n * bits, np.uint8)
    places, times = np.unique(bit.astype(np.int64) + np.arange(n) * bits, return_counts=True)
    odd[places] = times & 1
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def signatures(starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bands, small sketches, large sketches) of non-empty sets."""
    n = len(starts) - 1
    samples = np.empty((SAMPLES + MORE_SAMPLES, n), np.uint64)
    for i in range(SAMPLES):
        samples[i] = np.minimum.reduceat(values * _MULTIPLY[i], starts[:-1])
    half = (values >> np.uint64(32)).astype(np.uint32)
    for i in range(MORE_SAMPLES):
        samples[SAMPLES + i] = np.minimum.reduceat(half * _MULTIPLY_MORE[i], starts[:-1])
    samples = mix(samples)
    bands = np.zeros((BANDS, n), np.uint64)
    for r in range(ROWS):
        bands = mix(bands ^ samples[r:SAMPLES:ROWS], r + 1)
    bands = mix(bands + np.arange(BANDS, dtype=np.uint64)[:, None], 9)
    return bands.T.view(np.int64), odd_sketch(samples[:SAMPLES], BITS), odd_sketch(samples, FINE_BITS)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("fine", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=2 << 20):
        starts, values = shingle_sets(as_bytes(batch.column("text")))
        sizes = np.diff(starts)
        sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(values, s)))) for s in (21, 22)]
        k1, k2 = ((s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums)
        full = np.flatnonzero(sizes)
        made = signatures(np.append(starts[full], len(values)), values) if len(full) else (np.empty((0, BANDS), np.int64),) * 3
        where = np.full(len(sizes), -1)
        where[full] = np.arange(len(full))
        lists = [pa.array([rows[j] if j >= 0 else None for j in where], pa.list_(pa.int64())) for rows in made]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(k1), pa.array(k2), *lists], schema=_SIGNED)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text_b", 2 << 20):
        a, b = as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b"))
        own = {t: i for i, t in enumerate(dict.fromkeys(a))}
        (sa, va), (sb, vb) = shingle_sets(list(own)), shingle_sets(b)
        keep = []
        for i, t in enumerate(a):
            x, y = va[sa[own[t]] : sa[own[t] + 1]], vb[sb[i] : sb[i + 1]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts' full sets are similar."""
    one = docs.where("doc_id is not null")
    with_b = pairs.join(one.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(one.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def apart(x: str, y: str) -> F.Column:
    """Bits in which two small sketches differ."""
    return F.expr(" + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(BITS // 64)))


def close(x: str, y: str, fine_x: str, fine_y: str) -> F.Column:
    """Whether two documents' sketches leave a similarity at the threshold possible."""
    fine = F.aggregate(F.zip_with(fine_x, fine_y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return F.when(apart(x, y) <= MAX_APART, fine <= FINE_APART).otherwise(False)


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, signed_at = save(docs.mapInArrow(_sign, "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>, fine array<long>"), "op5-signed")
    sets = signed.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"))
    nodes = signed.where("n > 0").join(sets.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")

    bands = nodes.select("doc_id", F.posexplode("bands").alias("turn", "band"))
    pivots = bands.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot <> last").drop("last")
    members, members_at = save(bands.join(pivots, "band"), "op5-members")
    star = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    sketches = nodes.select("doc_id", "sketch", "fine")
    star = star.join(sketches.toDF("a", "x", "fx"), "a").join(sketches.toDF("b", "y", "fy"), "b").where(close("x", "y", "fx", "fy"))
    links, links_at = save(confirmed(star.select("a", "b").distinct(), docs), "op5-links")
    found, found_at = components(links)

    # What the stars leave open: buckets that still hold several components.
    placed = members.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = placed.groupBy("band").agg(F.min_by("component", "doc_id").alias("main"), F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("size")).where("least <> most and size > 2").select("band", "main")
    left = placed.where("doc_id <> pivot").join(several, "band")
    left = left.join(nodes.select("doc_id", "sketch", "fine", F.col("bands").alias("own")), "doc_id")
    others = left.where("component <> main").select("band", "turn", F.col("doc_id").alias("p"), F.col("component").alias("cp"), F.col("sketch").alias("x"), F.col("fine").alias("fx"), F.col("own").alias("op"))
    against = left.select(F.col("band").alias("bucket"), F.col("doc_id").alias("q"), F.col("component").alias("cq"), F.col("main").alias("mq"), F.col("sketch").alias("y"), F.col("fine").alias("fy"), F.col("own").alias("oq"))
    first = ~F.exists(F.slice(F.zip_with("op", "oq", lambda a, b: a == b), F.lit(1), F.col("turn")), lambda e: e)
    once = F.expr("cp <> cq and (cq = mq or p < q)")  # two others meet from either side
    rest = others.join(against, [F.col("band") == F.col("bucket"), F.when(once, F.when(close("x", "y", "fx", "fy"), first).otherwise(False)).otherwise(False)])
    rest, rest_at = save(rest.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "op5-rest")
    if not rest.isEmpty():
        more, more_at = save(links.union(confirmed(rest, docs)), "op5-links")
        discard(docs.sparkSession, found_at)
        found, found_at = components(more)
        discard(docs.sparkSession, more_at)
    discard(docs.sparkSession, links_at, rest_at, members_at)

    of_set = sets.join(found.withColumnRenamed("id", "node"), "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n", "k1", "k2").join(of_set, ["k1", "k2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that near-duplicate one of a smaller doc_id; rows of one doc_id stay or go together."""
    gone = near_dedup(docs).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM cut, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= {PERCENT} * (x.n + y.n - m)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM sides UNION SELECT r.node, s.b FROM reach r JOIN sides s ON s.a = r.other),
least_ AS (SELECT node, min(other) AS m FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM cut LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON node = doc_id"""
