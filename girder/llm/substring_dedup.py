"""Exact substring dedup with fixed-block anchors.

Every text is cut into non-overlapping blocks of BLOCK words, which are the index. Every rolling window of BLOCK words
probes it. A run of WINDOW >= 2 * BLOCK - 1 words that occurs twice holds a whole block of the other occurrence, so a
probe inside it hits. Hits are extended by WINDOW - BLOCK words to both sides, which gives the only windows that can
repeat; their full hashes are then counted, which trims every extension to the maximal exact repeat. No pairs of
occurrences are formed: an occurrence only learns whether another one exists, so groups of copies cost linear work.

Probes and blocks are dealt to buckets of about BUCKET_BYTES of text by their hash. What a chunk of texts can settle by
itself is not dealt: a probe with another block of its hash in the chunk is a hit, and of a full window that a chunk holds
several times one is dealt, marked so. So however many texts hold a passage, a bucket gets few of its occurrences from
each chunk. With many buckets, the hashes of several chunks are dealt together, so that a bucket gets enough of them in a row;
chunks and what is held stay as small however large the table. Beyond WIDE buckets a chunk's share of one would be too small, so texts are dealt to WIDE first, and each of
those is dealt further.

Nulls and edge cases: a null text has no words; a null doc_id is kept as null; rows that repeat are occurrences of their
own, so copies of a row lose their repeated windows; texts shorter than WINDOW words lose nothing; a text longer than a
chunk is a chunk of its own; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm import common
from girder.llm.common import Words, as_bytes, chunks, save

WINDOW, BLOCK = 35, 18
BUCKET_BYTES = 16 << 20  # text bytes whose probes share a bucket
WIDE = 1 << 16  # buckets that texts are dealt to at once
CHUNK = 2 << 20  # text bytes that one numpy pass handles here
PER_ROW = 32  # hashes of a bucket that share a row, on average and at least
HELD = 32 << 20  # bytes of hashes of one bucket that are dealt further together

_DEALT = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("marks", pa.binary()), ("parts", pa.binary()), ("settled", pa.bool_())])
_SHAPE = "bucket long, ids binary, counts binary, hashes binary, marks binary, parts binary, settled boolean"


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    """What rows go by here: doc_id, or for a null one the text's hash. Rows that share it share hits, which are candidates, and
    windows that occur once, which only one of them holds."""
    return batch.column("rid").to_numpy(zero_copy_only=False)


def _dealt(ids: np.ndarray, docs: np.ndarray, bucket: np.ndarray, hashes: np.ndarray, marks: np.ndarray, fine: int = 1, settled: bool = False) -> pa.RecordBatch:
    """One row for each bucket: the hashes that fall into it, by text, with a mark bit for each. With `fine` > 1 that many
    buckets share a row, and `parts` tells them apart."""
    wide = bucket // fine
    order = np.argsort(wide, kind="stable")
    docs, hashes, marks, wide, parts = docs[order], hashes[order], marks[order], wide[order], (bucket % fine)[order].astype(np.uint32)
    starts = np.flatnonzero(np.diff(wide, prepend=-1))
    rows: list[tuple] = []
    for a, b in zip(starts, np.append(starts[1:], len(wide))):
        turn = np.flatnonzero(np.diff(docs[a:b], prepend=-1))
        rows.append((int(wide[a]), np.diff(ids[docs[a:b][turn]], prepend=0).tobytes(), np.diff(np.append(turn, b - a)).astype(np.uint32).tobytes(), hashes[a:b].tobytes(), np.packbits(marks[a:b]).tobytes(), parts[a:b].tobytes() if fine > 1 else None, settled))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _DEALT)], schema=_DEALT)


def _gathered(rows: pa.Table | pa.RecordBatch, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, mark) of all that was dealt to one bucket."""
    ids, hashes, marks = [np.empty(0, np.int64)], [np.empty(0, kind)], [np.empty(0, bool)]
    for i, c, h, m in zip(*(rows.column(x).to_pylist() for x in ("ids", "counts", "hashes", "marks"))):
        h = np.frombuffer(h, kind)
        ids.append(np.repeat(np.cumsum(np.frombuffer(i, np.int64)), np.frombuffer(c, np.uint32)))
        hashes.append(h)
        marks.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)).astype(bool))
    return np.concatenate(ids), np.concatenate(hashes), np.concatenate(marks)


class _Merge:
    """Rows of several chunks are dealt together until there are enough for all buckets: at most WIDE * PER_ROW hashes and a chunk's."""

    def __init__(self, wide: int, fine: int, settled: bool = False):
        self.least, self.fine, self.settled, self.parts = wide * PER_ROW, fine, settled, []

    def add(self, ids: np.ndarray, docs: np.ndarray, bucket: np.ndarray, hashes: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        """docs are places in ids, in order."""
        new = np.diff(docs, prepend=-1) != 0
        self.parts.append((ids[docs[new]], np.cumsum(new) - 1, bucket, hashes, marks))
        if sum(len(p[1]) for p in self.parts) >= self.least:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            before = np.cumsum([0, *(len(p[0]) for p in self.parts[:-1])])
            ids, docs = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] + b for p, b in zip(self.parts, before)])
            bucket, hashes, marks = (np.concatenate(x) for x in list(zip(*self.parts))[2:])
            self.parts.clear()
            yield _dealt(ids, docs, bucket, hashes, marks, self.fine, self.settled)


def _further(fine: int, kind: type) -> Callable:
    """Deals rows of WIDE buckets, sorted by bucket, to `fine` buckets each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for settled in (False, True):
                own = pa.Table.from_batches(held).filter(pc.equal(pc.field("settled"), settled))
                if own.num_rows:
                    ids, hashes, marks = _gathered(own, kind)
                    parts = np.concatenate([np.frombuffer(x, np.uint32) for x in own.column("parts").to_pylist()]).astype(np.int64)
                    new = np.diff(ids, prepend=ids[0] - 1) != 0
                    yield _dealt(ids[new], np.cumsum(new) - 1, held[0].column("bucket")[0].as_py() * fine + parts, hashes, marks, 1, settled)
            held.clear()
            size = 0

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if held and (row.column("bucket")[0] != held[0].column("bucket")[0] or size >= HELD):
                    yield from emptied()
                held.append(row)
                size += len(row.column("hashes")[0].as_py())
        if held:
            yield from emptied()

    return run


def _in_buckets(dealt: DataFrame, wide: int, fine: int, kind: type, answer: Callable) -> DataFrame:
    """(rid, key): what each bucket answers."""
    if fine > 1:
        dealt = dealt.repartition(wide, "bucket").sortWithinPartitions("bucket").mapInArrow(_further(fine, kind), _SHAPE)
    return dealt.repartition(wide * fine, "bucket").groupBy("bucket").applyInArrow(answer, "rid long, key int" if kind is np.uint32 else "rid long, key long")


def _found(ids: np.ndarray, keys: np.ndarray) -> pa.Table:
    return pa.table([pa.array(ids, pa.int64()), pa.array(keys.view(f"i{keys.itemsize}"))], ["rid", "key"])


def _split(g: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and low half, which is what probes of a bucket are compared by, and the hits of a text told apart: two windows of one
    text that share it only make a candidate more."""
    return ((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), g.astype(np.uint32)


def _settled(key: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probes with another block of their key here, probes to deal: all others, and a block of each key to stand for the rest)."""
    order = np.lexsort((~block, key))  # of each key its blocks first
    k, b = key[order], block[order]
    start = np.concatenate(([True], k[1:] != k[:-1]))
    blocks = np.add.reduceat(b.astype(np.int64), np.flatnonzero(start))[np.cumsum(start) - 1]
    hit, deal = np.empty(len(key), bool), np.empty(len(key), bool)
    hit[order] = blocks - b >= 1
    deal[order] = (blocks - b < 1) | start & b
    return hit, deal


def _probes(wide: int, fine: int) -> Callable:
    buckets = wide * fine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = _Merge(wide, fine), _Merge(wide, fine, True)
        for batch in chunks(batches, limit=CHUNK):
            words = Words(as_bytes(batch.column("text")))
            at, g = words.grams(BLOCK)
            if not len(at):
                continue
            docs, ids = words.doc[at], _ids(batch)
            bucket, key = _split(g, buckets)
            block = (at - words.first[docs]) % BLOCK == 0
            hit, deal = _settled(bucket.view(np.uint64) << np.uint64(32) | key, block)
            yield from open_.add(ids, docs[deal], bucket[deal], key[deal], block[deal])
            # hits go by their text, not by their key, which may be frequent
            yield from done.add(ids, docs[hit], (ids[docs[hit]].view(np.uint64) % np.uint64(buckets)).astype(np.int64), key[hit], block[hit])
        yield from open_.rest()
        yield from done.rest()

    return run


def _hits(table: pa.Table) -> pa.Table:
    """Probes that equal an indexed block other than themselves."""
    ids, low, block = _gathered(table.filter(pc.invert(table.column("settled"))), np.uint32)
    own_ids, own_keys, _ = _gathered(table.filter(table.column("settled")), np.uint32)
    index, times = np.unique(low[block], return_counts=True)
    if len(index):
        at = np.minimum(np.searchsorted(index, low), len(index) - 1)
        hit = (index[at] == low) & (times[at] > block)
        own_ids, own_keys = np.concatenate((own_ids, ids[hit])), np.concatenate((own_keys, low[hit]))
    order = np.lexsort((own_keys, own_ids))
    own_ids, own_keys = own_ids[order], own_keys[order]
    first = np.ones(len(order), bool)
    first[1:] = (own_ids[1:] != own_ids[:-1]) | (own_keys[1:] != own_keys[:-1])
    return _found(own_ids[first], own_keys[first])


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), values.view(f"u{values.itemsize}")


def _pair(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return common.mix(keys.astype(np.uint64) + common.mix(rows.astype(np.uint64), 7), 3)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_EXTENDED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("text", pa.string()), ("runs", pa.binary()), ("kept_sha256", pa.string())])


def _extend(buckets: int) -> Callable:
    """Each text with the starts of its windows that can repeat, as runs; texts without any are done with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            texts = as_bytes(batch.column("text"))
            words = Words(texts)
            at, g = words.grams(BLOCK)
            rows, keys = _listed(batch.column("hits"))
            hit = at[np.isin(_pair(words.doc[at], _split(g, buckets)[1]), _pair(rows, keys))] if len(rows) else at[:0]
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, np.maximum(hit - (WINDOW - BLOCK), words.first[words.doc[hit]]), 1)
            np.add.at(mark, hit + 1, -1)
            last = np.repeat(words.first[1:], np.diff(words.first)) - WINDOW  # the last start in each text
            able = (np.cumsum(mark)[:-1] > 0) & (np.arange(len(words)) <= last)
            out: list[tuple] = []
            for i, (text, rid, id_) in enumerate(zip(texts, _ids(batch).tolist(), batch.column("doc_id").to_pylist())):
                a, b = words.first[i], words.first[i + 1]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], able[a:b], [0]))))
                out.append((rid, id_, b - a, text.decode(), edge.astype(np.uint32).tobytes(), None) if len(edge) else (rid, id_, b - a, None, None, _sha(text.split())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _EXTENDED)], schema=_EXTENDED)

    return run


def _windows(words: Words, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, bucket hash) of the windows that can repeat."""
    mark = np.zeros(len(words) + 1, np.int8)
    for i, r in enumerate(runs):
        edge = np.frombuffer(r, np.uint32).astype(np.int64) + words.first[i]
        mark[edge[::2]] += 1
        mark[edge[1::2]] -= 1
    able = np.cumsum(mark, dtype=np.int8)[:-1] > 0
    at, h = words.grams(WINDOW)
    _, other = words.grams(WINDOW, 1)
    use = able[at]
    return at[use], h[use], other[use]


def _count(wide: int, fine: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = _Merge(wide, fine)
        for batch in chunks(batches, limit=CHUNK):
            words = Words(as_bytes(batch.column("text")))
            at, h, other = _windows(words, batch.column("runs").to_pylist())
            if not len(at):
                continue
            h, one, times = np.unique(h, return_index=True, return_counts=True)
            order = np.argsort(one)
            h, one, times = h[order], one[order], times[order]
            yield from open_.add(_ids(batch), words.doc[at[one]], (other[one] % np.uint64(wide * fine)).astype(np.int64), h, times > 1)
        yield from open_.rest()

    return run


def _single(table: pa.Table) -> pa.Table:
    """Windows that occur once: far fewer than those that repeat, so these are what is sent back."""
    ids, h, several = _gathered(table, np.uint64)
    order = np.argsort(h)
    s = h[order]
    alone = ~several[order]
    same = s[1:] == s[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    return _found(ids[order[alone]], s[alone])


_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _remove(keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            texts = as_bytes(batch.column("text"))
            words = Words(texts)
            at, h, _ = _windows(words, batch.column("runs").to_pylist())
            rows, keys = _listed(batch.column("single"))
            again = at[~np.isin(_pair(words.doc[at], h), _pair(rows, keys))]
            cover = np.zeros(len(words) + 1, np.int64)
            cover[again] += 1
            cover[again + WINDOW] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            out: list[tuple] = []
            for i, (text, id_) in enumerate(zip(texts, batch.column("doc_id").to_pylist())):
                lost = gone[words.first[i] : words.first[i + 1]]
                kept = b" ".join(compress(text.split(), ~lost))
                out.append((id_, len(lost), int(lost.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DONE)], schema=_DONE)

    return run


def substring_dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null where nothing was removed or keep_text is false)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("rid", F.coalesce("doc_id", F.xxhash64("text")))
    buckets = max(64, -(-common.text_bytes(docs) // BUCKET_BYTES))
    fine = -(-buckets // WIDE)
    wide = min(buckets, WIDE)

    hits = _in_buckets(docs.mapInArrow(_probes(wide, fine), _SHAPE), wide, fine, np.uint32, _hits)
    hits = hits.groupBy("rid").agg(F.collect_set("key").alias("hits"))
    both = docs.join(hits, "rid", "left").select("rid", "doc_id", "text", "hits")
    extended, _ = save(both.mapInArrow(_extend(wide * fine), "rid long, doc_id long, n_words long, text string, runs binary, kept_sha256 string"), "op1-extended")

    open_ = extended.where("runs is not null").select("rid", "doc_id", "text", "runs")
    single = _in_buckets(open_.mapInArrow(_count(wide, fine), _SHAPE), wide, fine, np.uint64, _single)
    single = single.groupBy("rid").agg(F.collect_set("key").alias("single"))
    both = open_.join(single, "rid", "left").select("doc_id", "text", "runs", "single")
    removed = both.mapInArrow(_remove(keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    clean = extended.where("runs is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    return clean.unionByName(removed)


ORACLE = r"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
each AS (SELECT rid, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM base),
win AS (SELECT rid, i, array_to_string(words[i:i + 34], ' ') AS w FROM base, LATERAL (SELECT unnest(range(1, len(words) - 33)) AS i)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY w) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT rid, i + j AS i FROM again, (SELECT unnest(range(0, 35)) AS j)),
kept AS (SELECT rid, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY each.i) FILTER (gone.i IS NULL) AS text FROM each LEFT JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM base LEFT JOIN kept USING (rid)"""
