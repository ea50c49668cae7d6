"""Benchmark decontamination by latent semantic retrieval.

Words (runs of letters, digits and bytes from 0x80 on, A-Z lower-cased) are hashed to FEATURES. Document frequencies over
all passages of PASSAGE words give the inverse weights. A randomised SVD of TF-IDF passages, those of the benchmark and a
bounded sample of the corpus, gives a basis of RANK directions: tasks multiply their passages with a random matrix and
back, which gives an image of the passages' range, a table of FEATURES rows; the small matrices of its products with itself
and with the passages tell how to turn it into orthogonal, then singular directions, each of which is divided by its
singular value: what nearly all passages share, such as a language, would else decide. The driver handles nothing but
these small matrices and the inverse weights. The basis is the index and is fitted on at most SAMPLE passages; the search
covers every window of every text.

Windows of PASSAGE words, STEP apart, are projected and held against all passages of all items: PASSAGE words each, half of
them shared with the next, the last up to the item's end; those with a cosine of at least COSINE make the item a candidate.
An item of fewer than SHORT words is a small part of a window and may be told apart too little by RANK directions. It is also a
candidate where one of its RARE rarest runs of RUN words stands in a text unbroken: those that the fewest items share, then
those of the greatest inverse weights. So an opening that all questions share names none of them, and a place names as many
items as share all but all of their runs. From SHORT words on the cosine finds all there is but for a few in a hundred.
The words where the item would then stand, with half an item around, are verified by the longest common subsequence: it is
found where it covers at least SAME of the item's words, or at least CLOSE of them and the item's answer stands there
unbroken, as in a paraphrase of the question. The answer is the last sentence; of a single sentence, what follows its last
comma, colon, semicolon or dash, or else its last quarter. An answer of one or two words counts only behind at least
CLOSE of the words before it, and only if one of its words is none of theirs. Items of fewer than EXACT words are found where they
stand unbroken; one of fewer than RUN words is a run of its own.

A benchmark is handled in blocks of about ITEMS_AT_ONCE items or ITEM_BYTES; tasks read a block from the shared folder, and
each block's findings are written there before the next begins.

Nulls and edge cases: null and empty texts have no windows; a null doc_id is reported as null; items without words are null ones'
like and have no place; an item of one or two words is found wherever these words stand, so a caller who holds that to prove
nothing leaves such items out; a very long text is searched in slices of WINDOWS windows;
rows that repeat are searched each; items with the same words are searched once and reported each; of several places in a text the one with the
most common words counts, of equals the first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import Words, as_bytes, chunks, discard, mix, read_saved, save, scratch_path, text_bytes

FEATURES, RANK, SPARE = 1 << 15, 64, 8
FLOOR = 1e-3  # of the largest squared singular value, below which a direction is not stretched further
PASSAGE, STEP, EXACT = 32, 8, 8
SAMPLE = 1 << 16  # passages of the corpus that the basis is fitted on, about
ITEM_WEIGHT = 8.0  # of the benchmark's passages in that fit
COSINE, SAME, CLOSE = 0.6, 0.7, 0.5
ITEMS_AT_ONCE, ITEM_BYTES = 4096, 16 << 20
RUN, SHORT, RARE = 3, 12, 2  # words of a run; words from which on items have no runs; runs of an item
WINDOWS, TARGETS_AT_ONCE = 8192, 1024  # windows and passages of items that are held against each other at a time
PASSAGES_AT_ONCE = 2048
BLOCK = 2048  # features in a row of the image
_CHUNK = 1 << 20

_BREAK = np.ones(256, bool)
_BREAK[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _BREAK[_a:_b] = False


def words_of(texts: list[bytes]) -> Words:
    return Words(texts, lower=True, space=_BREAK)


def _features(words: Words) -> np.ndarray:
    return (words.hash % np.uint64(FEATURES)).astype(np.int32)


def _passages(words: Words) -> tuple[np.ndarray, np.ndarray, int]:
    """(passage, place in it) of each word, and the number of passages; they don't overlap and stay within a text."""
    place = np.arange(len(words)) - words.first[words.doc]
    new = place % PASSAGE == 0
    return np.cumsum(new) - 1, place % PASSAGE, int(new.sum())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n): passages of a task with each feature; the feature FEATURES stands for all passages."""
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in chunks(batches):
        words = words_of(as_bytes(batch.column("text")))
        at, place, n = _passages(words)
        grid = np.full((n, PASSAGE), -1, np.int32)
        grid[at, place] = _features(words)
        grid.sort(axis=1)
        fresh = grid >= 0
        fresh[:, 1:] &= grid[:, 1:] != grid[:, :-1]
        total[:-1] += np.bincount(grid[fresh], minlength=FEATURES)
        total[-1] += n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"feature": pa.array(seen, pa.int32()), "n": pa.array(total[seen])})


def inverse_weights(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(inverse document frequency of each feature, number of passages); FEATURES + 1 sums reach the driver."""
    sums = docs.mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(FEATURES + 1)
    total[sums.column("feature").to_numpy()] = sums.column("n").to_numpy()
    return (np.log((total[-1] + 1) / (total[:-1] + 1)) + 1).astype(np.float32), int(total[-1])


def _tfidf(words: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passage, feature, weight) of each word, so that a passage's weights have length 1; and the number of passages."""
    at, _, n = _passages(words)
    f = _features(words)
    pairs, inverse, tf = np.unique(at * FEATURES + f, return_inverse=True, return_counts=True)
    square = np.bincount(pairs // FEATURES, weights=(tf * idf[pairs % FEATURES]) ** 2, minlength=n)
    length = np.sqrt(np.maximum(square, 1e-12))
    return at, f, (idf[f] / length[at]).astype(np.float32), n


def _slices(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word of each passage, feature and weight of each word) for at most PASSAGES_AT_ONCE passages at a time."""
    for batch in chunks(batches, limit=_CHUNK):
        words = words_of(as_bytes(batch.column("text")))
        at, f, w, n = _tfidf(words, idf)
        w = w * np.repeat(batch.column("weight").to_numpy(zero_copy_only=False), np.diff(words.first)).astype(np.float32)
        starts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
        for k in range(0, n, PASSAGES_AT_ONCE):
            own = starts[k : k + PASSAGES_AT_ONCE + 1]
            yield own[:-1] - own[0], f[own[0] : own[-1]], w[own[0] : own[-1]]


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _image(idf: np.ndarray) -> Callable:
    """(block, sums): of the passages' products with a random matrix and back, BLOCK features in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = random_start()
        total, any_ = np.zeros(start.shape), False
        for starts, f, w in _slices(batches, idf):
            any_ = True
            image = np.add.reduceat(start[f] * w[:, None], starts, axis=0)
            at = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(f))))
            order = np.argsort(f, kind="stable")
            turn = np.flatnonzero(np.diff(f[order], prepend=-1))
            total[f[order][turn]] += np.add.reduceat(image[at[order]] * w[order][:, None], turn, axis=0)
        if any_:
            raw = [total[k : k + BLOCK].astype(np.float32).tobytes() for k in range(0, FEATURES, BLOCK)]
            yield _rows(block=pa.array(range(len(raw)), pa.int32()), sums=pa.array(raw, pa.binary()))

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each block; there are FEATURES / BLOCK blocks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            total[block] = total.get(block, 0.0) + np.frombuffer(raw, np.float32).astype(float)
    yield _rows(block=pa.array(total, pa.int32()), sums=pa.array([t.astype(np.float32).tobytes() for t in total.values()], pa.binary()))


def _squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The image's product with itself, a part for each block."""
    for batch in batches:
        for raw in batch.column("sums").to_pylist():
            part = np.frombuffer(raw, np.float32).reshape(-1, RANK + SPARE).astype(float)
            yield _rows(sums=pa.array([(part.T @ part).tobytes()], pa.binary()))


def _projected(image_at: str, idf: np.ndarray) -> Callable:
    """Sums over passages of (passage image)^T (passage image)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, total = read_image(image_at), np.zeros((RANK + SPARE, RANK + SPARE))
        for starts, f, w in _slices(batches, idf):
            own = np.add.reduceat(image[f] * w[:, None], starts, axis=0).astype(float)
            total += own.T @ own
        yield _rows(sums=pa.array([total.tobytes()], pa.binary()))

    return run


def random_start() -> np.ndarray:
    return np.random.default_rng(64).standard_normal((FEATURES, RANK + SPARE)).astype(np.float32)


def read_image(path: str) -> np.ndarray:
    """The image from the shared folder, as a task sees it."""
    rows = read_saved(path)
    out = np.zeros((FEATURES, RANK + SPARE), np.float32)
    for block, raw in zip(rows.column("block").to_pylist(), rows.column("sums").to_pylist()):
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(raw, np.float32).reshape(-1, RANK + SPARE)
    return out


def _small(parts: DataFrame) -> np.ndarray:
    """The sum of a few square matrices of RANK + SPARE rows, a part for each block or task of the sample."""
    return sum((np.frombuffer(r.sums).reshape(RANK + SPARE, -1) for r in parts.collect()), np.zeros((RANK + SPARE,) * 2))


def fit(sample: DataFrame, idf: np.ndarray) -> tuple[str, np.ndarray]:
    """(where the image of the sample's TF-IDF passages lies, the matrix that turns it into the basis: singular directions
    over their singular values). A sample without passages has an empty image, and nothing is like anything."""
    made = sample.mapInArrow(_image(idf), "block int, sums binary").repartition(FEATURES // BLOCK, "block").mapInArrow(_added, "block int, sums binary")
    image, image_at = save(made, "op6-image")
    square, turn = np.linalg.eigh(_small(image.mapInArrow(_squared, "sums binary")))
    lead = square > max(1e-9 * square.max(), 1e-30)
    orthogonal = turn[:, lead] / np.sqrt(square[lead])
    square, turn = np.linalg.eigh(orthogonal.T @ _small(sample.mapInArrow(_projected(image_at, idf), "sums binary")) @ orthogonal)
    if not len(square):
        return image_at, np.zeros((RANK + SPARE, 1))
    lead = np.argsort(-square)[:RANK]
    return image_at, orthogonal @ (turn[:, lead] / np.sqrt(np.maximum(square[lead], FLOOR * square.max() + 1e-12)))


@dataclass
class Item:
    item_ids: list[int | None]
    words: list[int]  # their hashes
    answer: list[int]
    masks: dict[int, int]  # word -> places in the item, as bits


def answer_of(text: str) -> str:
    """The last sentence, or of a single one what follows its last pause, or its last quarter."""
    has_words = lambda part: len(words_of([part.encode()])) > 0
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if has_words(s)]
    if len(sentences) > 1:
        return sentences[-1]
    clauses = [s for s in re.split(r"[,;:\u2013\u2014]\s|\s-\s", text) if has_words(s)]
    own = text.split()
    return clauses[-1] if len(clauses) > 1 else " ".join(own[-max(3, len(own) // 4) :])


def items_of(rows: list[tuple[int | None, str | None]]) -> list[Item]:
    """Items with words; those with the same words and answer are one."""
    out: dict[tuple, Item] = {}
    for item_id, text in rows:
        own = words_of([(text or "").encode()]).hash.tolist()
        if own:
            answer = words_of([answer_of(text).encode()]).hash.tolist()
            key = (tuple(own), tuple(answer))
            if key not in out:
                masks: dict[int, int] = {}
                for i, w in enumerate(own):
                    masks[w] = masks.get(w, 0) | 1 << i
                out[key] = Item([], own, answer, masks)
            out[key].item_ids.append(item_id)
    return list(out.values())


def common_words(item: Item, words: list[int], least: int | None = None) -> int:
    """Length of the longest common subsequence with the item, or with its first `least` words: a word of the text at a
    time over the item's bits."""
    n = len(item.words) if least is None else least
    full = (1 << n) - 1
    row = full
    for w in words:
        if mask := item.masks.get(w, 0) & full:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def found(item: Item, words: list[int]) -> tuple[int, bool] | None:
    """(common words, whether the answer decided) if the words hold the item."""
    n = len(item.words)
    if sum((m.bit_count() for w in set(words) if (m := item.masks.get(w))), 0) < CLOSE * n:
        return None
    if n < EXACT:
        return (n, False) if any(words[i : i + n] == item.words for i in range(len(words) - n + 1)) else None
    both = common_words(item, words)
    if both >= SAME * n:
        return both, False
    a = item.answer
    places_ = [i for i in range(len(words) - len(a) + 1) if words[i : i + len(a)] == a] if both >= CLOSE * n and a else []
    if not places_:
        return None
    stem = n - len(a)
    if len(a) >= 3 or not set(a) <= set(item.words[:stem]) and common_words(item, words[: places_[-1]], stem) >= CLOSE * stem:
        return both, True
    return None


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("common_words", pa.int64()), ("by_answer", pa.bool_())])


def targets_of(items: list[Item], projection: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items' passages: (direction, item, first word in it) of each."""
    owner, offset, rows = [], [], []
    for i, item in enumerate(items):
        last = max(len(item.words) - PASSAGE, 0)
        vectors = projection[(np.array(item.words, np.uint64) % np.uint64(FEATURES)).astype(np.int64)]
        for o in (*range(0, last, PASSAGE // 2), last):
            v = vectors[o : o + PASSAGE].sum(axis=0)
            rows.append(v / max(float(np.linalg.norm(v)), 1e-12))
            owner.append(i)
            offset.append(o)
    return np.array(rows, np.float32).reshape(-1, projection.shape[1]), np.array(owner, np.int64), np.array(offset, np.int64)


def candidates(words: Words, projection: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, target) of windows whose cosine with a target reaches COSINE, WINDOWS of them at a time."""
    if not len(words) or not len(targets):
        return (np.empty(0, np.int64),) * 3
    place = np.arange(len(words)) - words.first[words.doc]
    starts = np.append(np.flatnonzero(place % STEP == 0), len(words))  # of blocks of STEP words
    features = _features(words)
    wide = np.vstack((projection, np.zeros((1, projection.shape[1]), projection.dtype)))  # the last row is for what a block lacks
    doc = words.doc[starts[:-1]]
    last, begin = (np.searchsorted(doc, doc, side=side) for side in ("right", "left"))  # the blocks of each block's text
    turn, span = np.arange(len(doc)), PASSAGE // STEP
    every = np.flatnonzero((turn + span <= last) | (turn == begin))
    near: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(every), WINDOWS):
        b = every[k : k + WINDOWS]
        stop = np.minimum(b + span, last[b])
        low, high = b[0], stop.max()
        own = slice(starts[low], starts[high])
        grid = np.full((high - low, STEP), FEATURES, np.int32)
        grid[np.cumsum(place[own] % STEP == 0) - 1, place[own] % STEP] = features[own]
        sums = wide[grid[:, 0]]
        for j in range(1, STEP):
            sums += wide[grid[:, j]]
        total = np.concatenate((np.zeros((1, sums.shape[1]), np.float32), np.cumsum(sums, axis=0, dtype=np.float32)))
        window = total[stop - low] - total[b - low]
        window /= np.maximum(np.sqrt((window**2).sum(axis=1, keepdims=True)), 1e-12)
        for t in range(0, len(targets), TARGETS_AT_ONCE):
            w, target = np.nonzero(window @ targets[t : t + TARGETS_AT_ONCE].T >= COSINE)
            near.append((b[w], target + t))
    at, target = (np.concatenate(x) for x in zip(*near))
    return doc[at], starts[at], target


def _runs(hashes: np.ndarray, length: int = RUN) -> np.ndarray:
    n = max(len(hashes) - length + 1, 0)
    total = np.zeros(n, np.uint64)
    for k in range(length if n else 0):
        total = mix(total + hashes[k : k + n], k)
    return total


@dataclass
class Runs:
    """The rarest runs of `length` words of short items, by hash."""

    length: int
    hash: np.ndarray  # sorted
    item: np.ndarray
    offset: np.ndarray
    some: np.ndarray  # whether any hash has these lowest bits

    @staticmethod
    def of(items: list[Item], idf: np.ndarray) -> list[Runs]:
        """One for each length: RUN, or that of items shorter than it."""
        out = []
        for length in range(1, RUN + 1):
            fit = [i for i, x in enumerate(items) if (len(x.words) == length if length < RUN else RUN <= len(x.words) < SHORT)]
            if not fit:
                continue
            words = [np.array(items[i].words, np.uint64) for i in fit]
            own = [_runs(w, length) for w in words]
            shared = dict(zip(*(x.tolist() for x in np.unique(np.concatenate([np.unique(o) for o in own]), return_counts=True))))
            rows: list[tuple[int, int, int]] = []
            for i, w, o in zip(fit, words, own):
                weight = idf[(w % np.uint64(FEATURES)).astype(np.int64)]
                order = sorted(range(len(o)), key=lambda k: (shared[int(o[k])], -float(weight[k : k + length].sum()), k))
                rows += [(int(o[k]), i, k) for k in order[:RARE]]
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            some = np.zeros(1 << 22, bool)
            some[(hashes & np.uint64(len(some) - 1)).astype(np.int64)] = True
            out.append(Runs(length, hashes, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), some))
        return out

    def starts(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word where the item would start, item) of every such run in the texts; of an item that is a run itself the first in
        each text."""
        own = _runs(words.hash, self.length)
        at = np.flatnonzero(self.some[(own & np.uint64(len(self.some) - 1)).astype(np.int64)])
        at = at[words.doc[at] == words.doc[at + self.length - 1]]
        left = np.searchsorted(self.hash, own[at])
        count = np.searchsorted(self.hash, own[at], side="right") - left
        which = np.repeat(left - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        at = np.repeat(at, count)
        text, start, item = words.doc[at], at - self.offset[which], self.item[which]
        if self.length < RUN:
            _, first = np.unique(np.stack((text, item)), axis=1, return_index=True)
            text, start, item = text[first], start[first], item[first]
        return text, start, item


def places(words: Words, items: list[Item], text: np.ndarray, start: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, from, to), each once, in order: the words to verify where items would start at the given words."""
    n = np.array([len(i.words) for i in items], np.int64)[item]
    grain = np.where(n <= PASSAGE, STEP, n // 4)  # what starts within a quarter of a long item is verified at once
    k = (start - words.first[text]) // grain
    a, b = words.first[text], words.first[text + 1]
    begin = a + k * grain - n // 2
    end = begin + n // 2 + (grain - STEP) + np.maximum(n, PASSAGE) + n // 2
    rows = np.unique(np.stack((text, item, np.maximum(a, begin), np.minimum(b, end)), axis=1), axis=0)
    return map(tuple, rows.tolist())


@dataclass
class Block:
    """What a task needs to search for a block of items."""

    items: list[Item]
    projection: np.ndarray
    targets: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    runs: list[Runs]

    @staticmethod
    def read(items_at: str, image_at: str, turn: np.ndarray, idf: np.ndarray) -> Block:
        rows = read_saved(items_at)
        items = items_of(list(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()))) if rows is not None else []
        projection = (read_image(image_at) @ turn.astype(np.float32)) * idf[:, None]
        return Block(items, projection, *targets_of(items, projection), Runs.of(items, idf))


_read: dict[str, Block] = {}


def _search(items_at: str, image_at: str, turn: np.ndarray, idf: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if items_at not in _read:
            _read.clear()  # a worker holds one block
            _read[items_at] = Block.read(items_at, image_at, turn, idf)
        own = _read[items_at]
        for batch in chunks(batches, limit=_CHUNK):
            words = words_of(as_bytes(batch.column("text")))
            ids = batch.column("doc_id").to_pylist()
            best: dict[tuple[int, int], tuple[int, bool]] = {}
            text, at, target = candidates(words, own.projection, own.targets)
            near = (text, at - own.offset[target], own.owner[target])
            for d, i, a, b in places(words, own.items, *(np.concatenate(x) for x in zip(near, *(r.starts(words) for r in own.runs)))):
                item = own.items[i]
                if best.get((d, i), (0, False))[0] == len(item.words):
                    continue
                hit = found(item, words.hash[a:b].tolist())
                if hit and hit > best.get((d, i), (0, False)):
                    best[d, i] = hit
            rows = [(ids[d], item_id, len(own.items[i].words), c, by) for (d, i), (c, by) in sorted(best.items()) for item_id in own.items[i].item_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _FOUND)], schema=_FOUND)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_words, common_words and by_answer: every item that a text holds."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    count, size = tests.count(), text_bytes(tests)
    blocks = max(1, -(-count // ITEMS_AT_ONCE), -(-size // ITEM_BYTES))
    items_at = scratch_path(spark, "op6-items")
    tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(items_at)

    idf, passages = inverse_weights(docs)
    share = min(1.0, SAMPLE / max(passages, 1))
    spread = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30))
    chosen = docs.where(spread("doc_id", "text") < int(share * (1 << 30))).select("text", F.lit(1.0).alias("weight"))
    among = tests.where(spread("item_id", "text") < int(min(1.0, SAMPLE / max(count, 1)) * (1 << 30))).select("text", F.lit(ITEM_WEIGHT).alias("weight"))
    sample, sample_at = save(chosen.union(among).repartition(8), "op6-sample")
    image_at, turn = fit(sample, idf)

    shape = "doc_id long, item_id long, item_words long, common_words long, by_answer boolean"
    found_at = scratch_path(spark, "op6-found")
    for k in range(blocks):
        docs.mapInArrow(_search(f"{items_at}/block={k}", image_at, turn, idf), shape).write.mode("append").parquet(found_at)
    discard(spark, sample_at, image_at, items_at)
    return spark.read.schema(shape).parquet(found_at)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item."""
    hits = decontaminate(docs, benchmark).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(hits["hit_id"]), "left_anti")
