"""Greedy word-piece counts from a linear longest-match automaton.

The vocabulary is a trie. Where a node has no child for the next byte, its failure link leads to the node that stands
after the longest pieces have been popped off the front, and the number of those pieces was counted when the automaton
was built: a word's pieces are counted in one pass over its bytes and no piece is ever cut out. All distinct words of a
chunk go through the automaton side by side, a byte at a time.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased, closed by an end mark that pieces ending in
"</w>" include; an end mark left over by itself counts nothing. A word that pieces cannot cover counts as one token.
Null and empty texts have no words and no tokens; a very long text is a chunk of its own; doc_id may be null; rows that
repeat are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import Words, as_bytes, chunks

END = 0x20  # the end mark: no word holds this byte
_NONE = -1


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow 255."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def word_pieces(path: str, mark: str = "</w>") -> list[bytes]:
    """The pieces of a tokenizers file with word ends, as bytes; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special, letters, pieces = {t["content"] for t in model.get("added_tokens", [])}, byte_letters(), []
    for piece in model["model"]["vocab"]:
        if piece not in special:
            body = piece.removesuffix(mark)
            pieces.append(bytes(letters[c] for c in body) + (bytes([END]) if body != piece else b""))
    return pieces


class Automaton:
    """Arrays over trie nodes: `fail` and `popped`, and a sorted table of edges (node * 256 + byte -> child)."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        whole = {0: False}
        for piece in pieces:
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                node = children[node][b]
            whole[node] = True
        if END not in children[0]:
            children[0][END] = len(children)
            children.append({})
        silent = children[0][END]  # an end mark by itself
        fail, popped = [_NONE] * len(children), [0] * len(children)
        level = [(0, b, c) for b, c in children[0].items()]
        while level:
            for parent, b, node in level:
                if node == silent or whole.get(node):
                    fail[node], popped[node] = 0, int(node != silent)
                    continue
                back, count = fail[parent], popped[parent]
                while back != _NONE and b not in children[back]:
                    count += popped[back]
                    back = fail[back]
                if back != _NONE:
                    fail[node], popped[node] = children[back][b], count
            level = [(node, b, c) for _, _, node in level for b, c in children[node].items()]
        edges = sorted((n << 8 | b, c) for n, own in enumerate(children) for b, c in own.items())
        self.edge, self.child = (np.array(x, np.int64) for x in zip(*edges))
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children, or -1."""
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.child[at], _NONE)

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word; the end mark is added here."""
        order = np.argsort(starts - ends, kind="stable")  # longest first, so that the words still running are a prefix
        starts, size = starts[order], (ends - starts)[order] + 1
        node, total, lost = (np.zeros(len(order), kind) for kind in (np.int64, np.int64, bool))
        running = len(order)
        for j in range(int(size[0]) if len(size) else 0):
            running = int(np.searchsorted(-size[:running], -j, side="left"))  # those with size > j
            live = np.flatnonzero(~lost[:running])
            byte = np.where(size[live] - 1 == j, END, buf[np.minimum(starts[live] + j, len(buf) - 1)]).astype(np.int64)
            while len(live):
                to = self.step(node[live], byte)
                ok = to != _NONE
                node[live[ok]] = to[ok]
                live, byte = live[~ok], byte[~ok]
                total[live] += self.popped[node[live]]
                node[live] = self.fail[node[live]]
                dead = node[live] == _NONE
                lost[live[dead]] = True
                live, byte = live[~dead], byte[~dead]
        live = np.flatnonzero(~lost)
        while len(live):
            live = live[node[live] != 0]
            total[live] += self.popped[node[live]]
            node[live] = self.fail[node[live]]
            lost[live[node[live] == _NONE]] = True
            live = live[node[live] != _NONE]
        total[lost] = 1
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


_built: dict[str, Automaton] = {}
_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _built:
            _built[path] = Automaton(word_pieces(path))
        for batch in chunks(batches):
            words = Words(as_bytes(batch.column("text")), lower=True)
            _, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
            each = _built[path].count(words.buf, words.starts[first], words.ends[first])[inverse]
            sums = np.concatenate(([0], np.cumsum(each)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(words.first)), pa.array(sums[words.first[1:]] - sums[words.first[:-1]])], schema=_COUNTED)

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words and n_tokens of every text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count(vocabulary), "doc_id long, n_words long, n_tokens long")
