"""SentencePiece encoding and decoding that keeps source offsets.

Ids and decoded texts are the sentencepiece library's. Offsets come from our own normalisation: the model's compiled
character map (a double-array trie over source prefixes) is matched longest-prefix-first, and each normalised byte keeps
the source byte it came from; the pieces' lengths then run along the normalised text and project every piece to a span of
source bytes. Where the map is empty, the alignment is made with array operations.

Byte-pair merges never cross from a letter to a following space mark unless a piece holds such a pair; where the model has
no such piece, a text is the concatenation of its units (spaces with the word after them), and each distinct unit is
encoded once.

Null and empty texts give only the end id and decode to an empty text; a very long text is encoded whole; doc_id may be
null; rows that repeat are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import as_bytes, chunks

MARK = "▁".encode()
_UNIT = re.compile(rb" *[^ ]+| +$")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffers message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = raw[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class CharMap:
    """The compiled character map: a double array of 32-bit units, then the replacement texts, each closed by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units, self.texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of text[at:] that the map knows, and its replacement."""
        if not self.units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, found = offset(self.units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                to = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[to : self.texts.index(b"\0", to)]
        return found


class Normalizer:
    """Normalised text and, for each of its bytes and its end, the source byte."""

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        self.map = CharMap(fields.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(fields.get(k, 1)) for k in (3, 4, 5))

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not self.map.units and not self.squeeze and self.escape:
            return self._plain(text)
        pieces: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at)
            if hit is None:
                size = 1
                while at + size < len(text) and text[at + size] & 0xC0 == 0x80:
                    size += 1
                hit = size, text[at : at + size]
            pieces.append((hit[1], at))
            at += hit[0]
        if self.squeeze:
            pieces = [(bytes([b]) if len(p) > 1 and p.isascii() else p, at) for p, at in pieces for b in (p if p.isascii() else (0,))]
            while pieces and pieces[0][0] == b" ":
                pieces.pop(0)
            kept: list[tuple[bytes, int]] = []
            for p in pieces:
                if not (p[0] == b" " and kept and kept[-1][0] == b" "):
                    kept.append(p)
            pieces = kept[:-1] if kept and kept[-1][0] == b" " else kept
        if self.prefix and pieces:
            pieces.insert(0, (b" ", pieces[0][1]))
        out, align = [], []
        for p, at in pieces:
            p = p.replace(b" ", MARK) if self.escape else p
            out.append(p)
            align += [at] * len(p)
        return b"".join(out), np.array([*align, len(text)], np.int64)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        body = np.repeat(np.arange(len(text)), np.where(np.frombuffer(text, np.uint8) == 32, len(MARK), 1))
        return (MARK if self.prefix else b"") + text.replace(b" ", MARK), np.concatenate((np.zeros(len(MARK) * self.prefix, np.int64), body, [len(text)]))


class PieceCodec:
    """Encodes and decodes by a model file; remembers two generations of about MOST units, so that frequent ones stay."""

    MOST = 250_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.normalizer = Normalizer(b"".join(v for k, v in fields if k == 3))
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.sizes = np.array([1 if self.model.is_byte(i) else 0 if self.model.is_control(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        self.unknown = self.model.unk_id()
        self.end = self.model.eos_id()
        plain = not self.normalizer.map.units and not self.normalizer.squeeze and self.normalizer.escape and self.normalizer.prefix
        own = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.by_units = plain and not any(re.search("[^▁]▁", p) for p in own)
        self.lone = self.model.encode("a ")[len(self.model.encode("a")) :]  # a space mark by itself
        self.known: dict[bytes, tuple[list[int], bytes]] = {}
        self.before: dict[bytes, tuple[list[int], bytes]] = {}

    def _units(self, text: bytes) -> list[bytes]:
        """What to encode by itself: the library puts a space mark before each, so all but the first leave one space out."""
        if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
            return text.split(b" ") if text else []
        found = _UNIT.findall(text)
        return [u if i == 0 else u[1:] for i, u in enumerate(found)]

    def encode(self, texts: list[bytes]) -> list[tuple[list[int], bytes]]:
        """(ids, the ids in decimal joined by spaces) of each text, with the end id."""
        if not self.by_units:
            found = [[*ids, self.end] for ids in self.model.encode([t.decode() for t in texts], num_threads=1)]
            return [(ids, b" ".join(b"%d" % i for i in ids)) for ids in found]
        split = [[] if MARK in t else self._units(t) for t in texts]  # a mark of the text's own makes units unclear
        if len(self.known) > self.MOST:
            self.known, self.before = {}, self.known
        new = []
        for u in set().union(*split):
            if u not in self.known:
                if u in self.before:
                    self.known[u] = self.before[u]
                else:
                    new.append(u)
        for u, ids in zip(new, self.model.encode([u.decode() for u in new], num_threads=1)):
            ids = ids if u else self.lone
            self.known[u] = ids, b"".join(b"%d " % i for i in ids)
        out, last = [], b"%d" % self.end
        for text, units in zip(texts, split):
            found = [self.known[u] for u in units]
            if text and not units:
                whole = self.model.encode(text.decode())
                found = [(whole, b"".join(b"%d " % i for i in whole))]
            ids: list[int] = []
            for own, _ in found:
                ids += own
            ids.append(self.end)
            out.append((ids, b"".join([d for _, d in found]) + last))
        return out

    def spans(self, text: bytes, ids: list[int]) -> np.ndarray:
        """(pieces, 2): each id's [start, end) in source bytes; the end id stands behind the text."""
        normal, align = self.normalizer(text)
        which = np.array(ids, np.int64)
        sizes = self.sizes[which]
        if (which == self.unknown).any():  # an unknown piece is as long as the characters that no piece covers
            sizes = self._unknown_sizes(text, normal, ids)
        ends = np.cumsum(sizes)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return np.stack([align[ends - sizes], align[ends]], axis=1)

    def _unknown_sizes(self, text: bytes, normal: bytes, ids: list[int]) -> np.ndarray:
        found = self.model.encode(text.decode(), return_type="proto").pieces
        return np.array([len(p.piece.encode()) for p in found] + [0] * (len(ids) - len(found)), np.int64)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1)


_codecs: dict[str, PieceCodec] = {}
_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64()), ("ids", pa.list_(pa.int32())), ("span_ends", pa.list_(pa.int32())), ("decoded", pa.string())])


def _code(path: str, full: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _codecs:
            _codecs[path] = PieceCodec(path)
        codec = _codecs[path]
        for batch in chunks(batches, limit=1 << 20):
            texts = as_bytes(batch.column("text"))
            coded = codec.encode(texts)
            decoded = codec.decode([ids for ids, _ in coded])
            ends = [codec.spans(t, ids)[:, 1].astype("<u4") for t, (ids, _) in zip(texts, coded)]
            none = [None] * len(texts)
            cols = [
                batch.column("doc_id"), [len(ids) for ids, _ in coded], [hashlib.sha256(d).hexdigest() for _, d in coded], [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                [zlib.crc32(e) for e in ends], [ids for ids, _ in coded] if full else none, [e.astype(np.int32) for e in ends] if full else none, decoded if full else none,
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, _CODED)], schema=_CODED)

    return run


def piece_codec(docs: DataFrame, model: str, full: bool = True) -> DataFrame:
    """Digests of every text's ids, decoded text and spans; with `full` also the ids, the source byte each piece ends at and the decoded text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.mapInArrow(_code(model, full), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long, ids array<int>, span_ends array<int>, decoded string")
    return out if full else out.drop("ids", "span_ends", "decoded")
