"""Token-id files with Elias-Fano document boundaries, and the Spark data source that writes and reads them.

A file holds the ids of consecutive documents in one array. Document i's ids lie between boundaries i and i + 1; those
numbers never fall, so Elias-Fano keeps their low bits verbatim and their high parts as a unary bit string, about
2 + log2(ids per document) bits each. `select` finds the i-th one of the bit string from the stored places of every 64th
(32 bits each), so offsets are read a block of documents at a time, and no 64-bit table of them is ever made. Doc_ids,
which ascend too, are kept alike. A predicate on one doc_id or a range reaches the reader: it opens the files whose range
fits, finds the documents by bisection, and reads their ids alone.

Layout, little-endian: magic "EFTK", u32 width of an id in bytes, u64 documents, u64 ids, u64 bytes of the boundaries,
u64 bytes of the doc_ids; boundaries; doc_ids; ids. A folder of such files has a manifest with each file's counts and
first global offset; a writer's task makes files under names of its own, and only files of committed tasks get into the
manifest, so repeated tasks do no harm.

Nulls and edge cases: a null text counts as empty, and every document ends with END_ID; rows are ordered by doc_id, then
text, nulls first and apart from the least doc_id; doc_ids may lie any distance apart; rows that repeat are stored each; a text of any length is encoded whole, and a document is never split
between files; an empty table makes a manifest without files; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from girder.llm import common
from girder.llm.common import Words, as_bytes, chunks, scratch_path

END_ID = 1
FILE_IDS, FILE_DOCS = 32 << 20, 1 << 20  # ids or documents after which a task starts another file
PART_BYTES = 32 << 20  # text bytes of a range of documents
_HEAD = np.dtype([("magic", "S4"), ("width", "<u4"), ("docs", "<u8"), ("ids", "<u8"), ("bounds", "<u8"), ("numbers", "<u8")])


class EliasFano:
    """A non-decreasing sequence of non-negative integers, read by `select` without ever being inflated as a whole."""

    EVERY = 64  # ones between two samples

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        if len(values) and (int(values[0]) < 0 or (values[1:] < values[:-1]).any()):  # unsigned ones reach 2**64 - 1
            raise ValueError("the sequence falls")
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), places[:: cls.EVERY].astype("<u4"))

    def _ones(self, i: int, n: int) -> np.ndarray:
        """Places of the ones i to i + n - 1: those between the samples around them are looked at, and no others."""
        first = i // self.EVERY
        after = (i + n - 1) // self.EVERY + 1
        begin = int(self.sample[first]) >> 3
        stop = (int(self.sample[after]) >> 3) + 1 if after < len(self.sample) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:stop], bitorder="little")) + 8 * begin
        skip = int(np.searchsorted(ones, int(self.sample[first]))) + i - first * self.EVERY
        return ones[skip : skip + n]

    def select(self, i: int) -> int:
        """Place of the i-th one in the bit string."""
        return int(self._ones(i, 1)[0])

    def slice(self, i: int, n: int) -> np.ndarray:
        """The values i to i + n - 1, modulo 2**64."""
        out = (self._ones(i, n) - np.arange(i, i + n)) << self.low_bits
        if self.low_bits:
            begin, skip = i * self.low_bits >> 3, i * self.low_bits & 7
            bits = np.unpackbits(self.low[begin : ((i + n) * self.low_bits + 7) >> 3], bitorder="little")[skip : skip + n * self.low_bits]
            out += bits.reshape(n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, 1)[0]) & (1 << 64) - 1

    def first_at_least(self, value: int) -> int:
        """The least index whose value is at least `value`, or n."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self[middle] < value else (low, middle)
        return low

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.sample)], "<u8")
        return b"".join(x.tobytes() for x in (head, self.low, self.high, self.sample))

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, low, high, sample = (int(x) for x in np.frombuffer(raw, "<u8", 5))
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, low, 40), np.frombuffer(raw, np.uint8, high, 40 + low), np.frombuffer(raw, "<u4", sample, 40 + low + high))


@dataclass
class Numbers:
    """The ascending doc_ids of a file; null ones come first."""

    nulls: int
    least: int
    rest: EliasFano

    @classmethod
    def of(cls, doc_ids: np.ndarray, nulls: int) -> Numbers:
        """The first `nulls` of doc_ids are null; the others may lie up to 2**64 - 1 apart."""
        known = doc_ids[nulls:]
        least = int(known[0]) if len(known) else 0
        if (known[1:] < known[:-1]).any():
            raise ValueError("the sequence falls")
        return cls(nulls, least, EliasFano.of(known.view(np.uint64) - np.uint64(least % 2**64)))

    def slice(self, i: int, n: int) -> pa.Array:
        nulls = min(max(self.nulls - i, 0), n)
        known = self.rest.slice(i + nulls - self.nulls, n - nulls) + self.least if n > nulls else np.empty(0, np.int64)
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(known, pa.int64())])

    def first_at_least(self, doc_id: int) -> int:
        return self.nulls + self.rest.first_at_least(doc_id - self.least)

    def to_bytes(self) -> bytes:
        return np.array([self.nulls, self.least], "<i8").tobytes() + self.rest.to_bytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Numbers:
        nulls, least = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        return cls(nulls, least, EliasFano.from_bytes(raw[16:]))


def file_bytes(doc_ids: np.ndarray, nulls: int, sizes: np.ndarray, ids: bytes, width: int) -> bytes:
    bounds = EliasFano.of(np.concatenate(([0], np.cumsum(sizes)))).to_bytes()
    numbers = Numbers.of(doc_ids, nulls).to_bytes()
    head = np.array([(b"EFTK", width, len(sizes), int(sizes.sum()), len(bounds), len(numbers))], _HEAD)
    return b"".join((head.tobytes(), bounds, numbers, ids))


class _Files:
    """Any store that pyarrow opens, by a URI or a local path."""

    def __init__(self, path: str):
        self.store, self.at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, name: str, *parts: bytes) -> None:
        self.store.create_dir(self.at, recursive=True)
        with self.store.open_output_stream(f"{self.at}/{name}", compression=None) as f:
            for p in parts:
                f.write(p)

    def open(self, name: str) -> pa.NativeFile:
        return self.store.open_input_file(f"{self.at}/{name}")

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()

    def remove(self, name: str) -> None:
        self.store.delete_file(f"{self.at}/{name}")


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        out, files = _Files(self.path), []
        numbers, sizes, ids, held, nulls = [], [], [], 0, 0

        def close() -> None:
            nonlocal held, nulls
            doc_ids, counts = np.concatenate(numbers), np.concatenate(sizes)
            name = f"{uuid.uuid4().hex}.eftk"
            out.write(name, file_bytes(doc_ids, nulls, counts, b"".join(ids), self.width))
            known = doc_ids[nulls:].tolist() or [None]  # null doc_ids come first
            files.append({"name": name, "docs": len(counts), "ids": int(counts.sum()), "nulls": nulls, "first": known[0], "last": known[-1], "turn": len(files)})
            numbers.clear(), sizes.clear(), ids.clear()
            held = nulls = 0

        for batch in iterator:
            rows = as_bytes(batch.column("ids"))
            if rows:
                nulls += batch.column("doc_id").null_count
                numbers.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
                sizes.append(np.fromiter(map(len, rows), np.int64, len(rows)) // self.width)
                ids.extend(rows)
                held += int(sizes[-1].sum())
            if held >= FILE_IDS or sum(map(len, sizes)) >= FILE_DOCS:
                close()
        if numbers:
            close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (not f["nulls"], f["first"] or 0, f["turn"]))
        start = 0
        for f in files:
            f["start"] = start
            start += f["ids"]
        _Files(self.path).write("manifest.json", json.dumps({"width": self.width, "files": files}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for f in m.files if m else []:
                _Files(self.path).remove(f["name"])


@dataclass
class _Part(InputPartition):
    name: str
    start: int


_SIDES = {EqualTo: (True, True), GreaterThan: (True, False), GreaterThanOrEqual: (True, False), LessThan: (False, True), LessThanOrEqual: (False, True)}


class _Reader(DataSourceReader):
    """Reads documents; without an `ids` column in the wanted schema, ids are only summed up."""

    SPAN = 4 << 20  # ids held at once, or one document
    ROWS = 4096  # documents whose boundaries are held at once

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names
        self.low: int | None = None  # doc_ids wanted, both ends included
        self.high: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if f.__class__ in _SIDES and f.attribute == ("doc_id",) and isinstance(f.value, int):
                below, above = _SIDES[f.__class__]
                low = f.value + (f.__class__ is GreaterThan)
                high = f.value - (f.__class__ is LessThan)
                self.low = max(low, self.low if self.low is not None else low) if below else self.low
                self.high = min(high, self.high if self.high is not None else high) if above else self.high
            elif not (isinstance(f, IsNotNull) and f.attribute == ("doc_id",)):
                yield f
                continue
            if self.low is None and self.high is None:  # "is not null" alone
                self.low = -(2**63)

    def partitions(self) -> list[_Part]:
        files = json.loads(_Files(self.path).read("manifest.json"))["files"]
        fits = [f for f in files if (self.low is None or f["last"] is not None and f["last"] >= self.low) and (self.high is None or f["first"] is not None and f["first"] <= self.high)]
        return [_Part(f["name"], f["start"]) for f in fits] or [_Part("", 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        with _Files(self.path).open(part.name) as f:
            head = np.frombuffer(f.read(_HEAD.itemsize), _HEAD)[0]
            if head["magic"] != b"EFTK":
                raise ValueError(f"{part.name} is no token file")
            bounds = EliasFano.from_bytes(f.read(int(head["bounds"])))
            numbers = Numbers.from_bytes(f.read(int(head["numbers"])))
            base, width = f.tell(), int(head["width"])
            at, last = 0, int(head["docs"])
            if self.low is not None or self.high is not None:
                at = numbers.first_at_least(self.low) if self.low is not None else numbers.nulls
                last = numbers.first_at_least(self.high + 1) if self.high is not None else last
            while at < last:
                some = bounds.slice(at, min(self.ROWS, last - at) + 1)
                n = max(1, int(np.searchsorted(some, some[0] + self.SPAN, side="right")) - 1)
                own = some[: n + 1] - some[0]
                cols = {"doc_id": numbers.slice(at, n), "start": pa.array(some[:n] + part.start), "n_tokens": pa.array(np.diff(own))}
                if not {"ids", "ids_crc32"}.isdisjoint(self.names):
                    f.seek(base + int(some[0]) * width)
                    raw = f.read(int(own[-1]) * width)
                    if len(raw) != int(own[-1]) * width:
                        raise ValueError(f"{part.name} ends early")
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    if "ids_crc32" in self.names:
                        cols["ids_crc32"] = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(own, own[1:])], pa.int64())
                    if "ids" in self.names:
                        cols["ids"] = pa.array([ids[a:b].astype(np.int64) for a, b in zip(own, own[1:])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({k: cols[k] for k in self.names})
                at += n


class TokenFiles(DataSource):
    """format("girder_tokens"): writes (doc_id long, ids binary of little-endian numbers), reads doc_id, start, n_tokens, ids_crc32 and ids."""

    @classmethod
    def name(cls) -> str:
        return "girder_tokens"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options["width"]))


# fixed values: the normaliser and pre-tokeniser for which texts may be encoded by their parts
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_BLANK, _MARK, _LETTER, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[128:] = _OTHER
for _a, _b, _k in ((48, 58, _DIGIT), (65, 91, _LETTER), (97, 123, _LETTER)):
    _KIND[_a:_b] = _k
_CONTRACTED = np.zeros(256, bool)
_CONTRACTED[np.frombuffer(b"strvmld", np.uint8)] = True  # the first letters of what may follow an apostrophe in the pattern


def _two_byte_letters() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x800: whether each is a letter that normalisation leaves alone and whose lower case is one too, and that lower case."""
    plain, low = np.zeros(0x800, bool), np.arange(0x800)
    for c in range(0x80, 0x800):
        s, t = chr(c), chr(c).lower()
        plain[c] = s.isalpha() and len(t) == 1 and t.isalpha() and 0x80 <= ord(t) < 0x800 and unicodedata.is_normalized("NFC", s + t)
        low[c] = ord(t) if plain[c] else c
    return plain, low


_PLAIN, _LOWERED = _two_byte_letters()


class Parts(Words):
    """The parts of several texts that are encoded by themselves: runs of letters, single digits and runs of marks, A-Z and
    two-byte letters lower-cased. A word with any other byte, with an apostrophe that may begin a contraction, or with what
    may be a special token is `hard`, a part as a whole and as it is written."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" ".join(texts) + b" \0", np.uint8)
        kind, buf = _KIND[raw], common._LOWER[raw]
        lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
        point = (raw[lead] & 31).astype(np.int64) << 6 | raw[lead + 1] & 63
        lead, point = lead[_PLAIN[point]], _LOWERED[point[_PLAIN[point]]]
        kind[lead] = kind[lead + 1] = _LETTER
        buf[lead], buf[lead + 1] = 0xC0 | point >> 6, 0x80 | point & 63
        odd = kind == _OTHER
        odd[:-1] |= (raw[:-1] == 39) & _CONTRACTED[buf[1:]] | (raw[:-1] == 60) & (raw[1:] == 124)
        raw, kind, buf, odd = (x[:-1] for x in (raw, kind, buf, odd))

        blank = np.concatenate(([True], kind == _BLANK))
        begin, end = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        bad = np.unique(np.searchsorted(begin, np.flatnonzero(odd), side="right") - 1)  # words
        cover = np.zeros(len(raw) + 1, np.int8)
        cover[begin[bad]] = 1
        cover[end[bad]] = -1
        inside = np.cumsum(cover, dtype=np.int8)[:-1].view(bool)
        kind[inside] = _OTHER
        self.buf = np.where(inside, raw, buf)
        edge = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)))
        edge = np.flatnonzero(edge)
        of = kind[edge]
        full = of != _BLANK
        self.starts, self.ends = edge[full], np.append(edge[1:], len(raw))[full]
        self.hard = of[full] == _OTHER
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(sizes + 1))))
        self.hash = self._hashes()


class Known:
    """Ids of parts by their hash: sorted hashes, and where the ids of each stand in one pool."""

    def __init__(self, kind: str):
        self.hash, self.at, self.size, self.pool = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, the number of each)."""
        size = self.size[places]
        return self.pool[np.repeat(self.at[places] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))], size

    def add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, ids))
        hashes, at, size = (np.concatenate(x) for x in ((self.hash, hashes), (self.at, at), (self.size, size)))
        order = np.argsort(hashes, kind="stable")
        self.hash, self.at, self.size = hashes[order], at[order], size[order]


class PartEncoder:
    """Ids of texts by the tokenizers library. Where the tokenizer cuts texts as _PATTERN does and marks word ends, no token
    crosses the border of two parts, so each distinct part is encoded once and remembered by its 64-bit hash: two
    generations of MOST parts, so that frequent ones stay. Other tokenizers get whole texts.

    New parts go to the library many in one text, and their ids are told apart by the word ends; if their number is not as
    expected, each part is encoded by itself.
    """

    MOST, AT_ONCE = 1_000_000, 512

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = f"<u{id_width(path)}"
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_parts = bool(suffix) and (spec["normalizer"] or {}).get("normalizers") == _NORMALIZER and self._cuts(spec["pre_tokenizer"] or {}) and not spec["post_processor"]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.by_parts:
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.now, self.before = Known(self.kind), Known(self.kind)

    @staticmethod
    def _cuts(spec: dict) -> bool:
        steps = spec.get("pretokenizers") or [{}]
        first = steps[0]
        return first.get("pattern") == {"Regex": _PATTERN} and first.get("invert") is True and first.get("behavior") == "Removed" and all(s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in steps[1:])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: Parts, new: np.ndarray) -> None:
        """Encode the parts of the given numbers."""
        own = parts.buf.tobytes()
        cut = lambda k: [own[a:b].decode() for a, b in zip(parts.starts[k].tolist(), parts.ends[k].tolist())]
        easy, hard = new[~parts.hard[new]], new[parts.hard[new]]
        texts, found, sizes = cut(easy), [], []
        groups = [texts[i : i + self.AT_ONCE] for i in range(0, len(texts), self.AT_ONCE)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                found.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = self._ids(group)
                found += each
                sizes.append(np.array([len(i) for i in each]))
        each = self._ids(cut(hard))
        found += each
        sizes.append(np.array([len(i) for i in each], np.int64))
        if len(new):
            self.now.add(parts.hash[np.concatenate((easy, hard))], np.concatenate(found), np.concatenate(sizes))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids, END_ID behind them, as little-endian numbers."""
        end = np.array([END_ID], self.kind)
        if not self.by_parts:
            return [np.concatenate((i, end)).tobytes() for i in self._ids([t.decode() for t in texts])]
        parts = Parts(texts)
        if len(self.now.hash) > self.MOST:
            self.now, self.before = Known(self.kind), self.now
        own, where, which = np.unique(parts.hash, return_index=True, return_inverse=True)
        lost = np.flatnonzero(self.now.find(own) < 0)
        again = self.before.find(own[lost])
        ids, size = self.before.ids(again[again >= 0])
        self.now.add(own[lost[again >= 0]], ids, size)
        self._learn(parts, where[lost[again < 0]])
        ids, size = self.now.ids(self.now.find(own))
        start = np.append(np.cumsum(size) - size, len(ids))  # the last one is the end id's
        ids, size = np.append(ids, end), np.append(size, 1)
        which = np.insert(which, parts.first[1:], len(own))
        count = size[which]
        raw = ids[np.repeat(start[which] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))].tobytes()
        bounds = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], parts.first[1:] + np.arange(1, len(texts) + 1)))] * ids.itemsize
        return [raw[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


def id_width(path: str) -> int:
    """Bytes of an id of this tokenizer."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


_encoders: dict[str, PartEncoder] = {}


def _encode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = PartEncoder(path)
        for batch in chunks(batches):
            ids = _encoders[path](as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode every text and write token files in ascending doc_id order."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(64, -(-common.text_bytes(docs) // PART_BYTES))
    ids = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_encode(tokenizer), "doc_id long, ids binary")
    ids.write.format("girder_tokens").option("width", id_width(tokenizer)).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, columns: str = "doc_id long, start long, n_tokens long, ids_crc32 long") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenFiles)
    return spark.read.format("girder_tokens").schema(columns).load(path)


def token_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from files in the shared folder."""
    path = scratch_path(docs.sparkSession, "op4-tokens")
    write_tokens(docs, tokenizer, path)
    return read_tokens(docs.sparkSession, path)
