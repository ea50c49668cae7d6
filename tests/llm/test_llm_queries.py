"""Every registered corpus query with SQL against that SQL in DuckDB, on the smallest tables; the others against libraries and plain programs."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from girder.llm import token_counts
from girder.llm.queries import ORACLE_SQL, PIECES, QUERIES, WORDS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    want = duck.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def texts():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def test_token_counts_are_greedy(spark):
    vocabulary = set(token_counts.word_pieces(public_tokenizers.path(WORDS)))
    known: dict[bytes, int] = {}

    def count(word: bytes) -> int:
        if word not in known:
            rest, n = bytes(c + 32 if 65 <= c < 91 else c for c in word) + b" ", 0
            while rest and rest != b" ":
                k = next(k for k in range(len(rest), 0, -1) if rest[:k] in vocabulary)
                n, rest = n + 1, rest[k:]
            known[word] = n
        return known[word]

    want = {i: (len(w), sum(map(count, w))) for i, t in texts() for w in [t.encode().split()]}
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in QUERIES["op2_token_counts"](spark, SF).collect()} == want


def test_token_files_are_the_library_s(spark):
    library, start, want = Tokenizer.from_file(public_tokenizers.path(WORDS)), 0, {}
    for i, t in texts():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_token_files"](spark, SF).collect()} == want


def test_pieces_are_the_library_s(spark):
    library, want = SentencePieceProcessor(model_file=public_tokenizers.path(PIECES)), {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in texts():
        ids = library.encode(t, add_eos=True)
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op8_sentencepiece"](spark, SF).collect()} == want


def test_contamination_holds_what_stands_verbatim(spark):
    """Items of the benchmark whose words stand unbroken in a text, by plain search."""
    plain = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\uffff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t))) + " "
    items = [(i, plain(t)) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    want = {(d, i) for d, t in texts() for own in [plain(t)] for i, x in items if x in own}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontamination"](spark, SF).collect()}
    assert want and want <= got
