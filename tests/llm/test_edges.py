"""Every operator and stage: nulls, empty and long texts, repeated rows, empty tables, clashing columns, against plain Python."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from girder.llm import decontam, near_dedup, piece_codec, quality, secrets, sharding, substring_dedup, token_counts, token_store, warc
from girder.llm.common import components

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = ["hits", "key", "band", "component", "slot", "shard", "which", "found", "kept_id", "kept_key", "gone_id", "hit_id", "m0", "row", "words", "n", "a", "b", "text_a", "kept"]
LONG = " ".join(f"w{i % 977}x{i % 131}" for i in range(30_000))
SHARED = " ".join(f"shared{i}" for i in range(60))
ITEM = "What is the tallest of the seven blue mountains beyond the river. It is the mount of Arenthal near the western gate."


def rows():
    base = " ".join(f"near{i}" for i in range(100))
    out = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (None, "one two three"), (6, LONG), (7, base), (8, base.replace("near50", "other")),
        (9, SHARED + " tail"), (10, "head " + SHARED), (11, "é ß 🙂 " * 12), (12, 'x password = "hunter2hunter2" AKIA' + "Z" * 16 + " " + "0f" * 15 + " TOKEN:abc token=abcdef"),
        (13, "before " + ITEM.upper() + " after " + " ".join(f"p{i}" for i in range(50))), (14, "say it again " * 20), (7, base), (15, "A B c d e"), (16, "a b C d e"), (17, "x\x0by\x85z\xa0w"),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), *["z"] * len(CLASH)) for i, t in rows()]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def words(t):
    return (t or "").encode().split()


def test_substring_dedup(docs, none):
    seen = Counter(tuple(w[i : i + 35]) for _, t in rows() for w in [words(t)] for i in range(len(w) - 34))
    want = []
    for i, t in rows():
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r)[:4] for r in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substring_dedup.substring_dedup(none).count() == 0


def shingles(t):
    w = words((t or "").encode().translate(bytes(c + 32 if 65 <= c < 91 else c for c in range(256))).decode())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts if i is not None}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sets, label


def test_near_dedup(docs, none):
    sets, label = brute_components(rows())
    for r in near_dedup.near_dedup(docs).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept and r.n_shingles == 1
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id)
    assert near_dedup.near_dedup(none).count() == 0
    assert near_dedup.keep_one(docs).columns == docs.columns


def test_names_in_other_cases(spark, docs):
    """Columns of the caller that differ from an operator's own names by case only."""
    own = spark.createDataFrame([(i, t, "en", c, c) for i, t in rows() for c in "z"], "doc_id long, text string, lang string, Slot string, KEPT_ID string")
    out = sharding.place(own)
    assert out.columns == ["doc_id", "text", "lang", "KEPT_ID", "slot", "shard"] and out.select("KEPT_ID", "slot").count() == len(rows())
    labels, items = spark.createDataFrame([(1, 1)], "doc_id long, quality int"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    wide = own.withColumnsRenamed({"Slot": "Stratum"}).selectExpr("*", *[f"'x' AS {c}" for c in ("Band", "Words", "HITS", "Component", "RID", "Block", "Place", "Start", "Label", "ROW", "Hit_Id", "Gone_Id", "Kept_Key", "Found", "N")])
    for made in (near_dedup.keep_one(wide), quality.keep(wide, labels), decontam.without_contaminated(wide, items), secrets.redact(wide)):
        assert made.columns == wide.columns and made.count() > 0
    for made in (substring_dedup.substring_dedup(wide), near_dedup.near_dedup(wide), token_counts.token_counts(wide, WORDS), secrets.secret_scan(wide), quality.judge(wide, labels)):
        assert made.count() == len(rows())


def test_near_dedup_chains_and_open_buckets(spark):
    """Groups of edits of one text: many pairs just above and below the threshold, linked over third documents only."""
    r = np.random.default_rng(5)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(90)]
        for _ in range(60):
            w = list(base)
            for k in r.choice(90, r.integers(0, 7), replace=False):
                w[k] = f"new{r.integers(1 << 30)}"
            texts.append((len(texts), " ".join(w)))
    order = r.permutation(len(texts))
    data = [(int(order[i]), t) for i, t in texts]
    sets, label = brute_components(data)
    got = {x.doc_id: x.component_id for x in near_dedup.near_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == label


def test_sketches_estimate():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(200):
        x = r.integers(0, 2**63, 400, dtype=np.uint64)
        sets += [np.sort(x[:350]), np.sort(x[50:])]  # a similarity of 0.75
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    bands, small, large = near_dedup.signatures(starts, np.concatenate(sets))
    differ = lambda s: np.bitwise_count((s[::2] ^ s[1::2]).view(np.uint64)).sum(axis=1)
    assert differ(small).max() <= near_dedup.MAX_APART and differ(large).max() <= near_dedup.FINE_APART
    assert abs(differ(large).mean() - 297) < 6 and (bands[::2] == bands[1::2]).any(axis=1).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.id: r.component for r in components(links)[0].collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_token_counts(docs, none):
    vocabulary = set(token_counts.word_pieces(WORDS))

    def count(word):
        word, n = bytes(c + 32 if 65 <= c < 91 else c for c in word) + b" ", 0
        while word and word != b" ":
            k = next(k for k in range(len(word), 0, -1) if word[:k] in vocabulary)
            n, word = n + 1, word[k:]
        return n

    want = [(i, len(words(t)), sum(map(count, words(t)))) for i, t in rows()]
    assert sorted(map(tuple, token_counts.token_counts(docs, WORDS).collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(none, WORDS).count() == 0


def test_automaton_on_small_vocabularies():
    for seed in range(100):
        r = np.random.default_rng(seed)
        pieces = sorted({bytes(r.choice([97, 98, 99], r.integers(1, 5)).tolist()) + (b" " if r.random() < 0.3 else b"") for _ in range(8)})
        for w in [bytes(r.choice([97, 98, 99], r.integers(1, 9)).tolist()) for _ in range(20)]:
            rest, n = w + b" ", 0
            while rest and rest != b" ":
                k = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
                n, rest = (n + 1, rest[k:]) if k else (1, b"")
            made = token_counts.Automaton(pieces).count(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
            assert made.tolist() == [n], (w, pieces)


def test_warc(spark):
    big = "x" * 120
    data = [(1, "http://a b\n", None), (2, None, big), (3, "u", big), (3, "u", big), (None, "u", big), (2, "u", big), (5, "é", "kurz"), (6, "z", "kurz"), (7, "q", "é\r\n\r\nWARC/1.1\r\n\n\x00" * 20)]
    pages = spark.createDataFrame([(*r, "z", "z") for r in data], "page_id long, url string, html string, digest string, payload string")
    want = [(p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and p == 3 else "response", 2 if h == big and p == 3 else None) for p, _, h in data]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.warc_round_trip(pages.where("1 = 0")).count() == 0


def test_warc_predicates_reach_the_reader(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same text " * 20 if i < 5 else f"own {i}") for i in range(10)], "page_id long, url string, html string")
    for compression in ("none", "gzip"):
        path = f"file://{tmp_path}/{compression}"
        warc.write_archives(pages, path, compression=compression)
        all_ = warc.read_archives(spark, path)
        assert {r.page_id for r in all_.where("record_type = 'revisit' and page_id > 2").collect()} == {3, 4}
        one = all_.where("url = 'http://h/7'").select("payload")
        assert bytes(one.first().payload) == b"own 7"
        assert "Filter (" not in one._jdf.queryExecution().executedPlan().toString()


def test_elias_fano():
    r = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 65, 129, 1000):
        for top in (0, 1, 5, 10**6, 2**40):
            v = np.sort(r.integers(0, top + 1, n))
            e = token_store.EliasFano.from_bytes(token_store.EliasFano.of(v).to_bytes())
            assert [e[i] for i in range(n)] == v.tolist() and len(e.to_bytes()) < 60 + n * (3 + (top // n).bit_length()) / 8 + n / 16 + 8
            for i in {0, n // 3, n - 1}:
                for k in {1, n // 2, n - i}:
                    assert e.slice(i, min(k, n - i)).tolist() == v[i : i + min(k, n - i)].tolist()
            for x in (0, int(v[n // 2]), int(v[-1]), int(v[-1]) + 1):
                assert e.first_at_least(x) == int(np.searchsorted(v, x))
    with pytest.raises(ValueError):
        token_store.EliasFano.of(np.array([3, 2]))


def test_token_files_are_read_by_doc_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store._Reader, "ROWS", 7)
    data = [(None if i < 3 else i * i - 500, "word " * (i % 9)) for i in range(120)]
    path = f"file://{tmp_path}/tokens"
    token_store.write_tokens(spark.createDataFrame(data, "doc_id long, text string"), WORDS, path)
    all_ = token_store.read_tokens(spark, path, "doc_id long, start long, n_tokens long, ids array<long>")
    rows = sorted(all_.collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows[:-1]]).tolist() and all(len(r.ids) == r.n_tokens for r in rows)
    for test in ("doc_id = 400", "doc_id > 13000", "doc_id between -400 and 99", "doc_id <= -491 and doc_id >= -491", "doc_id < -1000", "doc_id is not null", "doc_id is null"):
        found = all_.where(test)
        assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in spark.createDataFrame(rows, all_.schema).where(test).collect()), test
        assert (" Filter " in found._jdf.queryExecution().executedPlan().toString()) == (test == "doc_id is null")


def test_token_store(docs, none):
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(WORDS), 0, []
    for i, t in sorted(rows(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.token_round_trip(docs, WORDS).collect()), key=str) == sorted(want, key=str)
    assert token_store.token_round_trip(none, WORDS).count() == 0


def test_part_encoder_equals_the_library():
    import random

    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(WORDS), token_store.PartEncoder(WORDS)
    assert encoder.by_parts
    parts = ["a", "B", "é", "é", "É", "Ö", "ж", "Ж", " ", "\n", " ", "\xa0", "'s", "'", "'LL", "l", "ve", "3", "<|endoftext|>", "<", "|", "ß", "Σ", "ΑΣ", "ς", "İ", "ı", "ſ", "ǆ", "ʹ", "ʰ", "ª", "́", "한", "ᄒ", "ᅡ", "🙂", "\x1c", "\x85", "​", "\t", "ﬁ", "</w>", ".", ",,", "###", "_", "²", "¼", "word", "ا", "ً", "א", "\0", "x"]
    texts = ["".join(random.Random(i).choices(parts, k=random.Random(-i).randint(0, 14))) for i in range(6000)]
    for i in range(0, len(texts), 50):
        for s, ids in zip(texts[i : i + 50], encoder([t.encode() for t in texts[i : i + 50]])):
            assert np.frombuffer(ids, encoder.kind).tolist() == [*library.encode(s, add_special_tokens=False).ids, 1], s
    letters = "".join(map(chr, range(0x80, 0x800)))
    for s in [f"a{c}b {c}' {c}, x{c}" for c in letters]:
        assert np.frombuffer(encoder([s.encode()])[0], encoder.kind).tolist() == [*library.encode(s, add_special_tokens=False).ids, 1], s


def test_part_encoder_forgets_and_finds_again(monkeypatch):
    monkeypatch.setattr(token_store.PartEncoder, "MOST", 50)
    encoder, fresh = token_store.PartEncoder(WORDS), token_store.PartEncoder(WORDS)
    r = np.random.default_rng(3)
    for _ in range(30):
        text = " ".join(f"w{x}" if x % 3 else f"été{'x' * (x % 7)}!" for x in r.integers(0, 200, 40)).encode()
        fresh.now = fresh.before = token_store.Known(fresh.kind)
        assert encoder([text, b"", text]) == fresh([text, b"", text])


def test_tokenizers_of_other_kinds_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, s = token_store.PartEncoder(path), "Two  words,\n and more"
    assert not encoder.by_parts
    assert np.frombuffer(encoder([s.encode()])[0], encoder.kind).tolist() == [*Tokenizer.from_file(path).encode(s, add_special_tokens=False).ids, 1]


def test_piece_codec(docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t in rows():
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = piece_codec.piece_codec(docs, PIECES, full=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert piece_codec.piece_codec(none, PIECES).count() == 0


def test_piece_codec_ids_and_spans_equal_the_library():
    import random

    codec = piece_codec.PieceCodec(PIECES)
    parts = ["a", "B", "é", "▁", " ", "  ", "\n", "\xa0", "'", "3", "<s>", "</s>", "<unk>", "ß", "🙂", "\x1c", "\0", "한", "\t", "ﬁ", "ing", "tion", "the"]
    for i in range(1500):
        r = random.Random(i)
        s = "".join(r.choices(parts, k=r.randint(0, 14)))
        ids, text = codec.encode([s.encode()])[0]
        assert ids == codec.model.encode(s, add_eos=True) and text.decode() == " ".join(map(str, ids)), s
        for (a, b), p in zip(codec.spans(s.encode(), ids), codec.model.encode(s, return_type="proto").pieces):
            assert (a, b) == (p.begin, p.end) or p.piece.startswith("<0x"), (s, p)


def test_character_map():
    """A hand-made double array: a -> x, ab -> yz; the longest prefix wins and each byte knows its source."""
    texts = b"x\0yz\0"
    units = [0] * 512
    unit = lambda label, offset, leaf: offset << 10 | leaf << 8 | label
    units[0] = unit(0, 1, 0)
    a = 1 ^ ord("a")
    units[a] = unit(ord("a"), a ^ 256, 1)
    units[256] = 0 | 1 << 31
    ab = 256 ^ ord("b")
    units[ab] = unit(ord("b"), ab ^ 257, 1)
    units[257] = 2 | 1 << 31
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + texts
    spec = b"\x12" + bytes([len(blob) & 127 | 128, len(blob) >> 7]) + blob + b"\x18\x00\x20\x00\x28\x00"
    normal, align = piece_codec.Normalizer(spec)(b"aabcb")
    assert normal == b"xyzcb" and align.tolist() == [0, 1, 1, 3, 4, 5]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, ITEM, "z"), (2, None, "z"), (3, "too short", "z"), (4, " ".join(f"q{i}" for i in range(40)), "z")], "item_id long, text string, doc_id string")
    got = decontam.decontaminate(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(13, 1)]
    kept = decontam.without_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(rows()) - 1
    assert decontam.decontaminate(none, items).count() == 0 and decontam.decontaminate(docs, items.where("1 = 0")).count() == 0


def test_token_files_of_far_doc_ids(spark):
    """The least and the greatest doc_id in one file, the least apart from null."""
    ends = [None, -(2**63), -5, 0, 2**63 - 1]
    docs_ = spark.createDataFrame([(i, f"text {i}") for i in ends], "doc_id long, text string").coalesce(1)
    rows_ = {r.doc_id: r.start for r in token_store.token_round_trip(docs_, WORDS).collect()}
    assert sorted(rows_.values()) == [rows_[i] for i in ends]
    numbers = token_store.Numbers.of(np.array([0, 0, *ends[1:]], np.int64), 2)
    back = token_store.Numbers.from_bytes(numbers.to_bytes())
    assert back.slice(0, 6).to_pylist() == [None, None, *ends[1:]] and back.slice(3, 2).to_pylist() == ends[2:4]
    assert [back.first_at_least(i) for i in (-(2**63), -(2**63) + 1, 1, 2**63 - 1)] == [2, 3, 5, 5]


def test_paraphrase_needs_the_answer():
    item = decontam.items_of([(1, ITEM)])[0]
    hashed = lambda s: decontam.words_of([s.encode()]).hash.tolist()
    answer = "It is the mount of Arenthal near the western gate"
    assert decontam.found(item, hashed("which tallest seven mountains river? " + answer))[1]
    assert decontam.found(item, hashed("which tallest seven mountains river? the mount of it near gate the")) is None


def test_short_answers_and_short_items():
    hashed = lambda s: decontam.words_of([s.encode()]).hash.tolist()
    item = decontam.items_of([(1, "Which river runs past the old northern capital of the kingdom? Arenthal.")])[0]
    assert decontam.found(item, hashed("the river that runs past the northern capital kingdom is Arenthal")) == (8, True)
    assert decontam.found(item, hashed("Arenthal the river that runs past the northern capital kingdom is")) is None
    assert decontam.answer_of("How far is it to the sea, forty two miles") == "forty two miles" and decontam.answer_of("a b c d e f g h") == "f g h"
    five = decontam.items_of([(2, "five words stand right here"), (3, None), (4, "?!"), (5, "Five words stand right here")])
    assert [i.item_ids for i in five] == [[2, 5]]
    assert decontam.found(five[0], hashed("look: Five words stand right here.")) == (5, False) and decontam.found(five[0], hashed("five words stand here right")) is None


def test_items_of_any_length_are_matched(spark):
    """Short ones exactly; items with the same words are reported each; null doc_ids are sampled by their texts."""
    docs_ = spark.createDataFrame([(1, "so: Yes it is"), (2, "yes yes"), (None, "is it"), (None, "go to sea now"), (3, "five words stand here right")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "it is"), (3, "to sea now"), (4, "To sea, now!"), (5, "five words stand right here"), (6, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.item_words, r.common_words) for r in decontam.decontaminate(docs_, items).collect())
    assert got == Counter([(1, 1, 1, 1), (2, 1, 1, 1), (1, 2, 2, 2), (None, 3, 3, 3), (None, 4, 3, 3)])


def test_a_shared_opening_names_no_item():
    """Places to verify grow with the texts, not with the items that begin alike."""
    r = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 3000, n))
    items = decontam.items_of([(k, f"Which of the following is {word(4)}?") for k in range(2000)])
    texts = [f"which of the following is {word(20)}".encode() for _ in range(400)]
    words, idf = decontam.words_of(texts), np.ones(decontam.FEATURES, np.float32)
    found = [run.starts(words) for run in decontam.Runs.of(items, idf)]
    assert sum(len(x[0]) for x in found) < 2 * len(texts)
    verbatim = decontam.words_of([f"so {word(9)} which of the following is".encode(), b"x"])
    assert sum(len(run.starts(verbatim)[0]) for run in decontam.Runs.of(items, idf)) < 4


def test_the_cosine_alone_finds_items_of_some_length(spark):
    """Without the runs: recall by length, of verbatim items and of paraphrases, among 1,500 items."""
    r = np.random.default_rng(11)
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text")
    texts = [x.text.split() for x in docs_.orderBy("doc_id").collect() if len(x.text.split()) > 120]
    made = []
    for k in range(1500):
        n = int((10, 12, 16, 24, 48, 80)[k % 6])
        t = texts[int(r.integers(len(texts)))]
        at = int(r.integers(len(t) - n))
        own = t[at : at + n]
        told = own if k % 2 or n < 16 else [w for w in own[:-3] if r.random() < 0.75] + own[-3:]
        around = [" ".join(texts[int(r.integers(len(texts)))][:40]) for _ in range(2)]
        made.append((n, k % 2 or n < 16, " ".join(own), f"{around[0]} {' '.join(told)} {around[1]}"))
    items = decontam.items_of([(k, m[2]) for k, m in enumerate(made)])
    tests = spark.createDataFrame([(m[2], 8.0) for m in made], "text string, weight double")
    idf, _ = decontam.inverse_weights(docs_)
    from pyspark.sql import functions as F

    image, turn = decontam.fit(docs_.select("text", F.lit(1.0).alias("weight")).union(tests), idf)
    projection = (decontam.read_image(image) @ turn.astype(np.float32)) * idf[:, None]
    targets, owner, _ = decontam.targets_of(items, projection)
    number = {k: i for i, item in enumerate(items) for k in item.item_ids}
    text, _, target = decontam.candidates(decontam.words_of([m[3].encode() for m in made]), projection, targets)
    near = set(zip(text.tolist(), owner[target].tolist()))
    hit: dict[tuple, list[bool]] = {}
    for k, (n, verbatim, _, told) in enumerate(made):
        if verbatim or decontam.found(items[number[k]], decontam.words_of([told.encode()]).hash.tolist()):
            hit.setdefault((n, bool(verbatim)), []).append((k, number[k]) in near)
    assert all(sum(x) >= 0.9 * len(x) for x in hit.values()), {k: sum(x) / len(x) for k, x in hit.items()}


def test_windows_are_searched_in_slices(monkeypatch):
    r = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 400, n)).encode() for n in (3000, 0, 5, 40, 9, 700)]
    words, projection = decontam.words_of(texts), r.standard_normal((decontam.FEATURES, 8)).astype(np.float32)
    items = decontam.items_of([(k, " ".join(texts[0].decode().split()[k * 50 : k * 50 + 40])) for k in range(20)])
    targets = decontam.targets_of(items, projection)[0]
    whole = [set(zip(*(x.tolist() for x in decontam.candidates(words, projection, targets))))]
    monkeypatch.setattr(decontam, "WINDOWS", 7)
    monkeypatch.setattr(decontam, "TARGETS_AT_ONCE", 3)
    whole.append(set(zip(*(x.tolist() for x in decontam.candidates(words, projection, targets)))))
    assert len(whole[0]) >= 20 and len(whole[0] ^ whole[1]) <= 0.01 * len(whole[0])  # sums in another order


def test_a_text_of_two_million_words(spark):
    """Holds an item in its middle; a product of all its windows with all items would take gigabytes."""
    r = np.random.default_rng(8)
    w = np.char.add("v", r.integers(0, 50_000, 2_000_000).astype(str)).tolist()
    w[1_000_000:1_000_000] = ITEM.split()
    items = [(1, ITEM)] + [(k, " ".join(np.char.add("q", r.integers(0, 50_000, 40).astype(str)))) for k in range(2, 2000)]
    long = spark.createDataFrame([(1, " ".join(w)), (2, "short")], "doc_id long, text string")
    assert [(x.doc_id, x.item_id) for x in decontam.decontaminate(long, spark.createDataFrame(items, "item_id long, text string")).collect()] == [(1, 1)]


def test_paraphrases_are_found_on_several_blocks(spark, monkeypatch):
    """Half, or a little more, of an item's words in their order between other words, and its last sentence whole."""
    import random

    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 100)
    r = random.Random(7)
    word = lambda: f"{r.choice('abcdefghij')}{r.randrange(2000)}"
    items, docs_, want = [], [], set()
    for k in range(300):
        body, answer = [word() for _ in range(r.randrange(16, 50))], [word() for _ in range(4)]
        items.append((k, " ".join(body) + ". " + " ".join(answer) + "."))
        kept = set(r.sample(range(len(body)), round(0.6 * len(body))))
        told = [w if i in kept else word() for i, w in enumerate(body)]
        docs_.append((k, " ".join([word() for _ in range(60)] + told + answer + [word() for _ in range(60)])))
        if decontam.found(decontam.items_of(items[-1:])[0], decontam.words_of([docs_[-1][1].encode()]).hash.tolist()):
            want.add((k, k))
    got = {(x.doc_id, x.item_id) for x in decontam.decontaminate(spark.createDataFrame(docs_, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 250 and len(want & got) >= 0.95 * len(want)


def test_a_basis_of_a_small_sample_searches_everything(spark, monkeypatch):
    """The pipeline's stage with the basis fitted on about a tenth of the corpus: every text is searched, and recall stays."""
    import random

    monkeypatch.setattr(decontam, "SAMPLE", 512)
    r = random.Random(11)
    word = lambda: f"{r.choice('abcdefghij')}{r.randrange(2000)}"
    items = [(k, " ".join(word() for _ in range(r.randrange(16, 50))) + ". " + " ".join(word() for _ in range(4)) + ".") for k in range(200)]
    docs_, want = [], set()
    for k in range(900):
        text = [word() for _ in range(150)]
        if k % 3 == 0:
            own = items[k % 200][1].split()
            kept = set(r.sample(range(len(own) - 4), round(0.65 * (len(own) - 4)))) | set(range(len(own) - 4, len(own)))
            text[60:60] = [w if i in kept else word() for i, w in enumerate(own)]
            if decontam.found(decontam.items_of([items[k % 200]])[0], decontam.words_of([" ".join(text).encode()]).hash.tolist()):
                want.add(k)
        docs_.append((k, " ".join(text)))
    made = spark.createDataFrame(docs_, "doc_id long, text string")
    assert decontam.inverse_weights(made)[1] > 4000
    kept = {x.doc_id for x in decontam.without_contaminated(made, spark.createDataFrame(items, "item_id long, text string")).collect()}
    gone = set(range(900)) - kept
    assert len(want) > 250 and len(want & gone) >= 0.9 * len(want) and all(k % 3 == 0 for k in gone)


def test_decontamination_finds_what_brute_force_finds(spark):
    d = "/root/testdata/sf0.001"
    docs_, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    own = decontam.items_of([(r.item_id, r.text) for r in items.collect()])
    want = set()
    for r in docs_.collect():
        w = decontam.words_of([(r.text or "").encode()]).hash.tolist()
        for i in own:
            n = len(i.words)
            if len(set(w) & set(i.words)) >= 0.5 * len(set(i.words)) and any(decontam.found(i, w[k : k + 2 * n]) for k in range(0, max(1, len(w) - n), n // 4)):
                want |= {(r.doc_id, k) for k in i.item_ids}
    got = {(r.doc_id, r.item_id) for r in decontam.decontaminate(docs_, items).collect()}
    assert want and len(want & got) >= 0.9 * len(want)


def test_secret_scan(docs, none):
    import re

    kinds = [("assign", re.compile(secrets.BASE[0].pattern, re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.secret_scan(docs).collect())
    want = Counter()
    for i, t in rows():
        spans = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m.group(g)) >= least]
        n = [sum(s[1] == k for s in spans) for k in range(3)]
        want[(i, *n, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest())] += 1
    assert got == want and secrets.secret_scan(none).count() == 0


def test_secrets_are_redacted(docs):
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows())
    by = {r.doc_id: r.text for r in clean.collect()}
    assert by[12] == 'x [assign]" [access] [hex] TOKEN:abc [assign]' and by[1] is None and by[6] == LONG


def test_many_secrets_in_one_text(spark):
    """Places of 20,000 matches, and what is left of their text, in time that grows with the text."""
    import time

    text = "".join(f"né {i:06d} 🙂 token = {i:08x} {'0f' * 13} " for i in range(10_000))
    docs_ = spark.createDataFrame([(1, text), (2, "token = 12345678"), (3, None)], "doc_id long, text string").repartition(1)
    secrets.secret_scan(docs_.where("doc_id > 1")).collect()
    secrets.redact(docs_.where("doc_id > 1")).collect()
    began = time.time()
    r = secrets.secret_scan(docs_).where("doc_id = 1").first()
    middle = time.time()
    clean = secrets.redact(docs_).where("doc_id = 1").first().text
    assert clean == "".join(f"né {i:06d} 🙂 [assign] [hex] " for i in range(10_000))
    assert (r.n_assign, r.n_hex) == (10_000, 10_000) and middle - began < 10 and time.time() - middle < 10
    unit = len(f"né {0:06d} 🙂 token = {0:08x} {'0f' * 13} ")
    assert r.spans.startswith("assign:12:28,hex:29:55") and r.spans.endswith(f"hex:{9_999 * unit + 29}:{9_999 * unit + 55}")


def test_masks_at_the_borders_of_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(secrets, "LETTERS", 4)
    monkeypatch.setattr(secrets, "SUMS", 3)
    rows_ = []
    for i in range(200):
        r = random.Random(i)
        text = "".join(r.choices("aé🙂\n", k=r.randint(1, 30)))
        spots = sorted((a, 0, "k", r.randint(a + 1, len(text))) for a in (r.randrange(len(text)) for _ in range(r.randint(1, 12))))
        out, at = "", 0
        for a, _, k, b in spots:
            out += text[at:a] + "[k]" if a >= at else ""
            at = max(at, b)
        rows_.append((text, spots, out + text[at:]))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows_, f"text string, found array<{secrets.SPOT}>, want string")
    assert df.where(secrets.masked(F.col("text"), F.col("found")) != F.col("want")).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == secrets.ANY
    assert secrets.trigram_query("ab(cd|ef)+x") == frozenset([frozenset(["abc", "bcd"]), frozenset(["abe", "bef"])]) or secrets.trigram_query("ab(cd|ef)+x") == secrets.ANY
    import random
    import re

    for i in range(300):
        r = random.Random(i)
        p = "".join(r.choice(["abc", "a?", "[xy]bc", "(ab|cde)", "d+", "(abc)*", ".", "bcd"]) for _ in range(4))
        text = "".join(r.choices("abcdexy", k=40))
        if re.search(p, text):
            assert any(all(t in text for t in need) for need in secrets.trigram_query(p)), (p, text)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0, "z"), (1, None, 0, "z"), (None, 1, 0, "z"), (6, 0, 0, "z"), (6, 1, 0, "z")], "doc_id long, quality int, toxic int, text string")
    for r in quality.judge(docs, labels).collect():
        if r.doc_id == 14:
            assert (r.n_words, r.n_repeat_words, r.base_failed, r.kept) == (60, 60, True, False)
        if r.doc_id == 6:
            assert (r.n_words, r.n_repeat_words, r.kept) == (30_000, 0, True)
        if r.doc_id in (1, 2, 3):
            assert (r.n_words, r.base_failed) == (0, True)
    assert quality.judge(none, labels.where("1 = 0")).count() == 0
    assert quality.keep(docs, labels).columns == docs.columns


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    cases = [(0, 10, 0.3), (2, 50, 0.1), (7, 400, 0.03), (1, 2000, 0.006)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for k, n, p in cases:
        got = df.where((F.col("k") == k) & (F.col("n") == n)).select(quality.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).first().t
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(got - want) < 1e-9 * max(want, 1) or k >= n * p


def test_thresholds_keep_their_promise(spark):
    """3000 good documents without symbols and 1000 bad ones full of them: the rule is admitted and spares the good."""
    good = [(i, " ".join(f"word{i}a{k}" for k in range(30)), "en") for i in range(3000)]
    bad = [(3000 + i, " ".join(f"###wo%%{i}$${k}" for k in range(30)), "en") for i in range(1000)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(table, labels).where("kept").collect()}
    assert kept == set(range(3000))


def brute_cutoffs(measured, good):
    """stratum -> rule -> cutoff, in plain Python."""
    from math import comb

    rate = {
        "symbols": lambda r: 1000 * r.n_symbols // r.word_chars, "capitals": lambda r: 1000 * r.n_capitals // r.word_chars, "exclaims": lambda r: 1000 * r.n_exclaims // r.word_chars,
        "repeats": lambda r: 1000 * r.n_repeat_words // r.n_words, "lines": lambda r: 1000 * r.n_dup_lines // r.n_words,
    }
    rates = {}
    for r in measured:
        if r.doc_id in good:
            part = int(hashlib.sha256(str(r.doc_id).encode()).hexdigest()[:2], 16) % 3 == 0
            rates.setdefault(r.stratum, ([], []))[part].append({n: f(r) if r.n_words else 0 for n, f in rate.items()})
    held = {s: x for s, x in rates.items() if x[0]}
    out = {}
    for s, (held_out, proposing) in held.items():
        least = {n: next((k for k, c in enumerate(cuts) if 5 * sum(x[n] >= c for x in proposing) <= len(proposing) * quality.RISK), len(cuts)) for n, (_, cuts) in quality.RULES.items()}
        for step in range(6):
            cut = {n: cuts[max(5 - step, least[n])] if least[n] < 6 else 1e9 for n, (_, cuts) in quality.RULES.items()}
            k, n = sum(any(x[r] >= c for r, c in cut.items()) for x in held_out), len(held_out)
            if sum(comb(n, i) * quality.RISK**i * (1 - quality.RISK) ** (n - i) for i in range(k + 1)) > quality.LEVEL / len(held):
                break
            out[s] = {r: c for r, c in cut.items() if c < 1e9}
    return out


def test_cutoffs_equal_brute_force(spark):
    """On tables large enough for several strata to admit cutoffs."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    measured = quality.features(spark.read.parquet(f"{d}/documents.parquet")).cache()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    got = {r.stratum: {k: v for k, v in r.cutoffs.items() if v is not None} for r in quality.calibrate(measured, labels).collect()}
    assert got == brute_cutoffs(measured.collect(), good) and len(got) >= 3


def test_a_document_of_two_languages_is_judged_by_each(spark):
    """One id and text in two strata: only the one with labels has a cutoff, and only its row goes."""
    good = [(i, " ".join(f"word{i}a{k}" for k in range(30)), "en") for i in range(600)]
    bad = " ".join(f"###wo%%$${k}" for k in range(30))
    table = spark.createDataFrame([*good, (9999, bad, "en"), (9999, bad, "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    assert [r.lang for r in quality.keep(table, labels).where("doc_id = 9999").collect()] == ["xx"]


def test_sharding(docs, none):
    table = sharding.fill(sharding.shard_names(7), 997)
    counts = Counter(table)
    assert set(table) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(sharding.shard_names(6), 997)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 0.25 * 997
    placed = sharding.place(docs).collect()
    assert len(placed) == len(rows()) and len({r.shard for r in placed if r.doc_id == 7}) == 1
    whole = sharding.fill(sharding.shard_names(sharding.SHARDS))
    for r in placed:
        slot = int(hashlib.sha256(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, whole[slot])
    assert sharding.place(none).count() == 0


def test_stages(spark, docs, none):
    d = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
        assert stage(spark, none, d).count() == 0, name


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id for r in corpus_pipeline.run(spark, d).collect()}
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id for r in quality.judge(documents, labels).where("kept").collect()}
    _, label = brute_components([(r.doc_id, r.text) for r in documents.collect() if r.doc_id in kept])
    alone = {i for i, c in label.items() if i == c}
    leaks = {r.doc_id for r in decontam.decontaminate(documents, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert got == alone - leaks


def test_long_items_are_found_where_copied(spark):
    import random

    r = random.Random(5)
    made = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(3000)}" for _ in range(n))
    # each long item's passages differ, so no one window resembles the whole item
    items = [(k, made(n)) for k, n in enumerate([100, 240, 360, 600, 1000] * 6)]
    docs_ = spark.createDataFrame([(k, f"{made(50)} {t} {made(50)}") for k, t in items], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.common_words, r.item_words) for r in decontam.decontaminate(docs_, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sorted(got) == [(k, k) for k, _ in items] and all(c == n for c, n in got.values())


def test_short_items_are_found_on_a_large_benchmark(spark):
    import random

    r = random.Random(6)
    docs_ = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text")
    texts = [(x.doc_id, x.text.split()) for x in docs_.orderBy("doc_id").collect() if len(x.text.split()) > 40]
    items, source = [], {}
    for k in range(3000):
        doc, t = r.choice(texts)
        at = r.randrange(len(t) - 8)
        items.append((k, " ".join(t[at : at + 8])))
        source[k] = doc
    long_enough = {k for i in decontam.items_of(items) for k in i.item_ids}
    got = {(r.doc_id, r.item_id) for r in decontam.decontaminate(docs_, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert sum((source[k], k) in got for k in long_enough) >= 0.99 * len(long_enough)
