"""Encoding, packing and token files against the tokenizers library and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from patchlake.llm import bpe, packing, rans, text_queries, token_files
from patchlake.llm.storage import new_folder, staged

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "   ", "Hello, wörld!", "Hello, wörld!", "don't 'sam '' ''s !'s I'LL they're 'll'll a'b'", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>",
    "éa ́x 　y\x1cz\u0085", "İSTANBUL ΑΣ ½²Ⅷ ﬁ ẞ", "日本語テキスト🎉👨‍👩‍👧", "x" * 3000, "abc123 " * 300, "word " * 5000, "x\u0000y ﻿z",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts; ids repeat for equal rows, one id is null, and other columns have the names of results."""
    rows = [(k, text, "clash", 7) for k, text in enumerate(TEXTS)] + [(4, TEXTS[4], "clash", 7), (None, "no id", "clash", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, row int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH), keep=3)  # the chunk table starts anew all the time
    for _ in range(2):
        for text in TEXTS:
            flat, counts = encoder.encode([text and text.encode(), None])
            assert flat.tolist() == ids_of(library, text) and counts.tolist() == [len(flat), 0]


def test_long_fragments(library):
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    rng = np.random.default_rng(1)
    for n in (63, 64, 65, 200, 1000):
        word = "".join(rng.choice(list("aeiouthns"), n))
        assert encoder.encode([word.encode()])[0].tolist() == ids_of(library, word)


def test_a_batch_asks_for_a_chunk_once():
    """However often a chunk stands in a batch, the chunk table is asked once; white space is as bytes.split() has it."""
    asked = []

    class Asked(bpe.Numbered):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    texts = [b"", b" ", b"the cat the\tcat\x0b\x0cthe ", None, b"\r\nthe\x1ccat \xc2\xa0cat the"]
    words, of, counts = bpe.distinct_chunks([x or b"" for x in texts])
    assert [words[k] for k in of] == [x for text in texts for x in (text or b"").split()]
    assert counts.tolist() == [len((text or b"").split()) for text in texts]
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    encoder.known = Asked()
    encoder.encode(texts)
    assert sorted(asked) == sorted(set(words)) and len(words) == 4


def test_ranks_of_pairs():
    """Pairs whose slot another pair has taken are found behind it, others nowhere."""
    vocabulary = bpe.load_vocabulary(PATH)
    encoder = bpe.Encoder(vocabulary)
    left, right, _ = vocabulary.merges.T
    assert np.array_equal(encoder._rank(left, right), np.arange(len(left)))
    merges = set(zip(left.tolist(), right.tolist(), strict=True))
    some = np.random.default_rng(2).integers(0, len(vocabulary.tokens), (2, 20_000))
    found = encoder._rank(*some) < bpe.NEVER
    assert found.tolist() == [pair in merges for pair in zip(*some.tolist(), strict=True)]


def test_character_classes(library):
    """A sample of all planes, tried out on the library's own splitter."""
    classes = bpe.load_vocabulary(PATH).classes
    for code in range(0x20, 0x30000, 7):
        if 0xD800 <= code < 0xE000 or code == 0x27:
            continue
        letter, mark = (len(library.pre_tokenizer.pre_tokenize_str(x + chr(code))) for x in "x!")
        want = {(1, 2): 1, (1, 1): 0, (2, 1): 3, (2, 2): 2}[letter, mark]
        assert classes[code] == want, hex(code)


def test_round_trip(spark, docs, nothing, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).withColumnRenamed("id", "doc_id").collect())
    want = []
    for row in docs.collect():
        ids = ids_of(library, row.text)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((row.doc_id is None, row.doc_id or 0, len(ids), *sha))
    assert got == sorted(want)
    decoded = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).where("id = 3").first()
    assert decoded.decoded == library.decode(ids_of(library, TEXTS[3]), skip_special_tokens=False)
    assert bpe.round_trip(nothing, PATH).count() == 0


def packed_rows(frame):
    return sorted(frame.collect(), key=lambda r: (r.sequence_id, r.offset))


def test_packing(docs, nothing, library):
    rows = packed_rows(packing.pack_documents(docs, PATH, 64))
    at, last = 0, None
    for row in rows:
        at = 0 if row.sequence_id != last else at
        assert row.offset == at and at + row.length <= 64
        at, last = at + row.length, row.sequence_id
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for row in docs.collect():
        ids = np.array([*ids_of(library, row.text), 0], dtype="<u4")
        want += [(row.doc_id is None, row.doc_id or 0, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    assert pieces == sorted(want)
    assert packing.pack_documents(nothing, PATH, 64).count() == 0


def test_local_search():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 100, 500), rng.integers(30, 60, 300), np.array([100, 1, 1, 99, 50, 50])):
        where, offset, fill = packing.pack_lengths(lengths, 100)
        sums = np.bincount(where, weights=lengths)
        assert sums.max() <= 100 and (sums[where] == fill).all() and len(sums) >= -(-lengths.sum() // 100)
        greedy = packing.Bins(100)
        for x in sorted(lengths.tolist(), reverse=True):
            greedy.add(x, 0)
        assert len(sums) <= len(greedy.items)
    # Best fit, longest first, takes three bins here; exchanges make it two.
    bins = packing.Bins(100)
    for at, items in enumerate([[45, 30], [45, 30], [25, 25]]):
        bins.free.append(100)
        bins.items.append([])
        bins.open.append((100, at))
        for length in items:
            bins._put(at, length, 10 * at + len(bins.items[at]))
    bins.improve()
    assert sorted(map(len, bins.items)) == [0, 3, 3]


@pytest.mark.parametrize("low,high,n,capacity,saved", [(300, 901, 3000, 2048, 12), (500, 1101, 3000, 2048, 30), (30, 60, 300, 100, 1)])
def test_local_search_saves_bins(low, high, n, capacity, saved):
    """Fewer bins than best fit alone, and no step that lowers the sum of squared fills."""
    lengths = np.random.default_rng(3).integers(low, high, n)
    bins = packing.Bins(capacity)
    for at in np.argsort(-lengths, kind="stable").tolist():
        bins.add(int(lengths[at]), at)
    greedy = len(bins.items)
    squares = sum((capacity - free) ** 2 for free in bins.free)
    packing.Exchange(bins).run()
    assert sum((capacity - free) ** 2 for free in bins.free) > squares
    assert sorted(piece for items in bins.items for _, piece in items) == list(range(n))
    bins.improve()
    assert sum(map(bool, bins.items)) <= greedy - saved
    assert all(sum(x for x, _ in items) == capacity - free <= capacity for items, free in zip(bins.items, bins.free, strict=True))


def test_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    rng = np.random.default_rng(5)
    rows = [(int(k), int(n), 0, int(k)) for k, n in enumerate(rng.integers(1, 100, 400))]
    out = packed_rows(packing.pack(spark.createDataFrame(rows, "doc_id long, length long, part int, row long"), 100))
    assert sorted(r.doc_id for r in out) == list(range(400))
    fills = {}
    for r in out:
        assert fills.get(r.sequence_id, 0) == r.offset
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 100 and len(fills) <= 1.03 * sum(r.length for r in out) / 100 + 1


def test_levels_of_pieces_that_share_no_bin(spark, monkeypatch):
    """Lengths of which no two fit together end too, with the number of bins that they need."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    monkeypatch.setattr(packing, "staged", lambda df, name: staged(df, name) if name != "packed-20" else pytest.fail("levels don't end"))
    rng = np.random.default_rng(6)
    rows = [(int(k), int(n), 0, int(k)) for k, n in enumerate(rng.integers(51, 98, 300))]
    out = packed_rows(packing.pack(spark.createDataFrame(rows, "doc_id long, length long, part int, row long"), 100))
    assert sorted((r.doc_id, r.length) for r in out) == [(k, n) for k, n, _, _ in rows]
    assert len({r.sequence_id for r in out}) == 300 and {r.offset for r in out} == {0}


def test_coder():
    rng = np.random.default_rng(2)
    tokens = np.minimum(rng.zipf(1.3, 200_000), 4000).astype(np.uint32)
    coder = rans.Coder(rans.scaled(np.bincount(tokens, minlength=5000)))
    for n in (0, 1, 511, 512, 513, 70_000, 200_000):
        raw = coder.encode(tokens[:n])
        assert (coder.decode(raw) == tokens[:n]).all()
        assert (np.concatenate([coder.decode(raw, k) for k in range(rans.checkpoints(raw))]) == tokens[:n]).all()
    with pytest.raises(ValueError):
        coder.decode(raw[:100] + bytes([raw[100] ^ 1]) + raw[101:])
    with pytest.raises(ValueError):
        coder.encode(np.array([4999], dtype=np.uint32))
    assert rans.crc32_of_both(zlib.crc32(b"ab" * 50), zlib.crc32(b"xyz"), 3) == zlib.crc32(b"ab" * 50 + b"xyz")
    with pytest.raises(ValueError):
        rans.scaled(np.ones((1 << rans.SCALE_BITS) + 1))


def test_token_files(spark, docs, nothing, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 1000)  # long documents go through several blocks
    folder, n = new_folder(spark, "files"), len(bpe.load_vocabulary(PATH).tokens)
    token_files.write(docs, PATH, folder, end_id=2)
    got = sorted(token_files.document_digests(token_files.read_pieces(spark, folder, n, digest=True)).collect(), key=lambda r: r.start)
    at, want = 0, []
    for row in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*ids_of(library, row.text), 2], dtype="<u4")
        want.append((row.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    whole = {r.doc_id: r.ids for r in token_files.read_pieces(spark, folder, n).where("n = total").collect()}
    assert np.frombuffer(whole[3], dtype="<u4").tolist() == [*ids_of(library, TEXTS[3]), 2]
    empty = new_folder(spark, "files")
    token_files.write(nothing, PATH, empty, end_id=2)
    assert token_files.read_pieces(spark, empty, n).count() == 0


def test_queries(spark):
    for query in (text_queries.op1_bpe, text_queries.op8_rans_token_files):
        assert query(spark, "/root/testdata/sf0.001").count() == 200
