"""Operators on documents against brute force on small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlake.llm import hash_forest, langid, ngram_join, shard_queries, sharding, substring_dedup, suffix_sort, urls, url_queries, winnow, winnow_queries
from patchlake.llm.components import connected_components

SF_DIR = "/root/testdata/sf0.001"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def sentences(rng, n, words=400):
    return " ".join(f"w{x}" for x in rng.integers(0, words, n))


# ---- URL filters -----------------------------------------------------------------


def test_urls(spark):
    rules = [urls.Rule.parse("allow", "org/"), urls.Rule.parse("block", "example.org/es/"), urls.Rule.parse("block", "com/de/")]
    rows = [
        (1, "https://A.Example.ORG/es/1?x=1#y", "k"), (2, "http://example.org", "k"), (3, "no scheme", "k"), (4, None, "k"), (5, "http://x.com/de/", "k"),
        (6, "HTTP://www.bad.net/p/?utm_source=a&b=2&a=1", "k"), (7, "https://bad.net/p?a=1&b=2#frag", "k"), (8, "https://bad.net/q", "k"), (8, "https://bad.net/q", "k"),
        (9, "http://xorg/es/", "k"), (10, "://", "k"), (11, "http://h?a/b", "k"), (12, "http://bad.net/" + "long/" * 20000, "k"),
    ]
    pages = table(spark, rows, "page_id long, url string, __llm_block string")
    listed = table(spark, [("bad.net/p?a=1&b=2",), ("bad.net/p?a=1&b=2",), (None,)], "c string")
    got = sorted((r.page_id, r.url_host, r.url_path[:9], r.url_rule, r.url_verdict) for r in urls.judge(pages, listed, rules).collect())
    assert [(a, b, c, d or "", e) for a, b, c, d, e in got] == sorted([
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "example.org", "", "", "allow"), (3, "", "", "", "allow"), (4, "", "", "", "allow"),
        (5, "x.com", "/de/", "com/de/", "block"), (6, "www.bad.net", "/p/", "", "block"), (7, "bad.net", "/p", "", "block"), (8, "bad.net", "/q", "", "allow"),
        (8, "bad.net", "/q", "", "allow"), (9, "xorg", "/es/", "", "allow"), (10, "", "", "", "allow"), (11, "h", "", "", "allow"), (12, "bad.net", "/long/lon", "", "allow"),
    ])
    assert urls.judge(pages.where("false"), listed, rules).count() == 0
    assert urls.judge(pages, listed.where("false"), rules).where("url_verdict = 'block'").count() == 2


def test_bloom_has_no_misses_and_few_hits(spark, monkeypatch):
    keys = spark.range(5000).select(F.concat(F.lit("site/"), "id").alias("k"))
    other = spark.range(5000, 45_000).select(F.concat(F.lit("site/"), "id").alias("k"))
    for limit in (urls.BROADCAST_BYTES, 0):  # broadcast, and shuffled by block
        monkeypatch.setattr(urls, "BROADCAST_BYTES", limit)
        found = urls.split_by_list(keys.unionByName(other), "k", keys)
        assert found.count() == 45_000 and found.where("__llm_listed").count() == 5000
    bloom, blocks = urls.build_filter(keys, "k")
    assert bloom.count() <= blocks == 313
    plan = urls.judge(other.withColumnRenamed("k", "url"), keys, [])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_url_query_reads_only_urls(spark):
    plan = url_queries.op3_url_filter(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan


# ---- fingerprints ----------------------------------------------------------------


def marks_of(spark, texts, **sizes):
    df = winnow.marks(table(spark, list(enumerate(texts))), "text", "m", **sizes)
    rows = df.select("doc_id", F.transform("m", lambda x: winnow.hash_of(x)).alias("h"), F.transform("m", lambda x: winnow.position_of(x)).alias("p")).collect()
    return {r.doc_id: list(zip(r.p, r.h, strict=True)) for r in rows}


def test_winnowing(spark):
    rng = np.random.default_rng(0)
    shared = sentences(rng, 14)
    texts = [sentences(rng, 60, 5) for _ in range(10)] + [sentences(rng, 30) + " " + shared + " " + sentences(rng, 30), shared + " " + sentences(rng, 50), "a", "a b c", "", None, "same " * 50, "x" * 500]
    got = marks_of(spark, texts, gram=3, window=4)
    every = marks_of(spark, texts, gram=3, window=1)
    for k, text in enumerate(texts):
        grams = dict(every[k])
        n = max(len(grams), 0)
        want = []
        for i in range(max(1, n - 3) if n else 0):
            place = min(range(i, min(n, i + 4)), key=lambda j: (grams[j], -j))
            if (place, grams[place]) not in want:
                want.append((place, grams[place]))
        if len(grams) == len(every[k]) and text and len(set(grams.values())) == len(grams):
            assert got[k] == want, k
    # A passage of gram + window - 1 words is found in both texts.
    assert len({h for _, h in got[10]} & {h for _, h in got[11]}) >= 2
    assert got[14] == got[15] == [] and len(got[12]) == len(got[13]) == 1
    # Equal hashes: the rightmost of each window.
    assert [p for p, _ in got[16]] == list(range(3, 48))


def test_fingerprint_query(spark):
    rows = winnow_queries.op4_winnowing(spark, SF_DIR).collect()
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()), reverse=True)
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for k, (doc_id, text) in enumerate(docs):
        after, cut = docs[(k + 1) % len(docs)], len(text) // 3
        edited = text[: len(text) - cut] + after[1][:cut]
        row = by_id[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [{x.split("@")[0] for x in f.split()} for f in (row.fingerprint, row.edited_fingerprint, by_id[after[0]].fingerprint)]
        for other, value in ((sets[1], row.near_edited), (sets[2], row.near_next)):
            assert value == pytest.approx(len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0)


def test_next_row(spark):
    rows = [(5, "e"), (1, "a"), (None, "n"), (9, "i"), (3, None), (7, "g")]
    for parts in (1, 3, 50):
        got = {r[0]: r[2] for r in winnow.with_next(table(spark, rows), "doc_id", ["text"], parts).collect()}
        assert got == {9: "g", 7: "e", 5: None, 3: "a", 1: "n", None: "i"}
    assert [r[2] for r in winnow.with_next(table(spark, [(1, "a")]), "doc_id", ["text"], 4).collect()] == ["a"]
    assert winnow.with_next(table(spark, []), "doc_id", ["text"], 4).count() == 0
    # Rows of one id at the edge of a range: the next of 9 is the same whatever the ranges.
    rows = [(9, "a"), (7, "g1"), (7, "g3"), (7, "g2"), (7, None), (5, "z")]
    for parts in (1, 2, 3, 5):
        got = sorted(map(tuple, winnow.with_next(table(spark, rows).repartition(3), "doc_id", ["text"], parts).select("doc_id", "text", "__llm_next_text").collect()), key=str)
        assert got == sorted([(9, "a", "g3"), (7, "g3", "g2"), (7, "g2", "g1"), (7, "g1", None), (7, None, "z"), (5, "z", "a")], key=str)


# ---- n-gram join -----------------------------------------------------------------


def brute_components(rows, width, num, den):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        sets[doc_id] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    own = {k: k for k in sets}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    own[max(x, y)] = min(x, y)
    return sorted((k, len(sets[k]), find(k)) for k in sets)


def near_rows(seed=4):
    """Families of copies with a few changed words, hub and chain, beside odd texts."""
    rng = np.random.default_rng(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One\tTwo"), (7, "É É É"), (8, "é é é")]
    for size in (12, 40, 120):
        base = sentences(rng, size).split()
        for _ in range(14):
            words = list(base)
            for at in rng.integers(0, size, rng.integers(0, max(2, size // 12))):
                words[at] = f"new{rng.integers(0, 4)}"
            rows.append((len(rows), " ".join(words)))
            if rng.random() < 0.3:
                base = words
    return rows


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 4, 5)])
def test_near_duplicates(spark, width, num, den):
    rows = near_rows()
    got = ngram_join.near_duplicates(table(spark, rows), width, num, den)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, width, num, den)


def test_near_duplicates_with_other_budgets(spark, monkeypatch):
    """Budgets chosen at random: deletion keys find what the left out segments don't."""
    rng = np.random.default_rng(8)

    def budgets(hits, n_keys, sizes, num, den):
        bands, out = ngram_join.Bands(num, den), {}
        for band in range(bands.band(sizes[0]) + 1):
            budget = np.ones(bands.differences(band) + 1, dtype=np.int8)
            moved = rng.permutation(len(budget))[: len(budget) // 2 * 2]
            budget[moved[::2]], budget[moved[1::2]] = 0, 2
            out[band] = budget
        return out

    monkeypatch.setattr(ngram_join, "allocate", budgets)
    rows = near_rows(11)
    got = ngram_join.near_duplicates(table(spark, rows), 3, 9, 10)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, 3, 9, 10)


def test_near_duplicates_odd_tables(spark):
    assert ngram_join.near_duplicates(table(spark, [])).count() == 0
    rows = [(1, "a b c d e f", 3), (1, "a b c d e f", 3), (2, "a b c d e f", 3), (None, "a b c d e f", 3), (3, "x " * 30_000, 3)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 3)]


def test_row_without_id_before_its_copies(spark):
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f g h"), (4, "x y z")]
    got = ngram_join.near_duplicates(table(spark, rows).coalesce(1), 3, 4, 5).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_every_text_of_a_repeated_id_links(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, a), (5, "u v w"), (5, "u v w"), (None, a), (None, b), (6, "z z z")]
    got = ngram_join.near_duplicates(table(spark, rows), 1, 4, 5).collect()
    want = [(-1, -1), (-1, -1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (5, 5), (6, 6)]
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == want


def test_budgets_keep_every_link():
    """With any budgets that sum to the differences plus one, linked sets share a key."""
    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (4, 5)):
        bands = ngram_join.Bands(num, den)
        for _ in range(300):
            n = int(rng.integers(1, 120))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a.copy()
            while True:
                c = np.unique(np.append(np.delete(b, rng.integers(0, len(b))) if rng.random() < 0.5 and len(b) > 1 else b, np.uint64(rng.integers(0, 2**63))))
                if not ngram_join.are_linked(len(np.intersect1d(a, c)), len(a), len(c), num, den):
                    break
                b = c
            budgets = {}
            for band in {bands.band(len(a)), bands.band(len(b)), bands.band(len(a)) - 1, bands.band(len(b)) - 1} - {-1}:
                budget = np.ones(bands.differences(band) + 1, dtype=np.int8)
                for _ in range(int(rng.integers(0, len(budget) // 2 + 1))):
                    ones = np.flatnonzero(budget == 1)
                    if len(ones) >= 2:
                        budget[rng.choice(ones, 2, replace=False)] = (0, 2)
                budgets[band] = budget
            for given in ({}, budgets):
                keys = [np.concatenate([ngram_join.segment_keys(x, band, bands, given) for band in (bands.band(len(x)), bands.band(len(x)) - 1) if band >= 0]) for x in (a, b)]
                assert len(np.intersect1d(*keys)), (len(a), len(b))


def test_empty_segments_bring_no_sets_together():
    """Sets without a common element share no key, however many they are."""
    rng, bands, met = np.random.default_rng(3), ngram_join.Bands(4, 5), []
    sizes = [n for n in (60, 300, 396) for _ in range(200)]
    for n in sizes:
        grams = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        met.append(np.concatenate([ngram_join.segment_keys(grams, bands.band(n) - k, bands, {}) for k in (0, 1)]))
    _, copies = np.unique(np.concatenate(met), return_counts=True)
    assert (copies > 1).sum() <= 30  # few sets have so few segments with elements that the empty ones count


@pytest.mark.parametrize("moved", [False, True])
def test_sets_that_only_empty_segments_link(moved):
    """Eight segments with elements, each of which differs in one: such sets keep the keys of their empty segments."""
    bands = ngram_join.Bands(4, 5)
    band = bands.band(40)
    segments = bands.differences(band) + 1
    pool = np.random.default_rng(4).integers(0, 2**63, 5000).astype(np.uint64)
    at = (ngram_join.mixed(pool + np.uint64(band)) % np.uint64(segments)).astype(int)
    parts = [pool[at == k] for k in range(8)]
    a = np.sort(np.concatenate([x[:5] for x in parts]))
    b = np.sort(np.concatenate([x[:4] if k < 4 else x[:6] for k, x in enumerate(parts)]))
    assert ngram_join.are_linked(len(np.intersect1d(a, b)), len(a), len(b), 4, 5)
    budget = np.ones(segments, dtype=np.int8)
    budget[[8, 9]] = (0, 2)
    keys = [ngram_join.segment_keys(x, band, bands, {band: budget} if moved else {}) for x in (a, b)]
    assert len(np.intersect1d(*keys))


def test_allocation_moves_budgets(spark):
    """A segment that brings very many sets together gives its budget away."""
    bands = ngram_join.Bands(9, 10)
    band = bands.band(200)
    segments = bands.differences(band) + 1
    slots = ngram_join.slot_of(band, np.arange(segments)).astype(np.int64)
    rows = [(int(slots[0]) | 5 << 20, 0, k) for k in range(400)] + [(int(s) | 9 << 20, 0, k) for s in slots[1:] for k in (0, 1)]
    hits = spark.createDataFrame(rows, "key long, center long, doc_id long")
    given = ngram_join.allocate(hits, 300, [200], 9, 10)
    assert given[band][0] == 0 and given[band].sum() == segments and (given[band] == 2).sum() == 1
    assert ngram_join.allocate(hits, 500, [200], 9, 10) == {}  # new keys for all would cost more
    assert ngram_join.allocate(hits.where("doc_id < 2"), 0, [200], 9, 10) == {}


def crowd_rows(copies):
    """Sets of words that share one segment of a band and nothing else, or near copies of one set; and near copies elsewhere."""
    rng, bands = np.random.default_rng(12), ngram_join.Bands(4, 5)
    words = [f"w{k}" for k in range(20_000)]
    hashes = np.concatenate(ngram_join.gram_sets([w.encode() for w in words], 1))
    band = bands.band(41)
    segments = bands.differences(band) + 1
    at = (ngram_join.mixed(hashes + np.uint64(band)) % np.uint64(segments)).astype(int)
    shared, rest = [words[k] for k in np.flatnonzero(at == 0)[:4]], [words[k] for k in np.flatnonzero(at > 0)]
    texts = [" ".join([*shared, *rest[38 * k : 38 * k + 38]]) for k in range(200)]
    if copies:
        texts = [texts[0].rsplit(" ", 1)[0] + f" y{k}" for k in range(200)]
    for k in range(10):
        own = [f"x{k}_{j}" for j in range(int(rng.integers(20, 90)))]
        texts += [" ".join(own), " ".join([*own, "more"])]
    return list(enumerate(texts))


@pytest.mark.parametrize("copies", [False, True])
def test_crowded_segment_loses_its_budget(spark, monkeypatch, copies):
    """near_duplicates itself moves budgets where one segment's documents stay apart; near copies share all segments and keep them."""
    taken, keyed_documents = [], ngram_join.keyed_documents
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "keyed_documents", lambda *args: taken.append(args[-1]) or keyed_documents(*args))
    rows = crowd_rows(copies)
    got = ngram_join.near_duplicates(table(spark, rows), 1, 4, 5)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, 1, 4, 5)
    assert [bool(budgets) for budgets in taken] == ([False] if copies else [False, True])
    assert copies or any(0 in x and 2 in x for x in taken[1].values())


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- repeated strings ------------------------------------------------------------


def test_suffix_array():
    rng = np.random.default_rng(0)
    for trial in range(200):
        n, letters, depth = int(rng.integers(1, 150)), int(rng.integers(1, 4)), int(rng.integers(1, 30))
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        raw = text.tobytes()
        order = suffix_sort.suffix_array(text, n)
        assert [raw[k:] for k in order] == sorted(raw[k:] for k in range(n))
        prefixes = suffix_sort.common_prefixes(text, order, depth)
        for k in range(1, n):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            shared = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert prefixes[k] == min(depth, shared)


def brute_removed(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        own = [raw[k : k + length] for k in range(len(raw) - length + 1)]
        for k, string in enumerate(own):
            if string in seen:
                gone[k : k + length] = True
            seen.add(string)
        spans = int((np.diff(gone, prepend=False).astype(int) * gone).sum()) if len(raw) else 0
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id if doc_id is not None else -1, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeat_rows():
    rng = np.random.default_rng(9)
    passages = [sentences(rng, 60) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "é" * 400), (4, "ab" * 900), (None, passages[0] + " null id")]
    for k in range(5, 40):
        parts = [sentences(rng, int(rng.integers(1, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [passages[rng.integers(0, 4)][int(rng.integers(0, 50)) :], sentences(rng, int(rng.integers(0, 20)))]
        rows.append((k, " ".join(parts)))
    return [*rows, (40, rows[20][1]), (41, rows[20][1]), (42, "short")]


@pytest.mark.parametrize("block", [substring_dedup.BLOCK_BYTES, 3000, 200])
def test_repeated_strings(spark, monkeypatch, block):
    """One block, blocks dealt by anchor, and strings grouped by themselves."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    rows = repeat_rows()
    docs = table(spark, [(a, b, "k", 1) for a, b in rows], "doc_id long, text string, kind string, row int")
    got = substring_dedup.deduplicate(docs, 100, digest=True)
    assert sorted((r.row.doc_id if r.row.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got.collect()) == brute_removed(rows, 100)


def texts_of_one_hash(rng):
    """Two ASCII texts of 128 letters with the same xxhash64: what one word of a lane changes, its next one undoes."""
    first, second, size = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 1 << 64
    back = pow(second, -1, size)

    def turned(state, word):
        state = (state + word * second) % size
        return ((state << 31 | state >> 33) % size) * first % size

    letters = np.arange(97, 123, dtype=np.uint8)
    start = (42 + first + second) % size
    text = rng.choice(letters, 128).tobytes()
    one, two = (int.from_bytes(text[at : at + 8], "little") for at in (0, 32))
    while True:
        word = rng.choice(letters, 8).tobytes()
        other = (two + (turned(start, one) - turned(start, int.from_bytes(word, "little"))) * back) % size
        tail = other.to_bytes(8, "little")
        if word != text[:8] and all(32 < x < 127 for x in tail):
            return text.decode(), (word + text[8:32] + tail + text[40:]).decode()


def test_texts_of_one_hash(spark):
    one, two = texts_of_one_hash(np.random.default_rng(8))
    rows = [(1, one), (2, two), (3, one), (4, two), (5, "short")]
    df = table(spark, rows)
    assert one != two and df.select(F.xxhash64("text")).distinct().count() == 2
    kept = {r.row.doc_id: r.kept for r in substring_dedup.deduplicate(df).collect()}
    assert kept == {1: one, 2: two, 3: "", 4: "", 5: "short"}


def test_repeated_strings_odd_tables(spark):
    assert substring_dedup.deduplicate(table(spark, []), 100).count() == 0
    text = "é" * 100
    rows = substring_dedup.deduplicate(table(spark, [(1, text), (1, text), (2, "a" + text)]), 101).collect()
    kept = sorted((r.row.doc_id, r.kept) for r in rows)
    assert kept[0] == kept[1] and kept[2][0] == 2  # rows that repeat an id are one document


# ---- nearest neighbours ----------------------------------------------------------


def test_forest(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "BLOCK_ROWS", 300)
    monkeypatch.setattr(hash_forest, "QUERY_ROWS", 20)
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((900, 24)).astype(np.float32)
    vectors[100:140] = vectors[100]  # a hot vector
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None] * 24), (1004, [float("inf")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    got = defaultdict(list)
    for r in hash_forest.search(df, df.where("vec_id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    exact = vectors.astype(np.float64)
    for query, found in got.items():
        score = np.sqrt(((exact - exact[query]) ** 2).sum(1))
        order = [k for k in np.lexsort((np.arange(900), score)) if k != query][:10]
        assert len(found) == 10 and all(s == pytest.approx(score[k], abs=1e-12) for k, s in found)
        hits += len({k for k, _ in found} & set(order))
    assert hits >= 0.9 * 10 * len(got)
    assert [k for k, _ in got[100]] == list(range(101, 111))
    few = df.where("vec_id < 4 or vec_id > 999")
    assert hash_forest.search(few, few, 10).count() == 12
    assert hash_forest.search(df.where("false"), df, 10).count() == 0
    assert hash_forest.search(df, df.where("false"), 10).count() == 0


def test_nearest_neighbours_broadcast_nothing(spark, monkeypatch):
    """Query blocks, made anew for each block of vectors, stay off the driver; slabs of them change no row."""
    monkeypatch.setattr(hash_forest, "BLOCK_ROWS", 100)
    monkeypatch.setattr(hash_forest, "QUERY_ROWS", 20)
    data = np.random.default_rng(5).standard_normal((400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, vector array<double>")
    found = hash_forest.search(df, df.where("vec_id % 4 = 0"), 5)
    rows = sorted(found.collect())
    assert len(rows) == 500 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(hash_forest, "SLAB_PARTS", 2)
    assert sorted(hash_forest.search(df, df.where("vec_id % 4 = 0"), 5).collect()) == rows


def test_nearest_neighbours_of_one_repeated_id(spark, monkeypatch):
    """Rows of one id fill a single block, whatever its number is."""
    monkeypatch.setattr(hash_forest, "BLOCK_ROWS", 10)
    rows = spark.createDataFrame([(7, [1.0, float(i)]) for i in range(35)], "vec_id long, vector array<double>")
    query = spark.createDataFrame([(1, [1.0, 3.2])], "vec_id long, vector array<double>")
    assert [(r.vec_id, round(r.score, 3)) for r in hash_forest.search(rows, query, 2).orderBy("rank").collect()] == [(7, 0.2), (7, 0.8)]


# ---- language --------------------------------------------------------------------


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit_documents(docs)
    found = langid.predict(docs, model).where(langid.held_out(F.col("doc_id")))
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("lang_score"), F.max("lang_score")).first()
    assert right[0] >= 0.98 and 0 < right[1] <= right[2] <= 1
    assert (model.weights == 0).mean() > 0.3  # the L1 penalty
    odd = table(spark, [(1, None, 5), (2, "", 5), (3, "123 !?", 5), (4, "the the the and of", 5), (5, "der die und " * 20_000, 5)], "doc_id long, text string, lang_pred int")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 1.0) and got[4][0] == "en" and got[5][0] == "de"
    assert langid.predict(odd.where("false"), model).count() == 0


def test_language_without_classes(spark):
    schema = "doc_id long, text string, lang string"
    docs = table(spark, [(1, "abc", "xx"), (2, None, "yy"), (3, "def", None)], schema)
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.withColumnRenamed("doc_id", "row"))).where("text is not null").collect()} == {"xx"}
    none = langid.fit(docs.where("false").withColumnRenamed("doc_id", "row"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_temperature():
    rng = np.random.default_rng(0)
    truth = [(int(k), 5.0 * np.eye(3)[k if rng.random() < 0.8 else (k + 1) % 3]) for k in rng.integers(0, 3, 400)]
    assert langid.fit_temperature(truth) > 1.5  # too sure of itself
    right = [(k, 0.01 * np.eye(3)[k]) for _, k in truth_rows(rng, 400)]
    assert 0.0002 < langid.fit_temperature(right) < 0.02  # without an error, below the first range's end
    assert langid.fit_temperature([]) == langid.fit_temperature([(0, np.zeros(3))]) == 1.0


def truth_rows(rng, n):
    return [(i, int(k)) for i, k in enumerate(rng.integers(0, 3, n))]


def test_cuts():
    assert langid.cuts("äbc".encode()) == [] and langid.cuts(b"") == []
    text = "Der Übergang war schön und grün"
    assert [len(x.decode()) for x in langid.cuts(text.encode())] == list(langid.CUTS)
    assert all(x.decode() in text for x in langid.cuts(text.encode()))


# ---- sharding --------------------------------------------------------------------


def test_shards(spark):
    rng = np.random.default_rng(6)
    groups = [f"g{k // 3}" if k < 300 else ("hot" if k < 700 else None) for k in range(1500)]
    rows = [(k, g, int(rng.integers(1, 1000)) if g != "hot" else 500) for k, g in enumerate(groups)]
    df = spark.createDataFrame(rows, f"doc_id long, {sharding.GROUP} string, {sharding.SIZE} long").withColumn(sharding.ROW, F.xxhash64("doc_id"))
    placed = sharding.with_slots(sharding.balanced_labels(df, 4), ["doc_id"]).collect()
    assert sorted(r.doc_id for r in placed) == list(range(1500))
    loads = Counter()
    slots, shards = defaultdict(list), defaultdict(set)
    for r in placed:
        loads[r[sharding.SHARD]] += r[sharding.SIZE]
        slots[r[sharding.SHARD]].append(r["__llm_slot"])
        if (r[sharding.GROUP] or "hot") != "hot":
            shards[r[sharding.GROUP]].add(r[sharding.SHARD])
    mean = sum(loads.values()) / 4
    assert len(loads) == 4 and max(loads.values()) - min(loads.values()) <= 0.03 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) == 1 for s in shards.values()) >= 0.9 * len(shards)
    assert sharding.with_slots(sharding.balanced_labels(df.where("false"), 4), ["doc_id"]).count() == 0


def test_shard_query(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (2, None), (None, "é"), (3, "a"), (4, "x" * 100_000)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = shard_queries.op10_label_shards(spark, str(tmp_path)).collect()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == want and {r.law for r in got} == {"bytes"}
