"""The operators for training data against brute force, and on odd rows."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankfold.llm import (
    bwt_intervals, chat_format, components, language_id, mixing, sentencepiece_lattice, shared_passages, sharding, simhash, spotsigs,
    suffix_dedup, token_counts, topk_search,
)
from rankfold.llm.queries import tokenizer_path

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"


def documents(spark, texts, sources=("b", "a", None)):
    """Documents with clashing extra columns, null ids and repeated rows."""
    rows = [(i, t, "en" if i % 2 else None, sources[i % len(sources)], None, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, "without an id", None, None, None, None, None), (1, texts[1], "en", sources[1], None, "x", "y")]
    return spark.createDataFrame(rows, DOCUMENT).repartition(3)


ODD = ["plain words here and there", "the same text twice over", None, "", " \t\n", "the same text twice over",
       "x" * 5000, "Ünïcode wörds 日本語 😀", "a b c", "the cat of the house and the dog in a barn " * 40, "!!!"]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


# 1 top-k

def brute_top(vectors, k, every):
    good = {i: [math.floor(64 * float(x)) for x in v] for i, v in vectors.items()
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    found = []
    for q in (i for i in good if i % every == 0):
        scores = [(-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q]
        found += [(q, r + 1, c, -s) for r, (s, c) in enumerate(heapq.nsmallest(k, scores))]
    return sorted(found)


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 40)])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(3)
    vectors = {i: [float(np.float32(x)) for x in rng.integers(-40, 40, 12) / 64] for i in range(150)}
    vectors.update({150: None, 151: [1.0, None], 152: [float("nan")] * 12, 160: [], 153: [0.5], 180: vectors[5], 7: vectors[5]})
    df = spark.createDataFrame([*vectors.items(), (None, [1.0]), (5, vectors[5])], "vec_id long, embedding array<float>")
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, 20, query_block=blocks[0], candidate_block=blocks[1])
    assert sorted(tuple(r) for r in got.collect()) == brute_top(vectors, 20, 20)
    assert not topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect()


def test_top_k_of_large_components(spark):
    vectors = {i: [float(i) * 1e15, 1.0] for i in range(30)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, 3).filter("query_id = 20").orderBy("rank").collect()
    assert [r["score"] for r in got] == [(1 << 63) - 1] * 3 and [r["vec_id"] for r in got] == [1, 2, 3]


def test_different_vectors_of_one_id_all_count(spark):
    import duckdb

    rows = [(20, [1.0]), (1, [1.0]), (1, [2.0]), (1, [2.0]), (40, [1.0, 2.0]), (40, [3.0, 1.0]), (3, None), (None, [9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for blocks in ((1024, 8192), (1, 2)):
        found = topk_search.top_k(df, F.col("vec_id") % 20 == 0, 20, query_block=blocks[0], candidate_block=blocks[1])
        got = sorted(tuple(r) for r in found.collect())
        assert [r for r in got if r[0] == 20][:3] == [(20, 1, 40, 12288), (20, 2, 1, 8192), (20, 3, 1, 4096)]
        assert len(got) == 4 + 2 * 4
    with duckdb.connect() as db:   # the SQL takes vectors of one length
        even = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (40, [1.0, 2.0]), (40, [3.0, 1.0])]
        df = spark.createDataFrame(even, "vec_id long, embedding array<double>")
        db.register("embeddings", df.toPandas())
        expected = sorted(db.sql(topk_search.sql()).fetchall())
    assert sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()) == expected


def test_reading_stops_early_and_keeps_all_that_can_win():
    rng = np.random.default_rng(1)
    c = np.round(rng.normal(size=(4000, 2)) * 20)
    q = np.round(rng.normal(size=(6, 2)) * 20)
    found = topk_search.read_lists(q, c, np.zeros((6, 4000), dtype=bool), 5)
    for rows, scores in zip(found, q @ c.T):
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(rows) and len(rows) < 400


# 2 sharding

def shard_rows(df, shards):
    return sharding.shard_documents(df, shards).collect()


def test_shards_of_odd_rows(odd, none):
    rows = shard_rows(odd, 4)
    assert len(rows) == odd.count() and not shard_rows(none, 4)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["size"] == 8 and by_id[2]["text_crc32"] is None
    assert by_id[7]["size"] == len(ODD[7].encode()) + 8 and by_id[7]["text_crc32"] == zlib.crc32(ODD[7].encode())


def test_shards_are_nearly_equal_even_with_one_text_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(5)
    texts = ["copy of one text"] * 2000 + ["w" * int(n) for n in rng.integers(0, 300, 4000)] + ["long" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sums = Counter()
    for r in shard_rows(df, 24):
        sums[r["shard"]] += r["size"]
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) <= 0.02 * sum(sums.values()) / 24


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_key_are_divided(spark, doc_id):
    rng = np.random.default_rng(6)
    rows = [(doc_id, "one text of rows that nothing tells apart")] * 2000
    rows += [(1000 + i, "w" * int(n)) for i, n in enumerate(rng.integers(0, 60, 1000))]
    found = shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 24)
    sums, slots = Counter(), defaultdict(list)
    for r in found:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(found) == 3000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sums) == 24 and max(sums.values()) - min(sums.values()) <= 0.06 * sum(sums.values()) / 24


def test_overfull_ranges_are_subdivided(spark):
    rows = spark.range(4000).select(F.col("id").alias("key"), F.when(F.col("id") < 2000, 1).otherwise(100).alias("size"))
    splitters, totals = sharding.find_splitters(rows, 202_000, 16)
    assert max(t["bytes"] for t in totals) <= sharding.OVERFULL * 202_000 / 16 and sum(t["rows"] for t in totals) == 4000


# 3 mixing

def test_targets_follow_the_rule(spark):
    words = {"a": 100, "b": 5, "c": 200, "d": 1, None: 50, "e": 0}
    sized = spark.createDataFrame(list(words.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [1, 2, 3, 1, 2, 3]))
    capped, expected = set(), {}
    while True:   # the rule as told: reshare until none is above
        left = sum(words.values()) - sum(3 * words[s] for s in capped)
        share = left / sum(w for s, w in weight.items() if s not in capped)
        expected = {s: 3 * words[s] if s in capped else share * weight[s] for s in words}
        above = {s for s in words if expected[s] > 3 * words[s] and s not in capped}
        if not above:
            break
        capped |= above
    assert got == pytest.approx(expected)


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd, keep=("doc_id", "text")).collect()
    assert len(rows) == odd.count() and not mixing.mix(none).collect()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["positions"]) in (0, r["copies"])
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])


def test_mix_replaces_columns_named_like_results(spark):
    df = spark.createDataFrame([(1, "a b", "s", -1, -1.0)], "doc_id long, text string, source string, size long, target double")
    mixed = mixing.mix(df, keep=("doc_id", "size", "target", "source"))
    assert mixed.columns == ["doc_id", "source", *mixing.RESULTS] and mixed.first()["size"] == 2


def test_mix_of_sources_without_words(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate([("a b c", "full"), ("d e", "full"), (None, "none"), ("", "none"), (" \n", "none")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert len(got) == 5 and sum(r["taken"] for r in got.values()) > 0
    assert all((got[i]["target"], got[i]["copies"], got[i]["positions"]) == (0, 0, []) for i in (2, 3, 4))
    nulls = spark.createDataFrame([(i, None, s) for i, s in enumerate("aab")], df.schema)
    assert [(r["target"], r["copies"]) for r in mixing.mix(nulls).collect()] == [(0, 0)] * 3


def test_words_taken_come_near_the_targets(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(n), "abcd"[i % 4] if i % 3 else "hot") for i, n in enumerate(rng.pareto(1.2, 3000) * 20)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("source",))
    for r in mixed.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.01 * r["target"]


def test_schedules_are_inverted(spark):
    parts = spark.range(101).select((F.col("id") / 100).alias("p"), F.explode(F.array(*map(F.lit, range(3)))).alias("c"))
    for p, c, t in parts.select("p", "c", mixing.time_of(F.col("p"), F.col("c"))).collect():
        done = sum(rate * u + slope * u * u / 2 for start, length, rate, slope, _ in mixing.segments(mixing.SCHEDULES[c])
                   for u in [min(max(t - start, 0), length)])
        assert done == pytest.approx(p, abs=1e-9)


# 4 SentencePiece

VOCABULARY = sentencepiece_lattice.Vocabulary(
    (("▁", 0, -4.0), ("a", 1, -2.0), ("b", 2, -2.0), ("ab", 3, -3.0), ("▁ab", 4, -5.0), ("aba", 5, -4.0), ("ba", 6, -3.0),
     ("▁▁", 7, -6.0)), tuple(range(10, 266)), 266, 267)


def best_ids(text, v):
    """Viterbi over the whole escaped text."""
    s = "▁" + text.replace(" ", "▁") if text else ""
    pieces = {p: (i, score) for p, i, score in v.pieces}
    best = [(0.0, 0, [])] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - v.longest), end):
            sub = s[start:end]
            if sub in pieces or end - start == 1:
                i, score = pieces.get(sub, (None, v.unknown_score))
                total = best[start][0] + score
                ids = [i] if i is not None else [v.byte_ids[b] for b in sub.encode()]
                if best[end] is None or total > best[end][0]:
                    best[end] = (total, start, ids)
    found, at = [], len(s)
    while at:
        found.append(best[at][2])
        at = best[at][1]
    return [i for ids in reversed(found) for i in ids]


@pytest.mark.parametrize("lookup", [1000, 2])
def test_encoding_is_the_best_path_and_decodes(spark, monkeypatch, lookup):
    monkeypatch.setattr(sentencepiece_lattice, "PORTION", 16)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abab c"), int(n))) for n in rng.integers(0, 60, 60)] + [None, "", " ", "ab" * 300, "日本\n😀ab"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, ids string")
    codec = sentencepiece_lattice.codec_for(df, VOCABULARY, lookup=lookup)
    assert codec.complete == (lookup == 1000)
    for r in codec.decode(codec.encode(df), output="back").collect():
        assert list(r["ids"]) == best_ids(r["text"] or "", VOCABULARY) and r["back"] == (r["text"] or "")
    assert all(r["d"] == (r["text"] or "") for r in codec.encode(df, decoded="d").collect())
    empty = sentencepiece_lattice.codec_for(df.limit(0), VOCABULARY)
    assert not empty.decode(empty.encode(df.limit(0))).collect()


def test_both_ways_of_cutting_give_the_same_units():
    rng = np.random.default_rng(12)
    for v in (VOCABULARY, sentencepiece_lattice.load_vocabulary(tokenizer_path("piece_bpe_32k.model"))):
        cutter = sentencepiece_lattice._Cutter(v)
        texts = ["".join(rng.choice(list("ab \n7\t.é▁\0"), int(n))) for n in rng.integers(0, 40, 500)]
        regular = [t for t in texts if t and not re.search("^ |  |▁|\0", t)]
        for some in ([*texts, None], regular, []):   # texts of both kinds, of one, none
            words, counts = cutter.words(pa.array(some, pa.string()))
            want = [cutter.pattern.findall("▁" + t.replace(" ", "▁")) if t else [] for t in some]
            assert words.to_pylist() == [w for own in want for w in own] and counts.tolist() == [len(w) for w in want]


def test_encoding_with_the_public_vocabulary(spark):
    v = sentencepiece_lattice.load_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    texts = ["the cat sat on the mat", "Straße 12345\n日本語 😀", "  two  blanks "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    codec = sentencepiece_lattice.codec_for(df, v)
    for r in codec.decode(codec.encode(df), output="back").collect():
        assert list(r["ids"]) == best_ids(r["text"], v) and r["back"] == r["text"]


# 5 language

def test_languages_of_held_out_rows(spark):
    words = {"en": "the of and in that was with by for this house river", "de": "der die und das nicht ein mit haus wasser über",
             "fr": "le la les des une que dans pour maison rivière", "es": "el los las una que para con casa río"}
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 40)), lang) for i, lang in enumerate(list(words) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(df.drop("lang"), language_id.fit(df)).join(df.select("doc_id", "lang"), "doc_id")
    held = found.withColumn("h", language_id.held_out(F.col("doc_id"))).filter("h").collect()
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert {r["doc_id"] for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_of_odd_rows(odd, none):
    found = language_id.identify(odd, language_id.fit(odd)).collect()
    assert len(found) == odd.count()
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "en") == letters and (r["lang_pred"] == "und") == (not letters)
    assert language_id.fit(none) == {} and not language_id.identify(none, {}).collect()
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}


def plain_sample(rows, texts, characters):
    """Dictionaries of (id, text, language) rows: those of the smallest hashes, a slice of each by its hash."""
    import xxhash

    of = defaultdict(list)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            h = xxhash.xxh64_intdigest(str(i).encode(), 42)
            of[lang].append((h - (1 << 64) if h >> 63 else h, i, text))
    found = {}
    for lang, own in of.items():
        slices = [t[h % max(1, len(t) - characters + 1):][:characters] for h, _, t in sorted(own)[:texts]]
        found[lang] = "\n".join(slices).lower().encode()
    return found


def plain_language(text, dictionaries):
    """The language whose dictionary makes all windows of the text smallest."""
    import zstandard

    sizes = {}
    for lang, content in sorted(dictionaries.items()):
        settings = zstandard.ZstdCompressionParameters.from_level(
            language_id.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
        packer = zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(
            content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        data = text.lower().encode()
        n = max(1, math.ceil(len(data) / language_id.WINDOW))
        ends = [len(data) * k // n for k in range(n + 1)]
        sizes[lang] = sum(len(packer.compress(data[a:b])) for a, b in zip(ends, ends[1:]))
    return min(sorted(sizes), key=sizes.get)


def test_languages_against_a_plain_version(spark):
    rng = np.random.default_rng(14)
    words = {lang: ["".join(rng.choice(list("abcdeéfghiknorstuü"), 5)) for _ in range(60)] for lang in ("en", "de", "fr")}
    rows = [(i, " ".join(rng.choice(words[lang], int(rng.integers(1, 400)))), lang)   # most of one language
            for i, lang in enumerate(["en"] * 300 + ["de", "fr"] * 40)]
    rows += [(900, None, "en"), (901, "aéb", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    for texts in (5, 37, 400):   # fewer and more than a share or a language has
        assert language_id.fit(df, texts=texts, characters=90) == plain_sample(rows, texts, 90)
    learned = language_id.fit(df, texts=37, characters=90)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, learned).collect()}
    assert got == {i: "und" if t is None else plain_language(t, learned) for i, t, _ in rows}


def test_language_keeps_columns_of_all_names(spark):
    df = spark.createDataFrame([(1, "the cat", "en", 7, 8)], "doc_id long, text string, lang string, _language int, score int")
    found = language_id.identify(df, {"en": b"the cat"})
    assert found.columns == [*df.columns, "lang_pred", "margin", "rejected"] and found.first()["_language"] == 7


# 6 fingerprints

def test_neighbours_of_odd_rows(odd, none):
    rows = spotsigs.compare_neighbours(odd).collect()
    assert len(rows) == odd.count() and not spotsigs.compare_neighbours(none).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    edited = Counter()
    for (i, t), (_, following) in zip(texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        edited[i, hashlib.sha256((t[:len(t) - half] + following[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in rows) == edited
    prints = defaultdict(set)
    for r in rows:
        prints[{i: t for i, t in texts}[r["doc_id"]]].add(tuple(r["signatures"]))
    assert all(len(p) == 1 for p in prints.values())


def test_near_pairs_are_those_of_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [list(rng.choice([f"{x:08x}" for x in range(400)], 30, replace=False)) for _ in range(12)]
    sets = [sorted({*b[:30 - k], *(f"f{i}{k}{j:05x}" for j in range(k))}) for i, b in enumerate(base) for k in (0, 1, 2, 8)]
    df = spark.createDataFrame([(s,) for s in [*sets, sets[0]]], "signatures array<string>")
    got = {frozenset((r["a"], r["b"])) for r in spotsigs.near_pairs(df, threshold=0.8).collect()}
    expected = {frozenset(("".join(a), "".join(b))) for i, a in enumerate(sets) for b in sets[:i]
                if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))}
    assert got == expected and expected


# 7 suffix-array dedup

def brute_cut(texts, length=suffix_dedup.LENGTH):
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    found = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(np.frombuffer(t, dtype="uint8")[~gone[:-1]])
        found.append((len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0,
                      hashlib.sha256(kept).hexdigest()))
    return found


@pytest.fixture(scope="module")
def passages():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgé"), 5))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(90), text(67), text(200)]
    texts = [text(int(n)) for n in rng.integers(5, 300, 40)]
    texts += [text(20) + s + text(30) for s in shared for _ in range(6)]
    long_one = text(300)
    texts += [long_one, long_one, long_one[:900] + "!" + long_one[900:], "a" * 3000, "abc def " * 120, "", None, "é" * 500]
    return texts + [text(60) + shared[0] + shared[1] + shared[0]]


@pytest.mark.parametrize("most", [4096, 1])
def test_repeats_are_cut_exactly(spark, passages, most):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(passages)], "doc_id long, text string, n_bytes int").repartition(3)
    got = suffix_dedup.remove_repeats(df, most=most).collect()
    expected = brute_cut([(t or "").encode() for t in passages])
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == dict(enumerate(expected))
    assert sum(e[1] for e in expected) > 5000


def test_repeats_in_odd_rows(odd, none):
    rows = suffix_dedup.remove_repeats(odd, keep=("doc_id", "text", "size")).collect()
    assert len(rows) == odd.count() and {r["size"] for r in rows} == {"x", None}
    assert not suffix_dedup.remove_repeats(none).collect()


def runs_of(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def test_shared_passages_are_those_of_brute_force(spark, odd, none):
    rng = np.random.default_rng(9)
    text = lambda n: [f"w{x}é" for x in rng.integers(0, 10**9, n)]
    shared = [text(n) for n in (50, 51, 80, 39, 30)]
    texts = [" ".join(text(int(rng.integers(0, 40))) + s + text(int(rng.integers(0, 400)))) for s in shared for _ in range(3)]
    texts += [" ".join(text(int(n))) for n in rng.integers(0, 300, 30)]
    within = " ".join(text(60))
    copy = " ".join(text(55))
    texts += [within + " . " + within, copy, copy, " ".join(text(20)), "a " * 200, "  a\n" * 300, "", None, "b" * 3_000_000 + " c" * 90]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, shares_passage boolean")
    got = suffix_dedup.remove_repeats(df.repartition(3), sharing=shared_passages.sharing_texts).collect()
    assert len(got) == len(texts)
    flagged = {r["doc_id"] for r in got if r["shares_passage"]}

    def sharers(n):
        counts = Counter(run for t in texts for run in runs_of(t, n))
        return {i for i, t in enumerate(texts) if any(counts[run] > 1 for run in runs_of(t, n))}

    assert sharers(shared_passages.WORDS) <= flagged <= sharers(shared_passages.SHINGLE) and len(flagged) >= 13
    of_odd = suffix_dedup.remove_repeats(odd, sharing=shared_passages.sharing_texts).collect()
    assert len(of_odd) == odd.count() and not any(r["shares_passage"] for r in of_odd)
    assert not suffix_dedup.remove_repeats(none, sharing=shared_passages.sharing_texts).collect()


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    data = np.frombuffer(("ab é " * 50 + "long" * 40 + " ab\té").encode(), dtype="uint8")
    whole = shared_passages.word_hashes(data)
    assert len(whole) == 103 and len(set(whole.tolist())) == 3 and whole[0] == whole[101] and whole[1] == whole[102]
    for size in (1, 7, 64):
        monkeypatch.setattr(shared_passages, "SLICE", size)
        assert (shared_passages.word_hashes(data) == whole).all()


def test_interval_expansion_finds_every_shared_string():
    rng = np.random.default_rng(0)
    for alphabet, n in ((2, 300), (4, 2000), (20, 2000)):
        data = rng.integers(97, 97 + alphabet, n).astype("uint8")
        data[n // 2:n // 2 + 60] = data[10:70]
        for length in (1, 7, 12, 40):
            got = bwt_intervals.repeated_starts(data, np.arange(n) <= n - length, np.arange(n, dtype="uint64"), length)
            counts = Counter(bytes(data[i:i + length]) for i in range(n - length + 1))
            assert got.tolist() == [i <= n - length and counts[bytes(data[i:i + length])] > 1 for i in range(n)]


def test_long_texts_are_sliced(monkeypatch):
    data = np.random.default_rng(1).integers(97, 101, 9000).astype("uint8")
    whole = suffix_dedup.text_anchors(data)
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    for a, b in zip(whole, suffix_dedup.text_anchors(data)):
        assert a.tolist() == b.tolist()


# 8 token counts

def test_token_counts_are_the_library_s(spark, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [*ODD, "a  b \n c", " lead", "tail ", "<|endoftext|> in <|endoftext|>text", "it's we'll  'x", "　 \x1c y", "word " * 3000]
    df = documents(spark, texts)
    got = token_counts.count_tokens(df, path).collect()
    assert len(got) == df.count()
    for r in got:
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 1024)
    assert not token_counts.count_tokens(none, path).collect()


def test_forgetting_chunks_changes_no_count(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    lengths = token_counts._Lengths(tokenizer_path("byte_bpe_50k.json"))
    texts = [f"some {i} words {'x' * i}" for i in range(90)]
    assert [lengths.count([t])[0] for t in texts] == lengths.count(texts)


# 9 SimHash

def brute_components(prints):
    """prints: (id, fingerprint) -> smallest id reachable, by fingerprint."""
    fs = sorted({f for _, f in prints})
    root = {f: f for f in fs}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fs):
        for b in fs[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.RADIUS:
                root[find(a)] = find(b)
    first = {}
    for i, f in prints:
        r = find(f)
        first[r] = i if first.get(r) is None else first[r] if i is None else min(first[r], i)
    return {f: first[find(f)] for f in fs}


@pytest.mark.parametrize("most", [100_000, 2])
def test_links_connect_what_brute_force_connects(spark, most):
    rng = np.random.default_rng(7)
    prints = [int(x) for x in rng.integers(-2**63, 2**63, 150)]
    for f in prints[:40]:
        for _ in range(5):
            for bit in rng.integers(0, 64, 5):
                f ^= -(1 << 63) if bit == 63 else 1 << int(bit)
            prints.append(f)
    df = spark.createDataFrame([(f,) for f in set(prints)], "f long")
    found = components.connected_components(simhash.fingerprint_links(df, most))
    got = dict(found.collect())
    expected = brute_components([(f, f) for f in set(prints)])
    assert {f: got.get(f, f) for f in set(prints)} == expected


def test_gray_ranks_order_the_reflected_code(spark):
    codes = [i ^ (i >> 1) for i in range(50)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i long, c long")
    assert [r["i"] for r in df.orderBy(simhash.gray_rank(F.col("c"))).collect()] == list(range(50))


def test_components_of_odd_rows(odd, none):
    import xxhash

    rows = simhash.near_components(odd).collect()
    assert len(rows) == odd.count() and not simhash.near_components(none).collect()
    expected = brute_components([(r["doc_id"], r["f"]) for r in rows])
    assert all(r["component_id"] == expected[r["f"]] for r in rows)
    by_id = {r["doc_id"]: r["f"] for r in rows}
    assert by_id[2] == by_id[3] == by_id[4] == 0
    assert by_id[8] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)
    kept = simhash.keep_first_of_components(odd).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({expected[r["f"]] for r in rows})


# 10 chats

CONVERSATIONS = {
    1: [("user", "hi"), ("assistant", "hello")], 2: [("user", "hi"), ("assistant", "hello"), ("user", "more")],
    3: [("user", "hi"), ("assistant", "hello"), ("user", "more")], 4: [("user", "hi")], 5: [("user", "hi"), ("assistant", "hullo")],
    6: [(None, None), ("user", "<|im_end|>")], 7: [("", "")], 8: [("assistant", "hi")],
}


def test_snapshots_collapse(spark):
    rows = [(c, i, r, t, 1) for c, turns in CONVERSATIONS.items() for i, (r, t) in enumerate(turns)]
    rows += [rows[0], (None, 0, "user", "hi", 2), (None, None, "system", "x", 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, total int").repartition(3)
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["chat"]) for r in chat_format.format_chats(df).collect()}
    assert set(got) == {2, 5, 6, 7, 8, None} and got[2][:2] == (3, 2)
    assert got[6][2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>user\n< |im_end| ><|im_end|>\n"
    assert got[None] == (1, 1, "<|im_start|>system\nx<|im_end|>\n")   # the other row without an id yields
    assert not chat_format.format_chats(df.limit(0)).collect()


def chats_by_sql(df):
    import duckdb

    with duckdb.connect() as db:
        db.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        return sorted(db.sql(chat_format.sql()).fetchall(), key=repr)


@pytest.mark.parametrize("part", [1024, 3])
def test_chats_in_parts_are_those_of_the_sql(spark, monkeypatch, part):
    monkeypatch.setattr(chat_format, "PART", part)
    rng = np.random.default_rng(10)
    long = "one beginning of more than sixty-four characters that all of these texts share "
    rows = []
    for c in range(60):
        n, seed = int(rng.integers(1, 14)), int(rng.integers(0, 4))   # those of one seed prefix each other
        first = int(rng.integers(0, 3))
        for i in range(n):
            rows.append((c, first + i, "user" if i % 2 else None, f"{seed} {i}" if (seed + i) % 5 else None, 1))
    rows += [(100, t, "user", long + x, 1) for t in (None, -5, 0, 7) for x in "ba"]   # ties, null and negative numbers
    rows += [(101, t, "user", long + x, 1) for t, x in ((None, "a"), (None, "b"), (-5, "a"))]
    rows += [(None, i % 7, None, "1 0" if i % 2 else f"alone {i}", 1) for i in range(200)]   # most rows have no id
    rows += rows[:30]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(5)
    got = sorted((tuple(r) for r in chat_format.format_chats(df).collect()), key=repr)
    assert got == chats_by_sql(df) and (len({r[3] for r in got}) > 3) == (part == 3)


def test_tied_turns_stand_in_the_order_of_their_whole_texts(spark):
    long = "the same beginning of more than sixty-four characters in every one of these "
    assert len(long) > 64
    rows = []
    for c in range(40):   # each with a snapshot of its first reply only
        tied = sorted(f"{long}{c} {x}" for x in ("a", "b"))
        rows += [(c, 0, "user", t) for t in tied] + [(100 + c, 0, "user", tied[0])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r["n_turns"] for r in chat_format.format_chats(df).collect()}
    assert got == {c: 2 for c in range(40)}


def test_words_are_divided_where_no_piece_reaches():
    v = sentencepiece_lattice.load_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    divider = sentencepiece_lattice._Divider(v)
    side_by_side = {p[i:i + 2] for p, _, _ in v.pieces for i in range(len(p) - 1)}
    words = ["▁the", "▁word,", "êêçéoi", "a😀b", "x", "日本語", "▁"]
    units, counts = divider.divide(pa.array(["before", *words])[1:])
    units = units.to_pylist()
    assert "".join(units) == "".join(words) and counts.sum() == len(units)
    at = iter(units)
    for word, n in zip(words, counts):
        own = [next(at) for _ in range(n)]
        assert "".join(own) == word
        assert all((a[-1] + b[0]) not in side_by_side for a, b in zip(own, own[1:]))
        assert all(u[i:i + 2] in side_by_side for u in own for i in range(len(u) - 1))
