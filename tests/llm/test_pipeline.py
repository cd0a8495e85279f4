"""The pipeline's stages on a small corpus, each on its own input."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from rankfold.llm import mixing, simhash, suffix_dedup

WORDS = {"en": "the of and in that was with by for this house river stone", "de": "der die und das nicht ein mit haus wasser über",
         "fr": "le la les des une que dans pour maison rivière eau"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)

    def text(lang, n):
        return " ".join("".join(rng.choice(WORDS[lang].split(), 2)) for _ in range(n))

    rows = [(i, text(lang, int(rng.integers(30, 150))), lang) for i, lang in enumerate(list(WORDS) * 40)]
    passage = text("en", 80)
    rows += [(200 + i, text("en", 60) + " " + passage + " " + text("en", 60), "en") for i in range(4)]
    rows += [(300, rows[0][1], "en"), (301, rows[1][1] + " end", "de"), (302, None, "en"), (303, "123 456", None), (304, "", "fr"), (305, passage, "en")]
    rows = [(i, t, lang, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t, lang in rows]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(
        f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, corpus):
    docs, found = spark.read.parquet(f"{corpus}/documents.parquet"), []
    for _, stage in cp.STAGES:
        after = stage(spark, docs, corpus).cache()
        found.append((docs.collect(), after.collect()))
        docs = after
    return found


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone == {302, 303, 304}


def test_one_document_of_each_component_stays(stages):
    before, after = stages[1]
    prints = {r["doc_id"]: simhash.text_fingerprint(r["text"]) for r in before}
    group = {i: i for i in prints}
    for i in sorted(prints):
        for j in prints:
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4:
                group = {k: min(group[i], group[j]) if g in (group[i], group[j]) else g for k, g in group.items()}
    assert {r["doc_id"] for r in after} == set(group.values()) and 300 not in {r["doc_id"] for r in after}


def test_near_copies_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, n)] for n in (60, 400, 1000) for _ in range(6)]
    texts = [" ".join(words) for words in base]
    texts += [" ".join([*words[:-1], "x"]) for words in base] + ["", None, "two words", "Two  words"]
    prints = [simhash.text_fingerprint(t) & (2**64 - 1) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert len(base) < len(set(root)) + 1 and len(set(root)) < len(texts) - 10
    rows = [(i, t, "en", None, 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", None, 0), (None, texts[4], "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    after = cp.without_near_copies(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in after) == Counter(set(root))


def test_repeats_go(stages):
    before, after = stages[2]
    texts = [r["text"].encode() for r in before]
    counts = Counter(t[i:i + 400] for t in texts for i in range(len(t) - 399))
    kept = {r["doc_id"]: r["text"] for r in after}
    for r, t in zip(before, texts):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 399):
            if counts[t[i:i + 400]] > 1:
                gone[i:i + 400] = True
        expected = bytes(np.frombuffer(t, dtype="uint8")[~gone]).decode("utf-8", "ignore")
        assert kept.get(r["doc_id"], "") == expected
    assert sum(r["n_chars"] for r in after) < sum(r["n_chars"] for r in before)


def test_mix_takes_documents_in_order(spark, stages):
    before, after = stages[3]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(before, schema)).collect()}
    assert Counter(r["doc_id"] for r in after) == Counter({i: n for i, n in plan.items() if n})
    words, target = defaultdict(int), {}
    for r in after:
        words[r["source"]] += len(r["text"].split())
    for r in mixing.mix(spark.createDataFrame(before, schema), keep=("source",)).select("source", "target").distinct().collect():
        assert abs(words[r["source"]] - r["target"]) <= 0.05 * r["target"]


def test_texts_are_encoded(stages):
    before, after = stages[4]
    assert len(before) == len(after) and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) > 0 for r in after)


def test_run_and_columns(spark, corpus, stages):
    assert cp.run(spark, corpus).count() == len(stages[4][1])
    assert all(set(after[0].asDict()) == set(cp.COLUMNS) for _, after in stages[:4])


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert not docs.collect()
