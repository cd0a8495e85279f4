"""Passages of 50 words that another document has too, cut by the pipeline, against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as cp
from rankfold.llm import shared_passages as sp


def expected(texts, words=sp.WORDS):
    """Texts without the bytes of the runs of words that two texts have."""
    owners, runs = defaultdict(set), []
    for i, text in enumerate(texts):
        found = list(re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
        for a in range(len(found) - words + 1):
            own = tuple(m.group() for m in found[a:a + words])
            owners[own].add(i)
            runs.append((i, own, found[a].start(), found[a + words - 1].end()))
    gone = [np.zeros(len((t or "").encode()), dtype=bool) for t in texts]
    for i, own, low, high in runs:
        if len(owners[own]) > 1:
            gone[i][low:high] = True
    return [bytes(np.frombuffer((t or "").encode(), dtype="uint8")[~g]).decode() for t, g in zip(texts, gone)]


def some_texts():
    rng = np.random.default_rng(3)
    word = lambda n: [f"é{x}" for x in rng.integers(0, 1000, n)]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    fifty, more, less, twice = word(50), word(62), word(49), word(60)   # all under 400 bytes
    return [text(word(30), fifty, word(40)), text(word(5), fifty), "\n".join(fifty), text(word(60), more, word(3)), text(more[:57], word(80)),
            text(word(50), less, word(50)), text(less, word(50)), text(twice, word(9), twice), text(word(300)), text(more[9:], ["x"], fifty),
            text(word(49)), "", None, " \n ", text(word(10), ["  "], fifty[:-1])]


@pytest.mark.parametrize("group", [sp.GROUP, 7])
def test_runs_of_a_text(monkeypatch, group):
    monkeypatch.setattr(sp, "GROUP", group)
    data = np.frombuffer(some_texts()[3].encode(), dtype="uint8")
    w, low, high, fresh = sp.runs_of(data, sp.kept_shingles(data))
    assert len(w) == 125 - 49 and fresh.all() and low[0] == 0 and high[-1] == len(data)


def test_shared_passages_of_the_pipeline_go(spark):
    texts = some_texts()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).repartition(3)
    after = {r["doc_id"]: r for r in cp.without_long_repeats(spark, docs, "").collect()}
    for i, (text, kept) in enumerate(zip(texts, expected(texts))):
        if kept.strip() or kept == (text or ""):
            assert (after[i]["text"] or "") == kept and after[i]["n_chars"] == len(kept)
        else:
            assert i not in after
    assert after[7]["text"] == texts[7] and after[10]["text"] == texts[10] and 2 not in after   # a repeat within one text stays


def test_a_run_that_many_texts_have_needs_no_single_task(spark, monkeypatch):
    """What is joined with the runs is saved, so the join has an exchange on either side or a broadcast, and the result is too."""
    plans, save = [], sp.cut_lineage
    monkeypatch.setattr(sp, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(df))
    kept = [t for t in some_texts() if t]
    rows = [(i, 0, bytearray(t.encode())) for i, t in enumerate(kept)]
    texts = spark.createDataFrame(rows, "k1 long, k2 int, body binary")
    last = sp.passage_spans(texts)
    joined = [p for p in plans if "LeftSemi" in p and "low" in p]
    assert len(joined) == 1 and joined[0].count("Aggregate") == 1   # of the spans, above the join
    assert "Join" not in last._jdf.queryExecution().optimizedPlan().toString()
    assert {r["k1"] for r in last.collect()} == {i for i, (t, left) in enumerate(zip(kept, expected(kept))) if t != left}
