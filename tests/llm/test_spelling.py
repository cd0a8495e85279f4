"""Spelling variants against brute force, and on odd rows."""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, form string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j - 1] + (x != y), above[j] + 1, row[-1] + 1))
    return row[-1]


def brute_words(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def brute(words):
    near = {w: [] for w in words}
    for a, b in combinations(sorted(words), 2):
        if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    found = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        found.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(found)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(5)
    letters = list("abÀéß")
    stems = ["".join(rng.choice(letters, rng.integers(5, 9))) for _ in range(60)]
    made = []
    for i in range(120):
        words = []
        for w in rng.choice(stems, 80):
            at, kind = rng.integers(0, len(w)), rng.integers(0, 12)
            w = w[:at] + w[at + 1:] if kind == 0 else w[:at] + str(rng.choice(letters)) + w[at + (kind == 1):] if kind <= 2 else w
            words.append(w.upper() if kind == 5 and w.isascii() else w)
        made.append((i, "; ".join(words)))
    long = "q" * 3000
    return made + [(None, "aaaaaa " * 30), (7, None), (8, ""), (9, "× ÷ 123 short"), (10, f"{long} " * 6 + f"{long}a " * 40),
                   (10, f"{long} " * 6 + f"{long}a " * 40)]


@pytest.mark.parametrize("most", [spelling.MOST, 4])
def test_variants(spark, docs, most):
    df = spark.createDataFrame([(*d, "x", 1, "y") for d in docs], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in spelling.variants(df, most=most).collect()))
    assert got == brute(brute_words(docs))
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(none).count() == 0


def test_lists_are_bounded_and_hold_every_pair(spark):
    rng = np.random.default_rng(2)
    # one list would hold them all: a common first half
    words = sorted({"common" + "".join(rng.choice(list("abc"), rng.integers(5, 7))) for _ in range(600)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    sizes = spelling.lists(df, 50).groupBy("size", "path", "key", "left").count().filter("left > 1").agg(F.max("count")).first()[0]
    assert sizes <= 50
    got = sorted((r["word"], r["near"]) for r in spelling.near_words(df, 50).collect())
    want = sorted((a, b) for a in words for b in words if abs(len(a) - len(b)) <= 1 and edits(a, b) == 1)
    assert got == want


def test_rows_one_edit_apart():
    rng = np.random.default_rng(9)
    for alphabet, longest in (("ab", 6), ("abcd", 4), ("a", 9)):
        words = sorted({"".join(rng.choice(list(alphabet), rng.integers(0, longest + 1))) for _ in range(150)})
        sizes = np.array([len(w) for w in words], dtype="int32")
        codes = np.zeros((len(words), max(sizes)), dtype="int32")
        for i, w in enumerate(words):
            codes[i, :len(w)] = [ord(c) for c in w]
        fresh = np.zeros(len(words), dtype=bool)
        fresh[0] = fresh[len(words) // 2] = True
        a, b = spelling.near_rows(codes, sizes, fresh)
        half = len(words) // 2
        want = {(i, j) for i, j in combinations(range(len(words)), 2) if (i < half) == (j < half) and edits(words[i], words[j]) == 1}
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)
