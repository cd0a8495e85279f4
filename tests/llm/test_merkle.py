"""The Merkle manifest against a plain tree, and on odd rows."""

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from rankfold.llm import merkle
from rankfold.session import cut_lineage

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, i):
    found = []
    for nodes in levels[:-1]:
        run = i // 16 * 16
        found.append((nodes[run:i], nodes[i + 1:run + 16]))
        i //= 16
    return found


def brute(rows):
    first = lambda v: (v is not None, (v if isinstance(v, int) else (v or "").encode()))
    rows = sorted(rows, key=lambda r: (first(r[1]), first(r[0]) if r[0] is not None else (False, 0), leaf_of(*r)))
    sources = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    trees = [grow([leaf_of(*r) for r in g]) for g in sources]
    upper = grow([t[-1][0] for t in trees]) if trees else []
    found = []
    for k, (group, tree) in enumerate(zip(sources, trees)):
        for i, r in enumerate(group):
            path = way(tree, i) + way(upper, k)
            leaf = own = leaf_of(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                own = leaf_of(*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))
            for left, right in path:
                own = sha(*left, own, *right)
            proof = sha(*(x for left, right in path for x in (*left, *right)))
            found.append((r[0], leaf, tree[-1][0], upper[-1][0], proof, own, own == upper[-1][0]))
    return sorted(found, key=repr)


def rows_of(n):
    rows = [(i, ["a", "b", "b", "b", "ü", None][i % 6], "en" if i % 2 else None, i, [f"Text {i} ÀB", None, "", "lower"][i % 4]) for i in range(n)]
    return rows + [(None, "b", None, None, "No id"), (None, "b", None, None, "No id"), (5, "alone", None, None, "Aa"),
                   (3, "b", "en", 3, "lower"), (10**15, "z", "en", 3, "Z" * 4000)]


@pytest.mark.parametrize("levels", [3, 1])
@pytest.mark.parametrize("n", [0, 40, 700])
def test_manifest(spark, monkeypatch, n, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** levels)
    rows = rows_of(n) if n else rows_of(0)[:1]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = merkle.manifest(df)
    got = sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)
    assert got == brute(rows)


def test_versions_share_and_copy(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows_of(300)], SCHEMA)
    found = merkle.manifest(df, tampered=F.col("doc_id") == 2, changed=F.lit("other")).collect()
    versions = [r for r in found if r["copies"] is not None]
    assert [r["doc_id"] for r in versions] == [2]
    assert versions[0]["copies"][-1] == versions[0]["folded_root"] != versions[0]["root"]
    assert not versions[0]["verified"] and all(r["verified"] for r in found if r["copies"] is None)


def test_many_sources(spark):
    rows = [(i, f"s{i}", None, None, "A" if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in merkle.manifest(df).drop("source", "copies").collect()), key=repr)
    assert got == brute(rows)


def test_none(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_places_split_equal_rows(spark, monkeypatch):
    saved = []
    monkeypatch.setattr(merkle, "cut_lineage", lambda df: saved.append(cut_lineage(df)) or saved[-1])
    df = spark.range(4000).select(F.lit(1).alias("k")).repartition(4)
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"   # such a small table would be one partition again
    spark.conf.set(coalescing, "false")
    try:
        placed = merkle.numbered(df, [F.col("k")])
    finally:
        spark.conf.set(coalescing, "true")
    assert sorted(r["place"] for r in placed.collect()) == list(range(4000))
    # rows that are equal in the order fill several partitions of the sort
    assert saved[0].select(F.shiftright("_at", 33)).distinct().count() > 1
