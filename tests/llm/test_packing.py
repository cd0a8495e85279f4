"""Packing against the tokenizer library, and on odd rows."""

import json
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rankfold.llm import packing
from rankfold.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
TEXTS = ["plain words here", None, "", " \t\n", "the same text", "the same text", "it's <|endoftext|> inside  two\n\n blanks ",
         "Ünïcode wörds 日本語 😀 1234", "x" * 3000, "many small words in a row " * 2500, "a b c " * 700]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def documents(spark, texts):
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, "without an id", "x", 7), (4, "the same text", "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length long").repartition(2)


def check_pieces(rows, expected, capacity):
    """expected: (doc_id, ids) of every document."""
    sequences, documents_, lost = defaultdict(list), defaultdict(list), 0
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) > 0
        sequences[r["sequence_id"]].append(r)
        documents_[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and len({round(r["sequence_cost"], 6) for r in parts}) == 1
        assert parts[0]["sequence_cost"] == pytest.approx(sum(packing.LINEAR * r["length"] + packing.QUADRATIC * r["length"] ** 2 for r in parts))
        lost += capacity - at if at & (at - 1) else 0
    want = defaultdict(list)
    for doc, ids in expected:
        want[doc, len(ids)] += ids
    got = {key: sorted(parts, key=lambda p: p[0]) for key, parts in documents_.items()}
    assert got.keys() == want.keys()
    for key, parts in got.items():
        assert sorted(i for _, ids in parts for i in ids) == sorted(want[key])
        if len(want[key]) == key[1]:   # one document: its pieces in order are its ids
            assert [i for _, ids in parts for i in ids] == want[key]
            assert [start for start, _ in parts] == np.cumsum([0, *(len(ids) for _, ids in parts)])[:-1].tolist()
    return lost


@pytest.mark.parametrize("capacity, block", [(2048, packing.BLOCK), (64, 500)])
def test_every_id_stands_in_one_piece(spark, library, capacity, block):
    df = documents(spark, TEXTS)
    rows = packing.pack(df, PATH, capacity=capacity, block=block, with_ids=True).collect()
    expected = [(r["doc_id"], library(r["text"])) for r in df.collect()]
    assert check_pieces(rows, expected, capacity) == 0


def test_given_documents(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(df, PATH, with_ids=True).collect()
    assert check_pieces(rows, [(r["doc_id"], library(r["text"])) for r in df.collect()], packing.CAPACITY) == 0


def test_none(spark):
    assert packing.pack(documents(spark, []).filter("false"), PATH).count() == 0


def test_reruns_agree(spark):
    df = documents(spark, TEXTS)
    once, again = (sorted(map(tuple, packing.pack(df, PATH).collect()), key=repr) for _ in range(2))
    assert once == again


def test_slices_and_other_files(monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SLICE", 50)
    text = "some words, it's  odd \n " * 40 + "y" * 300 + " end"
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(tokenizer_path(name))
        encoder = packing.Encoder(tokenizer_path(name))
        plain = name.startswith("byte")
        ids = np.concatenate(list(encoder.slices(text if plain else text[:40])))
        assert ids.tolist() == library.encode(text if plain else text[:40], add_special_tokens=False).ids
    said = json.loads(open(PATH, encoding="utf-8").read())
    said["model"]["merges"] = said["model"]["merges"][::-1]   # merges that ids do not order are left to the library
    (tmp_path / "other.json").write_text(json.dumps(said))
    library = Tokenizer.from_file(str(tmp_path / "other.json"))
    assert packing.Encoder(str(tmp_path / "other.json"))._encode("plain words").tolist() == library.encode("plain words").ids


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 400, 3000).tolist()
    placed = packing.assign(lengths)
    costs, filled = defaultdict(float), defaultdict(int)
    for _, _, length, s in placed:
        costs[s] += packing.LINEAR * length + packing.QUADRATIC * length ** 2
        filled[s] += length
    whole = [c for s, c in costs.items() if filled[s] == packing.CAPACITY]
    assert len(whole) == sum(lengths) // packing.CAPACITY
    assert max(whole) < 1.05 * min(whole)
    # few documents are cut
    assert len(placed) - len(lengths) <= len(costs)


def test_rooms_hold_exactly_the_tokens():
    for tokens in (0, 1, 2047, 2048, 2049, 10_000):
        rooms = packing.room(tokens, 2048)
        assert sum(rooms) == tokens and all(r & (r - 1) == 0 for r in rooms)
