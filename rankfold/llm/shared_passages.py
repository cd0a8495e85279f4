"""Which texts share a passage with another document, and where.

A passage is a run of ``WORDS`` words, whatever stands between them.  Of the
shingles of ``SHINGLE`` words in such a run, the one with the smallest hash is
kept; equal runs keep the same one, so two documents that share a passage share
a kept shingle, and one count by hash with map-side sums finds these.

Defined results: every passage of ``WORDS`` words or more that stands in two
documents counts; shared runs of ``SHINGLE`` to ``WORDS`` - 1 words count where
their shingle is kept; shorter ones never do (but for collisions of 64-bit
hashes); a passage repeated within one document only does not count; copies
share all they have; texts of fewer than ``WORDS`` words, empty and null ones
share nothing; an empty table gives an empty table.

``passage_spans`` is exact: of the texts with kept shingles that two documents
have, every run of ``WORDS`` words that such a shingle stands for is counted by
its own hash, so shorter shared runs do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.suffix_dedup import _MIX, SLICE, _powers, _sliding_minimum
from rankfold.session import cut_lineage

WORDS, SHINGLE = 50, 40
#: Words whose shingles are formed at once.
GROUP = 1 << 18
_ROW_DDL = "k1 long, k2 int, h long"


_WINDOW_DDL = "k1 long, k2 int, w long, low long, high long, fresh boolean"


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the words of a text."""
    word = ~_blank(data)
    return (np.flatnonzero(word & np.concatenate([[True], ~word[:-1]])),
            np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every word (run of bytes other than blanks) of a text, in order."""
    blank = _blank(data)
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    found = np.zeros(len(starts), dtype="uint64")
    if not len(starts):
        return found
    values, up, _ = _powers()
    for low in range(int(starts[0]), len(data), SLICE):
        high = min(low + SLICE, len(data))
        first, last = int(np.searchsorted(starts, low, "right")) - 1, int(np.searchsorted(starts, high))
        own = starts[first:last]
        begins = np.maximum(own, low)
        offsets = np.arange(low, high) - np.repeat(own, np.diff(np.append(begins, high)))
        terms = values[data[low:high]] * up[offsets % len(up)]
        terms[blank[low:high]] = 0
        found[first:last] += np.add.reduceat(terms, begins - low)
    found ^= found >> np.uint64(29)
    found *= _MIX
    return found ^ (found >> np.uint64(32))


def _runs(part: np.ndarray, sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of a number of words."""
    found = (sums[length:] - sums[:-length]) * _powers()[1][:len(part) - length + 1]
    found ^= found >> np.uint64(29)
    found *= _MIX
    return found ^ (found >> np.uint64(32))


def _parts(data: np.ndarray, words: int, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a text, part by part: number of its first word, its words' hashes and their sums, hashes of its shingles, place of
    the shingle kept for every run of ``words`` words."""
    hashes = word_hashes(data)
    _, _, down = _powers()
    for begin in range(0, len(hashes) - words + 1, GROUP):
        part = hashes[begin:begin + GROUP + words - 1]
        sums = np.zeros(len(part) + 1, dtype="uint64")
        np.cumsum(part * down[:len(part)], out=sums[1:])
        shingles = _runs(part, sums, shingle)
        marked = (shingles & ~np.uint64((1 << 24) - 1)) | np.arange(len(shingles), dtype="uint64")
        kept = _sliding_minimum(marked, words - shingle + 1) & np.uint64((1 << 24) - 1)
        yield begin, part, sums, shingles, kept.astype("int64")


def kept_shingles(data: np.ndarray, words: int = WORDS, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles that stand for the runs of ``words`` words of a text."""
    found = [np.zeros(0, dtype="uint64")]
    found += [shingles[np.unique(kept)] for _, _, _, shingles, kept in _parts(data, words, shingle)]
    return np.unique(np.concatenate(found)).view("int64")


def runs_of(data: np.ndarray, asked: np.ndarray, words: int = WORDS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last byte (exclusive) of the runs of ``words`` words that the shingles ``asked`` for stand for, and
    whether a run is the first of its hash in the text."""
    low, high = word_bounds(data)
    hashes, firsts = [np.zeros(0, dtype="uint64")], [np.zeros(0, dtype="int64")]
    for begin, part, sums, shingles, kept in _parts(data, words, shingle):
        wanted = np.flatnonzero(np.isin(shingles[kept].view("int64"), asked))
        hashes.append(_runs(part, sums, words)[wanted])
        firsts.append(begin + wanted)
    w, first = np.concatenate(hashes).view("int64"), np.concatenate(firsts)
    fresh = np.zeros(len(w), dtype=bool)
    fresh[np.unique(w, return_index=True)[1]] = True
    return w, low[first], high[first + words - 1], fresh


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flat(parts: list[tuple]) -> pa.RecordBatch:
        counts = [len(p[2]) for p in parts]
        columns = [np.repeat(np.array([p[0] for p in parts], dtype="int64"), counts),
                   np.repeat(np.array([p[1] for p in parts], dtype="int32"), counts),
                   np.concatenate([p[2] for p in parts])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "h"])

    for batch in batches:
        parts, size = [], 0
        for k1, k2, body in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["body"]):
            parts.append((k1, k2, kept_shingles(np.frombuffer(body.as_buffer(), dtype="uint8"))))
            size += len(parts[-1][2])
            if size >= 100_000:
                yield flat(parts)
                parts, size = [], 0
        if parts:
            yield flat(parts)


def sharing_texts(texts: DataFrame) -> DataFrame:
    """(k1, k2) of the texts that share a passage with another row; ``texts`` has k1, k2 and body, a row per document."""
    shingles = cut_lineage(texts.select("k1", "k2", "body").mapInArrow(_emit, _ROW_DDL))
    # a row gives a shingle once, so a count above one means two documents
    shared = shingles.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    return shingles.join(shared, "h", "left_semi").select("k1", "k2").distinct()


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "w", "low", "high", "fresh"]
    for batch in batches:
        for k1, k2, body, asked in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["body"], batch["asked"]):
            data = np.frombuffer(body.as_buffer(), dtype="uint8")
            runs = runs_of(data, np.asarray(asked.values, dtype="int64"))
            keys = [np.full(len(runs[0]), k1, dtype="int64"), np.full(len(runs[0]), k2, dtype="int32")]
            for at in range(0, len(runs[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 100_000]) for c in (*keys, *runs)], names=names)


def passage_spans(texts: DataFrame) -> DataFrame:
    """(k1, k2, spans): the bytes of the texts that lie in passages which another row has too; ``texts`` as for ``sharing_texts``.

    Only texts with a shared shingle are read again.  The result is saved, so that it adds nothing to the plan of the cutting,
    which the driver would plan anew after every stage.
    """
    shingles = cut_lineage(texts.select("k1", "k2", "body").mapInArrow(_emit, _ROW_DDL))
    shared = shingles.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    asked = cut_lineage(shingles.join(shared, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set("h").alias("asked")))
    runs = cut_lineage(texts.select("k1", "k2", "body").join(asked, ["k1", "k2"]).select("k1", "k2", "body", "asked").mapInArrow(
        _emit_runs, _WINDOW_DDL))
    # a row gives a run once as fresh, so two of them mean two documents; saved: the join then has an exchange
    # on either side (or a broadcast), and a run that many texts have can be split
    met = cut_lineage(runs.groupBy("w").agg(F.count_if("fresh").alias("n")).filter("n > 1").select("w"))
    return cut_lineage(runs.join(met, "w", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("spans")))
