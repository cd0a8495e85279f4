"""Removal of long repeated strings (suffix-array dedup) from texts of any number.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else goes.  Finding these strings is divided so that no task holds more than a
block of text:

1. Anchors.  Of the ``LENGTH`` - ``GRAM`` + 1 short strings (grams) in a string of
   ``LENGTH`` bytes, the one with the smallest hash is its anchor.  Equal strings
   have equal anchors, so a repeat lies around an anchor gram that repeats; the
   others, most of the corpus, are out after one aggregation by hash.
2. Contexts.  All strings of an anchor lie in the bytes around it, its context.
   An anchor whose whole context repeats needs no more: all of it goes, and one
   such context stands for all.
3. Different contexts of one gram are compared as strings: blocks of them are
   searched by threshold-bounded interval expansion on their Burrows-Wheeler
   transform (``bwt_intervals``).  A gram with more than ``MOST`` different
   contexts would overfill a block; the strings of its contexts are instead
   counted one by one, by hash, in one aggregation with map-side sums.
4. The spans of a text are merged and cut out.

Texts with copies are known by their hash; their anchors count once.  Texts are
shuffled once, by hash; the exchange serves both the contexts and the cutting.

Defined results: null text is empty; texts shorter than ``LENGTH`` lose nothing;
repeated rows are copies of each other; ids may repeat or be null; an empty
table gives an empty table; other columns pass through where asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.llm.bwt_intervals import repeated_starts
from rankfold.session import cut_lineage

LENGTH = 400
GRAM = 100
#: Contexts of a gram compared in one block; bytes of a block.
MOST, BLOCK = 4096, 2 << 20
#: Bytes of text whose anchors are found at once.
SLICE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_SEPARATOR = 0xFF   # no byte of UTF-8


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, and powers of the multiplier and of its inverse."""
    values = np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype="uint64")
    n = SLICE + 8 * LENGTH
    up = np.full(n, _MULTIPLIER, dtype="uint64")
    down = np.full(n, pow(_MULTIPLIER, -1, 1 << 64), dtype="uint64")
    up[0] = down[0] = 1
    return values, np.cumprod(up, dtype="uint64"), np.cumprod(down, dtype="uint64")


class _Hashes:
    """Hash of any substring of some bytes."""

    def __init__(self, data: np.ndarray):
        values, self.up, down = _powers()
        self.sums = np.zeros(len(data) + 1, dtype="uint64")
        np.cumsum(values[data] * down[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = (self.sums[end] - self.sums[start]) * self.up[start]
        found ^= found >> np.uint64(29)
        found = (found + (end - start).astype("uint64")) * _MIX
        return found ^ (found >> np.uint64(32))

    def all(self, length: int) -> np.ndarray:
        """Hashes of all substrings of a length."""
        count = len(self.sums) - length
        found = (self.sums[length:] - self.sums[:count]) * self.up[:count]
        found ^= found >> np.uint64(29)
        found = (found + np.uint64(length)) * _MIX
        return found ^ (found >> np.uint64(32))


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo("uint64").max, dtype="uint64")
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1:width - 1 + count])


def _thinned(places: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Leaves out anchors of one hash that stand so close that every string keeps one of them."""
    keep = np.ones(len(places), dtype=bool)
    same = (hashes[1:] == hashes[:-1]) & (np.diff(places) < width)
    i = 0
    for i0 in np.flatnonzero(same[1:] & same[:-1]) + 1:   # between two neighbours of its hash
        if i0 <= i:
            continue
        kept, i = places[i0 - 1], i0
        while i < len(same) and same[i]:
            if places[i + 1] - kept <= width:
                keep[i] = False
            else:
                kept = places[i]
            i += 1
    return keep


def text_anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash of the gram, hash of the context) of the anchors of one text."""
    width = length - gram + 1
    found = []
    for begin in range(0, len(data) - length + 1, SLICE):
        first = max(0, begin - width)
        part = data[first:begin + SLICE + 2 * length]
        hashes = _Hashes(part)
        grams = hashes.all(gram)
        marked = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype="uint64")
        starts = _sliding_minimum(marked, width)[begin - first:min(begin + SLICE, len(data) - length + 1) - first]
        places = np.unique(starts & np.uint64((1 << 24) - 1)).astype("int64")
        low = np.maximum(places + gram - length, 0)
        high = np.minimum(places + length, len(part))
        found.append((places + first, grams[places], hashes.of(low, high)))
    places, grams, contexts = (np.concatenate(x) for x in zip(*found))
    places, once = np.unique(places, return_index=True)
    grams, contexts = grams[once], contexts[once]
    keep = _thinned(places, grams, width)
    return places[keep], grams[keep].view("int64"), contexts[keep].view("int64")


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "place", "h", "c"]

    def flat(parts: list[tuple]) -> pa.RecordBatch:
        counts = [len(p[2]) for p in parts]
        columns = [np.repeat(np.array([p[0] for p in parts], dtype="int64"), counts),
                   np.repeat(np.array([p[1] for p in parts], dtype="int32"), counts),
                   np.concatenate([p[2] for p in parts]).astype("int32"),
                   np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for batch in batches:
        parts, size = [], 0
        for k1, k2, text in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["body"]):
            parts.append((k1, k2, *text_anchors(np.frombuffer(text.as_buffer(), dtype="uint8"))))
            size += len(parts[-1][2])
            if size >= 100_000:
                yield flat(parts)
                parts, size = [], 0
        if parts:
            yield flat(parts)


def keyed(df: DataFrame, text: str) -> DataFrame:
    """Adds body (bytes of the text) and its key (k1, k2)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.withColumn("body", body).withColumn("k1", F.xxhash64("body")).withColumn("k2", F.hash("body"))


def _identity(k1: np.ndarray, k2: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for a place in a text."""
    mixed = k1.view("uint64") * np.uint64(_MULTIPLIER) + k2.astype("uint64") * _MIX + place.astype("uint64")
    return (mixed ^ (mixed >> np.uint64(31))) * _MIX


def _emit_contexts(batches: Iterator[pa.RecordBatch], length: int = LENGTH, gram: int = GRAM) -> Iterator[pa.RecordBatch]:
    """The contexts asked for, from their texts."""
    names = ["h", "hot", "k1", "k2", "begin", "context"]
    for batch in batches:
        rows, size = [], 0
        for k1, k2, body, asked in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["body"], batch["asked"].to_pylist()):
            data = memoryview(body.as_buffer())
            for one in asked:
                begin = max(0, one["place"] + gram - length)
                rows.append((one["h"], one["hot"], k1, k2, begin, bytes(data[begin:one["place"] + length])))
            size += len(asked)
            if size >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_CONTEXTS)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_CONTEXTS)


_CONTEXTS = pa.schema([("h", pa.int64()), ("hot", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()),
                       ("begin", pa.int64()), ("context", pa.binary())])
_CONTEXT_DDL = "h long, hot boolean, k1 long, k2 long, begin long, context binary"
_SPAN_DDL = "k1 long, k2 long, low long, high long"


def block_spans(block: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """Spans covered by strings that repeat within a block of contexts."""
    sizes = block["context"].map(len).to_numpy("int64")
    data = np.frombuffer(b"".join(c + bytes([_SEPARATOR]) for c in block["context"]), dtype="uint8")
    owner = np.repeat(np.arange(len(block)), sizes + 1)
    offset = np.arange(len(data)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    place = block["begin"].to_numpy("int64")[owner] + offset
    identity = _identity(block["k1"].to_numpy("int64")[owner], block["k2"].to_numpy("int64")[owner], place)
    marks = repeated_starts(data, offset <= sizes[owner] - length, identity, length)
    where = np.flatnonzero(marks)
    if not len(where):
        return pd.DataFrame({n: pd.Series(dtype="int64") for n in ("k1", "k2", "low", "high")})
    fresh = np.concatenate([[True], np.diff(where) > 1])   # a separator stands between contexts
    heads = where[fresh]
    tails = where[np.concatenate([fresh[1:], [True]])]
    rows = owner[heads]
    return pd.DataFrame({"k1": block["k1"].to_numpy()[rows], "k2": block["k2"].to_numpy()[rows],
                         "low": place[heads], "high": place[tails] + length})


def _search_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Searches whole groups, several at once; contexts come sorted by the hash of their gram."""
    waiting: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        if not len(frame):
            continue
        for at in range(0, len(frame), 1000):
            part = frame.iloc[at:at + 1000]
            waiting.append(part)
            size += int(part["context"].map(len).sum())
            if size >= BLOCK:
                block = pd.concat(waiting, ignore_index=True)
                h = block["h"].to_numpy()
                cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
                if len(cuts):
                    yield block_spans(block.iloc[:cuts[-1]])
                    block = block.iloc[cuts[-1]:]
                waiting, size = [block], int(block["context"].map(len).sum())
    if waiting:
        yield block_spans(pd.concat(waiting, ignore_index=True))


def _strings_of(frames: Iterator[pd.DataFrame], length: int = LENGTH) -> Iterator[pd.DataFrame]:
    """Hash and place of every string of a context."""
    for frame in frames:
        for k1, k2, begin, context in zip(frame["k1"], frame["k2"], frame["begin"], frame["context"]):
            hashes = _Hashes(np.frombuffer(context, dtype="uint8")).all(length)
            yield pd.DataFrame({"s": hashes.view("int64"), "k1": k1, "k2": k2, "low": begin + np.arange(len(hashes))})


def find_spans(texts: DataFrame, most: int = MOST) -> DataFrame:
    """(k1, k2, spans) of texts that have copies or repeated strings.

    ``texts`` has k1, k2, body, row (an id of a row; of copies, the smallest stands
    for all).  spans is null where the whole text goes as it has a copy.
    """
    long_texts = texts.filter(F.octet_length("body") >= LENGTH)
    copies = cut_lineage(long_texts.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("row").alias("row")))
    whole = copies.filter("n > 1").select("k1", "k2")

    anchors = cut_lineage(long_texts.select("k1", "k2", "body").mapInArrow(
        _emit_anchors, "k1 long, k2 int, place int, h long, c long"))
    anchors = anchors.withColumn("id", F.xxhash64("k1", "k2", "place"))
    repeated = anchors.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("h")
    anchors = cut_lineage(anchors.join(repeated, "h", "left_semi"))
    contexts = anchors.groupBy("h", "c").agg(F.min("id").alias("one"), F.max("id").alias("other"))
    numbers = contexts.groupBy("h").agg(F.count("*").alias("contexts"))
    contexts = cut_lineage(contexts.join(numbers, "h"))
    members = anchors.join(contexts, ["h", "c"])
    wholly = members.filter("one <> other").select(
        "k1", F.col("k2").cast("long").alias("k2"),
        F.greatest(F.col("place") + GRAM - LENGTH, F.lit(0)).cast("long").alias("low"),
        (F.col("place") + LENGTH).cast("long").alias("high"))

    asked = members.filter("contexts > 1 AND id = one").groupBy("k1", "k2").agg(
        F.collect_set(F.struct("place", "h", (F.col("contexts") > most).alias("hot"))).alias("asked"))
    asked = asked.join(copies.select("k1", "k2", "row"), ["k1", "k2"]).withColumnRenamed("row", "stands")
    with_text = texts.join(asked, ["k1", "k2"]).filter(F.col("row").eqNullSafe(F.col("stands")))
    found = with_text.mapInArrow(_emit_contexts, _CONTEXT_DDL)
    found = cut_lineage(found.repartition("h", "hot"))
    compared = found.filter("not hot").repartition("h").sortWithinPartitions("h").mapInPandas(_search_blocks, _SPAN_DDL)

    strings = found.filter("hot").mapInPandas(_strings_of, "s long, k1 long, k2 long, low long")
    strings = strings.withColumn("id", F.xxhash64("k1", "k2", "low"))
    counted = strings.groupBy("s").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("s")
    by_string = strings.join(counted, "s", "left_semi").select("k1", "k2", "low", (F.col("low") + LENGTH).alias("high"))

    spans = wholly.union(compared).union(by_string).withColumn("k2", F.col("k2").cast("int"))
    spans = spans.join(whole, ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(
        F.collect_set(F.struct("low", "high")).alias("spans"))
    nothing = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    return spans.union(whole.select("k1", "k2", nothing.alias("spans")))


def merged(spans: Sequence[dict], size: int) -> list[tuple[int, int]]:
    """Maximal spans, clipped to the text."""
    found: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], min(s["high"], size)) for s in spans):
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], high))
        else:
            found.append((low, high))
    return found


def cut(body: bytes, spans: Sequence[tuple[int, int]]) -> bytes:
    """``body`` without the spans."""
    kept, at = [], 0
    for low, high in spans:
        kept.append(body[at:low])
        at = high
    kept.append(body[at:])
    return b"".join(kept)


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for body, whole, spans in zip(batch["body"], batch["whole"], batch["spans"]):
            found = [(0, len(body))] if whole else [] if spans is None else merged(spans, len(body))
            kept = cut(body, found)
            text = kept.decode("utf-8", "ignore")   # a character that lost some of its bytes loses all
            rows.append((len(body), sum(b - a for a, b in found), len(found), hashlib.sha256(kept).hexdigest(), text))
        yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ("doc_id",),
                   most: int = MOST, sharing: Callable[[DataFrame], DataFrame] | None = None,
                   passages: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``keep`` (but the text itself) and n_bytes, n_removed, n_spans, kept_sha256, kept_text of every row.

    kept_text is null where the text is.  ``sharing`` (``shared_passages.sharing_texts``)
    adds shares_passage; it decides nothing about what is removed.  ``passages``
    (``shared_passages.passage_spans``) gives further spans, which are removed too.
    """
    payload = F.struct(*[F.col(c) for c in keep if c != text], F.col(text).isNull().alias("_none"))
    rows = keyed(df.select(F.col(text).alias("_text"), payload.alias("kept"), F.col(doc_id).cast("string").alias("row")), "_text")
    texts = rows.select("k1", "k2", "body", "row", "kept")
    found = find_spans(texts, most).withColumn("found", F.lit(True))
    if sharing is not None:
        found = found.join(sharing(texts).withColumn("shares", F.lit(True)), ["k1", "k2"], "full")
    whole = F.coalesce(F.col("found"), F.lit(False)) & F.col("spans").isNull()
    found = found.withColumn("whole", whole)
    if passages is not None:
        none = F.array().cast("array<struct<low:bigint,high:bigint>>")
        found = found.join(passages(texts).withColumnRenamed("spans", "more"), ["k1", "k2"], "full").withColumn(
            "spans", F.concat(F.coalesce("spans", none), F.coalesce("more", none))).drop("more")
    joined = texts.join(found, ["k1", "k2"], "left")
    whole = F.coalesce("whole", F.lit(False))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    def apply(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return _cut_out(pd.DataFrame({"body": b, "whole": w, "spans": s}) for b, w, s in parts)

    shares = [F.coalesce(F.col("shares"), F.lit(False)).alias("shares_passage")] if sharing is not None else []
    done = joined.select("kept", apply(F.col("body"), whole, F.col("spans")).alias("done"), *shares)
    return done.select(*[F.col(f"kept.{c}").alias(c) for c in keep if c != text],
                       *[F.col(f"done.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")],
                       F.when(~F.col("kept._none"), F.col("done.kept_text")).alias("kept_text"),
                       *[F.col("shares_passage") for _ in shares])
