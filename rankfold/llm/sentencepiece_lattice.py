"""SentencePiece encoding and decoding with a relational lattice.

Texts are escaped (blanks become the mark, one mark is put in front) and cut into
words where no piece reaches across: before marks, and around single characters
that occur in no longer piece.  Where the table has byte pieces, words are cut again
into units, between any two characters that stand side by side in no piece.  Only
distinct units are encoded: their substrings
of bounded length are exploded and joined on equality to the piece table; what
matches are the edges of the unit's lattice, grouped by unit and folded to the
best-scoring path with Spark's higher-order ``aggregate``.

The encoded units are looked up when texts are encoded.  Up to ``LOOKUP`` of them,
with ``LONGEST`` pieces each on average, are sent to the tasks as arrays (8 bytes
a unit and 4 a piece).  If there are more, the most frequent of up to ``LONGEST``
pieces are sent, and what a text has beyond these is joined to it by hash.  Both
ways give the same result.

Scores are taken as the model file has them.  Among equal scores the path with the
longer last piece wins, as in the library's own Viterbi.  Unknown characters become
byte pieces if the table has them, else one unknown id per run.  The path is the
unigram model's; a model file trained by merges is read as pieces and scores.

Defined results: null text is empty; empty text has no pieces; ids may repeat or
be null; repeated rows give repeated rows; an empty table gives an empty table;
columns of clashing names are replaced, others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from rankfold.schema import local_table
from rankfold.session import bound_arrow_batches, cut_lineage

MARK = "▁"
#: Encoded units sent to the tasks at most, and pieces of such a unit.
LOOKUP, LONGEST = 6_000_000, 8
#: The library scores an unknown character so much below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Positions folded as one array; longer units are folded in portions.
PORTION = 256
#: Units whose edges are sorted by one task; so many fit in its memory, and nothing spills.
UNITS = 20_000
#: Distinct words that a task counts before it hands the sums of their units on.
COUNTED = 150_000
_SINGLES = ("\n", "\t", *"0123456789")
_UNKNOWN_TEXT = " ⁇ "


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model: (text, id, score), ids of the 256 bytes (or none), the id of unknown characters."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unknown_id: int
    size: int

    @property
    def longest(self) -> int:
        return max([1, *(len(p) for p, _, _ in self.pieces)])

    @property
    def unknown_score(self) -> float:
        return min([0.0, *(s for _, _, s in self.pieces)]) - UNKNOWN_PENALTY

    def unit_pattern(self) -> str:
        """Regular expression of the units: no piece reaches across their borders."""
        longer = [p for p, _, _ in self.pieces if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            return r"(?s).+"   # pieces reach across marks: the whole text is one unit
        inside = set("".join(longer))
        single = "".join(c for c in _SINGLES if c not in inside)
        alone = f"[{single}]|" if single else ""
        return f"{alone}{MARK}+[^{MARK}{single}]*|[^{MARK}{single}]+"

    def bytes_of_ids(self) -> list[bytes]:
        found = [b""] * self.size
        for piece, i, _ in self.pieces:
            found[i] = piece.replace(MARK, " ").encode()
        for value, i in enumerate(self.byte_ids):
            found[i] = bytes([value])
        if self.unknown_id >= 0:
            found[self.unknown_id] = _UNKNOWN_TEXT.encode()
        return found


def load_vocabulary(model_path: str) -> Vocabulary:
    """Reads a SentencePiece model file with identity normalisation and a leading mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces, byte_ids = [], {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), i, float(model.get_score(i))))
    whole = tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else ()
    return Vocabulary(tuple(pieces), whole, model.unk_id(), model.get_piece_size())


class _Cutter:
    """Cuts texts into words."""

    def __init__(self, vocabulary: Vocabulary):
        pattern = vocabulary.unit_pattern()
        self.pattern = re.compile(pattern)
        # in texts without runs of blanks, splitting at blanks and around single characters gives the same words
        found = re.match(r"\[([^]]*)\]\|", pattern)
        self.simple = MARK in pattern
        self.singles = found[1] if found else ""

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts one after the other, and the number of words of each text."""
        texts = pc.fill_null(texts, "")
        odd = np.ones(len(texts), dtype=bool)
        if self.simple:
            odd = np.zeros(len(texts), dtype=bool)
            for found in (pc.equal(texts, ""), pc.starts_with(texts, " "), *(
                    pc.match_substring(texts, part) for part in ("  ", MARK, "\0"))):
                odd |= found.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._split(texts)
        plain, sizes = self._split(texts.filter(pa.array(~odd)))
        others = [self.pattern.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
        counts = np.zeros(len(texts), dtype="int64")
        counts[~odd], counts[odd] = sizes, [len(words) for words in others]
        both = pa.concat_arrays([plain, pa.array([w for words in others for w in words], pa.string())])
        # the plain texts' words stand before the others': put them into the order of the texts
        begins = np.zeros(len(texts), dtype="int64")
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        begins[order] = np.cumsum(counts[order]) - counts[order]
        before = np.cumsum(counts) - counts
        return both.take(pa.array(np.repeat(begins - before, counts) + np.arange(counts.sum()))), counts

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        marked = pc.binary_join_element_wise(MARK, pc.replace_substring(texts, " ", "\0" + MARK), "")
        if self.singles:
            marked = pc.replace_substring_regex(marked, f"([{self.singles}])", "\0\\1\0")
        parts = pc.split_pattern(marked, "\0")
        flat = parts.flatten()
        full = pc.not_equal(flat, "")
        ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype("int64")
        at = np.concatenate([[0], np.cumsum(sizes)])
        return flat.filter(full), np.diff(ends[at])


class _Divider:
    """Divides words into units between characters that stand side by side in no piece.

    Without byte pieces words stay whole, as a run of unknown characters is one id.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.whole = not vocabulary.byte_ids
        if self.whole:
            return
        longer = [np.frombuffer(p.encode("utf-32-le"), dtype="<u4") for p, _, _ in vocabulary.pieces if len(p) > 1]
        known = np.unique(np.concatenate([np.zeros(1, "<u4"), *longer]))
        # characters as small numbers: 0 in no longer piece, 1 beyond the first plane
        self.numbers = np.zeros(1 << 16, dtype="int32")
        plane = known[(known > 0) & (known < 1 << 16)]
        self.numbers[plane] = np.arange(2, len(plane) + 2)
        self.together = np.zeros((len(plane) + 2, len(plane) + 2), dtype=bool)
        for piece in longer:
            at = self._numbers(piece)
            self.together[at[:-1], at[1:]] = True

    def _numbers(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes < 1 << 16, self.numbers[np.minimum(codes, (1 << 16) - 1)], 1)

    def divide(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of the words in order, and the number of units of each word."""
        if self.whole or not len(words):
            return words, np.ones(len(words), dtype="int64")
        # where words and characters begin among the bytes of all words
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, dtype="int32")[words.offset:words.offset + len(words) + 1]
        joined = data[offsets[0]:offsets[-1]]
        ends = offsets - offsets[0]
        places = np.flatnonzero((np.frombuffer(joined, dtype="uint8") & 0xC0) != 0x80)
        at = self._numbers(np.frombuffer(joined.to_pybytes().decode().encode("utf-32-le"), dtype="<u4"))
        begins = np.ones(len(at), dtype=bool)
        begins[1:] = ~self.together[at[:-1], at[1:]]
        begins[np.searchsorted(places, ends[:-1])] = True
        cuts = np.concatenate([places[begins], [len(joined)]]).astype("int32")
        # the units are an array over the same bytes with an offset for each
        return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), joined), np.diff(np.searchsorted(cuts, ends))


def _summed(counts: list[pa.Table], name: str) -> pa.Table:
    """One row per value of column ``name`` with the sum of n."""
    found = pa.concat_tables(counts).group_by(name, use_threads=False).aggregate([("n", "sum")])
    return pa.table({name: found[name], "n": found["n_sum"]})


def count_units(df: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    """(unit, n) over all texts; every task sums up before the shuffle."""
    cutter, divider = _Cutter(vocabulary), _Divider(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(words: pa.Table) -> Iterator[pa.RecordBatch]:
            units, per_word = divider.divide(words["word"].combine_chunks())
            n = np.repeat(words["n"].to_numpy(), per_word)
            yield from _summed([pa.table({"unit": units, "n": n})], "unit").to_batches(max_chunksize=UNITS)

        found: list[pa.Table] = [pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})]
        for whole in batches:
            for batch in _portions(whole, "text"):
                words = cutter.words(batch["text"])[0].value_counts()
                found.append(pa.table({"word": words.field("values"), "n": words.field("counts")}))
                if sum(map(len, found)) > 2 * COUNTED:
                    found = [_summed(found, "word")]
                    if len(found[0]) > COUNTED:
                        yield from counted(found[0])
                        found = [found[0].slice(0, 0)]
            pa.default_memory_pool().release_unused()   # the worker stays for later stages
        yield from counted(_summed(found, "word"))

    counts = df.select(F.col(text).alias("text")).mapInArrow(count, "unit string, n long")
    return counts.groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``units`` with their edges: end, length, start + 1, score, id (minus the end where the character is unknown).

    Edges come sorted by end and length.
    """
    spark = units.sparkSession
    # the vocabulary bounds this table
    pieces = F.broadcast(local_table(spark, list(vocabulary.pieces), "piece STRING, id INT, score DOUBLE"))
    longest = vocabulary.longest
    number, end, length = F.col("number"), F.col("end"), F.col("length")
    # long units in portions, so that no substring is counted off from far away
    portions = units.select("unit", "n", F.explode(F.sequence(
        F.lit(0), F.floor((F.length("unit") - 1) / PORTION).cast("int"))).alias("number"))
    first = F.greatest(number * PORTION - (longest - 1), F.lit(0))
    portions = portions.select("unit", "n", "number", first.alias("before"), F.substring(
        "unit", first + 1, (number + 1) * PORTION - first).alias("part"))
    ends = portions.select("unit", "n", "part", "before", F.explode(F.sequence(
        number * PORTION + 1, F.col("before") + F.length("part"))).alias("end"))
    spans = ends.select("unit", "n", "part", "before", "end", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(longest), end))).alias("length"))
    spans = spans.select("unit", "n", "end", "length", F.substring("part", end - length + 1 - F.col("before"), length).alias("sub"))
    edges = spans.join(pieces, F.col("sub") == F.col("piece"), "left").filter("length = 1 OR id IS NOT NULL")
    edge = F.struct("end", "length", (end - length + 1).alias("from"),
                    F.coalesce("score", F.lit(vocabulary.unknown_score)).alias("score"), F.coalesce("id", -end).alias("id"))
    return edges.groupBy("unit", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def best_paths(edges: DataFrame, longest: int) -> DataFrame:
    """(unit, n, ids) of the best paths.

    A fold forwards keeps the best total into every position; a fold backwards
    follows the edges that made these totals, the longest where several did.
    """
    def forwards(totals: Column, edge: Column, offset: Column) -> Column:
        total = F.element_at(totals, edge["from"] - offset) + edge["score"]
        return F.when(F.size(totals) <= edge["end"] - offset, F.array_append(totals, total)).when(
            total > F.element_at(totals, -1), F.concat(F.slice(totals, F.lit(1), F.size(totals) - 1), F.array(total))).otherwise(totals)

    start = F.array(F.lit(0.0))
    short = F.aggregate("edges", start, lambda t, e: forwards(t, e, F.lit(0)))

    # long units: the totals of a portion are folded on their own behind the last ones before it
    def portion(state: Column, number: Column) -> Column:
        own = F.filter("edges", lambda e: F.floor((e["end"] - 1) / PORTION).cast("int") == number)
        offset = number * PORTION - F.size(state["tail"]) + 1
        totals = F.aggregate(own, state["tail"], lambda t, e: forwards(t, e, offset))
        new = F.slice(totals, F.size(state["tail"]) + 1, F.size(totals))
        tail = F.slice(totals, -F.least(F.size(totals), F.lit(longest + 1)), F.lit(longest + 1))
        return F.struct(tail.alias("tail"), F.array_append(state["done"], new).alias("done"))

    size = F.element_at("edges", -1)["end"]
    numbers = F.sequence(F.lit(0), F.floor((size - 1) / PORTION).cast("int"))
    begin = F.struct(start.alias("tail"), F.array(start).alias("done"))
    long = F.flatten(F.aggregate(numbers, begin, portion)["done"])
    totals = edges.select("unit", "n", "edges", F.when(size <= PORTION, short).otherwise(long).alias("totals"))

    def backwards(state: Column, edge: Column) -> Column:
        made = F.element_at("totals", edge["from"]) + edge["score"] == F.element_at("totals", edge["end"] + 1)
        return F.when((edge["end"] == state["at"]) & made, F.struct(
            (edge["from"] - 1).alias("at"), F.array_append(state["ids"], edge["id"]).alias("ids"))).otherwise(state)

    none = F.array().cast("array<int>")
    back = F.aggregate(F.reverse("edges"), F.struct((F.size("totals") - 1).alias("at"), none.alias("ids")), backwards)["ids"]

    # long units: the ids of a portion are gathered on their own
    def back_portion(state: Column, number: Column) -> Column:
        own = F.reverse(F.filter("edges", lambda e: F.floor((e["end"] - 1) / PORTION).cast("int") == number))
        found = F.aggregate(own, F.struct(state["at"].alias("at"), none.alias("ids")), backwards)
        return F.struct(found["at"].alias("at"), F.array_append(state["done"], found["ids"]).alias("done"))

    last = F.size("totals") - 1
    numbers = F.reverse(F.sequence(F.lit(0), F.floor((last - 1) / PORTION).cast("int")))
    done = F.array().cast("array<array<int>>")
    long_back = F.flatten(F.aggregate(numbers, F.struct(last.alias("at"), done.alias("done")), back_portion)["done"])
    return totals.select("unit", "n", F.reverse(F.when(last <= PORTION, back).otherwise(long_back)).alias("ids"))


def encode_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, n, ids) of distinct units, which are saved: their number tells into how many tasks their edges go."""
    units = cut_lineage(units)
    dealt = units.repartition(max(1, units.count() // UNITS), "unit")
    found = best_paths(lattice(dealt, vocabulary), vocabulary.longest)
    unknown = F.exists("ids", lambda i: i < 0)
    if vocabulary.byte_ids:
        table = F.array(*[F.lit(i) for i in vocabulary.byte_ids])

        def spelled(i: Column) -> Column:
            code = F.hex(F.substring(F.col("unit"), -i, F.lit(1)).cast("binary"))
            pairs = F.sequence(F.lit(1), F.length(code), F.lit(2))
            values = F.transform(pairs, lambda p: F.conv(F.substring(code, p, F.lit(2)), 16, 10).cast("int"))
            return F.transform(values, lambda v: F.get(table, v))

        whole = F.flatten(F.transform("ids", lambda i: F.when(i < 0, spelled(i)).otherwise(F.array(i))))
    else:
        named = F.transform("ids", lambda i: F.when(i < 0, F.lit(vocabulary.unknown_id)).otherwise(i))
        whole = F.filter(named, lambda x, k: (x != vocabulary.unknown_id) | (k == 0) | (
            F.coalesce(F.get(named, k - 1), F.lit(-1)) != vocabulary.unknown_id))
    return found.select("unit", "n", F.when(unknown, whole).otherwise(F.col("ids")).alias("ids"))


class UnitTable:
    """Encoded units by hash, as arrays."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.hashes, self.offsets, self.ids = hashes, offsets, ids

    @classmethod
    def collect(cls, units: DataFrame, vocabulary: Vocabulary) -> UnitTable:
        """Of a bounded number of units with columns h and ids.

        Every task sends its units sorted by hash and packed as bytes, so the
        driver holds little more than the table.
        """
        small = "uint16" if vocabulary.size < 1 << 16 else "int32"

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = pc.list_value_length(batch["ids"]).to_numpy(zero_copy_only=False).astype("int32")
                ids = batch["ids"].flatten().to_numpy(zero_copy_only=False).astype(small)
                parts = [batch["h"].to_numpy(zero_copy_only=False).tobytes(), sizes.tobytes(), ids.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["h", "sizes", "ids"])

        packed = units.select("h", "ids").orderBy("h").mapInArrow(pack, "h binary, sizes binary, ids binary").toArrow()

        def joined(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(np.frombuffer(p.as_buffer(), dtype=kind) for p in packed[name])])

        hashes, ids = joined("h", "int64"), joined("ids", small)
        offsets = np.zeros(len(hashes) + 1, dtype="int32" if len(ids) < 1 << 31 else "int64")
        np.cumsum(joined("sizes", "int32"), out=offsets[1:])
        return cls(hashes, offsets, ids)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def with_more(self, more: list[tuple]) -> UnitTable:
        """A table of these units alone."""
        more = sorted(dict(more).items())
        sizes = np.array([len(ids) for _, ids in more], dtype="int64")
        return UnitTable(np.array([h for h, _ in more], dtype="int64"), np.cumsum(np.concatenate([[0], sizes])),
                         np.array([i for _, ids in more for i in ids], dtype="int32"))

    def expand(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes(rows)
        ends = np.cumsum(sizes)
        if not len(rows):
            return np.zeros(0, dtype="int32")
        return self.ids[np.repeat(self.offsets[rows] - (ends - sizes), sizes) + np.arange(ends[-1])]

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.offsets[rows + 1] - self.offsets[rows]


@dataclass
class _Words:
    """Distinct words and units of some texts, each known by its number."""

    numbers: np.ndarray     # of the words of the texts in order
    per_text: np.ndarray    # words of each text
    units: np.ndarray       # numbers of the units of the distinct words in order
    per_word: np.ndarray    # units of each distinct word
    hashes: np.ndarray      # of the distinct units


def _words_of(texts: pa.Array, cutter: _Cutter, divider: _Divider) -> _Words:
    """Each distinct word is divided once, each distinct unit is hashed once."""
    import xxhash

    flat, per_text = cutter.words(texts)
    words = flat.dictionary_encode()
    units, per_word = divider.divide(words.dictionary)
    units = units.dictionary_encode()
    own = units.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(42)), dtype="uint64", count=len(own)).view("int64")
    return _Words(words.indices.to_numpy(), per_text, units.indices.to_numpy(), per_word, hashes)


#: Bytes of text, or ids, coded at once: what bounds a worker's memory.
PORTION_SIZE = 1 << 19


def _portions(batch: pa.RecordBatch, column: str, size: int = PORTION_SIZE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes or values of a column."""
    sizes = pc.coalesce(pc.binary_length(batch[column]) if pa.types.is_string(batch.schema.field(column).type)
                        else pc.list_value_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // size)) + 1).tolist(), len(sizes)]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array, drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in (name, *drop)]
    return pa.RecordBatch.from_arrays([*(batch[n] for n in names), values], names=[*names, name])


def _output(df: DataFrame, name: str, kind: str, drop: tuple[str, ...] = ()) -> StructType:
    kept = [f for f in df.schema.fields if f.name not in (name, *drop)]
    return StructType([*kept, StructField(name, DataType.fromDDL(kind))])


def lists_of(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32")), pa.array(flat.astype("int32")))


class Codec:
    """Encodes and decodes texts with a table of encoded units."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary, encoded: DataFrame, lookup: int = LOOKUP):
        """``encoded`` has unit, n, ids and is read several times."""
        self.vocabulary = vocabulary
        self.encoded = encoded.withColumn("h", F.xxhash64("unit"))
        units, pieces = self.encoded.agg(F.count("*"), F.sum(F.size("ids"))).first()
        self.complete = units <= lookup and (pieces or 0) <= lookup * LONGEST
        frequent = self.encoded.filter(F.size("ids") <= LONGEST).orderBy(F.col("n").desc(), "unit").limit(lookup)
        sent = self.encoded if self.complete else frequent
        self.table = spark.sparkContext.broadcast(UnitTable.collect(sent, vocabulary))

    def _missing(self, text: Column) -> Column:
        table, cutter, divider = self.table, _Cutter(self.vocabulary), _Divider(self.vocabulary)

        @F.pandas_udf("array<long>")
        def missing(texts: pd.Series) -> pd.Series:
            found = []
            for text in texts:
                row = np.unique(_words_of(pa.array([text], pa.string()), cutter, divider).hashes)
                found.append(row[table.value.find(row) < 0])
            return pd.Series(found, dtype=object)

        return missing(text)

    def encode(self, df: DataFrame, text: str = "text", output: str = "ids", decoded: str | None = None) -> DataFrame:
        """Adds the ids of each whole text and, under the name ``decoded``, what they decode to."""
        table, cutter, divider = self.table, _Cutter(self.vocabulary), _Divider(self.vocabulary)
        decoder = _Decoder(self.vocabulary) if decoded else None
        if self.complete:
            rows, extra = df, ()
        else:
            keys = df.withColumn("_k1", F.xxhash64(text)).withColumn("_k2", F.hash(text))
            wanted = keys.select("_k1", "_k2", F.explode(self._missing(F.col(text))).alias("h")).distinct()
            own = wanted.join(self.encoded.select("h", "ids"), "h").groupBy("_k1", "_k2").agg(
                F.collect_list(F.struct("h", "ids")).alias("_own"))
            rows, extra = keys.join(own, ["_k1", "_k2"], "left").drop("_k1", "_k2"), ("_own",)

        def ids_of(hashes: np.ndarray, owns: list) -> tuple[np.ndarray, np.ndarray]:
            """Ids of the units one after the other, and the number of ids of each unit."""
            at = table.value.find(hashes)
            if (at >= 0).all():
                return table.value.expand(at), table.value.sizes(at)
            more = table.value.with_more([(u["h"], u["ids"]) for own in owns for u in own or ()])
            rest = more.find(hashes)
            parts = [table.value.expand(at[i:i + 1]) if at[i] >= 0 else more.expand(rest[i:i + 1]) for i in range(len(at))]
            return np.concatenate([np.zeros(0, "int32"), *parts]), np.array([len(p) for p in parts])

        def coded_texts(texts: pa.Array, owns: list) -> tuple[np.ndarray, np.ndarray]:
            """Ids of the texts one after the other, and where each text begins and the last ends."""
            words = _words_of(texts, cutter, divider)
            flat, sizes = ids_of(words.hashes, owns)
            # tables of the distinct units and words: words are rows of the first, texts of the second
            of_units = UnitTable(words.hashes, np.concatenate([[0], np.cumsum(sizes)]), flat)
            unit_ends = np.concatenate([[0], np.cumsum(of_units.sizes(words.units))])
            word_ends = unit_ends[np.concatenate([[0], np.cumsum(words.per_word)])]
            of_words = UnitTable(words.hashes, word_ends, of_units.expand(words.units))
            ends = np.concatenate([[0], np.cumsum(of_words.sizes(words.numbers))])
            return of_words.expand(words.numbers), ends[np.concatenate([[0], np.cumsum(words.per_text)])]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in _portions(whole, text):
                    flat, ends = coded_texts(batch[text], batch["_own"].to_pylist() if extra else [])
                    coded = _with_column(batch, output, lists_of(flat, np.diff(ends)), extra)
                    yield _with_column(coded, decoded, pa.array(decoder.texts(flat, ends), pa.string())) if decoder else coded
                pa.default_memory_pool().release_unused()

        schema = _output(df, output, "array<int>")
        if decoded:
            schema = StructType([*(f for f in schema.fields if f.name != decoded), StructField(decoded, StringType())])
        return rows.mapInArrow(encode, schema)

    def decode(self, df: DataFrame, ids: str = "ids", output: str = "decoded") -> DataFrame:
        """Adds the text of ids; bytes that are no text become replacement characters."""
        decoder = _Decoder(self.vocabulary)

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in _portions(whole, ids):
                    flat = batch[ids].flatten().to_numpy(zero_copy_only=False)
                    counts = pc.coalesce(pc.list_value_length(batch[ids]), 0).to_numpy(zero_copy_only=False)
                    texts = decoder.texts(flat, np.concatenate([[0], np.cumsum(counts)]))
                    yield _with_column(batch, output, pa.array(texts, pa.string()))

        return df.mapInArrow(decode, _output(df, output, "string"))


class _Decoder:
    """Texts of ids that stand one after the other."""

    def __init__(self, vocabulary: Vocabulary):
        pieces = vocabulary.bytes_of_ids()
        sizes = np.array([len(p) for p in pieces], dtype="int64")
        self.pieces = UnitTable(np.arange(len(pieces)), np.concatenate([[0], np.cumsum(sizes)]),
                                np.frombuffer(b"".join(pieces), dtype="uint8"))

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """One text for the ids between neighbouring ``ends``; its first byte, the blank of the leading mark, goes."""
        ids = ids.astype("int64")
        data = self.pieces.expand(ids).tobytes()
        at = np.concatenate([[0], np.cumsum(self.pieces.sizes(ids))])[ends].tolist()
        return [data[a + 1:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def codec_for(df: DataFrame, vocabulary: Vocabulary, text: str = "text", lookup: int = LOOKUP) -> Codec:
    """A codec that knows every unit of the texts of ``df``; bounds the session's Arrow batches, as texts may be long."""
    bound_arrow_batches(df.sparkSession)
    encoded = cut_lineage(encode_units(count_units(df, text, vocabulary), vocabulary))
    return Codec(df.sparkSession, vocabulary, encoded, lookup)
