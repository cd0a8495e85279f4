"""Packing of tokenised documents into sequences of bounded length, balanced by attention cost.

A document is its token ids and an end id.  What fills whole sequences is cut off
its front; the rest of it is a piece of less than a sequence.  The pieces of a
block of documents are packed together: their tokens are exactly the room of the
block's sequences, of which the last few are as long as powers of two, so nothing
is padded.  A piece costs ``linear * length + quadratic * length ** 2``, as its
tokens attend to nothing but their own piece.  From the longest to the shortest,
each goes to the sequence of the lowest cost so far that has room for it; where
none has, the one with the most room takes the front of the piece, and the rest
waits for its turn among the shorter ones.

Texts are encoded where they are read and packed by the same task, block by block
of ``BLOCK`` tokens: ids are neither shuffled nor saved, and a task holds one block
besides the slice of text at hand.  Costs are balanced within a block.

Defined results: null text is empty, and an empty document is its end id alone;
ids may repeat or be null; repeated rows are packed each on its own; an empty
table gives an empty table; other columns are left out, so clashing names do not
matter.  The same splits of the input give the same sequences; sequence numbers
are unique but not gapless, as every task counts from a number of its own.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, DoubleType, StructField, StructType

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END_ID = 2048, 1
#: Cost of a token, and of a pair of tokens in a piece (a model with 1024 channels).
LINEAR, QUADRATIC = 1.0, 1 / 6144
#: Tokens packed together.
BLOCK = 2 << 20
#: Characters encoded at once; longer texts are cut before a blank in front of a word.
SLICE = 1 << 20
#: Rows of an output batch.
ROWS = 20_000

# Fixed value: the pattern by which byte-level vocabularies of this kind cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def _byte_alphabet() -> dict[str, int]:
    """Characters by which such files spell bytes: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Ids of byte strings if merging in the order of ids is what the file says, else None."""
    alphabet = _byte_alphabet()
    try:
        spelled = {bytes(alphabet[c] for c in piece): i for piece, i in model["vocab"].items()}
    except KeyError:
        return None
    return spelled


class Encoder:
    """Ids of texts under a tokenizer file, as its own library gives them.

    A byte-level file whose merges are in the order of their ids is read as ranks of
    byte strings and encoded by a faster library; any other file by its own.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self._encode = self._by_ranks(said) or self._by_file(path)

    @staticmethod
    def _by_ranks(said: dict):
        import tiktoken

        model, cutting, specials = said["model"], said.get("pre_tokenizer") or {}, said.get("added_tokens", [])
        plain = (model.get("type") == "BPE" and cutting.get("type") == "ByteLevel" and not cutting.get("add_prefix_space")
                 and cutting.get("use_regex", True) and not said.get("normalizer") and not model.get("ignore_merges")
                 and not model.get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in specials))
        if not plain:
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"].get("".join(m), -1) for m in merges]
        names = {t["content"]: t["id"] for t in specials}
        vocabulary = {p: i for p, i in model["vocab"].items() if p not in names}
        ranks = _ranks({"vocab": vocabulary})
        if ranks is None or made != sorted(made) or len(set(made)) != len(made) or len(made) + 256 != len(vocabulary):
            return None
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=names)
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all")

    @staticmethod
    def _by_file(path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="uint32")

    def slices(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text in order; long texts in portions between safe boundaries."""
        begin = 0
        while len(text) - begin > SLICE:
            found = _SAFE.search(text, begin + SLICE)
            if not found:
                break
            yield self._encode(text[begin:found.start()])
            begin = found.start()
        yield self._encode(text[begin:])


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def room(tokens: int, capacity: int) -> list[int]:
    """Lengths of the sequences that hold exactly so many tokens: full ones, then powers of two."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR,
           quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of the parts of pieces, in the order of placing."""
    rooms = room(sum(lengths), capacity)
    waiting = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(waiting)
    cheap = [(0.0, s) for s in range(len(rooms))]   # by cost; those with too little room go to ``narrow``
    narrow: list[tuple[int, float, int]] = []       # by room, the most first
    placed = []

    def put(i: int, start: int, length: int, cost: float, s: int) -> None:
        placed.append((i, start, length, s))
        rooms[s] -= length
        if rooms[s]:
            heapq.heappush(cheap, (cost + linear * length + quadratic * length * length, s))

    while waiting:
        n, i, start = heapq.heappop(waiting)
        length = -n
        while narrow and -narrow[0][0] >= length:
            _, cost, s = heapq.heappop(narrow)
            heapq.heappush(cheap, (cost, s))
        while cheap and rooms[cheap[0][1]] < length:
            cost, s = heapq.heappop(cheap)
            heapq.heappush(narrow, (-rooms[s], cost, s))
        if cheap:
            cost, s = heapq.heappop(cheap)
            put(i, start, length, cost, s)
        else:
            free, cost, s = heapq.heappop(narrow)
            put(i, start, -free, cost, s)
            heapq.heappush(waiting, (-(length + free), i, start - free))
    return placed


@dataclass
class _Packer:
    """Collects documents and gives out the rows of their pieces."""

    capacity: int
    linear: float
    quadratic: float
    number: int                                        # of the next sequence
    with_ids: bool
    rows: list[tuple] = field(default_factory=list)
    tails: list[tuple] = field(default_factory=list)   # (document, start, ids, tokens of the document)
    held: int = 0

    def row(self, doc, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int, cost: float) -> tuple:
        found = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset, cost)
        return (*found, ids.astype("int32")) if self.with_ids else found

    def cost(self, length: int) -> float:
        return self.linear * length + self.quadratic * length * length

    def add(self, doc, portions: Iterator[np.ndarray], end_id: int) -> None:
        whole, rest = [], np.zeros(0, dtype="uint32")
        for portion in (*portions, np.array([end_id], dtype="uint32")):
            rest = np.concatenate([rest, portion])
            full = len(rest) - len(rest) % self.capacity
            for at in range(0, full, self.capacity):
                one = rest[at:at + self.capacity]
                whole.append(self.row(doc, len(whole) * self.capacity, one, 0, self.number + len(whole), 0, self.cost(self.capacity)))
            rest = rest[full:].copy()
        tokens = len(whole) * self.capacity + len(rest)
        self.number += len(whole)
        self.rows += [(*r[:4], tokens, *r[5:]) for r in whole]
        if len(rest):
            self.tails.append((doc, tokens - len(rest), rest, tokens))
            self.held += len(rest)

    def pack(self) -> None:
        """Packs the pieces at hand."""
        placed = assign([len(t[2]) for t in self.tails], self.capacity, self.linear, self.quadratic)
        costs: dict[int, float] = {}
        for _, _, length, s in placed:
            costs[s] = costs.get(s, 0.0) + self.cost(length)
        filled = dict.fromkeys(costs, 0)
        for i, start, length, s in placed:
            doc, first, ids, tokens = self.tails[i]
            self.rows.append(self.row(doc, first + start, ids[start:start + length], tokens, self.number + s, filled[s], costs[s]))
            filled[s] += length
        self.number += len(costs)
        self.tails, self.held = [], 0


def pack(df: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC, block: int = BLOCK,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_cost, and its ids if asked for.

    ids_crc32 is of the ids as little-endian unsigned 32-bit numbers; ``capacity`` is
    a power of two or more than the sum of those below it that a rest needs.  The file
    must be at the same path on every executor.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [StructField("doc_id", rows.schema["doc_id"].dataType), *(StructField(n, LongType()) for n in names[1:]),
              StructField("sequence_cost", DoubleType())]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        packer = _Packer(capacity, linear, quadratic, TaskContext.get().partitionId() << 33, with_ids)
        kinds: list = []

        def given(least: int) -> Iterator[pa.RecordBatch]:
            while len(packer.rows) >= max(1, least):
                part, packer.rows = packer.rows[:ROWS], packer.rows[ROWS:]
                columns = list(zip(*part))
                types = [kinds[0], *[pa.int64()] * 6, pa.float64(), *([pa.list_(pa.int32())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.name for f in fields])

        for batch in batches:
            kinds[:] = [batch["doc_id"].type]
            for doc, one in zip(batch["doc_id"].to_pylist(), batch["text"]):
                packer.add(doc, encoder.slices(one.as_py() or ""), end_id)
                if packer.held >= block:
                    packer.pack()
                yield from given(ROWS)
            pa.default_memory_pool().release_unused()
        packer.pack()
        yield from given(1)

    return rows.mapInArrow(work, StructType(fields))
