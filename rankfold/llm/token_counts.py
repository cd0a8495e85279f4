"""Token counts: batches encoded in an Arrow function that returns lengths only.

A byte-level BPE never merges across the pieces that its pattern cuts, and with
that pattern a blank followed by a non-blank always begins a piece.  Texts are
therefore cut before such blanks: the count of a text is the sum of the counts
of its chunks, long texts need no long encoding, and a chunk that occurs many
times is encoded once per worker.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
give repeated rows; an empty table gives an empty table; other columns pass
through untouched; a text without any safe boundary is encoded in one piece.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of new chunks handed to the tokenizer at once.
BATCH_BYTES = 1 << 20
#: Chunks whose counts a worker remembers; beyond that it forgets them all and goes on.
REMEMBERED = 300_000
#: Longer chunks are not remembered.
LONGEST_REMEMBERED = 64

_UNSAFE_BLANK = re.compile(r" (?=\s|$)|^\s")
_BOUNDARY = re.compile(r"(?= \S)")


def chunks_of(text: str) -> dict[str, int]:
    """Chunks of a text between safe boundaries with the number of times each occurs."""
    if _UNSAFE_BLANK.search(text):
        return Counter(_BOUNDARY.split(text))
    first, *others = text.split(" ")
    found = {" " + word: n for word, n in Counter(others).items()}
    found[first] = found.get(first, 0) + 1
    return found


class _Lengths:
    """Chunk lengths under one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def _encode(self, chunks: list[str]) -> Iterator[int]:
        return (len(e.ids) for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False))

    def learn(self, chunks: set[str]) -> dict[str, int]:
        """Lengths of new chunks, encoded in batches balanced by their size."""
        found: dict[str, int] = {}
        batch, size = [], 0
        for chunk in sorted(chunks, key=len):
            batch.append(chunk)
            size += len(chunk)
            if size >= BATCH_BYTES:
                found.update(zip(batch, self._encode(batch)))
                batch, size = [], 0
        found.update(zip(batch, self._encode(batch)))
        return found

    def count(self, texts: list[str]) -> list[int]:
        parts = [chunks_of(text) for text in texts]
        new = self.learn({chunk for part in parts for chunk in part if chunk not in self.known})
        known = self.known

        def tokens(part: dict[str, int]) -> int:
            return sum(n * (known[chunk] if chunk in known else new[chunk]) for chunk, n in part.items())

        counts = [tokens(part) for part in parts]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        known.update((chunk, n) for chunk, n in new.items() if len(chunk) <= LONGEST_REMEMBERED)
        return counts


@lru_cache(maxsize=4)
def _lengths(path: str) -> _Lengths:
    return _Lengths(path)


def _by_bytes(texts: list[str], most: int) -> Iterator[list[str]]:
    """Consecutive texts in groups of about ``most`` characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def token_count(text: Column, tokenizer_path: str) -> Column:
    """Number of tokens of ``text`` under the tokenizer file at ``tokenizer_path``.

    Without begin, end or added special tokens; special strings inside texts are
    handled as the tokenizer does by default; nothing is truncated or padded.
    The file must be at the same path on every executor.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = _lengths(tokenizer_path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            yield pd.Series([n for group in _by_bytes(texts, 4 * BATCH_BYTES) for n in lengths.count(group)],
                            dtype="int64")

    return count(text)


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit); columns of these names are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = df.withColumn("n_bytes", F.octet_length(whole).cast("long"))
    counted = counted.withColumn("n_tokens", token_count(F.col(text), tokenizer_path))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
