"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

1. Words are counted where texts are read and summed by word.
2. Two words one edit apart agree in their first or in their last half (of the
   shorter word's length).  So every word stands in the lists of its two halves,
   once as the shorter or equal word of a pair and once as the longer one.  A list
   with more than ``MOST`` words is divided again, by the halves of what its words
   do not share, until no list is that long; no pair is lost, and of the lists that
   a pair shares the first one tells it.
3. A list is sorted, and each of its words is compared with those that follow.  The
   rows of the edit matrix (a band of three cells) are kept by depth: the next word
   goes on from the row of the prefix that it shares with the last one (their longest
   common prefix).  Where a row exceeds one edit, all words that share the prefix up
   to there are skipped at once.  All words of many lists take these steps together
   as arrays.
4. A word's form is the best of its near words; roots follow forms by pointer
   doubling.  A form is at least ``RATIO`` times as frequent as its word, so chains
   are short.

Defined results: null text has no words; a null id counts as an empty one in the
hash that plants misspellings; repeated rows count again; an empty table gives an
empty table; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.session import cut_lineage

#: Code points and occurrences of a word at least; a form's occurrences in those of its word.
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
#: One run in so many, by hash, loses a code point.
PLANTED = 199
#: Distinct words that a task counts before it hands its sums on.
COUNTED = 200_000
#: Words of a list at most, before it is divided further.
MOST = 20_000
#: Cells (words times code points) of the lists searched together.
CELLS = 1 << 20
_FAR = 3   # any number of edits beyond those that count
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


# words

def lowered(run: str) -> str:
    """A-Z in lower case only."""
    return run.lower() if run.isascii() else run.translate(_UPPER)


def words_of(doc_id: str, text: str, shortest: int = LENGTH, planted: int = PLANTED) -> Counter[str]:
    """Words of a text with their number; runs whose hash ``planted`` divides lose one code point."""
    runs: Counter[str] = Counter()
    for match in re.finditer(rf"[A-Za-zÀ-ÿ]{{{shortest},}}", text):
        runs[match[0]] += 1
    folded: Counter[str] = Counter()
    for run, n in runs.items():
        folded[lowered(run)] += n
    begin, found = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in folded.items():
        h = zlib.crc32(run.encode(), begin)
        if h % planted == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < shortest:
                continue
        found[run] += n
    return found


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = LENGTH,
               occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words that occur often enough over all texts; every task sums up before the shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, one in zip(batch["doc_id"].to_pylist(), batch["text"]):
                found.update(words_of("" if i is None else i, one.as_py() or "", shortest))
                if len(found) > COUNTED:
                    yield counted()
                    found.clear()
            pa.default_memory_pool().release_unused()
        yield counted()

    rows = df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= occurrences)


# lists

def _halves(rows: DataFrame) -> DataFrame:
    """Every row in its two lists.

    ``rest`` is what the words of a list need not share, ``left`` its length in the
    shorter word of a pair.  The second list holds the rests reversed, so either
    list is keyed and sorted from the front.
    """
    half = F.expr("left DIV 2")
    back = F.reverse("rest")

    def one(side: str, rest: Column, taken: Column) -> Column:
        return F.struct(F.concat("path", F.lit(side)).alias("path"), F.concat("key", F.lit("|"), F.substring(rest, F.lit(1), taken)).alias("key"),
                        F.substring(rest, taken + 1, F.length(rest)).alias("rest"), (F.col("left") - taken).alias("left"))

    both = F.array(one("0", F.col("rest"), half), one("1", back, F.col("left") - half))
    return rows.select("size", "word", "n", F.inline(both))


def lists(words: DataFrame, most: int = MOST) -> DataFrame:
    """(size, path, key, rest, left, word, n): the lists in which near words meet; size is the shorter word's length."""
    length = F.length("word")
    rows = words.select(F.explode(F.array(length, length - 1)).alias("size"), "word", "n").filter("size > 0").select(
        "size", "word", "n", F.lit("").alias("path"), F.lit("").alias("key"), F.col("word").alias("rest"), F.col("size").alias("left"))
    done, rows = None, _halves(rows)
    while True:
        long = cut_lineage(rows.groupBy("size", "path", "key", "left").count().filter(F.col("count") > most).filter("left > 1")
                           .select("size", "path", "key", F.lit(True).alias("long")))
        if long.isEmpty():
            return rows if done is None else done.unionByName(rows)
        marked = rows.join(long, ["size", "path", "key"], "left")
        short = marked.filter("long IS NULL").drop("long")
        done = short if done is None else done.unionByName(short)
        rows = cut_lineage(_halves(marked.filter("long").drop("long")))


def path_of(a: str, b: str, size: int, depth: int) -> str:
    """The first of the lists of a depth that two words share."""
    path, left = "", size
    for _ in range(depth):
        half = left // 2
        if a[:half] == b[:half]:
            path, a, b, left = path + "0", a[half:], b[half:], left - half
        else:
            path, a, b, left = path + "1", a[::-1][left - half:], b[::-1][left - half:], half
    return path


# search of sorted lists

def shared_prefixes(codes: np.ndarray, sizes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row with the one before it; -1 where a list begins."""
    found = np.full(len(codes) + 1, -1, dtype="int32")
    if len(codes) > 1:
        apart = codes[1:] != codes[:-1]
        first = np.where(apart.any(axis=1), apart.argmax(axis=1), codes.shape[1])
        found[1:-1] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    found[:-1][fresh] = -1
    return found


def _next_below(shared: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the next one that shares less than ``depth`` with the one before it."""
    n = len(shared)
    places = np.where(shared < depth, np.arange(n), n - 1)
    found = np.minimum.accumulate(places[::-1])[::-1]
    return np.concatenate([found[1:], [n - 1]]).astype("int32")


def near_rows(codes: np.ndarray, sizes: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one list that are one edit apart.

    codes: code points of the sorted rows, 0 behind their ends; fresh: where a list begins.
    """
    n, width = codes.shape
    shared = shared_prefixes(codes, sizes, fresh)
    skips = np.stack([_next_below(shared, d) for d in range(width + 2)])
    padded = np.zeros((n, width + 4), dtype=codes.dtype)   # a query's characters from column 1 on
    padded[:, 1:width + 1] = codes
    # rows of the edit matrix by depth: cells for query prefixes one shorter, as long, and one longer
    matrix = np.full((n, width + 2, 3), _FAR, dtype="int8")
    matrix[:, 0, 1] = 0
    matrix[:, 0, 2] = np.where(sizes >= 1, 1, _FAR)

    query = np.flatnonzero(shared[1:] >= 0).astype("int32")   # rows with another one behind them
    cursor, depth = query + 1, np.zeros(len(query), dtype="int32")
    left, right = [], []
    while len(query):
        ended = depth == sizes[cursor]
        # words read to their end: the cell of the whole query tells the edits
        if ended.any():
            q, c, d = query[ended], cursor[ended], depth[ended]
            gap = sizes[q] - d
            inside = np.abs(gap) <= 1
            edits = np.where(inside, matrix[q, d, np.clip(gap, -1, 1) + 1], _FAR)
            left.append(q[edits == 1])
            right.append(c[edits == 1])
        # one more character of the others
        q, c, d = query[~ended], cursor[~ended], depth[~ended] + 1
        above = matrix[q, d - 1]
        letter, size = codes[c, d - 1], sizes[q]
        row = np.full((len(q), 3), _FAR, dtype="int8")
        for cell in range(3):
            reach = d + cell - 1   # length of the query's prefix
            value = above[:, cell] + (padded[q, np.clip(reach, 0, width + 3)] != letter)
            value = np.where(reach >= 1, value, _FAR)
            if cell < 2:
                value = np.minimum(value, above[:, cell + 1] + 1)
            if cell > 0:
                value = np.minimum(value, row[:, cell - 1] + 1)
            row[:, cell] = np.where((reach >= 0) & (reach <= size), np.minimum(value, _FAR), _FAR)
        matrix[q, d] = row
        dead = row.min(axis=1) > 1
        # where to go on: the next word, the next one beyond the skipped range, or one character further
        after = cursor.copy()
        after[ended] += 1
        moved = c.copy()
        moved[dead] = skips[d[dead], c[dead]]
        after[~ended] = moved
        deeper = np.zeros(len(query), dtype="int32")
        deeper[~ended] = d
        changed = after != cursor
        deeper[changed] = shared[after[changed]]
        open_ = deeper >= 0
        query, cursor, depth = query[open_], after[open_], deeper[open_]
    if not left:
        return np.zeros(0, dtype="int32"), np.zeros(0, dtype="int32")
    return np.concatenate(left), np.concatenate(right)


def _search(block: list[tuple]) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its n), both ways, of whole lists: (size, path, key, rest, word, n)."""
    sizes = np.array([len(r[3]) for r in block], dtype="int32")
    width = int(sizes.max())
    codes = np.zeros((len(block), width), dtype="int32")
    flat = np.frombuffer("".join(r[3] for r in block).encode("utf-32-le"), dtype="<i4")
    codes[np.arange(width) < sizes[:, None]] = flat
    fresh = np.array([True, *(a[:3] != b[:3] for a, b in zip(block, block[1:]))])
    for i, j in zip(*near_rows(codes, sizes, fresh)):
        a, b = block[i], block[j]
        if min(len(a[4]), len(b[4])) == a[0] and path_of(a[4], b[4], a[0], len(a[1])) == a[1]:
            yield a[4], b[4], b[5]
            yield b[4], a[4], a[5]


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, near_n): every pair of words one edit apart, both ways."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0

        def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            pairs = list(_search(rows)) if len(rows) > 1 else []
            if pairs:
                columns = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))],
                                                 names=["word", "near", "near_n"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("size", "path", "key", "rest", "word", "n"))):
                if size >= CELLS and row[:3] != waiting[-1][:3]:
                    yield from found(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[3]) + 1
        yield from found(waiting)

    rows = lists(words, most).select("size", "path", "key", "rest", "word", "n").repartition("size", "path", "key")
    return rows.sortWithinPartitions("size", "path", "key", "rest").mapInArrow(search, "word string, near string, near_n long")


# forms

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) without cycles; every round doubles the forms followed."""
    found = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut_lineage(found.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        found = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return found


def variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary of ``df``."""
    words = cut_lineage(vocabulary(df, doc_id, text))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    chosen = F.col("best.minus") <= -ratio * F.col("n")
    told = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.minus")).alias("form_n")))
    ends = roots(told.filter("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(table: str = "documents") -> str:
    """The same variants as SQL over ``table``, for checking: near words share a word with one place deleted or masked."""
    return f"""
WITH RECURSIVE bits AS (
  SELECT b AS byte, b::BIGINT AS c, 0 AS k FROM range(256) r(b)
  UNION ALL SELECT byte, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LENGTH},}}')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM {table}),
per AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
               string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
               lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END))),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM per, crc),
spelled AS (SELECT CASE WHEN h % {PLANTED} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
places AS (SELECT word, unnest(range(length(word))) AS i FROM words),
cut AS (SELECT word, i, word[:i] || word[i + 2:] AS rest FROM places),
links AS (
  SELECT a.word AS word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT l.word, count(*) AS n_near, min_by(l.near, (-w.n, l.near)) AS form, max(w.n) AS form_n
         FROM links l JOIN words w ON w.word = l.near GROUP BY l.word),
told AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
           CASE WHEN b.form_n >= {RATIO} * w.n THEN b.form END AS form, CASE WHEN b.form_n >= {RATIO} * w.n THEN b.form_n END AS form_n
         FROM words w LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS k FROM told
  UNION ALL SELECT c.word, t.form, c.k + 1 FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL)
SELECT t.word, t.form, r.root, t.n, t.n_near, t.form_n
FROM told t JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) r USING (word)
"""
