"""SimHash near duplicates over a Gray-order hierarchical index.

A fingerprint takes, for each of 64 bits, the majority over the text's shingle
hashes.  Fingerprints within ``RADIUS`` bits agree on one of ``RADIUS`` + 1
bands of bits: for each band, the fingerprints are rotated so that it leads, and
those that share its bits form a group.  A group is sorted by Gray rank, where
neighbours share most of their bits; runs of neighbours become leaves, leaves
become upper nodes, each with the bits that all below it share (a mask and a
pattern).  Two nodes whose patterns differ in more than ``RADIUS`` commonly
masked bits are left at once with everything below; the others are opened down
to single fingerprints.  A group tells only a spanning star of its links.

Only distinct fingerprints are indexed, so copies cost nothing.  A group with
more than ``MOST`` fingerprints is divided by further bands of its other bits,
of which one must agree as well; no pair is lost.

Defined results: null text and text without words have fingerprint zero, linked
like any other; texts of fewer words than a shingle have their whole sequence as
the only one; ids may repeat or be null (a component without any id has a null
component_id); repeated rows give repeated rows; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.llm.components import connected_components
from rankfold.session import cut_lineage

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Lowest bit and width of the bands that lead in turn.
BANDS = ((51, 13), (38, 13), (25, 13), (12, 13), (0, 12))
#: Entries of a leaf and children of an upper node.
LEAF, FANOUT = 16, 16
#: Fingerprints of a group at most, before it is divided further; fingerprints indexed at once.
MOST, BLOCK = 100_000, 50_000
#: Node pairs opened at once.
PAIRS = 4096


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles in their order, repeated ones as well."""
    import xxhash

    words = (text or "").encode().lower().split()   # bytes: A-Z only, and blanks are \\x20 \\x09-\\x0D
    if not words:
        return np.zeros(0, dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    joined = b" ".join(words)
    last = (ends - 1).tolist()[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last)), dtype="<u8", count=len(last))


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text as a signed 64-bit number."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(64, dtype="int64")
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")   # without words: zero
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, shingle) for t in texts], dtype="int64")

    return compute(text)


def rotated(value: Column, low: int, width: int) -> Column:
    """``value`` rotated so that the band leads."""
    left = 64 - low - width
    return value if left == 0 else F.shiftleft(value, left).bitwiseOR(F.shiftrightunsigned(value, 64 - left))


def gray_rank(code: Column) -> Column:
    """Place of a code in the order of the reflected binary code, as a signed number in that order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _band_groups(prints: DataFrame, most: int) -> DataFrame:
    """(band, part, code, rank): every fingerprint in the groups where it is indexed."""
    bands = F.array(*[F.struct(F.lit(i).alias("band"), rotated(F.col("f"), low, width).alias("code"), F.lit(width).alias("width"))
                      for i, (low, width) in enumerate(BANDS)])
    rows = prints.select(F.inline(bands))
    rows = rows.withColumn("part", F.expr("shiftrightunsigned(code, 64 - width)"))
    hot = rows.groupBy("band", "part").count().filter(F.col("count") > most).select("band", "part", F.lit(True).alias("hot"))
    rows = rows.join(hot, ["band", "part"], "left")
    # the bits behind the band in RADIUS + 1 parts; the last takes what is left over
    step = (64 - 13) // (RADIUS + 1)
    further = F.array(*[
        F.expr(f"shiftrightunsigned(shiftleft(code, width + {i * step}), "
               + (f"{64 - step})" if i < RADIUS else f"width + {i * step})")) * (RADIUS + 2) + i + 1
        for i in range(RADIUS + 1)])
    only = F.array(F.lit(0).cast("long"))
    return rows.select("band", "part", F.explode(F.when(F.col("hot"), further).otherwise(only)).alias("sub"), "code",
                       gray_rank(F.col("code")).alias("rank"))


class _Index:
    """Hierarchical index of codes in Gray order; node levels from leaves upwards."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []   # (mask, pattern) of the nodes of a level
        low = high = codes
        width = LEAF
        while True:
            starts = np.arange(0, len(low), width)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            mask = ~(low ^ high)
            self.levels.append((mask, low & mask))
            if len(low) == 1:
                break
            width = FANOUT

    def _children(self, a: np.ndarray, b: np.ndarray, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children of node pairs, each unordered pair once."""
        own = np.arange(width)
        left = np.repeat(a[:, None] * width + own, width, axis=1).ravel()
        right = np.tile(b[:, None] * width + own, (1, width)).ravel()
        keep = (left <= right) & (right < count) & (left < count)
        return left[keep], right[keep]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries within the radius, in portions."""
        stack = [(len(self.levels) - 1, np.zeros(1, dtype="int64"), np.zeros(1, dtype="int64"))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS:
                stack.append((level, a[PAIRS:], b[PAIRS:]))
                a, b = a[:PAIRS], b[:PAIRS]
            mask, pattern = self.levels[level]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
            near = apart <= RADIUS
            a, b = a[near], b[near]
            if not len(a):
                continue
            if level:
                left, right = self._children(a, b, FANOUT, len(self.levels[level - 1][0]))
                stack.append((level - 1, left, right))
            else:
                left, right = self._children(a, b, LEAF, len(self.codes))
                near = (np.bitwise_count(self.codes[left] ^ self.codes[right]) <= RADIUS) & (left < right)
                if near.any():
                    yield left[near], right[near]


def unite(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a[i] with b[i]; a root is the smallest member."""
    while True:
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        if not apart.any():
            return roots
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            further = roots[roots]
            if (further == roots).all():
                break
            roots = further


def spanning_links(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the entries that link to another one."""
    roots = np.arange(len(codes))
    for a, b in _Index(codes).links():
        roots = unite(roots, a, b)
    members = np.flatnonzero(roots != np.arange(len(codes)))
    return members, roots[members]


def _rotate_back(codes: np.ndarray, low: int, width: int) -> np.ndarray:
    left = 64 - low - width
    return codes if left == 0 else (codes >> np.uint64(left)) | (codes << np.uint64(64 - left))


def _link_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Indexes whole groups, several at once; frames come sorted by band, group and Gray rank."""
    def finished(block: pd.DataFrame) -> pd.DataFrame:
        found = []
        for band, rows in block.groupby("band", sort=False):
            codes = rows["code"].to_numpy("int64").view("uint64")
            members, roots = spanning_links(codes)
            back = _rotate_back(codes, *BANDS[band]).view("int64")
            found.append(pd.DataFrame({"u": back[members], "v": back[roots]}))
        return pd.concat(found)

    waiting: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        if not len(frame):
            continue
        waiting.append(frame)
        size += len(frame)
        if size >= BLOCK:
            block = pd.concat(waiting, ignore_index=True)
            keys = block[["band", "part", "sub"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield finished(block.iloc[:cuts[-1]])
                block = block.iloc[cuts[-1]:]
            waiting, size = [block], len(block)
    if waiting:
        yield finished(pd.concat(waiting, ignore_index=True))


def fingerprint_links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(u, v) links that connect all of the distinct fingerprints ``f`` within the radius of each other."""
    groups = _band_groups(prints, most).repartition("band", "part", "sub")
    return groups.sortWithinPartitions("band", "part", "sub", "rank").mapInPandas(_link_blocks, "u long, v long")


def near_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, f (signed fingerprint), component_id (smallest id reachable by links) and keeper.

    keeper is a fingerprint of the component that belongs to its component_id.
    """
    rows = cut_lineage(df.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("f")))
    prints = cut_lineage(rows.groupBy("f").agg(F.min("doc_id").alias("first_id")))
    components = connected_components(fingerprint_links(prints.select("f"), most=MOST))
    joined = prints.join(components.withColumnRenamed("node", "f"), "f", "left")
    joined = joined.withColumn("component", F.coalesce("component", "f"))
    # the smallest id, nulls last
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "f")).alias("first")
    smallest = joined.groupBy("component").agg(first)
    labels = joined.join(smallest, "component").select(
        "f", F.col("first.first_id").alias("component_id"), F.col("first.f").alias("keeper"))
    return rows.join(labels, "f").select("doc_id", "f", "component_id", "keeper")


def hex_fingerprint(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def keep_first_of_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``df`` that stand for their component: those of its smallest id.

    Of rows that repeat an id, and of components without any id, one row stays.
    """
    found = cut_lineage(near_components(df, doc_id, text, shingle))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("f") == F.col("keeper")))
    ids = kept.select(F.col("doc_id").alias("_id"), F.col("f").alias("_f")).distinct()
    same_id = F.col(doc_id).eqNullSafe(F.col("_id"))
    if found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return df.join(ids, same_id, "left_semi")
    rows = df.withColumn("_print", fingerprint(F.col(text), shingle))
    rows = rows.join(ids, same_id & (F.col("_print") == F.col("_f")), "left_semi")
    return rows.dropDuplicates([doc_id, "_print"]).drop("_print")
