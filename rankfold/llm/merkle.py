"""Merkle manifest of a dataset with a persistent tree: tampered leaves are versions that share what they leave alone.

Every row is a leaf, the leaves of a source ascend by id, and every ``ARITY``
consecutive nodes become one until a source has a single node, its subroot.  The
subroots, ordered by source, become the root in the same way.

* Leaves are range-sorted and saved; the counts of the partitions give every leaf
  its place, so no source passes one task.
* Aligned blocks of ``BLOCK`` leaves (``LEVELS`` levels) are rows of a saved table.
  A block grows its part of the tree in one task, and the blocks' top nodes are the
  leaves of the next round.  Rounds go on until every source has one node.
* Going down again, every block gets the siblings above it: one row per block.
* A tampered leaf makes a version: the ancestors on its way are copied with their
  new digests, within its block and then along the siblings above the block; all
  other nodes are those of the one tree and are never copied.  So versions, however
  many, stay spread as their leaves are.

Digests are the lowercase hex SHA-256 of their inputs one after the other; digests
enter as hex text.

Defined results: null fields are ``-`` in a leaf; null ids come first and are never
tampered with; rows of one id stand in the order of their digests; rows without a
source make a source, the first one; repeated rows are leaves of their own; an
empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.session import cut_lineage

ARITY = 16
#: Levels of a block, and the leaves it has at most.
LEVELS = 3
BLOCK = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


# leaves

def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(v) for v in values]).cast("binary"), 256))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def is_tampered(doc_id: Column, every: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.lit(False))


# places

def numbered(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    """The rows with their place (from 0) in an order; no task sees more than a partition of the sorted rows.

    Rows that are equal in the order are told apart by where they were read, so many of them are split as well.
    """
    placed = df.withColumn("_read", F.monotonically_increasing_id()).orderBy(*by, "_read").drop("_read")
    # the id holds the partition in its high bits and the place in it in the low 33 bits
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return ranked.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, "place")


# blocks

def height(count: int) -> int:
    """Levels above so many nodes."""
    found = 0
    while count > 1:
        count, found = -(-count // ARITY), found + 1
    return found


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class Tree:
    """Nodes of a block, level by level, each level as the hex digests one after the other."""

    def __init__(self, nodes: bytes, levels: int):
        self.levels = [nodes]
        for _ in range(levels):
            below = self.levels[-1]
            step = ARITY * _HEX
            self.levels.append(b"".join(sha(below[i:i + step]) for i in range(0, len(below), step)))

    @property
    def top(self) -> bytes:
        return self.levels[-1]

    def siblings(self, i: int) -> list[tuple[bytes, bytes]]:
        """Left and right siblings on the way from node i to the top."""
        found = []
        for nodes in self.levels[:-1]:
            first = i // ARITY * ARITY
            at, low, high = i * _HEX, first * _HEX, (first + ARITY) * _HEX
            found.append((nodes[low:at], nodes[at + _HEX:high]))
            i //= ARITY
        return found


def copied(node: bytes, siblings: Sequence[tuple[bytes, bytes]]) -> list[bytes]:
    """Digests of the ancestors that a version copies for a new ``node``; all else is shared."""
    found = []
    for left, right in siblings:
        node = sha(left + node + right)
        found.append(node)
    return found


def _blocks(nodes: DataFrame, *values: str) -> DataFrame:
    """(tree, count, block, nodes): aligned blocks of (tree, count, place, digest), saved; count is of the tree's nodes."""
    size = F.lit(BLOCK)
    rows = nodes.groupBy("tree", "count", F.expr(f"place DIV {BLOCK}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("place") % size).alias("at"), "digest", *values))).alias("nodes"))
    return cut_lineage(rows)


_TOPS = "tree long, count long, place long, digest binary"


def _tops(blocks: DataFrame) -> DataFrame:
    """(tree, count, place, digest) of the blocks' top nodes, the nodes of the next round."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, tops = batch["count"].to_pylist(), []
            for count, nodes in zip(counts, batch["nodes"]):
                tops.append(bytes.fromhex(Tree(_joined(nodes), min(LEVELS, height(count))).top.decode()))
            yield pa.RecordBatch.from_arrays(
                [batch["tree"], pa.array([-(-c // BLOCK) for c in counts], pa.int64()), batch["block"], pa.array(tops, pa.binary())],
                names=["tree", "count", "place", "digest"])

    return blocks.select("tree", "count", "block", F.transform("nodes", lambda x: x["digest"]).alias("nodes")).mapInArrow(grow, _TOPS)


def _joined(digests: pa.ListScalar) -> bytes:
    return b"".join(digests.values.to_pylist()).hex().encode()


def _grown(nodes: DataFrame, largest: int, *values: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and the one node that every tree has in the end."""
    rounds = []
    while True:
        rounds.append(_blocks(nodes, *values))
        nodes, values, largest = _tops(rounds[-1]), (), -(-largest // BLOCK)
        if largest <= 1:
            return rounds, nodes


# the way down

_WAY = "array<struct<left:binary,right:binary>>"


def _with_ways(blocks: DataFrame, ways: DataFrame) -> DataFrame:
    """Blocks with the siblings above their top node (``ways``: tree, place, way, subroot)."""
    above = ways.select("tree", F.col("place").alias("block"), "way", "subroot")
    return blocks.join(above, ["tree", "block"])


def _ways_of_nodes(blocks: DataFrame) -> DataFrame:
    """(tree, place, digest, way, subroot) of every node of blocks that know their way; subroot stays."""
    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(b"".join(row["nodes"]).hex().encode(), min(LEVELS, height(row["count"])))
                above = [(s["left"], s["right"]) for s in row["way"]]
                n = len(row["nodes"])
                ways = [[{"left": a, "right": b} for a, b in tree.siblings(i) + above] for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["tree"]] * n, pa.int64()), pa.array([row["block"] * BLOCK + i for i in range(n)], pa.int64()),
                    pa.array(row["nodes"], pa.binary()), pa.array(ways, _WAY_TYPE), pa.array([row["subroot"]] * n, pa.binary())],
                    names=["tree", "place", "digest", "way", "subroot"])

    rows = blocks.select("tree", "count", "block", F.transform("nodes", lambda x: x["digest"]).alias("nodes"), "way", "subroot")
    return rows.mapInArrow(descend, f"tree long, place long, digest binary, way {_WAY}, subroot binary")


_WAY_TYPE = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def _descended(rounds: list[DataFrame], ways: DataFrame) -> DataFrame:
    """Ways of the nodes of the first round but for the last step: its blocks, each with its way."""
    for blocks in reversed(rounds[1:]):
        ways = cut_lineage(_ways_of_nodes(_with_ways(blocks, ways)))
    return _with_ways(rounds[0], ways)


_PROOF_FIELDS = [("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()),
                 ("copies", pa.list_(pa.string()))]


def _proofs(blocks: DataFrame) -> DataFrame:
    """One row per leaf: what stands in _PROOF_FIELDS beside its id and source."""
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                nodes = batch["nodes"][k].values
                leaves, changed = nodes.field("digest").to_pylist(), nodes.field("changed").to_pylist()
                hexes = [d.hex().encode() for d in leaves]
                tree = Tree(b"".join(hexes), min(LEVELS, height(batch["count"][k].as_py())))
                above = [(s["left"], s["right"]) for s in batch["way"][k].as_py()]
                rest = b"".join(a + b for a, b in above)
                subroot = batch["subroot"][k].as_py().hex()
                found = []
                for i, leaf in enumerate(hexes):
                    siblings = tree.siblings(i)
                    proof = hashlib.sha256(b"".join(a + b for a, b in siblings) + rest).hexdigest()
                    own = leaf if changed[i] is None else changed[i].hex().encode()
                    way = copied(own, siblings + above)
                    root = (way[-1] if way else own).decode()
                    found.append((leaf.decode(), subroot, proof, root,
                                  None if changed[i] is None else [d.decode() for d in way]))
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*found), _PROOF_FIELDS)]
                yield pa.RecordBatch.from_arrays([nodes.field("doc_id"), nodes.field("source"), *columns],
                                                 names=["doc_id", "source", *(n for n, _ in _PROOF_FIELDS)])

    node = blocks.schema["nodes"].dataType.elementType
    schema = (f"doc_id {node['doc_id'].dataType.simpleString()}, source {node['source'].dataType.simpleString()}, leaf string, subroot string, "
              "proof_sha256 string, folded_root string, copies array<string>")
    return blocks.select("count", "nodes", "way", "subroot").mapInArrow(prove, schema)


def manifest(df: DataFrame, tampered: Column | None = None, changed: Column | None = None, doc_id: str = "doc_id",
             source: str = "source", fields: Sequence[str] = FIELDS, text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified and copies.

    Where ``tampered`` holds, the leaf's text is ``changed``: folded_root is the root of
    that version, copies the digests of the nodes it copies from the leaf's parent up to
    its root (null for other leaves).  Other leaves are folded as they are.
    proof_sha256 is the digest of the leaf's siblings, level by level up to the root.
    """
    if tampered is None:
        tampered = is_tampered(F.col(doc_id))
    if changed is None:
        changed = lower_ascii(F.col(text))
    other = digest(*[changed if f == text else F.col(f) for f in fields])
    leaves = cut_lineage(df.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), digest(*[F.col(f) for f in fields]).alias("digest"),
        F.when(tampered, other).alias("changed")))
    ranked = numbered(leaves, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"),
                               F.col("changed")])
    sources = ranked.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("count"))
    sources = cut_lineage(numbered(cut_lineage(sources), [F.col("source").asc_nulls_first()]).withColumnRenamed("place", "tree"))
    n_sources, largest = sources.agg(F.count("*"), F.max("count")).first()

    own = sources.withColumnRenamed("source", "_source")
    nodes = ranked.join(own, F.col("source").eqNullSafe(F.col("_source"))).select(
        "tree", "count", (F.col("place") - F.col("first")).alias("place"), "digest", "changed", "doc_id", "source")
    rounds, subroots = _grown(nodes, largest or 1, "changed", "doc_id", "source")

    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_sources).cast("long").alias("count"),
                            F.col("tree").alias("place"), "digest")
    upper_rounds, roots = _grown(upper, n_sources or 1)
    roots = cut_lineage(roots)

    ways = roots.select("tree", F.lit(0).cast("long").alias("place"), F.lit([]).cast(_WAY).alias("way"),
                        F.lit(None).cast("binary").alias("subroot"))
    trees = _ways_of_nodes(_descended(upper_rounds, ways))   # one row per source
    ways = cut_lineage(trees.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "way",
                                    F.col("digest").alias("subroot")))
    proofs = _proofs(_descended(rounds, ways))
    root = F.lower(F.hex("digest")).alias("root")
    proofs = proofs.crossJoin(F.broadcast(roots.select(root)))   # one row
    return proofs.select("doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"), "copies")


def sql(table: str = "documents") -> str:
    """The same manifest as SQL over ``table``, for checking."""
    def leaf(text: str) -> str:
        fields = [f"coalesce(octet_length(encode({v}::VARCHAR))::VARCHAR || ':' || {v}::VARCHAR, '-')"
                  for v in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(fields)})"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE bits AS (
  SELECT b AS byte, b::BIGINT AS c, 0 AS k FROM range(256) r(b)
  UNION ALL SELECT byte, {step}, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(lowered)} AS lowered,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS tampered
      FROM {table}, crc),
leaves AS (SELECT *, coalesce(CASE WHEN tampered THEN lowered END, leaf) AS own,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
nodes AS (
  SELECT 0 AS level, tree, place AS place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT level + 1, tree, place // {ARITY}, sha256(string_agg(digest, '' ORDER BY place)), ceil(n / {ARITY})::BIGINT
  FROM nodes WHERE n > 1 GROUP BY level, tree, place // {ARITY}, n),
subroots AS (SELECT tree, level AS top, digest FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, tree AS place, digest, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // {ARITY}, sha256(string_agg(digest, '' ORDER BY place)), ceil(n / {ARITY})::BIGINT
  FROM upper WHERE n > 1 GROUP BY level, place // {ARITY}, n),
root AS (SELECT digest AS root FROM upper WHERE n = 1),
every AS (
  SELECT level, tree, place, digest, level AS rank FROM nodes WHERE n > 1
  UNION ALL SELECT level, NULL, place, digest, level + 1000 FROM upper WHERE n > 1),
runs AS (SELECT rank, tree, place // {ARITY} AS run, list(digest ORDER BY place) AS digests FROM every GROUP BY rank, tree, place // {ARITY}),
climb AS (
  SELECT l.doc_id, l.tree, l.place AS leaf_place, l.leaf, s.digest AS subroot, l.place AS pos, 0 AS rank, s.top, l.own AS folded, '' AS proof
  FROM leaves l JOIN subroots s USING (tree)
  UNION ALL
  SELECT c.doc_id, c.tree, c.leaf_place, c.leaf, c.subroot, c.pos // {ARITY}, c.rank + 1, c.top,
    sha256(array_to_string(r.digests[:c.pos % {ARITY}], '') || c.folded || array_to_string(r.digests[c.pos % {ARITY} + 2:], '')),
    c.proof || array_to_string(r.digests[:c.pos % {ARITY}], '') || array_to_string(r.digests[c.pos % {ARITY} + 2:], '')
  FROM (SELECT * REPLACE (CASE WHEN rank = top AND rank < 1000 THEN tree ELSE pos END AS pos,
                          CASE WHEN rank = top AND rank < 1000 THEN 1000 ELSE rank END AS rank) FROM climb) c
  JOIN runs r ON r.rank = c.rank AND r.run = c.pos // {ARITY} AND (c.rank >= 1000 OR r.tree = c.tree))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY tree, leaf_place ORDER BY rank DESC) = 1), root
"""
