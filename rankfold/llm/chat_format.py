"""Chat formatting after cumulative-snapshot collapse.

Loggers often store a conversation again after each reply.  Every turn gets a
rolling hash of all turns up to it; a conversation whose last hash is the hash
of a proper prefix of a longer one is such a snapshot and goes, equal
conversations keep the smallest id, and the maximal conversations are rendered.

Hashes are two 64-bit values, each the exclusive or of position-keyed turn
hashes.  Turns are numbered by two 64-bit digests of their contents; whole texts
are looked at for turns that tie in number and role, and are moved once, for
rendering.  A conversation is divided into parts of ``PART`` turn numbers: the
windows run within a part, an offset per part joins them, and each part is
rendered as a row, so a conversation of any length is spread over tasks.  What
ties stays together: a part holds all turns of its numbers.  DataFrame functions
only.

Defined results: repeated rows of one turn count once; rows of one turn number
with different contents are turns in the order of role and text; null turn
numbers come first, and they and negative ones belong to the first part; a row without conv_id is a conversation of its own (and yields to an
equal or longer one that has an id; equal ones are counted as copies); a null
role renders as ``DEFAULT_ROLE``, a null text as empty, yet null and '' are
different turns; an empty table gives an empty table; further columns are
ignored.  Markers inside contents are broken up by a blank, so that no text can
open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>"
DEFAULT_ROLE = "user"
#: Turn numbers of a part.
PART = 1024
_TURN = ("turn", "role", "text")
_DIGESTS = ("d1", "d2")


def _content(seed: int) -> Column:
    parts = [F.lit(seed), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return F.xxhash64(*parts)


def _part_of(turn: Column) -> Column:
    return F.coalesce(F.greatest(F.floor(turn / F.lit(PART)), F.lit(0)), F.lit(0)).cast("long")


def _placed(n: Column, digest: str) -> Column:
    return F.xxhash64(n.cast("long"), F.col(digest))


def _rows(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", _part_of(F.col("turn")).alias("part"), *_TURN, _content(1).alias("d1"), _content(2).alias("d2"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct turns without their texts, with ``tie``: the place of the text among those of one turn number and role."""
    key = ("conv_id", "part", "turn", "role")
    each = Window.partitionBy(*key)
    # one exchange: what is dealt by conversation and part is also dealt by more columns
    narrow = rows.select(*key, *_DIGESTS).repartition("conv_id", "part").distinct()
    narrow = cut_lineage(narrow.withColumn("same", F.count("*").over(each)))
    # saved, so that their size is known and no text is dealt out for a few ties
    ties = cut_lineage(narrow.filter("same > 1").select("conv_id", "part", *_DIGESTS).distinct())
    texts = rows.join(ties, ["conv_id", "part", *_DIGESTS], "left_semi")
    # one content may tie under a turn number and stand alone under another
    texts = texts.select(*key, "text", *_DIGESTS).distinct().withColumn("same", F.count("*").over(each)).filter("same > 1")
    texts = texts.withColumn("tie", F.row_number().over(each.orderBy("text")))
    alone = narrow.filter("same = 1").select(*key, *_DIGESTS, F.lit(1).alias("tie"))
    return alone.unionByName(texts.select(*key, *_DIGESTS, "tie"))


def prefix_hashes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n, p1, p2, total) of every turn that has an id, and (conv_id, part, place) of every part.

    n counts the turns so far, p1 and p2 are their hash, total counts the turns of the conversation.
    """
    part = ["conv_id", "part"]
    order = Window.partitionBy(*part).orderBy("turn", "role", "tie")
    local = cut_lineage(_ordered(_rows(turns).filter(F.col("conv_id").isNotNull())).select(
        *part, *_DIGESTS, F.row_number().over(order).alias("m")))
    along = Window.partitionBy("conv_id").orderBy("part")
    ahead = along.rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(local.groupBy(*part).agg(F.count("*").alias("turns")).select(
        *part, (F.row_number().over(along) - 1).alias("place"), F.coalesce(F.sum("turns").over(ahead), F.lit(0)).alias("before"),
        F.sum("turns").over(Window.partitionBy("conv_id")).alias("total")))
    so_far = Window.partitionBy(*part).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = local.join(parts, part).select(*part, "total", (F.col("m") + F.col("before")).alias("n"), *_DIGESTS)
    hashes = [(f"p{i}", _placed(F.col("n"), d)) for i, d in enumerate(_DIGESTS, 1)]
    within = placed.select(*part, "n", "total", *[F.bit_xor(h).over(so_far).alias(p) for p, h in hashes])
    # only a conversation of several parts has hashes that stand before a part
    several = parts.filter((F.col("place") > 0) | (F.col("before") > 0)).select("conv_id").distinct()
    sums = placed.join(several, "conv_id", "left_semi").groupBy(*part).agg(*[F.bit_xor(h).alias(p) for p, h in hashes])
    sums = sums.select(*part, *[F.bit_xor(p).over(ahead).alias(f"a{p}") for p, _ in hashes])
    whole = within.join(sums, part, "left").select("conv_id", "n", "total", *[
        F.col(p).bitwiseXOR(F.coalesce(f"a{p}", F.lit(0))).alias(p) for p, _ in hashes])
    return whole, parts.select(*part, "place")


def _without_id(turns: DataFrame) -> DataFrame:
    """Rows without conv_id, each a conversation of one turn, with the hash of it."""
    rows = _rows(turns).filter(F.col("conv_id").isNull())
    hashes = [_placed(F.lit(1), d).alias(f"p{i}") for i, d in enumerate(_DIGESTS, 1)]
    return rows.select("role", "text", *hashes)


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that prefix no longer one, and (conv_id, part, place) of every part.

    Of a conversation: conv_id, n_turns, copies (conversations equal to it, itself included) and its hash p1, p2.
    """
    prefixes, parts = prefix_hashes(turns)
    prefixes = cut_lineage(prefixes)
    ended = prefixes.filter(F.col("n") == F.col("total")).select("conv_id", "n", "p1", "p2")
    single = _without_id(turns).select(
        F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).cast("long").alias("n"), "p1", "p2")
    whole = ended.unionByName(single).groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    begun = prefixes.filter(F.col("n") < F.col("total")).select("n", "p1", "p2").distinct()
    kept = whole.join(begun, ["n", "p1", "p2"], "left_anti")
    return kept.select("conv_id", F.col("n").cast("int").alias("n_turns"), "copies", "p1", "p2"), parts


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _line(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), _safe(F.coalesce(role, F.lit(DEFAULT_ROLE))), F.lit("\n"),
                    _safe(F.coalesce(text, F.lit(""))), F.lit(END + "\n"))


def render(turns: DataFrame, conversations: DataFrame, parts: DataFrame) -> DataFrame:
    """``conversations`` with their chat text, a row for each part."""
    wanted = conversations.filter(F.col("conv_id").isNotNull()).join(parts, "conv_id").select(
        "conv_id", F.col("part").alias("of"), "place", "n_turns", "copies")
    rows = turns.select("conv_id", _part_of(F.col("turn")).alias("of"), *_TURN).join(wanted, ["conv_id", "of"])
    grouped = rows.groupBy("conv_id", "of").agg(
        *[F.first(c).alias(c) for c in ("n_turns", "copies", "place")],
        F.array_sort(F.collect_set(F.struct(*_TURN))).alias("turns"))
    lines = F.transform("turns", lambda t: _line(t["role"], t["text"]))
    chats = grouped.select("conv_id", "n_turns", "copies", F.col("place").alias("part"), F.array_join(lines, "").alias("chat"))

    apart = conversations.filter(F.col("conv_id").isNull())
    single = _without_id(turns).groupBy("p1", "p2").agg(F.max(F.struct("role", "text")).alias("t")).join(apart, ["p1", "p2"])
    return chats.unionByName(single.select(
        "conv_id", "n_turns", "copies", F.lit(0).alias("part"), _line(F.col("t.role"), F.col("t.text")).alias("chat")))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, part (from 0) and chat of every maximal conversation, a row for each part."""
    conversations, parts = maximal_conversations(turns)
    return render(turns, cut_lineage(conversations), parts)


def sql(table: str = "conversations") -> str:
    """The same result as SQL over ``table``, for checking: prefixes are compared as whole strings."""
    safe = "replace(replace({0}, '<|', '< |'), '|>', '| >')"
    role, text = safe.format(f"coalesce(role, '{DEFAULT_ROLE}')"), safe.format("coalesce(text, '')")
    return f"""
WITH t AS (SELECT DISTINCT conv_id, 0::BIGINT AS own, turn, role, text FROM {table} WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, row_number() OVER ()::BIGINT AS own, 0 AS turn, role, text FROM {table} WHERE conv_id IS NULL),
o AS (SELECT *, row_number() OVER w AS n,
        string_agg(coalesce('r' || role, 'n') || chr(31) || coalesce('t' || text, 'n') || chr(30), '')
          OVER (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
        count(*) OVER (PARTITION BY conv_id, own) AS total
      FROM t WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
whole AS (SELECT prefix, min(conv_id) AS conv_id, CASE WHEN min(conv_id) IS NULL THEN min(own) ELSE 0 END AS own,
            max(total) AS n_turns, count(*) AS copies FROM o WHERE n = total GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM o WHERE n < total)),
p AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id, own ORDER BY greatest(coalesce(floor(turn / {float(PART)}), 0), 0)) - 1 AS part FROM t)
SELECT k.conv_id, k.n_turns::INT AS n_turns, k.copies, p.part::INT AS part,
       string_agg('{START}' || {role} || chr(10) || {text} || '{END}' || chr(10), ''
                  ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chat
FROM kept k JOIN p ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.own = k.own
GROUP BY k.conv_id, k.own, k.n_turns, k.copies, p.part"""
