"""Exact top-k search by inner product: aggregation without random access.

Every component of the candidates is a list sorted by value; a query reads list
i from its high end where its own component is positive and from its low end
where that is negative.  While the lists are read to growing depth, a candidate
has a lower bound (unread components at their worst) and an upper bound (unread
components at the value where reading stands).  Reading stops for a query when
the candidates whose upper bound reaches its k-th best lower bound are few;
their scores are then resolved.

Candidates and queries are dealt into blocks of bounded size; each pair of
blocks is one group, in which the lists are read for all its queries at once,
and the k best of the groups are merged.  The queries are a stated set.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows without an id; rows equal in id and vector count once,
different vectors of one id are candidates, and queries, of their own (for each
other too); missing components of shorter vectors count as 0;
ties go to the smaller id; fewer candidates than k give them all; scores beyond
the range of long stop at its ends; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.session import cut_lineage

SCALE = 64.0
#: Rows of a block of queries and of a block of candidates.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: Depths at which the bounds are compared, as parts of the lists; the last reads them to the end.
DEPTHS = (0.125, 0.5, 1.0)
#: Candidates of a query are resolved when they are fewer than this part of the block.
FEW = 0.02


def quantised(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component; null where the vector takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return F.when(~bad, whole)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype="int64")
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def read_lists(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, k: int, depths=DEPTHS) -> list[np.ndarray]:
    """For each query, the candidates (row numbers) that can be among its k best.

    own: (query, candidate) pairs that do not count, as a boolean matrix.
    """
    n = len(candidates)
    high, low = np.maximum(queries, 0), np.minimum(queries, 0)
    ends = np.concatenate([high, low], axis=1)
    ordered = np.sort(candidates, axis=0)
    smallest, largest = ordered[0], ordered[-1]
    found: list[np.ndarray] = [np.arange(0)] * len(queries)
    open_ = np.arange(len(queries))
    for depth in depths:
        last = depth >= 1
        read = n if last else max(1, int(n * depth))
        from_top, from_bottom = ordered[n - read], ordered[read - 1]
        lower = ends[open_] @ np.concatenate([np.where(candidates >= from_top, candidates, smallest),
                                              np.where(candidates <= from_bottom, candidates, largest)], axis=1).T
        lower[own[open_]] = -np.inf
        line = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(open_), -np.inf)
        if last:   # everything is read: both bounds are the score
            upper = lower
        else:
            upper = ends[open_] @ np.concatenate([np.maximum(candidates, from_top), np.minimum(candidates, from_bottom)], axis=1).T
            upper[own[open_]] = -np.inf
        can = (upper >= line[:, None]) & ~own[open_]
        done = can.sum(axis=1) <= max(4 * k, FEW * n) if not last else np.ones(len(open_), dtype=bool)
        for i in np.flatnonzero(done):
            found[open_[i]] = np.flatnonzero(can[i])
        open_ = open_[~done]
        if not len(open_):
            break
    return found


def block_best(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of a block for each query of a block."""
    empty = pd.DataFrame({name: pd.Series(dtype="int64") for name in ("query_row", "query_id", "vec_id", "score")})
    if not len(queries) or not len(candidates):
        return empty
    width = max(queries["v"].map(len).max(), candidates["v"].map(len).max(), 1)
    candidates = candidates.sort_values("vec_id")
    q, c = _matrix(queries["v"], width), _matrix(candidates["v"], width)
    qid, cid = queries["vec_id"].to_numpy("int64"), candidates["vec_id"].to_numpy("int64")
    size = float(np.abs(q.astype("float64")).sum(axis=1).max() * np.abs(c.astype("float64")).max())
    query_rows = queries["u"].to_numpy("int64")
    own = query_rows[:, None] == candidates["u"].to_numpy("int64")[None, :]
    if size >= 2.0**53:   # no float holds these products: whole scores in Python's integers
        reach = [np.flatnonzero(~row) for row in own]
        exact = lambda i, rows: np.clip(c[rows].astype(object) @ q[i].astype(object), -(1 << 63), (1 << 63) - 1)
    else:
        kind = "float32" if size < 2.0**24 else "float64"
        reach = read_lists(q.astype(kind), c.astype(kind), own, k)
        exact = lambda i, rows: c[rows] @ q[i]
    parts = []
    for i, rows in enumerate(reach):
        if len(rows):
            scores = exact(i, rows).astype("int64")
            best = np.lexsort((cid[rows], -scores.astype("float64"))) if size < 2.0**53 else np.array(
                sorted(range(len(rows)), key=lambda r: (-int(scores[r]), cid[rows[r]])))
            best = best[:k]
            parts.append(pd.DataFrame({"query_row": query_rows[i], "query_id": qid[i], "vec_id": cid[rows][best], "score": scores[best]}))
    return pd.concat(parts) if parts else empty


def top_k(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
          query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of every query row.

    ``is_query`` is a condition on the column vec_id.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector)).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    # saved with a number per row, which tells rows of one id apart and deals them out
    rows = cut_lineage(rows.distinct().withColumn("u", F.monotonically_increasing_id()))
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    q_blocks, c_blocks = max(1, -(-n_queries // query_block)), max(1, -(-n // candidate_block))

    def dealt(frame: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        mixed = F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")
        return frame.select("u", "vec_id", "v", mixed.alias(own), every.alias(other))

    queries = dealt(rows.filter(is_query), "qb", q_blocks, "cb", c_blocks).groupBy("qb", "cb")
    candidates = dealt(rows, "cb", c_blocks, "qb", q_blocks).groupBy("qb", "cb")
    best = queries.cogroup(candidates).applyInPandas(
        lambda q, c: block_best(q, c, k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def sql(k: int = 20, every: int = 20, table: str = "embeddings") -> str:
    """The same search as SQL over ``table``, for checking."""
    return f"""
WITH d AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM {table}
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT *, row_number() OVER () AS u FROM d),
s AS (SELECT q.u, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.u <> c.u WHERE q.vec_id % {every} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {k}"""
