"""Connected components of a graph given as edges, by large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour, so hubs become
stars around the smallest node of their component.  Minima are aggregated per
node before they are joined back; nothing gathers the neighbours of a node.
Lineage is cut by a written table after every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.session import cut_lineage

MOST_ROUNDS = 60


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = _minima(edges)
    moved = edges.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of (u, v) edges; the component is its smallest node."""
    directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") > F.col("v"))
    directed = cut_lineage(directed.distinct())
    state = _state(directed)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        directed = cut_lineage(small_star(large_star(directed)))
        before, state = state, _state(directed)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = directed.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return directed.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
