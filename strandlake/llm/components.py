"""Distributed connected components by alternating large and small stars.

Both steps only keep, for every node, the smallest node it knows; a node with very many neighbours is a hot key of a
minimum with map-side combining and of a join whose large side Spark may split. Every round is written to the shared
folder, so lost executors cost at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffled


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free checksum."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with an edge; a component is named by its smallest node.

    Self-loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(start.distinct(), "cc")
    state = _state(now)
    while state[0]:
        # large star: larger neighbours of u are tied to the smallest of u and its neighbours
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(shuffled(low), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        tied = large.join(shuffled(least), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = tied.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        now = materialize(small, "cc")
        before, state = state, _state(now)
        if state == before:
            break
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
