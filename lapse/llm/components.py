"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import drop_staged, is_empty, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node that
    can be reached.  Self-links, repeated links and nulls add nothing.

    Each round points every larger neighbour at the smallest one (large star)
    and then every smaller neighbour too (small star), until the links are
    stars around the roots.  Minima are partial aggregates; they are staged, so
    the join that hands them to the links can split a node with many links.
    No node's neighbours are ever gathered in one task."""
    e = staged(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    if is_empty(e):
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = _state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = staged(both.join(low, "u").where("v > u")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        nxt = staged(large.join(low2, "u")
                     .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                             F.col("m").alias("v")).distinct(), "links")
        drop_staged(e, low, large, low2)
        e, before, state = nxt, state, _state(nxt)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
