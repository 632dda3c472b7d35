"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.llm.staging import staged


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge; the component is its smallest reachable id.

    Each step sends a node's neighbours to the smallest of them; minima are combined map-side
    and joined back, so no task holds a node's whole neighbourhood. Steps are staged, and end
    when the edges stop changing. Null ends and loops are left out; no edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges = staged(edges, "components")
    seen = _fingerprint(edges)
    while seen[0]:
        # Large star: larger neighbours move to the smallest neighbour (or the node itself).
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = staged(small.union(smallest.select("a", F.col("m").alias("b"))).distinct(), "components")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
