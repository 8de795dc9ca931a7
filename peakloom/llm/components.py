"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import discard, materialize, narrowed


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang every larger neighbour of u on the least node among u and its neighbours. n: rows of edges."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return narrowed(narrowed(moved, n).distinct(), n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Hang u and its smaller neighbours on the least of them. Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return narrowed(narrowed(moved.union(least.select("u", F.col("m").alias("v"))), 2 * n).distinct(), 2 * n)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (u, v); component is the smallest node that is reachable.

    Every round is a handful of joins whose result is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path. An edge table of stars, each on its least node, is the fixed point.
    """
    spark = edges.sparkSession
    kept: list[str] = []
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), kept)
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before, old = state, kept
        kept = []
        edges = materialize(_small_star(_large_star(edges, state[0]), state[0]), kept)
        discard(spark, old)
