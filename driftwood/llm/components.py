"""Connected components of a graph given as pairs, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwood.llm.exchange import checkpointed


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link each smaller neighbour of a node, and the node, to the smallest of them; pairs have v < u."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v")))


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of a pair; `pairs` has columns u and v.

    Minima are found by aggregation, which combines before it shuffles, and joined back, so a star's centre with very
    many neighbours is a skewed join key and never a group in one task.  Pairs of nulls or of equal nodes don't count;
    an empty input gives an empty result.
    """
    pairs = pairs.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, before = checkpointed(pairs), None
    for _ in range(rounds):
        pairs = checkpointed(_small_star(_large_star(pairs).distinct()).distinct())
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()
