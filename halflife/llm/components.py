"""Connected components of an edge table by alternating stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.llm.common import stored

#: Edges beyond which a round's minima are stored.
MANY = 1_000_000


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the component's smallest node, itself included.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest; it ends when a
    round changes nothing, after a number of rounds that grows with the logarithm of the longest path. Every
    round is stored, so a lost executor never costs more than one. Minima are combined before the shuffle; of more
    than MANY edges they are stored too, so the join is one of plain shuffles, which Spark splits at a skewed node.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None

    def kept(least: DataFrame, n: int) -> DataFrame:
        return stored(least, "cc") if n > MANY else least

    while (state := _state(edges)) != before:
        before = state
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), state[0])
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), state[0])
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "cc")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())
