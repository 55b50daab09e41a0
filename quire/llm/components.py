"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.llm.common import cut


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links(a long, b long) -> (v long, label long), label the smallest vertex reachable; only vertices with a link to another appear.

    Every round is two grouped minima and two equi-joins on the link table; no vertex's neighbours are ever
    gathered, so a hub costs a partial aggregation and a join that AQE can split. Null ends and self-links are
    ignored; an empty table gives an empty result. Each round ends in a reliable checkpoint.
    """
    edges = cut(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (mark.n, mark.x) == seen or not mark.n:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct()
            )
        seen = (mark.n, mark.x)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select("b", "m").toDF("a", "b")
        edges = cut(small.unionByName(least.toDF("a", "b")).where("a != b").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
