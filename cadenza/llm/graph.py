"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.plans.materialize import by_shuffle, cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots, the smallest of each component.

    Large-star and small-star in turn: each step hangs neighbours onto the smallest neighbour,
    which keeps the components and ends in one star per component after about log(n) rounds.
    Minima are pre-aggregated before their shuffle, and each round is written to the shared
    folder. Only a count and a checksum come to the driver.
    """
    links = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while (now := tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())) != before:
        before = now
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(by_shuffle(least), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(by_shuffle(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
