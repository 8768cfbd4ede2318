"""Connected components of a link table, by alternating star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    others = links.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.where("a < b").union(least.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the component's smallest node.

    A step moves each node towards the smallest node of its component, so the number of rounds grows
    with the logarithm of the longest path. Rounds end when a round changes no link.
    """
    current = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    state = None
    while True:
        print_of = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        now = current.agg(F.count("*"), print_of).first()
        if now == state or now[0] == 0:
            break
        state = now
        current = written(small_star(large_star(current)), label)
    nodes = current.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return nodes.union(current.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
