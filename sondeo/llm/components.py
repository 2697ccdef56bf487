"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.support import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b longs) reaches.

    Alternates two steps until nothing changes: every node passes the smallest node of its
    neighbourhood to its larger neighbours, then to its smaller ones. Paths shorten by half in each
    round, so the number of rounds follows the logarithm of the longest path; each is a constant number
    of shuffles of at most the links there are, aggregated before they move. Self links and repeated
    links do no harm; null ends are ignored; no links give no rows.
    """
    both = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null")
    nodes = stored(both.select("a").union(both.select("b")).distinct())
    edges = stored(both.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    for _ in range(rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        # to larger neighbours: every neighbour above the node links to the smallest of the neighbourhood
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))   # a table: a hub's join can be split
        up = sides.join(least, "a").filter("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(up.distinct())
        # to smaller neighbours, the node itself included
        least = stored(edges.groupBy("a").agg(F.min("b").alias("low")))
        down = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b")
        edges = stored(down.union(least.select("a", F.col("low").alias("b"))).distinct())
        if edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first() == state:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    found = edges.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(found, "a", "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("component"))
