"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a grouped minimum and a join on the node, so a node with a third of
all edges is pre-aggregated and its join is split by adaptive execution.  Rounds
are stored in the shared folder and deleted when the next is there; nothing is
collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.llm.shared import Shelf


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round; ``edges`` has each link once, as (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a link whose upper end has smaller neighbours keeps its own minimum
        kept = edges.join(least, "u").select("u", F.col("m").alias("v"))
        out = moved.unionByName(kept)
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])


def components(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the smallest node it reaches.

    The result is the table ``components`` of the shelf, if one is given.
    """
    shelf = shelf or Shelf(edges.sparkSession)
    now = shelf.put("star-edges", edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(now)
    while before[0]:
        # a table replaces the one of its name only once it is written
        now = shelf.put("star-edges", _stars(shelf.put("stars", _stars(now, True)), False))
        after = _mark(now)
        if after == before:
            break
        before = after
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    done = shelf.put("components", members.unionByName(members.select(F.col("root").alias("node"), "root").distinct()))
    shelf.drop("star-edges", "stars")
    return done
