"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long): component is the smallest node reachable.

    Each round moves every node to the smallest of its neighbours and itself, follows that twice, and
    draws the links anew between where their ends went; links within one place vanish. A component's
    smallest node never moves, so when no link is left every node is there. Each round is written to
    the shared folder. Null ends and loops are ignored; an empty table gives no rows.
    """
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links = stored(links.where("a <> b").select(*ends).distinct(), "links")
    places = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b"), F.col("a")))
        moved = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        moved = stored(moved, "moved")
        onward = moved.select(F.col("node").alias("via"), F.col("to").alias("next"))
        moved = stored(moved.join(onward, F.col("to") == F.col("via")).select("node", F.col("next").alias("to")), "moved")
        if places is None:
            places = moved
        else:
            then = moved.select(F.col("node").alias("via"), F.col("to").alias("next"))
            places = stored(places.join(then, F.col("to") == F.col("via"), "left").select("node", F.coalesce("next", "to").alias("to")), "places")
        left = moved.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = moved.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        drawn = links.join(left, "a").join(right, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        links = stored(drawn.distinct(), "links")
    if places is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return places.select("node", F.col("to").alias("component"))
