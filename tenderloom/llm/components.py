"""Connected components of an edge list, by hooking and shortcutting over shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """The least node (`root`) that each node of `edges` (a, b: long, in any direction) is joined to. `rows`: a bound on
    the number of edges, if one is known.

    Each round links every node's larger neighbours, and then its smaller ones, to the least node among itself and
    its neighbours (large-star and small-star); edges never grow in number and paths at least halve over two rounds,
    so rounds grow with the logarithm of the longest path. A node's neighbours are reduced by a minimum that is combined
    before the shuffle and joined back, so no list of them is ever held. Each round is written to the shared folder, in
    files for the number of edges: a round over few edges costs what its files and tasks do.
    """
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
        rows,
    )
    n = 2 * edges.count()
    while True:
        # Large star: all larger neighbours of u go to the least of u and its neighbours.
        ups = edges.select("u", "v", F.lit(1).alias("up"), F.lit(0).alias("down"))
        downs = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        both = ups.unionByName(downs)
        least = both.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("m"), F.sum("up").alias("up"), F.max("down").alias("down")
        )
        least = written(least, "least", n)
        # Done when every edge goes from a node with no other edge to one that has none of its own.
        if least.where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        large = both.select("u", "v").join(least.select("u", "m"), "u").where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "edges", n)
        # Small star: all smaller neighbours of u, and u itself, go to the least of them.
        lows = written(large.groupBy("u").agg(F.min("v").alias("m")), "least", n)
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lows.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges", n)
