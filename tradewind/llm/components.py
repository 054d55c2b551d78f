"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.session import stage


EDGES_PER_FILE = 200_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node that has an edge (``a``, ``b``, both long).

    Large-star and small-star steps alternate until the edges no longer change; that takes a number of rounds of the
    order of the logarithm of the longest path. Each round is written to the shared folder, which cuts the lineage.
    The neighbours of a node are never collected: a node's smallest neighbour is an aggregate, and the join that hands
    it to the neighbours can be split where a node has very many.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, state = None, _state(now)
    # The number of edges never grows; few edges are written to few files.
    files = 1 + state[0] // EDGES_PER_FILE
    while state != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        )
        now = stage(small.coalesce(files), "edges")
        before, state = state, _state(now)
    # Now every node hangs on its root.
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
