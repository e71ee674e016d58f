"""Connected components of an edge table, by alternating large and small stars.

Each round sends every node's larger neighbours to the smallest node it knows (large
star), then its smaller ones (small star), until nothing moves (Kiveris et al. 2014).
Minima are aggregated before they move, so a node with very many neighbours costs no task
more than its share; each round's edges are written to the shared folder, and read by tasks
by their number rather than the session's, as few edges over many tasks cost what tasks cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, by_rows


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, stash: Stash, most_rounds: int = 100) -> DataFrame:
    """(a, b) pairs of ids -> (node, component) for every node with an edge; component is the smallest id reachable.

    Loops, nulls and repeated pairs count for nothing.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stash.put(edges), None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before, old = now, edges
        edges = stash.put(_small_star(_large_star(by_rows(edges, now[0]))))
        stash.drop(old)
    else:
        raise RuntimeError(f"components don't settle in {most_rounds} rounds")
    edges = by_rows(edges, 2 * now[0])
    return stash.put(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
