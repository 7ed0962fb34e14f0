"""Distributed connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join to it, so a hub with any number of neighbours is never
gathered in one task. Every round is staged in the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge: label is the smallest node that it reaches.

    Nodes are of any ordered type. Loops, repeated edges and edges with a null end are ignored.
    """
    a, b = F.greatest(u, v).alias("a"), F.least(u, v).alias("b")
    now = common.staged(edges.filter(F.col(u) != F.col(v)).select(a, b).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(met.select("a", "m"))
        last, now = now, common.staged(small.distinct(), "edges")
        common.release(last)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select("b", "b"))
