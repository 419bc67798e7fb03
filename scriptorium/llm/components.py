"""Connected components by alternating large-star and small-star rounds.

Each round is two joins against a grouped minimum. A hub with a third of all edges is
pre-aggregated before the shuffle, and its edges get the minimum by a broadcast of the
few hubs. Rounds are written to the shared folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, work_dir, written


def _with_least(e: DataFrame, name: str, folder: str, total: int) -> DataFrame:
    """e (u, v) plus m, the least v of each u."""
    least = written(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), f"{name}-least", folder)
    return spread_join(e, least, ["u"], "degree", total)


def _large_star(e: DataFrame, name: str, folder: str, total: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, name, folder, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(e: DataFrame, name: str, folder: str, total: int) -> DataFrame:
    """The least of each u becomes its end and that of its other ends; (u, m) itself is among the rows."""
    moved = _with_least(e, name, folder, total)
    return moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node, root): the smallest node of each node's component.

    Nodes without an edge to another node do not appear. No edges give no rows.
    """
    folder = work_dir(edges.sparkSession)
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", folder)
    before, k, total = None, 0, e.count()
    while True:
        e = written(_large_star(e, f"large{k}", folder, total), f"large{k}", folder)  # one row an edge at most
        e = written(_small_star(e, f"small{k}", folder, total), f"small{k}", folder)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before, k, total = now, k + 1, now[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
