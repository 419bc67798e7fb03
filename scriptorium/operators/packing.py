"""Greedy packing of ordered items into runs of bounded size, spread over tasks whatever the size of a key.

An item's run, if it began there, ends before the first later item that no longer fits. With
sums of sizes up to each item that is a lookup of one number in another item's interval: an
equi-join on blocks of sums. Which items begin runs is what the first item reaches by these
pointers, found by doubling: rounds as the logarithm of the longest key's number of runs.
Sums are taken within a task's share of the order and shifted by the shares before it. Keys
are not null; items with equal order are told apart as they happen to lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.sources.tables import kept


def ordered(items: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """items plus _share (of the order, one task's) and _at, which rises with key and order."""
    rows = items.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    return kept(rows.withColumns({"_share": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def running(rows: DataFrame, key: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows of ordered() plus sums of values, from the key's first item up to each."""
    shares = rows.groupBy(*key, "_share").agg(*(F.sum(v).alias(f"_{name}") for name, v in values.items()))
    before = Window.partitionBy(*key).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(*key, "_share", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in values))
    within = Window.partitionBy(*key, "_share").orderBy("_at")
    sums = rows.withColumns({name: F.sum(v).over(within) for name, v in values.items()}).join(shares, [*key, "_share"])
    return sums.withColumns({name: F.col(name) + F.col(f"_{name}") for name in values}).drop(*(f"_{name}" for name in values))


def _followers(items: DataFrame, key: list[str], limit: int, gap: int, first_gap: int, most_items: int | None) -> DataFrame:
    """key, _n, _next: the item that begins the run after a run that begins at item _n; none at the end."""
    block = limit + gap
    low, high = F.col("_end") - F.col("_size"), F.col("_end")
    asks = items.select(*key, "_n", F.greatest(low + limit + gap - first_gap, high).alias("_limit")).withColumn("_block", F.floor(F.col("_limit") / block))
    holds = items.select(*key, F.col("_n").alias("_next"), low.alias("_low"), high.alias("_high")).withColumn("_block", F.explode(F.sequence(F.floor(F.col("_low") / block), F.floor((F.col("_high") - 1) / block))))
    found = asks.join(holds, [*key, "_block"]).filter((F.col("_low") <= F.col("_limit")) & (F.col("_limit") < F.col("_high"))).select(*key, "_n", "_next")
    if most_items is None:
        return found
    full = items.filter(F.col("_n") > most_items).select(*key, (F.col("_n") - most_items).alias("_n"), F.col("_n").alias("_next"))
    return found.unionByName(full).groupBy(*key, "_n").agg(F.min("_next").alias("_next"))


def packed(items: DataFrame, key: list[str], order: list[str], size: str, limit: int, gap: int, first_gap: int = 0, most_items: int | None = None) -> DataFrame:
    """items plus group, from 0 in each key.

    A run's size is the sum of its sizes, plus gap between items, plus first_gap; it stays within
    limit, but one item alone may pass it. A run has most_items at most.
    """
    rows = ordered(items, key, order)
    rows = kept(running(rows.withColumn("_size", F.col(size).cast("long") + gap), key, {"_end": F.col("_size"), "_n": F.lit(1).cast("long")}))
    jumps = kept(_followers(rows.select(*key, "_n", "_end", "_size"), key, limit, gap, first_gap, most_items))
    begins = new = kept(rows.filter("_n = 1").select(*key, "_n"))
    while True:
        new = kept(begins.join(jumps, [*key, "_n"]).select(*key, F.col("_next").alias("_n")))
        if new.isEmpty():
            break
        begins = kept(begins.unionByName(new))
        further = jumps.select(*key, F.col("_n").alias("_next"), F.col("_next").alias("_further"))
        jumps = kept(jumps.join(further, [*key, "_next"]).select(*key, "_n", F.col("_further").alias("_next")))
    marks = rows.join(begins.withColumn("_first", F.lit(1)), [*key, "_n"], "left")
    groups = running(marks.drop("_end"), key, {"group": F.coalesce("_first", F.lit(0)).cast("long")})
    return groups.select(*items.columns, (F.col("group") - 1).alias("group"))
