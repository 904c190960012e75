"""Connected components by alternating large-star and small-star steps.

Each step is one shuffle on a node and never gathers a node's neighbours in one row: minima
are partial aggregates, and hot stars only cost rows. Every step is written to the shared
folder, so a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b) the smallest node it reaches."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e)
    last = None
    while True:
        before, e = e, written(_small_star(_large_star(e)))
        drop(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    star = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


SALTS = 16


def _with_least(e: DataFrame) -> DataFrame:
    """Rows (u, v) with the least v of their u. A hot u is dealt over salts by its v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("k"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    dealt = e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(least.hint("merge"), (F.col("u") == F.col("k")) & (dealt["s"] == least["s"])).select("u", "v", "m")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
    near = _with_least(both).where("v > u").withColumn("m", F.least("m", "u"))
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    moved = _with_least(e).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(e.groupBy("u").agg(F.min("v").alias("v"))).distinct()
