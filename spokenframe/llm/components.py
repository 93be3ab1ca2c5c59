"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def spread_join(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows (many for a hot key) joined with found (one row for each key).

    found mostly comes grouped by the key, and Spark would then bring rows to that grouping as
    they are.  A second key that both sides compute makes both sides be dealt out anew for the
    join alone, so that adaptive execution may cut a hot key's rows into several tasks.
    """
    deal = F.xxhash64(key, F.lit(11))
    return rows.withColumn("_deal", deal).join(found.withColumn("_deal", deal).hint("merge"), [key, "_deal"]).drop("_deal")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of edges (u, v); root is the smallest node of its component.

    Each round is two joins of the edges with each node's smallest neighbour; rounds grow
    with the logarithm of a component's longest path.  Loops and repeated edges don't
    matter; an empty table gives an empty result.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = spread_join(both.filter("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, down, "u")
        # a node's larger neighbours hang on its smallest one; the node itself does so too
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = written(small.filter("u <> v").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
