"""Joins that keep hot keys apart, and prefix sums that no task holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window of a prefix sum holds, as a power of two.
BLOCK_BITS = 10


def dealt(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows (many for a hot key) joined with table, which has one row for each of the keys.

    Such a table mostly comes grouped by the keys, and Spark would bring rows to that grouping as they
    are.  A further key that both sides compute makes both be dealt out for the join
    alone, so that adaptive execution may split a hot key's rows over tasks.
    """
    deal = F.xxhash64(*keys, F.lit(7))
    return rows.withColumn("_deal", deal).join(table.withColumn("_deal", deal).hint("merge"), [*keys, "_deal"], how).drop("_deal")


def prefix_sums(rows: DataFrame, group: list[str], at: str, values: list[str]) -> DataFrame:
    """rows with `before_<value>`: the sum over rows of the same group whose whole number `at` is smaller.

    Rows are unique by group and at.  Sums go by blocks of neighbouring numbers, blocks of
    blocks and so on, so that no window holds more than 1024 rows if numbers are dense; the
    uppermost holds one for each 2**30 numbers.
    """
    levels, sums = [rows], rows
    for level in (1, 2, 3):
        sums = sums.groupBy(*group, F.shiftright(at, BLOCK_BITS).alias(at)).agg(*[F.sum(v).alias(v) for v in values])
        levels.append(sums)
    out = None
    for level, table in reversed(list(enumerate(levels))):
        up = F.shiftright(at, BLOCK_BITS).alias("_up") if level < 3 else F.lit(0).cast("long").alias("_up")
        w = Window.partitionBy(*group, "_up").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        table = table.select("*", up).withColumns({f"before_{v}": F.coalesce(F.sum(v).over(w), F.lit(0).cast("long")) for v in values})
        if out is not None:
            above = out.select(*group, F.col(at).alias("_up"), *[F.col(f"before_{v}").alias(f"_{v}") for v in values])
            table = table.join(above.hint("merge"), [*group, "_up"]).withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"_{v}") for v in values}).drop(*[f"_{v}" for v in values])
        out = table.drop("_up")
    return out
