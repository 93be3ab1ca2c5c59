"""Ranks of whole tables without a task that holds a whole table or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import dealt, prefix_sums
from .shared import written

__all__ = ["FEW", "dealt", "meet", "prefix_sums", "ranked"]

#: Up to so many rows a table of keys is broadcast (its count is looked at first); beyond that it is joined.
FEW = 10_000


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `rank`, their place from 0 in the given order: sorted by ranges, written, then each part's base added."""
    placed = written(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the sort
    base = placed.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return placed.withColumn("_part", part).join(base.hint("merge"), "_part").withColumn("rank", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_base", "_at")


def meet(rows: DataFrame, table: DataFrame, key: str, n: int) -> DataFrame:
    """dealt() for a table of n rows, or a broadcast where these are few."""
    return rows.join(F.broadcast(table), key) if n <= FEW else dealt(rows, table, [key])
