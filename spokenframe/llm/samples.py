"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Up to so many labels their shares are broadcast; beyond that they are joined.
FEW = 10_000


def sample_by_class(rows: DataFrame, label: str, keys: list[str], per_class: int, most: int) -> DataFrame:
    """About per_class rows of each label, but no more than `most` in all: with many labels fewer of each, one at least.

    Rows are chosen by a hash of their keys (kept as the column _draw), so the choice is the same on every run
    and no class is sorted or gathered as a whole.
    """
    counts = written(rows.groupBy(label).count(), "class-counts")
    n = counts.count()
    each = max(1, min(per_class, most // max(1, n)))
    share = counts.select(F.col(label).alias("_label"), (F.lit(float(each)) / F.col("count")).alias("_share"))
    drawn = rows.withColumn("_draw", F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30))
    share = F.broadcast(share) if n <= FEW else share.hint("merge")
    return drawn.join(share, F.col(label) == F.col("_label")).filter(F.col("_draw") < F.col("_share")).drop("_label", "_share")
