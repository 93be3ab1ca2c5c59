"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Most bytes of column data in one Arrow batch handed to Python.
BATCH_BYTES = 8 << 20

#: The white space that the contracts name: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table or folder in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors and gives the
    optimizer true sizes for later joins.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch where the session allows more, so that very long texts don't pile up.

    Spark reads these settings when a result is computed, so they stay; a session that has lower ones keeps them.
    """
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", 4000)):
        have = spark.conf.get(name, None)
        value = int(have) if have is not None and have.lstrip("-").isdigit() else None
        if value is None or value <= 0 or value > most:
            spark.conf.set(name, str(most))


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id written as text; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name with as many underscores in front as it takes to be no column of df."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def release() -> None:
    """Drop what encoders keep in this worker; operators that encode nothing call it, for their own memory."""
    import sys

    for name in ("_kept_encoders", "_kept_pieces"):
        sys.modules.pop(name, None)


def slices_of(batch, column: int | str, most: int = 1 << 20):
    """Parts of an Arrow batch whose texts hold about `most` bytes."""
    import numpy as np

    if not len(batch):
        return
    size = np.cumsum(_lengths(batch.column(column)).astype(np.int64))
    cut = np.flatnonzero(np.diff(size // most)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
        yield batch.slice(lo, hi - lo)


def _lengths(texts):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
