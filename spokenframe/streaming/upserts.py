"""Upserts of a stream into a table of files, the same however often a batch is tried.

The table is cut into buckets by its keys.  A batch rewrites the buckets that it touches into a
folder of its own number, then commits by writing a list of which batch holds each bucket.  Readers
follow the newest whole list.  A batch that died before its commit is written again over what
it left; one that comes again after its commit changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


def _committed(spark: SparkSession, table: str) -> int | None:
    """The number of the last batch whose list is whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/commits")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return None
    done = [int(s.getPath().getName()) for s in store.listStatus(path) if store.exists(path.suffix(f"/{s.getPath().getName()}/_SUCCESS"))]
    return max(done, default=None)


def _holders(spark: SparkSession, table: str) -> dict[int, int]:
    """{bucket: batch that holds it}; as many entries as there are buckets."""
    last = _committed(spark, table)
    return {} if last is None else {r["bucket"]: r["batch"] for r in spark.read.schema("bucket int, batch bigint").parquet(f"{table}/commits/{last}").collect()}


def _rows(spark: SparkSession, table: str, schema: str, holders: dict[int, int]) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for batch in sorted(set(holders.values())):
        paths = [f"{table}/data/{batch}/bucket={b}" for b, n in holders.items() if n == batch]
        out = out.unionByName(spark.read.schema(schema).parquet(*paths))
    return out


def read_table(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The table as the last committed batch left it; empty before the first."""
    return _rows(spark, table, schema, _holders(spark, table))


def upsert_into(table: str, keys: list[str], order: list[str], *, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each key keeps its row that is greatest by `order` (nulls least), whether it came in this batch or before.

    Rows that agree in keys and order should be alike; else the greatest by all columns stays.  Columns are those of the
    stream.  A table has one writer.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = _committed(spark, table)
        if last is not None and number <= last:
            return  # the batch came before
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
        rows = F.struct(*order, *[c for c in batch.columns if c not in order])
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        latest = lambda df: df.groupBy(*keys).agg(F.max(rows).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in batch.columns])
        new = latest(batch).select("*", bucket)
        holders = _holders(spark, table)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        old = _rows(spark, table, schema, {b: n for b, n in holders.items() if b in touched})
        merged = latest(old.unionByName(new.drop("bucket"))).select("*", bucket)
        merged.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/{number}")
        lists = spark.createDataFrame([(b, n) for b, n in (holders | {b: number for b in touched}).items()], "bucket int, batch bigint")
        lists.coalesce(1).write.mode("overwrite").parquet(f"{table}/commits/{number}")

    return run
