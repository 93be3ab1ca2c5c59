"""Tables written between the steps of a long plan."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}  # by application, where no shared folder is set


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as a URI of the file system that it names, or of the cluster's default one.

    Only where it is unset and Spark runs on one machine (tests) is a temporary folder made; on a cluster it must be set.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _local.get(context.applicationId)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = _local[context.applicationId] = f"file://{local}"
    return _qualified(spark, path)


def _qualified(spark: SparkSession, path: str) -> str:
    """path as a URI; one without a scheme lies in Hadoop's default file system."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(hadoop.Path(path)).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the plan starts anew, and survives lost executors.

    Shuffle files of the steps before go once df is written, so that the disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
