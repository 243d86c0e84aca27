"""Saving intermediate tables, in the folder the cluster shares.

A table that several branches of a plan read is written once: otherwise every branch would
scan and shuffle the raw rows again.  Files survive lost executors, and their known size lets
Spark broadcast the small ones by its own size threshold.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a fresh local folder only when it is unset in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL[sc.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def save_table(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet files written now."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/honestpick-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
