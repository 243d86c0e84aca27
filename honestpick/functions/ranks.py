"""Row positions inside groups of any size.

A plain row_number() over a group sorts the whole group in one task.  Here the group is cut
into buckets that follow the sort order; positions are counted inside a bucket and shifted
by the size of the buckets before it, so one hot group uses many tasks.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from honestpick.functions.lineage import save_table


def with_position(df: DataFrame, by: list[str], order: list, bucket: Column,
                  position: str = "pos", size: str | None = "n") -> DataFrame:
    """0-based position by `order` inside `by`; `bucket` must be non-decreasing in `order`.

    `by` may be empty.  Only bucket counts are shuffled twice, never the rows.
    """
    df = df.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"),
        F.sum("_c").over(group).alias("_size"))
    inner = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(inner) - 1).join(offsets, keys)
    cols = [c for c in df.columns if c != "_bucket"]
    extra = [(F.col("_rn") + F.col("_offset")).cast("bigint").alias(position)]
    if size:
        extra.append(F.col("_size").alias(size))
    return out.select(*cols, *extra)


ROWS_PER_BUCKET = 500_000       # rows of one group that one task should sort


def id_bucket(df: DataFrame, by: list[str], c: str) -> Column:
    """Bucket for ordering by a number: ranges of one width, narrowed until the fullest is small.

    Each step is one small aggregate.  Crowded ids, or one far away, only make the width
    smaller; ranges without rows cost nothing.
    """
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"),
                                 F.max(c).alias("hi"))
    largest, low, high = groups.agg(F.max("n"), F.min("lo"), F.max("hi")).first()
    if (largest or 0) <= ROWS_PER_BUCKET or low == high:
        return F.lit(0)
    span = float(high) - float(low)
    width = span / math.ceil(largest / ROWS_PER_BUCKET)
    while True:
        bucket = F.floor((F.col(c).cast("double") - F.lit(float(low))) / F.lit(width))
        if _fullest(df, by, bucket) < 2 * ROWS_PER_BUCKET or width < span * 2 ** -50:
            return bucket
        width /= 8


def prefix_bucket(df: DataFrame, by: list[str], c: str) -> Column:
    """Bucket for ordering by text (or a value of another type, as text): as many leading
    characters as make the fullest bucket small."""
    length = 0
    while True:
        bucket = F.coalesce(F.substring(F.col(c).cast("string"), 1, length), F.lit(""))
        if _fullest(df, by, bucket) < 2 * ROWS_PER_BUCKET or length >= 256:
            return bucket
        length = 2 * length or 1


def hex_digits(df: DataFrame, by: list[str], most: int | None = None) -> int:
    """Leading hex digits that cut the largest group's uniform hashes into buckets of `most`."""
    most = ROWS_PER_BUCKET if most is None else most
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    digits = 0
    while (largest or 0) / 16 ** digits > most:
        digits += 1
    return digits


def spread(df: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """(rows for work that copies each of them, size of the largest group).

    A table that comes in fewer pieces than there are cores is dealt out and saved first, or a few
    tasks would do all the work, several times; others stay where they are.
    """
    largest, last = df.select(*by, F.spark_partition_id().alias("_task")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max("_task").alias("p")).agg(F.max("n"), F.max("p")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    dealt = df if (last or 0) + 1 >= cores else save_table(df.repartition(cores))
    return dealt, largest or 0


def _fullest(df: DataFrame, by: list[str], bucket: Column) -> int:
    counts = df.groupBy(*by, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0
