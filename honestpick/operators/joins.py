"""Joins with enforced cardinality and aligned comparisons."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """The same rows; the job fails if a key repeats.  One shuffle on the keys, no action."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"),
                                    *[F.first(c).alias(c) for c in df.columns
                                      if c not in keys])
    checked = F.when(F.col("_copies") > 1, F.raise_error(F.concat(
        F.lit(f"{what}: key is not unique: "),
        F.to_json(F.struct(*keys)))).cast("boolean")).otherwise(F.lit(True))
    return counted.where(checked).select(*df.columns)


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str],
                    how: str = "inner") -> DataFrame:
    return assert_unique(left, keys, "left").join(assert_unique(right, keys, "right"),
                                                  keys, how)


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that can never multiply rows."""
    return left.join(assert_unique(right, keys, "right"), keys, "left")


def join_summaries(left: DataFrame, *rights: DataFrame, keys: list[str]) -> DataFrame:
    """Left-join several group summaries on the same keys."""
    for r in rights:
        left = left.join(r, keys, "left")
    return left


def align_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str,
               tolerance: float = 1e-12) -> DataFrame:
    """One row: keys only in a, only in b, in both; largest difference; aligned flag."""
    both = (a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_in_a"))
            .join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_in_b")),
                  keys, "full"))
    out = both.agg(
        F.count_if(F.col("_in_b").isNull()).alias("only_a"),
        F.count_if(F.col("_in_a").isNull()).alias("only_b"),
        F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()).alias("matched"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"))
    return out.withColumn("aligned", (F.col("only_a") == 0) & (F.col("only_b") == 0)
                          & (F.coalesce(F.col("max_abs_diff"), F.lit(0.0)) < tolerance))


def compare_summaries(a: DataFrame, b: DataFrame, keys: list[str],
                      values: list[str]) -> DataFrame:
    """Largest absolute difference per value column over the shared keys."""
    joined = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values]).join(
        b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values]), keys)
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.max(F.abs(F.col(f"{v}_a") - F.col(f"{v}_b"))).alias(f"{v}_max_abs_diff")
        for v in values])


def with_grid(df: DataFrame, **settings) -> DataFrame:
    """Every row once per combination of the given parameter lists (parameters, not data)."""
    for name, values in settings.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str],
                   how: str = "left") -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key, as groups do; keys are taken from left."""
    renamed = right.withColumnsRenamed({k: f"_{k}_r" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}_r")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_{k}_r" for k in keys])
