"""Preparing arm tables: typing, validation, eligibility, bins."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from honestpick.functions.columns import (attach_row, bin_arm_count, coerce_bool, col, finite,
                                          safe_ratio)
from honestpick.functions.quantiles import exact_quantiles
from honestpick.operators.joins import join_null_safe
from honestpick.schema import RAW_ARM_COLUMNS


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def cast_arms(df: DataFrame) -> DataFrame:
    """Typed columns; under ANSI a text that is not a number fails the job."""
    return df.withColumns({
        "test_id": F.col("test_id").cast("string"),
        "source_row_id": F.col("source_row_id").cast("bigint"),
        "impressions": F.col("impressions").cast("bigint"),
        "clicks": F.col("clicks").cast("bigint"),
        "first_place": coerce_bool("first_place"),
        "winner": coerce_bool("winner")})


def bad_counts() -> Column:
    i, c = F.col("impressions"), F.col("clicks")
    return ~F.coalesce((i > 0) & (c >= 0) & (c <= i), F.lit(False))


def validate_arms(df: DataFrame) -> DataFrame:
    """Fails the job on impossible counts, in the same pass that uses them."""
    message = F.format_string("impossible counts in test %s: clicks %s of %s",
                              F.col("test_id"), F.col("clicks"), F.col("impressions"))
    return df.withColumn("impressions", F.when(
        bad_counts(), F.raise_error(message).cast("bigint")).otherwise(F.col("impressions")))


def add_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("rate", F.col("clicks") / F.col("impressions"))


def add_arm_ordinal(df: DataFrame, by: str = "test_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy("source_row_id")
    return df.withColumn("arm_ordinal", (F.row_number().over(w) - 1).cast("int"))


def prepare_arms(raw: DataFrame) -> DataFrame:
    """P2-P6 in order."""
    return add_arm_ordinal(add_rate(validate_arms(cast_arms(
        require_columns(raw, RAW_ARM_COLUMNS)))))


def test_sizes(arms: DataFrame) -> DataFrame:
    return arms.groupBy("test_id").agg(F.count(F.lit(1)).alias("n_arms"),
                                       F.min("impressions").alias("min_impressions"))


def eligible_tests(arms: DataFrame, min_arms: int = 2, min_impressions: int = 1000,
                   limit_tests: int | None = None) -> DataFrame:
    """Arms of tests with enough arms, each large enough; optionally the first N test ids."""
    keep = (test_sizes(arms)
            .where((F.col("n_arms") >= min_arms)
                   & (F.col("min_impressions") >= min_impressions)).select("test_id"))
    if limit_tests is not None:
        keep = keep.orderBy("test_id").limit(limit_tests)
    kept = arms.join(keep, "test_id", "left_semi")
    return add_arm_ordinal(kept) if "arm_ordinal" in arms.columns else kept


def eligibility_summary(arms: DataFrame, min_arms: int = 2,
                        min_impressions: int = 1000) -> DataFrame:
    enough = F.col("n_arms") >= min_arms
    large = F.col("min_impressions") >= min_impressions
    return test_sizes(arms).agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.coalesce(F.sum("n_arms"), F.lit(0)).alias("total_arms"),
        F.count_if(enough & large).alias("eligible_tests"),
        F.coalesce(F.sum(F.when(enough & large, F.col("n_arms"))), F.lit(0))
         .alias("eligible_arms"),
        F.count_if(~(enough & large)).alias("excluded_tests"),
        F.count_if(~enough).alias("single_arm_tests"),
        F.count_if(enough & ~large).alias("low_impression_tests"))


def add_click_spread(df: DataFrame) -> DataFrame:
    """Within-arm standard deviation from counts (ddof 1) and standard error of the rate."""
    n, c = F.col("impressions").cast("double"), F.col("clicks").cast("double")
    sd = F.when(n > 1, F.sqrt(c * (n - c) / (n * (n - 1))))
    return df.withColumn("click_sd", sd).withColumn("click_se", sd / F.sqrt(n))


def add_arm_bin(df: DataFrame, c: str = "n_arms", name: str = "arm_bin") -> DataFrame:
    return df.withColumn(name, bin_arm_count(c))


def _attach(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Join per-group values; without groups the small side is exactly one row."""
    return join_null_safe(df, small, by) if by else attach_row(df, small)


def quantile_bins(df: DataFrame, bins: dict[str, str], q: int, by: list[str] = (),
                  clip=None, drop_dup: bool = True) -> DataFrame:
    """{new column: source}: 1-based equal-probability bins, right-closed, lowest included.

    All columns share one quantile computation, which reads `df` twice; the bins themselves
    are added to a third reading, so save an expensive `df` first.
    """
    by, names = list(by), list(bins)
    xs = {}
    for n, c in bins.items():
        x = F.col(c).cast("double")
        xs[f"_x_{n}"] = x if clip is None else F.greatest(
            F.lit(float(clip[0])), F.least(F.lit(float(clip[1])), x))
    df = df.withColumns(xs)
    stacked = df.select(*by, *xs).unpivot(by, list(xs), "_measure", "_value")
    edges = exact_quantiles(stacked, "_value", [i / q for i in range(q + 1)],
                            [*by, "_measure"], name="_edges")
    if drop_dup:
        edges = edges.withColumn("_edges", F.array_distinct("_edges"))
    wide = edges.groupBy(*by).agg(*[F.first(F.when(
        F.col("_measure") == f"_x_{n}", F.col("_edges")), ignorenulls=True).alias(f"_e_{n}")
        for n in names])
    out = _attach(df, wide, by)

    def bin_of(n):
        x, e = F.col(f"_x_{n}"), F.col(f"_e_{n}")
        inner = F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0)))
        return F.when(x.isNotNull() & (F.size(e) > 1),
                      F.size(F.filter(inner, lambda v: x > v)) + 1)
    return out.withColumns({n: bin_of(n) for n in names}).drop(
        *xs, *[f"_e_{n}" for n in names])


def quantile_bin(df: DataFrame, c: str, q: int, by: list[str] = (), clip=None,
                 name: str | None = None, drop_dup: bool = True) -> DataFrame:
    return quantile_bins(df, {name or f"{c}_bin": c}, q, by, clip, drop_dup)


def unit_columns(df: DataFrame, columns: list[str], suffix: str = "_pp") -> DataFrame:
    """Hundredfold copies: percent or percentage points."""
    return df.withColumns({f"{c}{suffix}": F.col(c) * 100 for c in columns})


def drop_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns}).na.drop(subset=columns)


def log_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """{new name: source}: natural logarithms, NULL for values that are not positive."""
    return df.withColumns({new: F.when(F.col(c) > 0, F.log(F.col(c).cast("double")))
                           for new, c in columns.items()})


def truncate_errors(df: DataFrame, lower: float = -5.0, upper: float = 5.0,
                    c: str = "wc", flag_only: bool = False) -> DataFrame:
    """Errors strictly inside (lower, upper); or all rows with a `valid` flag."""
    inside = F.coalesce((F.col(c) > lower) & (F.col(c) < upper), F.lit(False))
    return df.withColumn("valid", inside) if flag_only else df.where(inside)


def cap_outliers(df: DataFrame, c: str, p: float = 0.99, by: list[str] = (),
                 name: str | None = None) -> DataFrame:
    """Values above the p-quantile replaced by it."""
    by = list(by)
    caps = exact_quantiles(df, c, [p], by).select(*by, F.col("q")[0].alias("_cap"))
    return _attach(df, caps, by).withColumn(
        name or f"{c}_capped", F.least(F.col(c).cast("double"), F.col("_cap"))).drop("_cap")


def ratio_column(df: DataFrame, num: str, den: str, name: str) -> DataFrame:
    return df.withColumn(name, safe_ratio(col(num), col(den)))
