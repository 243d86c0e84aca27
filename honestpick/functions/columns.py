"""Small Column-to-Column expressions used across the operators."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Texts that count as true, after trimming and lower-casing.
TRUE_TEXTS = ("true", "1", "yes", "y", "t")

# Upper bound (inclusive) and label of each arm-count bin.
ARM_COUNT_BINS = [(2, "2"), (3, "3"), (4, "4"), (5, "5"), (7, "6-7"), (None, "8+")]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_bool(c) -> Column:
    """Text to strict boolean; anything not listed as true, null included, is false."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def finite(c) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def safe_ratio(num, den) -> Column:
    """num/den, NULL when the denominator is zero, missing or not finite."""
    return F.try_divide(col(num).cast("double"), finite(col(den).cast("double")))


def bin_arm_count(c) -> Column:
    c = col(c)
    out = F.when(c <= 1, F.lit(None).cast("string"))
    for upper, label in ARM_COUNT_BINS:
        out = out.when(c.isNotNull() if upper is None else c <= upper, F.lit(label))
    return out


def logit(p) -> Column:
    p = col(p)
    return F.when((p > 0) & (p < 1), F.log(p / (1 - p)))


def logistic(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def normal_density(x, mean=0.0, var=1.0) -> Column:
    """Density of N(mean, var) at x; arguments are Columns, names or numbers."""
    x, mean, var = (a if isinstance(a, Column) else F.col(a) if isinstance(a, str)
                    else F.lit(float(a)) for a in (x, mean, var))
    return F.exp(-(x - mean) * (x - mean) / (2 * var)) / F.sqrt(2 * F.pi() * var)


def week_of(ts) -> Column:
    """Calendar week as 'Monday/Sunday' dates."""
    start = F.date_trunc("week", col(ts))
    return F.concat_ws("/", F.date_format(start, "yyyy-MM-dd"),
                       F.date_format(F.date_add(start.cast("date"), 6), "yyyy-MM-dd"))


def month_of(ts) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def between_left(ts, start: str, end: str) -> Column:
    """start <= ts < end."""
    ts = col(ts)
    return (ts >= F.to_timestamp_ntz(F.lit(start))) & (ts < F.to_timestamp_ntz(F.lit(end)))


def stars_from_z(mean, se) -> Column:
    z = F.abs(safe_ratio(mean, se))
    return (F.when(z > 2.58, "***").when(z > 1.96, "**").when(z > 1.645, "*").otherwise(""))


def stars_from_p(p) -> Column:
    p = col(p)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def winner_of(effect="effect", arm="arm", keep=()) -> Column:
    """Aggregate: struct(arm, effect, *keep) of the largest effect, ties to the lowest arm."""
    return F.max_by(F.struct(F.col(arm), F.col(effect), *[F.col(k) for k in keep]),
                    F.struct(F.col(effect), -F.col(arm)))


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row, as a scalar subquery."""
    row = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")
