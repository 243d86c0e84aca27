"""Exact quantiles of groups of any size, by counters alone.

percentile() keeps every distinct value of a group in one task.  Here a wanted rank is an interval
of values, at first from a group's least to its greatest.  A pass counts the rows of open
intervals in bins, where the rows are; the bin that holds the rank is the next interval, from the
least to the greatest value really in it.  An interval of one value is solved; one with few rows
is solved by counting its values.  The values are saved once, as all passes read them; rows stay
where they are: what is exchanged are counters.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from honestpick.functions.columns import attach_row, col
from honestpick.functions.lineage import save_table


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """By keys that may be NULL; without keys, the one row of `right` beside every row."""
    if not keys:
        return attach_row(left, right)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def _bin(v: Column, lo: Column, hi: Column, bins: int, logarithmic: bool) -> Column:
    """A bin that never falls with v; the ends have bins of their own, so intervals shrink.

    Equal widths suit most values; every other pass takes logarithms around zero, for values that
    differ by many orders of magnitude.
    """
    def place(x):
        if not logarithmic:
            return x / 2                # a difference of doubles may overflow
        scale = F.greatest(F.abs(lo), F.abs(hi)) * 2.0 ** -40
        return F.signum(x) * F.log1p(F.try_divide(F.abs(x), scale))
    share = F.try_divide(place(v) - place(lo), place(hi) - place(lo))
    share = F.when(share.isNull() | F.isnan(share), 0.5).otherwise(share)
    inner = F.greatest(F.lit(1), F.least(F.lit(bins - 2), F.floor(share * bins)))
    return F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(inner).cast("int")


def _hits(counts: DataFrame, targets: DataFrame, by: list[str], order: str) -> DataFrame:
    """The targets with the row of `counts` (by..., _q_lo, order, _q_c, _q_min, _q_max) they fall in."""
    run = Window.partitionBy(*by, "_q_lo").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1)
    upto = counts.withColumn("_q_before", F.coalesce(F.sum("_q_c").over(run), F.lit(0)))
    at = F.col("_q_rank") - F.col("_q_below") - F.col("_q_before")
    # _q_lo is a key on both sides, and never NULL
    return _join(targets, upto, [*by, "_q_lo"]).where((at >= 0) & (at < F.col("_q_c")))


def _inside(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Rows in one of their group's intervals, with `_q_lo` and `_q_hi`."""
    wanted = targets.groupBy(*by).agg(F.collect_set(F.struct("_q_lo", "_q_hi")).alias("_q_in"))
    v = F.col("_q_v")
    own = F.get(F.filter("_q_in", lambda x: (x["_q_lo"] <= v) & (v <= x["_q_hi"])), F.lit(0))
    return _join(rows, wanted, by).select(*by, "_q_v", own.alias("_q_i")).where(
        "_q_i IS NOT NULL").select(*by, "_q_v", "_q_i._q_lo", "_q_i._q_hi")


def exact_quantiles(df: DataFrame, value, probs: Sequence[float], by: list[str] = (),
                    name: str = "q", limit: int = 10_000, bins: int = 4_096) -> DataFrame:
    """(by..., n, <name> ARRAY<DOUBLE>) with linearly interpolated quantiles; NULL and NaN are
    ignored, a NULL key is a group, a group without values has no row.  Columns named _q_... are
    the function's own.

    Intervals with up to `limit` rows are solved by counting their values: a setting of the work,
    not of the result.
    """
    by = list(by)
    # every pass must meet the same values: a sum of doubles may differ when it is made again
    rows = save_table(df.select(
        *[F.col(f"`{k}`") for k in by], col(value).cast("double").alias("_q_v")).where(
        F.col("_q_v").isNotNull() & ~F.isnan("_q_v")))
    position = [(F.col("_q_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("bigint") for x in position
                                       for f in (F.floor, F.ceil)]))
    targets = save_table(rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_q_n"), F.min("_q_v").alias("_q_lo"), F.max("_q_v").alias("_q_hi"))
        .where("_q_n > 0").select(*by, "_q_n", "_q_lo", "_q_hi", F.lit(0).cast("bigint").alias("_q_below"),
                                F.col("_q_n").alias("_q_rows"), F.explode(ranks).alias("_q_rank")))
    large = (F.col("_q_lo") < F.col("_q_hi")) & (F.col("_q_rows") > limit)
    passes = 0
    while not (wide := targets.where(large)).isEmpty():
        near = _inside(rows, wide, by)
        counts = near.groupBy(*by, "_q_lo", _bin(F.col("_q_v"), F.col("_q_lo"), F.col("_q_hi"), bins,
                                               passes % 2 == 1).alias("_q_b")).agg(
            F.count(F.lit(1)).alias("_q_c"), F.min("_q_v").alias("_q_min"), F.max("_q_v").alias("_q_max"))
        next_ = _hits(counts, wide, by, "_q_b").select(
            *by, "_q_n", F.col("_q_min").alias("_q_lo"), F.col("_q_max").alias("_q_hi"),
            (F.col("_q_below") + F.col("_q_before")).alias("_q_below"), F.col("_q_c").alias("_q_rows"),
            "_q_rank")
        targets = save_table(targets.where(~large).unionByName(next_))
        passes += 1
    small = targets.where("_q_lo < _q_hi")
    counts = _inside(rows, small, by).groupBy(*by, "_q_lo", "_q_v").agg(F.count(F.lit(1)).alias("_q_c"))
    found = _hits(counts, small, by, "_q_v").select(*by, "_q_n", "_q_rank", F.col("_q_v").alias("_q_x"))
    found = found.unionByName(targets.where("_q_lo = _q_hi").select(*by, "_q_n", "_q_rank",
                                                                F.col("_q_lo").alias("_q_x")))
    by_rank = found.groupBy(*by, "_q_n").agg(F.map_from_entries(F.collect_list(
        F.struct("_q_rank", "_q_x"))).alias("_q_m"))

    def interpolated(x):
        low = F.floor(x).cast("bigint")
        lo, hi = F.col("_q_m")[low], F.col("_q_m")[F.ceil(x).cast("bigint")]
        return lo * (1 - (x - low)) + hi * (x - low)
    return by_rank.select(*by, F.col("_q_n").alias("n"),
                          F.array(*[interpolated(x) for x in position]).alias(name))


def exact_median(df: DataFrame, value, by: list[str] = (), name: str = "median") -> DataFrame:
    out = exact_quantiles(df, value, [0.5], by)
    return out.select(*by, F.col("q")[0].alias(name))
