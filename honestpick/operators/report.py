"""Summaries over per-test estimates and error tables."""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from honestpick.functions import gauss
from honestpick.functions.columns import attach_row, bin_arm_count, col, safe_ratio
from honestpick.functions.lineage import save_table
from honestpick.functions.quantiles import exact_quantiles
from honestpick.operators import bootstrap as B, effects as E, selective as S, shrink as H
from honestpick.operators import splits as V
from honestpick.operators.joins import join_null_safe
from honestpick.operators.prep import quantile_bin, truncate_errors
from honestpick.schema import ESTIMATOR_FAMILIES

COUNT_ESTIMATORS = ["standard", "moon", "split", "eb_normal", "hybrid_si"]


def with_quantiles(main: DataFrame, source: DataFrame, value, probs: dict[str, float],
                   by: list[str]) -> DataFrame:
    """Add exact quantiles of a column to a grouped table."""
    q = exact_quantiles(source, value, list(probs.values()), by)
    q = q.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(probs)])
    return join_null_safe(main, q, by) if by else attach_row(main, q)


# --- per-test estimates (R1) ---------------------------------------------------------------

def per_test_estimates(arms: DataFrame, estimators: list[str], draws: int = 1000,
                       splits: int = 100, power: float = 0.6, fraction: float = 0.5,
                       seed: int = 42) -> DataFrame:
    """Long table: one row per test and estimator with the record's columns alongside.

    Works from counts, so its cost is tests x arms x draws whatever the traffic; draws stay in
    arrays, so what moves is tests x arms x blocks of draws.
    """
    unknown = set(estimators) - set(COUNT_ESTIMATORS)
    if unknown:
        raise ValueError(f"unknown estimators: {sorted(unknown)}")
    effects = save_table(E.arm_effects_from_counts(arms))
    made = {
        "standard": lambda: B.correct_counts(effects, draws, seed=seed),
        "moon": lambda: B.correct_counts(effects, draws, power, seed=seed),
        "split": lambda: V.correct_split_counts(effects, fraction, splits, seed=seed),
        "eb_normal": lambda: H.correct_eb_normal(effects, tie="source_row_id"),
        "hybrid_si": lambda: S.si_correct(effects, "hybrid", tie="source_row_id"),
    }
    null = F.lit(None).cast("double")

    def shape(df):
        have = df.columns
        return df.select(
            "test_id", "estimator", "corrected", "bias",
            *[(F.col(c) if c in have else null).alias(c) for c in
              ("bias_sd", "bias_se", "bias_q025", "bias_q50", "bias_q975")],
            (F.col("status") if "status" in have else F.lit("ok")).alias("status"))
    tables = reduce(DataFrame.unionByName, [shape(made[e]()) for e in estimators])
    return E.test_records(arms).join(tables, "test_id").withColumn(
        "bias_pct", safe_ratio("bias", "naive"))


def wide_estimates(long: DataFrame, estimators: list[str],
                   values=("corrected", "bias", "bias_pct")) -> DataFrame:
    """One row per test, `<estimator>_<value>` columns."""
    return long.groupBy("test_id").pivot("estimator", estimators).agg(
        *[F.first(v).alias(v) for v in values])


def long_estimates(wide: DataFrame, keys: list[str], suffix: str, estimators: list[str],
                   name: str = "value") -> DataFrame:
    """Wide `<estimator>_<suffix>` columns to (keys..., estimator, value)."""
    renamed = wide.select(*keys, *[F.col(f"{e}_{suffix}").cast("double").alias(e)
                                   for e in estimators])
    return renamed.unpivot(keys, estimators, "estimator", name)


# --- summary by groups (R2, R14) -----------------------------------------------------------

def summarize(long: DataFrame) -> DataFrame:
    """Overall and subgroup means per estimator over tests with a bias.

    Every test is copied once per grouping, so all groupings share one aggregation.
    """
    # both are one row per test and read by every pass of a quantile
    tests = save_table(long.select("test_id", "total_impressions").dropDuplicates(["test_id"]))
    quartile = save_table(quantile_bin(tests, "total_impressions", 4, name="_quartile").select(
        "test_id", "_quartile"))
    groups = F.array(*[F.struct(F.lit(name).alias("group"), value.alias("group_value"))
                       for name, value in [
        ("overall", F.lit("all")), ("split", F.col("split")),
        ("arm_count_bin", bin_arm_count("n_arms")),
        ("impression_bin", F.col("_quartile").cast("string")),
        ("selected_winner", F.col("selected_winner").cast("string")),
        ("selected_first_place", F.col("selected_first_place").cast("string"))]])
    valid = long.where(F.col("bias").isNotNull()).join(quartile, "test_id")
    cells = valid.withColumn("_g", F.explode(groups)).select(
        "_g.*", "estimator", "bias", "corrected", "naive", "bias_pct", "selected_impressions")
    keys = ["group", "group_value", "estimator"]
    w = F.col("selected_impressions")

    def weighted(c):
        return F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))
    main = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tests"), F.avg("bias").alias("mean_bias"),
        F.avg("corrected").alias("mean_corrected"), F.avg("naive").alias("mean_naive"),
        F.avg("bias_pct").alias("mean_bias_pct"), weighted("bias").alias("weighted_mean_bias"),
        weighted("naive").alias("weighted_mean_naive"),
        weighted("bias_pct").alias("weighted_mean_bias_pct"),
        F.sum(w).alias("selected_impressions"))
    main = main.withColumn("aggregate_bias_pct",
                           safe_ratio("weighted_mean_bias", "weighted_mean_naive"))
    return with_quantiles(main, cells, "bias", {"median_bias": 0.5}, keys)


def subgroup_table(summary: DataFrame, group: str, estimators: list[str],
                   columns=("n_tests", "mean_bias", "median_bias")) -> DataFrame:
    return summary.where((F.col("group") == group) & F.col("estimator").isin(estimators)).select(
        "group_value", "estimator", *columns)


# --- means with errors (R3-R7) ----------------------------------------------------------------

def mean_se(c) -> Column:
    """Aggregate: standard error of a mean (ddof 1)."""
    return F.stddev_samp(col(c)) / F.sqrt(F.count(col(c)))


def ratio_of_means(num, den) -> Column:
    return F.avg(col(num)) / F.avg(col(den))


def ratio_of_means_se(num, den) -> Column:
    """Aggregate: paired delta-method standard error of a ratio of means, from moments."""
    n, d = col(num), col(den)
    ratio = F.avg(n) / F.avg(d)
    spread = F.var_samp(n) - 2 * ratio * F.covar_samp(n, d) + ratio * ratio * F.var_samp(d)
    return F.sqrt(F.greatest(spread, F.lit(0.0)) / F.count(n)) / F.abs(F.avg(d))


def headline(long: DataFrame) -> DataFrame:
    return long.where(F.col("bias").isNotNull()).groupBy("estimator").agg(
        F.count(F.lit(1)).alias("n_tests"), F.avg("naive").alias("mean_naive"),
        F.avg("corrected").alias("mean_corrected"), mean_se("corrected").alias("se_corrected"),
        F.avg("bias").alias("mean_bias"), mean_se("bias").alias("se_bias"),
        (100 * ratio_of_means("bias", "naive")).alias("bias_pct"),
        (100 * ratio_of_means_se("bias", "naive")).alias("se_bias_pct"))


def bias_distribution(long: DataFrame) -> DataFrame:
    rows = long.where(F.col("bias").isNotNull())
    main = rows.groupBy("estimator").agg(
        F.countDistinct("test_id").alias("n_tests"), F.avg("bias").alias("mean_bias"),
        F.avg("bias_pct").alias("mean_bias_pct"),
        F.avg((F.col("bias") < 0).cast("int")).alias("negative_share"))
    main = with_quantiles(main, rows, "bias", {"p25": 0.25, "median_bias": 0.5, "p75": 0.75},
                          ["estimator"])
    return with_quantiles(main, rows, "bias_pct", {"median_bias_pct": 0.5}, ["estimator"])


def mean_ci_by(df: DataFrame, by: list[str], value: str, x: str | None = None,
               gap: str | None = None) -> DataFrame:
    """n, mean, sd, se and 95% interval per bin; optional bin mean of x and share of the gap."""
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("sd"), mean_se(value).alias("se")]
    if x:
        aggs.append(F.avg(x).alias(f"mean_{x}"))
    if gap:
        aggs.append(F.avg(gap).alias("mean_gap"))
    out = df.groupBy(*by).agg(*aggs).withColumns({
        "ci_low": F.col("mean") - 1.96 * F.col("se"),
        "ci_high": F.col("mean") + 1.96 * F.col("se")})
    return out.withColumn("pct_of_gap", 100 * safe_ratio("mean", "mean_gap")) if gap else out


def heatmap(df: DataFrame, row: str, column: str, labels: list, value: str) -> DataFrame:
    """Mean value by row and column bin; `labels` fixes the columns, so no extra pass."""
    return df.groupBy(row).pivot(column, labels).agg(F.avg(value))


# --- distributions and audits (R9-R13) --------------------------------------------------------

def distribution_stats(df: DataFrame, value: str, probs: dict[str, float],
                       thresholds: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Mean, sd, extremes, quantiles, and counts and shares above thresholds."""
    by = list(by)
    keyed = df if by else df.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    x = F.col(value)
    main = keyed.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        *[F.count_if(x > t).alias(f"n_{n}") for n, t in thresholds.items()],
        *[F.avg((x > t).cast("int")).alias(f"share_{n}") for n, t in thresholds.items()])
    out = with_quantiles(main, keyed, value, probs, keys)
    return out if by else out.drop("_all")


def histogram(df: DataFrame, value: str, width: float, by: list[str] = ()) -> DataFrame:
    bin_ = F.floor(F.col(value) / width)
    return (df.where(F.col(value).isNotNull()).groupBy(*by, bin_.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("left", F.col("bin") * F.lit(float(width))))


def validation_checks(long: DataFrame, columns: list[str]) -> DataFrame:
    """(check, n): rows, repeated ids, missing cells per column, ties, negative biases."""
    rows = long.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.countDistinct("test_id")).alias("repeated_ids"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
        F.count_if(F.col("ties") > 1).alias("ties"),
        F.count_if(F.col("bias") < 0).alias("negative_bias"))
    return rows.unpivot([], rows.columns, "check", "n")


def data_audit(rows: DataFrame, outcomes: list[str]) -> DataFrame:
    """One row: rows, columns, missing cells, positives and maximum per outcome."""
    missing = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in rows.columns])
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(rows.columns)).alias("columns"),
        missing.alias("missing_cells"),
        *[F.count_if(F.col(o) > 0).alias(f"{o}_positive") for o in outcomes],
        *[F.max(o).alias(f"{o}_max") for o in outcomes])


def arm_summary(rows: DataFrame, outcomes: list[str], by: list[str] = E.TEST,
                arm: str = "arm") -> DataFrame:
    """Per arm: size, share of its test, mean, sd and positive rate of every outcome."""
    arms = rows.groupBy(*by, arm).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(o).alias(f"{o}_mean") for o in outcomes],
        *[F.stddev_samp(o).alias(f"{o}_sd") for o in outcomes],
        *[F.avg((F.col(o) > 0).cast("int")).alias(f"{o}_positive_rate") for o in outcomes])
    return arms.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


# --- errors against a truth (R15-R20) --------------------------------------------------------

def error_measures(estimates: DataFrame, truths: DataFrame, keys: list[str],
                   lower: float = -5.0, upper: float = 5.0) -> DataFrame:
    """wc = estimate - truth, an estimator's own truth first, then the naive pick's.

    `estimates`: (keys..., estimator, val_est, own_true); `truths`: (keys..., naive_true).
    """
    joined = estimates.join(truths, keys).withColumn(
        "val_true", F.coalesce("own_true", "naive_true")).withColumn(
        "wc", F.col("val_est") - F.col("val_true"))
    return truncate_errors(joined, lower, upper, flag_only=True).drop("own_true", "naive_true")


def error_stats(errors: DataFrame, by: list[str], metric: str = "wc",
                gap: str | None = None) -> DataFrame:
    """Mean, median and std (ddof 0) of wc or |wc| per setting and estimator.

    With a `gap` column the figures are percentages of it; a zero gap leaves them unscaled.
    """
    if metric not in ("wc", "mae"):
        raise ValueError("metric must be 'wc' or 'mae'")
    value = F.col("wc") if metric == "wc" else F.abs("wc")
    if gap:
        value = value * F.when(F.col(gap) != 0, 100 / F.col(gap)).otherwise(F.lit(1.0))
    rows = errors.withColumn("_e", value)
    keys = [*by, "estimator"]
    main = rows.groupBy(*keys).agg(
        F.count("_e").alias("repeats"), F.avg("_e").alias("mean"),
        F.stddev_pop("_e").alias("std"))
    return with_quantiles(main, rows, "_e", {"median": 0.5}, keys)


def snr_label(gap, sigma) -> Column:
    """Setting label: gap over noise in percent with one decimal."""
    return F.format_string("%.1f%%", 100 * col(gap) / col(sigma))


def arm_gap(means: DataFrame, by: list[str], arm: str = "arm") -> DataFrame:
    """(by..., n_arms, gap): average gap between neighbouring arms, (max-min)/(k-1)."""
    return means.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_arms"),
        F.coalesce(F.try_divide(F.max("effect") - F.min("effect"), F.count(F.lit(1)) - 1),
                   F.lit(0.0)).alias("gap"))


def pivot_stats(stats: DataFrame, setting: str, labels: list, value: str = "mean") -> DataFrame:
    """Estimators by settings."""
    return stats.groupBy("estimator").pivot(setting, labels).agg(F.first(value))


def depth_stats(errors: DataFrame, by: list[str], gap: float | None = None) -> DataFrame:
    """Mean error, Monte Carlo se (NULL for one repeat), MAE and repeats per setting."""
    if gap is not None and gap <= 0:
        raise ValueError("normalisation needs a positive gap")
    k = 1.0 if gap is None else 100.0 / gap
    se = F.when(F.count("wc") > 1, F.stddev_samp("wc") / F.sqrt(F.count("wc")))
    return errors.groupBy(*by).agg(
        F.count("wc").alias("repeats"), (k * F.avg("wc")).alias("mean_wc"),
        (k * se).alias("mc_se"), (k * F.avg(F.abs("wc"))).alias("mae"))


def agreement_rates(selections: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by..., repeat, rate): share of customers to whom two estimators give the same arm."""
    keys = [*by, "repeat", "customer_id"]
    picks = selections.where(F.col("estimator").isin(a, b)).groupBy(*keys).agg(
        F.max(F.when(F.col("estimator") == a, F.col("arm"))).alias("_a"),
        F.max(F.when(F.col("estimator") == b, F.col("arm"))).alias("_b"))
    return picks.groupBy(*by, "repeat").agg(
        F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("rate"))


def policy_comparison(errors: DataFrame, rates: DataFrame | None, by: list[str],
                      focal: str = "none", other: str = "split") -> DataFrame:
    """Mean true values of two policies, paired difference and agreement, with se over repeats.

    `rates` is (by..., repeat, rate); a repeat without a rate in [0, 1] fails the job.
    """
    wide = errors.where(F.col("estimator").isin(focal, other)).groupBy(*by, "repeat").agg(
        F.max(F.when(F.col("estimator") == focal, F.col("val_true"))).alias("_f"),
        F.max(F.when(F.col("estimator") == other, F.col("val_true"))).alias("_o"))
    if rates is None:
        wide = wide.withColumn("rate", F.lit(None).cast("double"))
    else:
        good = F.coalesce(F.col("rate").between(0, 1), F.lit(False))
        wide = wide.join(rates, [*by, "repeat"], "full").withColumn("rate", F.when(
            ~good | F.col("_f").isNull(), F.raise_error(F.lit(
                "agreement must be one rate in [0, 1] per repeat")).cast("double"))
            .otherwise(F.col("rate")))
    diff = F.col("_f") - F.col("_o")
    many = F.count(F.lit(1)) > 1
    return wide.groupBy(*by).agg(
        F.count(F.lit(1)).alias("repeats"), F.avg("_f").alias("focal_value"),
        F.avg("_o").alias("other_value"), F.avg(diff).alias("difference"),
        F.when(many, mean_se(diff)).alias("difference_se"), F.avg("rate").alias("agreement"),
        F.when(many, mean_se("rate")).alias("agreement_se"))


def moon_table(errors: DataFrame, size: str, powers: list[float],
               gap: float | None = None) -> DataFrame:
    """Mean error by sample size: none, standard and one column per power."""
    k = 1.0 if gap is None else 100.0 / gap
    label = F.when(F.col("estimator") == "moon", F.concat(
        F.lit("gamma_"), F.col("power").cast("string"))).otherwise(F.col("estimator"))
    return (errors.withColumn("_label", label).groupBy(size)
            .pivot("_label", ["none", "standard", *[f"gamma_{p}" for p in powers]])
            .agg(k * F.avg("wc")))


# --- presentation helpers (R21-R25) -------------------------------------------------------------

def family_rank(c="estimator") -> Column:
    rank = F.when(F.lit(False), F.lit(0))
    for i, patterns in enumerate(ESTIMATOR_FAMILIES):
        fits = [col(c).startswith(p[:-1]) if p.endswith("*") else col(c) == p for p in patterns]
        rank = rank.when(reduce(Column.__or__, fits), i)
    return rank.otherwise(len(ESTIMATOR_FAMILIES))


def order_estimators(df: DataFrame, position: str) -> DataFrame:
    """Presentation order by family, original position within a family."""
    return df.withColumn("family", family_rank()).orderBy("family", position)


@F.pandas_udf(T.DoubleType())
def _normal_p(t: pd.Series) -> pd.Series:
    x = t.to_numpy(float, na_value=np.nan)
    p = gauss.two_sided_p(np.nan_to_num(x))
    return pd.Series(np.where(np.isfinite(x), p, None), dtype=object)


def ttest_1samp(errors: DataFrame, by: list[str], value: str = "wc") -> DataFrame:
    """Mean against zero; the p-value uses the normal limit (meant for 500 rows and more)."""
    out = errors.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                  safe_ratio(F.avg(value), mean_se(value)).alias("t"))
    return out.withColumn("p", _normal_p("t"))


def compare_to_expected(actual: DataFrame, expected: DataFrame, keys: list[str],
                        value: str, digits: str = "digits") -> DataFrame:
    """Match after rounding to the printed digits; `expected` has (keys..., expected, digits)."""
    scale = F.pow(F.lit(10.0), F.col(digits))
    shown = F.round(F.col(value) * scale) / scale
    return actual.join(expected, keys).select(
        *keys, F.col(value), "expected", (F.col(value) - F.col("expected")).alias("delta"),
        (F.abs(shown - F.col("expected")) < 1e-9).alias("matches"))


def match_counts(compared: DataFrame, by: list[str]) -> DataFrame:
    return compared.groupBy(*by).agg(F.count(F.lit(1)).alias("total"),
                                     F.count_if("matches").alias("matches"))


def winner_change_rate(values: DataFrame, by: list[str]) -> DataFrame:
    """Percent of repeats in which the split's pick differs from the full winner."""
    changed = (F.col("selected_arm") != F.col("full_winner")).cast("int")
    return values.groupBy(*by).agg((100 * F.avg(changed)).alias("change_pct"))
