"""Selective inference for the picked arm."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from honestpick.functions import gauss
from honestpick.functions.lineage import save_table
from honestpick.functions.quantiles import exact_quantiles
from honestpick.operators.effects import TEST
from honestpick.operators.joins import join_null_safe

STEPS = 200          # halvings of a bracket; doubles run out well before
BETA_SHARE = 0.1     # part of alpha the hybrid method spends on the projection


def pick_summary(effects: DataFrame, by: list[str] = TEST, arm: str = "arm",
                 tie: str | None = None) -> DataFrame:
    """(by..., selected_arm, naive, sd, runner_up, n_arms): all these methods look at."""
    w = Window.partitionBy(*by).orderBy(F.col("effect").desc(), tie or arm)
    two = (effects.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
           .groupBy(*by).agg(
               F.max(F.when(F.col("_r") == 1, F.struct(
                   F.col(arm).alias("selected_arm"), F.col("effect").alias("naive"),
                   F.sqrt("var").alias("sd")))).alias("_w"),
               F.max(F.when(F.col("_r") == 2, F.col("effect"))).alias("runner_up")))
    sizes = effects.groupBy(*by).agg(F.count(F.lit(1)).alias("n_arms"))
    return two.join(sizes, by).select(*by, "_w.*", "runner_up", "n_arms")


def solvable() -> Column:
    return (F.when(F.col("n_arms") < 2, "single_arm")
            .when(~F.coalesce(F.col("sd") > 0, F.lit(False)), "no_spread")
            .when(F.col("naive") <= F.col("runner_up"), "tie").otherwise("ok"))


def conditional_root(x, sd, runner_up, q):
    """mu at which the pick's truncated distribution puts probability q above x."""
    x, sd, b = (np.asarray(v, float) for v in (x, sd, runner_up))

    def above(mu):
        return gauss.tail_ratio((x - mu) / sd, (b - mu) / sd)   # rises with mu

    lo, hi, reach = x.copy(), x.copy(), np.ones_like(x)
    for _ in range(21):                                       # up to 2^20 > 1e6 spreads
        need = above(lo) > q
        if not need.any():
            break
        lo = np.where(need, x - reach * sd, lo)
        reach = np.where(need, reach * 2, reach)
    found = (above(lo) <= q) & (lo >= x - 1e6 * sd)
    reach = np.ones_like(x)
    for _ in range(21):
        need = above(hi) < q
        if not need.any():
            break
        hi = np.where(need, x + reach * sd, hi)
        reach = np.where(need, reach * 2, reach)
    found &= above(hi) >= q
    mu = _bisect(lambda m: above(m) > q, lo, hi)
    found &= np.abs(above(mu) - q) < 1e-9
    return np.where(found, mu, np.nan)


def _bisect(too_high, lo, hi):
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        if np.all((mid == lo) | (mid == hi)):
            break
        up = too_high(mid)
        hi, lo = np.where(up, mid, hi), np.where(up, lo, mid)
    return (lo + hi) / 2


def hybrid_cdf(x, sd, runner_up, c, mu):
    lower = np.maximum(np.maximum(runner_up, x - c * sd), mu - c * sd)
    upper = np.minimum(x + c * sd, mu + c * sd)
    return gauss.truncnorm_cdf(x, lower, upper, mu, sd)


def hybrid_root(x, sd, runner_up, k, q, alpha=0.05):
    """The same with the distribution also cut to +-c_beta spreads around x and mu."""
    x, sd, b = (np.asarray(v, float) for v in (x, sd, runner_up))
    sizes = {int(v): gauss.max_abs_quantile(int(v), alpha * BETA_SHARE) for v in np.unique(k)}
    c = np.array([sizes[int(v)] for v in k], float)
    lo, hi = x - c * sd, x + c * sd
    mu = _bisect(lambda m: ~(hybrid_cdf(x, sd, b, c, m) > 1 - q), lo, hi)
    ok = np.abs(hybrid_cdf(x, sd, b, c, mu) - (1 - q)) < 1e-8
    return np.where(ok, mu, np.nan)


def _nullable(out: np.ndarray) -> pd.Series:
    return pd.Series(np.where(np.isfinite(out), out, None), dtype=object)


def _root_udf(method: str, q: float, alpha: float):
    @F.pandas_udf("double")
    def root(x: pd.Series, sd: pd.Series, b: pd.Series, k: pd.Series,
             status: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        ok = (status == "ok").to_numpy()
        if ok.any():
            a = [s.to_numpy(float)[ok] for s in (x, sd, b)]
            out[ok] = (conditional_root(*a, q) if method == "conditional" else
                       hybrid_root(*a, k.to_numpy()[ok], q, alpha))
        return _nullable(out)
    return root


def root_column(method: str, q: float = 0.5, alpha: float = 0.05) -> Column:
    if method not in ("conditional", "hybrid"):
        raise ValueError(f"unknown method {method!r}")
    return _root_udf(method, q, alpha)("naive", "sd", "runner_up", "n_arms", "status")


def si_correct(effects: DataFrame, method: str = "hybrid", q: float = 0.5,
               by: list[str] = TEST, arm: str = "arm", alpha: float = 0.05,
               tie: str | None = None) -> DataFrame:
    """Median-unbiased (q=.5) value of the pick; NULL with a status when there is none."""
    rows = pick_summary(effects, by, arm, tie).withColumn("status", solvable())
    out = rows.withColumn("corrected", root_column(method, q, alpha))
    name = {"conditional": "si_conditional", "hybrid": "hybrid_si"}[method]
    return out.select(
        *by, F.lit(name).alias("estimator"), "selected_arm", "naive", "corrected",
        (F.col("naive") - F.col("corrected")).alias("bias"),
        F.when((F.col("status") == "ok") & F.col("corrected").isNull(), "not_converged")
        .otherwise(F.col("status")).alias("status"))


@F.pandas_udf(T.DoubleType())
def _max_abs_quantile_udf(k: pd.Series, alpha: pd.Series) -> pd.Series:
    pairs, inverse = np.unique(np.column_stack([k, alpha]), axis=0, return_inverse=True)
    values = np.array([gauss.max_abs_quantile(int(a), b) for a, b in pairs])
    return pd.Series(values[inverse.ravel()] if len(k) else [], dtype=float)


def with_critical_value(df: DataFrame, alpha: float, size: str = "n_arms",
                        name: str = "c_alpha") -> DataFrame:
    """(1-alpha) quantile of the largest of `size` absolute normals, once per size of a batch."""
    return df.withColumn(name, _max_abs_quantile_udf(F.col(size), F.lit(float(alpha))))


def projection_interval(effects: DataFrame, alpha: float = 0.05, by: list[str] = TEST,
                        arm: str = "arm") -> DataFrame:
    out = with_critical_value(pick_summary(effects, by, arm), alpha)
    half = F.col("c_alpha") * F.col("sd")
    return out.select(*by, "selected_arm", "naive", "c_alpha",
                      (F.col("naive") - half).alias("ci_low"),
                      (F.col("naive") + half).alias("ci_high"))


def intervals(effects: DataFrame, alpha: float = 0.05, by: list[str] = TEST,
              arm: str = "arm") -> DataFrame:
    """Conventional, conditional, projection and hybrid intervals, one row each."""
    rows = with_critical_value(
        pick_summary(effects, by, arm).withColumn("status", solvable()), alpha)
    beta = alpha * BETA_SHARE
    q = (alpha - beta) / (2 * (1 - beta))
    x, sd = F.col("naive"), F.col("sd")
    z = gauss.NormalDist().inv_cdf(1 - alpha / 2)
    wide = rows.select(
        *by, "selected_arm", "naive",
        (x - z * sd).alias("conventional_low"), (x + z * sd).alias("conventional_high"),
        root_column("conditional", alpha / 2).alias("conditional_low"),
        root_column("conditional", 1 - alpha / 2).alias("conditional_high"),
        (x - F.col("c_alpha") * sd).alias("projection_low"),
        (x + F.col("c_alpha") * sd).alias("projection_high"),
        root_column("hybrid", q, alpha).alias("hybrid_low"),
        root_column("hybrid", 1 - q, alpha).alias("hybrid_high"))
    kinds = ["conventional", "conditional", "projection", "hybrid"]
    parts = F.explode(F.array(*[F.struct(
        F.lit(k).alias("kind"), F.col(f"{k}_low").alias("ci_low"),
        F.col(f"{k}_high").alias("ci_high")) for k in kinds]))
    return wide.select(*by, "selected_arm", "naive", parts.alias("_i")).select(
        *by, "selected_arm", "naive", "_i.*",
        (F.col("_i.ci_high") - F.col("_i.ci_low")).alias("width"))


def si_convergence(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group of repeats: customers, unconverged solves (mean, rate, worst, share affected).

    Input has one row per repeat with `customers` and `not_converged`.
    """
    share = F.col("not_converged") / F.col("customers")
    main = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("repeats"), F.avg("customers").alias("customers"),
        F.avg("not_converged").alias("mean_not_converged"), F.avg(share).alias("mean_rate"),
        F.max(share).alias("worst_rate"),
        F.avg((F.col("not_converged") > 0).cast("int")).alias("share_affected"))
    medians = exact_quantiles(df, "not_converged", [0.5], by).select(
        *by, F.col("q")[0].alias("median_not_converged"))
    return join_null_safe(main, medians, by)


def coverage(df: DataFrame, truth: str, by: list[str], estimate: str = "corrected",
             low: str = "ci_low", high: str = "ci_high") -> DataFrame:
    """Coverage, share over-estimated, mean and median error, median width per group.

    A missing interval does not cover.
    """
    def share(condition):
        return F.coalesce(condition, F.lit(False)).cast("int")

    df = save_table(df.select(*dict.fromkeys([*by, truth, estimate, low, high])))
    error = F.col(estimate) - F.col(truth)
    main = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(share(F.col(truth).between(F.col(low), F.col(high)))).alias("coverage"),
        F.avg(share(error > 0)).alias("over_share"), F.avg(error).alias("mean_error"))
    err = exact_quantiles(df, error, [0.5], by).select(
        *by, F.col("q")[0].alias("median_error"))
    wid = exact_quantiles(df, F.col(high) - F.col(low), [0.5], by).select(
        *by, F.col("q")[0].alias("median_width"))
    return join_null_safe(join_null_safe(main, err, by), wid, by)
