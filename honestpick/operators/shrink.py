"""Plug-in, Bayes and empirical Bayes corrections."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from honestpick.functions import gauss
from honestpick.functions.columns import attach_row, normal_density
from honestpick.functions.lineage import cut_lineage, save_table
from honestpick.operators.bootstrap import numbered
from honestpick.operators.effects import TEST, select_winner
from honestpick.operators.joins import join_null_safe



# --- plug-in, two arms (C1, C2) -----------------------------------------------------------

def _pair_summary(rows: DataFrame, by: list[str], arm: str, value: str) -> DataFrame:
    y, a = F.col(value), F.col(arm)
    out = rows.groupBy(*by).agg(
        F.avg(F.when(a == 0, y)).alias("e0"), F.avg(F.when(a == 1, y)).alias("e1"),
        F.count(F.when(a == 0, y)).alias("n0"), F.stddev_pop(y).alias("sigma"),
        F.count_if(~a.isin(0, 1)).alias("_other"))
    ok = F.when((F.col("_other") > 0) | F.col("e0").isNull() | F.col("e1").isNull(),
                F.raise_error(F.lit("the plug-in correction needs exactly arms 0 and 1"))
                .cast("boolean")).otherwise(F.lit(True))
    return out.where(ok).withColumn("v", F.col("sigma") * F.sqrt(2 / F.col("n0"))).select(
        *by, "v", (F.col("e0") - F.col("e1")).alias("delta"),
        F.when(F.col("e1") > F.col("e0"), 1).otherwise(0).alias("selected_arm"),
        F.greatest("e0", "e1").alias("naive"))


def _phi(x: Column) -> Column:
    return normal_density(x)


def correct_plugin(rows: DataFrame, by: list[str] = TEST, arm: str = "arm",
                   value: str = "y") -> DataFrame:
    """Bias of the larger of two means under normality, with the pooled spread."""
    bias = F.col("v") * _phi(F.col("delta") / F.col("v"))
    return _pair_summary(rows, by, arm, value).select(
        *by, F.lit("plugin").alias("estimator"), "selected_arm", "naive",
        (F.col("naive") - bias).alias("corrected"), bias.alias("bias"))


def correct_plugin_integrated(rows: DataFrame, by: list[str] = TEST, arm: str = "arm",
                              value: str = "y", row_key: str = "row_id") -> DataFrame:
    """The density averaged over |differences| of the arms' i-th rows (where both have one)."""
    num = numbered(rows.select(*by, arm, row_key, value), by, arm, row_key)
    pairs = num.groupBy(*by, "pos").agg(
        F.max(F.when(F.col(arm) == 0, F.col(value))).alias("y0"),
        F.max(F.when(F.col(arm) == 1, F.col(value))).alias("y1"))
    summary = _pair_summary(rows, by, arm, value)
    density = pairs.join(summary.select(*by, "v"), by).groupBy(*by).agg(
        F.avg(_phi(F.abs(F.col("y1") - F.col("y0")) / F.col("v"))).alias("_d"))
    bias = F.col("v") * F.col("_d")
    return summary.join(density, by).select(
        *by, F.lit("plugin_integrated").alias("estimator"), "selected_arm", "naive",
        (F.col("naive") - bias).alias("corrected"), bias.alias("bias"))


# --- normal priors (C3, C4) ---------------------------------------------------------------

def posterior_normal(effects: DataFrame, mean: float, std: float) -> DataFrame:
    """Adds `posterior`: every effect shrunk to a given normal prior."""
    prior = F.lit(float(std) ** 2)
    shrink = prior / (prior + F.col("var"))
    return effects.withColumn("posterior", shrink * F.col("effect")
                              + (1 - shrink) * F.lit(float(mean)))


def posterior_eb_normal(effects: DataFrame, over: list[str]) -> DataFrame:
    """Adds `posterior`, `prior_mean`, `prior_std`; prior from the effects within `over`.

    Two partial aggregates and a join back, so a group may be of any size.
    """
    prior = effects.groupBy(*over).agg(F.avg("effect").alias("prior_mean"),
                                       F.var_pop("effect").alias("_pv"))
    joined = effects.join(prior, over) if over else attach_row(effects, prior)
    total = F.col("_pv") + F.col("var")
    shrink = F.when(total > 0, F.col("_pv") / total).otherwise(F.lit(0.0))
    return joined.withColumn("posterior", shrink * F.col("effect")
                             + (1 - shrink) * F.col("prior_mean")).withColumn(
        "prior_std", F.sqrt("_pv")).drop("_pv")


def value_of_pick(posteriors: DataFrame, estimator: str, by: list[str] = TEST,
                  arm: str = "arm", keep: list[str] = (), tie: str | None = None) -> DataFrame:
    """Posterior value of the arm picked on the raw effects."""
    pick = select_winner(posteriors, by, arm, tie).drop("ties", "effect")
    return pick.join(posteriors.select(*by, arm, "effect", "posterior", *keep),
                     [*by, arm]).select(
        *by, F.lit(estimator).alias("estimator"), F.col(arm).alias("selected_arm"),
        F.col("effect").alias("naive"), F.col("posterior").alias("corrected"),
        (F.col("effect") - F.col("posterior")).alias("bias"), *keep)


def correct_bayes_normal(effects: DataFrame, mean: float, std: float, by: list[str] = TEST,
                         arm: str = "arm") -> DataFrame:
    return value_of_pick(posterior_normal(effects, mean, std), "bayes_normal", by, arm)


def correct_eb_normal(effects: DataFrame, over: list[str] = TEST, by: list[str] = TEST,
                      arm: str = "arm", tie: str | None = None) -> DataFrame:
    return value_of_pick(posterior_eb_normal(effects, over), "eb_normal", by, arm,
                         ["prior_mean", "prior_std"], tie)


# --- Tweedie (C5) -------------------------------------------------------------------------

def _natural_basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Natural cubic spline basis (truncated powers), as many columns as knots."""
    def d(k):
        return ((np.maximum(x - knots[k], 0) ** 3 - np.maximum(x - knots[-1], 0) ** 3)
                / (knots[-1] - knots[k]))
    last = d(len(knots) - 2)
    return np.column_stack([np.ones_like(x), x] + [d(k) - last for k in range(len(knots) - 2)])


def _poisson_fit(design: np.ndarray, counts: np.ndarray, steps: int = 100) -> np.ndarray:
    """Log-mean of a Poisson regression by reweighted least squares."""
    eta = np.log((counts + counts.mean()) / 2)
    deviance = np.inf
    for _ in range(steps):
        mu = np.exp(eta)
        z = eta + (counts - mu) / mu
        w = np.sqrt(mu)
        beta = np.linalg.lstsq(design * w[:, None], z * w, rcond=None)[0]
        eta = design @ beta
        mu = np.exp(eta)
        new = 2 * np.sum(np.where(counts > 0, counts * np.log(np.where(counts > 0, counts, 1)
                                                              / mu), 0) - (counts - mu))
        if abs(new - deviance) < 1e-10 * (abs(new) + 0.1):
            break
        deviance = new
    return eta


def _spline_curvature(y: np.ndarray, h: float) -> np.ndarray:
    """Second derivatives of the natural cubic spline through equally spaced points."""
    n, m = len(y), np.zeros(len(y))
    if n > 2:
        rhs = 6 * (y[2:] - 2 * y[1:-1] + y[:-2]) / h ** 2
        diag = np.full(n - 2, 4.0)
        for i in range(1, n - 2):                     # Thomas elimination
            f = 1 / diag[i - 1]
            diag[i] -= f
            rhs[i] -= f * rhs[i - 1]
        m[n - 2] = rhs[-1] / diag[-1]
        for i in range(n - 4, -1, -1):
            m[i + 1] = (rhs[i] - m[i + 2]) / diag[i]
    return m


def _basis_curvature(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Second derivatives of the natural spline basis."""
    def d(k):
        return 6 * (np.maximum(x - knots[k], 0) - np.maximum(x - knots[-1], 0)) / (
            knots[-1] - knots[k])
    last = d(len(knots) - 2)
    zero = np.zeros_like(x)
    return np.column_stack([zero, zero] + [d(k) - last for k in range(len(knots) - 2)])


def _smooth_fit(x: np.ndarray, counts: np.ndarray, nb: int, dof: int, width: float,
                at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Poisson spline fit where bins are far finer than the spline: (log mean, its second
    derivative) at the centres of the bins `at` and the ones after them.

    Sums over all bins are integrals over the pieces between knots (Gauss-Legendre), so memory
    and time follow the occupied bins, not the range.
    """
    ends = np.array([0.5, nb - 0.5]) * width
    knots = np.linspace(*ends, dof)
    x0, scale = ends.mean(), nb * width / np.sqrt(12)
    k = (knots - x0) / scale
    node, weight = np.polynomial.legendre.leggauss(400)
    half = np.diff(knots)[:, None] / 2
    nodes = (knots[:-1, None] + half * (node + 1)).ravel()
    weights = (half * weight / width).ravel()
    weights *= nb / weights.sum()
    every, seen = (_natural_basis((v - x0) / scale, k) for v in (nodes, x))
    beta = np.zeros(dof)
    beta[0] = np.log(counts.sum() / nb)

    def gain(v):
        with np.errstate(over="ignore"):
            return counts @ (seen @ v) - weights @ np.exp(every @ v)

    best = gain(beta)
    for _ in range(200):
        mu = weights * np.exp(every @ beta)
        step = np.linalg.lstsq(every.T @ (every * mu[:, None]), seen.T @ counts - every.T @ mu,
                               rcond=None)[0]
        size = 1.0
        while size > 1e-8 and not gain(beta + size * step) > best:
            size /= 2
        if size <= 1e-8:
            break
        beta = beta + size * step
        best = gain(beta)
    centres = (np.concatenate([at, at + 1]) + 0.5) * width
    z = (centres - x0) / scale
    return _natural_basis(z, k) @ beta, _basis_curvature(z, k) @ beta / scale ** 2


_FIT = T.ArrayType(T.StructType([T.StructField("bin", T.LongType())] + [
    T.StructField(c, T.DoubleType()) for c in ("y0", "y1", "m0", "m1")]))
FINE = 100_000      # bins beyond which sums over bins are taken as integrals (equal to 1e-9)


def _log_density_fit(dof: int, width: float):
    """Fitted log density and curvature at the centres around each piece that a row may need."""
    @F.pandas_udf(_FIT)
    def fit(n_bins: pd.Series, bins: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for nb, b, c in zip(n_bins, bins, counts):
            pieces = None
            if nb >= max(3, dof):
                nb, b, c = int(nb), np.asarray(b, np.int64), np.asarray(c, float)
                i = np.unique(np.clip(np.concatenate([b - 1, b]), 0, nb - 2))
                try:
                    if nb > FINE:
                        y, m = _smooth_fit((b + 0.5) * width, c, nb, dof, width, i)
                        y0, y1, m0, m1 = y[:len(i)], y[len(i):], m[:len(i)], m[len(i):]
                    else:
                        dense = np.zeros(nb)
                        dense[b] = c
                        x = (np.arange(nb) + 0.5) * width    # distance from the lowest value
                        knots = np.quantile(x, np.linspace(0, 1, dof))
                        x0, scale = x.mean(), max(x.std(), 1e-300)
                        y = _poisson_fit(_natural_basis((x - x0) / scale, (knots - x0) / scale),
                                         dense)
                        m = _spline_curvature(y, width)
                        y0, y1, m0, m1 = y[i], y[i + 1], m[i], m[i + 1]
                    if all(np.all(np.isfinite(v)) for v in (y0, y1, m0, m1)):
                        pieces = [dict(bin=k, y0=p, y1=q, m0=r, m1=s) for k, p, q, r, s in zip(
                            *(v.tolist() for v in (i, y0, y1, m0, m1)))]
                except np.linalg.LinAlgError:
                    pass
            out.append(pieces)
        return pd.Series(out)
    return fit


def posterior_eb_tweedie(effects: DataFrame, over: list[str], dof: int = 3,
                         bin_width: float = 0.2) -> DataFrame:
    """Adds `posterior` = effect + var * slope of the log density, NULL where the fit failed.

    Counting per bin and applying the slope are Spark's; only a group's histogram reaches
    Python, whose memory grows with the group's range over the bin width, not with its rows.
    Rows fetch the piece of the fit they fall in by a join on (group, piece).
    """
    w = float(bin_width)
    keys = over or ["_all"]
    rows = effects if over else effects.withColumn("_all", F.lit(1))
    stats = rows.groupBy(*keys).agg(F.min("effect").alias("_low"), F.max("effect").alias("_hi"))
    stats = stats.withColumn("_nb", F.greatest(F.lit(1), F.ceil(
        (F.col("_hi") - F.col("_low")) / w))).drop("_hi")
    placed = join_null_safe(rows, stats, keys)
    t = F.col("effect") - F.col("_low") - w / 2          # distance from the first centre
    placed = placed.withColumn("_t", t).withColumn("_i", F.least(
        F.greatest(F.floor(t / w), F.lit(0)), F.col("_nb") - 2).cast("bigint"))
    hist = (placed.where(F.col("effect").isNotNull()).withColumn("_bin", F.least(
        F.floor((F.col("effect") - F.col("_low")) / w), F.col("_nb") - 1))
            .groupBy(*keys, "_nb", "_bin").agg(F.count(F.lit(1)).alias("_c"))
            .groupBy(*keys, "_nb").agg(F.sort_array(F.collect_list(
                F.struct("_bin", "_c"))).alias("_h")))
    pieces = hist.select(*keys, F.explode(_log_density_fit(dof, w)(
        F.col("_nb"), F.col("_h._bin"), F.col("_h._c"))).alias("_f"))
    pieces = pieces.select(*keys, F.col("_f.bin").alias("_i"), *[F.col(f"_f.{c}").alias(f"_{c}")
                                                               for c in ("y0", "y1", "m0", "m1")])
    joined = join_null_safe(placed, pieces, [*keys, "_i"])
    right = (F.col("_i") + 1) * w - F.col("_t")
    left = F.col("_t") - F.col("_i") * w
    y0, y1, m0, m1 = (F.col(f"_{c}") for c in ("y0", "y1", "m0", "m1"))
    slope = (-m0 * right * right / (2 * w) + m1 * left * left / (2 * w)
             + (y1 - y0) / w - w * (m1 - m0) / 6)
    out = joined.withColumn("posterior", F.col("effect") + F.col("var") * slope).withColumn(
        "fit_failed", F.col("posterior").isNull())
    return out.select(*[c for c in effects.columns if c not in ("posterior", "fit_failed")],
                      "posterior", "fit_failed")


def correct_eb_tweedie(effects: DataFrame, over: list[str], by: list[str] = TEST,
                       arm: str = "arm", dof: int = 3, bin_width: float = 0.2) -> DataFrame:
    return value_of_pick(posterior_eb_tweedie(effects, over, dof, bin_width), "eb_tweedie",
                         by, arm, ["fit_failed"])


# --- spike and slab (C6, C7) ----------------------------------------------------------------

def _slab_weight() -> Column:
    spike = F.col("pi") * normal_density(F.col("effect"), 0.0, F.col("var"))
    slab = (1 - F.col("pi")) * normal_density(F.col("effect"), F.col("mu0"),
                                              F.col("var") + F.col("tau2"))
    return F.coalesce(F.try_divide(slab, spike + slab), F.lit(1.0))


def spike_slab_fit(effects: DataFrame, over: list[str], pi: float = 0.5, max_iter: int = 100,
                   tol: float = 1e-6, compat: bool = False, chunk: int = 5) -> DataFrame:
    """(over..., pi, mu0, tau2, previous parameters, converged): EM as repeated aggregates.

    A step is one grouped sum over the data; parameters stay a DataFrame and are checkpointed
    every `chunk` steps, when convergence is also looked at.  A converged group stays put.
    """
    slim = cut_lineage(effects.select(*over, "effect", "var").where(F.col("effect").isNotNull()))
    key = over or ["_all"]
    if not over:
        slim = slim.withColumn("_all", F.lit(1))
    params = slim.groupBy(*key).agg(F.avg("effect").alias("mu0"),
                                    F.var_pop("effect").alias("tau2")).withColumns({
        "pi": F.lit(float(pi)), "change": F.lit(1.0)})
    for old in ("pi", "mu0", "tau2"):
        params = params.withColumn(f"{old}_last", F.col(old))
    noise = F.col("var") * F.col("var") if compat else F.col("var")

    # parameters are read back from files, whose size Spark weighs when it plans the join
    params = save_table(params)
    state = ["pi", "mu0", "tau2", "pi_last", "mu0_last", "tau2_last", "change"]

    def step(p):
        # the old parameters ride along as grouping keys, so a step reads `p` once
        sums = slim.join(p, key).withColumn("_r", _slab_weight()).groupBy(
            *key, *state).agg(
            F.count(F.lit(1)).alias("_n"), F.sum("_r").alias("_s"),
            F.sum(F.col("_r") * F.col("effect")).alias("_sx"),
            F.sum(F.col("_r") * F.col("effect") * F.col("effect")).alias("_sxx"),
            F.sum(F.col("_r") * noise).alias("_sv"))
        mu = F.when(F.col("_s") > 0, F.col("_sx") / F.col("_s")).otherwise(F.lit(0.0))
        tau2 = F.greatest(F.lit(1e-6), F.coalesce(F.try_divide(
            F.col("_sxx") - 2 * mu * F.col("_sx") + mu * mu * F.col("_s") - F.col("_sv"),
            F.col("_s")), F.lit(0.0)))
        new = sums.select(*key, *state, (1 - F.col("_s") / F.col("_n")).alias("_pi"),
                          mu.alias("_mu0"), tau2.alias("_tau2"))
        live = F.col("change") >= tol
        moved = F.greatest(*[F.abs(F.col(f"_{c}") - F.col(c)) for c in state[:3]])
        return new.select(
            *key, *[F.when(live, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in state[:3]],
            *[F.when(live, F.col(c)).otherwise(F.col(f"{c}_last")).alias(f"{c}_last")
              for c in state[:3]],
            F.when(live, moved).otherwise(F.col("change")).alias("change"))

    done = 0
    while done < max_iter:
        for _ in range(min(chunk, max_iter - done)):
            params = step(params)
            done += 1
        params = save_table(params)
        if params.agg(F.max("change")).first()[0] < tol:
            break
    params = params.withColumn("converged", F.col("change") < tol)
    return params if over else params.drop("_all")


def posterior_spike_slab(effects: DataFrame, params: DataFrame, over: list[str],
                         compat: bool = False) -> DataFrame:
    """Adds `posterior`; with `compat` the slab weight uses the parameters of the last E-step."""
    joined = effects.join(params, over) if over else attach_row(effects, params)
    if compat:
        last = joined.withColumnsRenamed({"pi": "_pi", "mu0": "_mu0", "tau2": "_tau2"}
                                         ).withColumnsRenamed(
            {"pi_last": "pi", "mu0_last": "mu0", "tau2_last": "tau2"}).withColumn(
            "_r", _slab_weight()).drop("pi", "mu0", "tau2")
        joined = last.withColumnsRenamed({"_pi": "pi", "_mu0": "mu0", "_tau2": "tau2"})
    else:
        joined = joined.withColumn("_r", _slab_weight()).drop("pi_last", "mu0_last", "tau2_last")
    total = F.col("var") + F.col("tau2")
    slab = (F.col("tau2") * F.col("effect") + F.col("var") * F.col("mu0")) / total
    return joined.withColumn("posterior", F.col("_r") * slab).drop("_r", "change")


def correct_eb_spike_slab(effects: DataFrame, over: list[str] = TEST, by: list[str] = TEST,
                          arm: str = "arm", pi: float = 0.5, max_iter: int = 100,
                          tol: float = 1e-6, compat: bool = False) -> DataFrame:
    params = spike_slab_fit(effects, over, pi, max_iter, tol, compat)
    return value_of_pick(posterior_spike_slab(effects, params, over, compat), "eb_spike_slab",
                         by, arm, ["pi", "mu0", "tau2", "converged"])


_NODES, _WEIGHTS = np.polynomial.hermite_e.hermegauss(80)


def selected_posterior(y, other, s2, s2_other, pi, mu0, tau2, epsilon=1e-6):
    """E[mu | y, arm was picked] by Gauss-Hermite per prior component (numpy arrays)."""
    num = den = 0.0
    spread = np.sqrt(s2 + s2_other)
    for share, mean, var in ((pi, 0.0, epsilon), (1 - pi, mu0, tau2)):
        total = s2 + var
        weight = share * np.exp(-(y - mean) ** 2 / (2 * total)) / np.sqrt(total)
        m, v = (var * y + s2 * mean) / total, s2 * var / total
        mu = m[:, None] + np.sqrt(v)[:, None] * _NODES
        prob = np.maximum(gauss.cdf((mu - other[:, None]) / spread[:, None]), 1e-12)
        num = num + weight * ((mu / prob) @ _WEIGHTS)
        den = den + weight * ((1 / prob) @ _WEIGHTS)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den > 0, num / den, np.nan)


@F.pandas_udf(T.DoubleType())
def _selected_posterior_udf(y: pd.Series, other: pd.Series, s2: pd.Series, s2_other: pd.Series,
                            pi: pd.Series, mu0: pd.Series, tau2: pd.Series) -> pd.Series:
    a = [c.to_numpy(float) for c in (y, other, s2, s2_other, pi, mu0, tau2)]
    out = selected_posterior(*a)
    return pd.Series(np.where(np.isfinite(out), out, None), dtype=object)


def correct_spike_slab_selected(effects: DataFrame, by: list[str] = TEST, arm: str = "arm",
                                pi: float = 0.5, max_iter: int = 100,
                                tol: float = 1e-6) -> DataFrame:
    """Two-arm tests: spike-slab prior per arm across tests, adjusted for having been picked."""
    params = spike_slab_fit(effects, [arm], pi, max_iter, tol).select(arm, "pi", "mu0", "tau2")
    a, e = F.col(arm), F.col("effect")
    wide = effects.groupBy(*by).agg(*[
        F.max(F.when(a == k, F.col(c))).alias(f"{c}_{k}") for k in (0, 1) for c in
        ("effect", "var")])
    first = F.col("effect_0") >= F.col("effect_1")
    picked = wide.select(
        *by, F.when(first, 0).otherwise(1).alias(arm),
        F.when(first, F.col("effect_0")).otherwise(F.col("effect_1")).alias("naive"),
        F.when(first, F.col("effect_1")).otherwise(F.col("effect_0")).alias("other"),
        F.when(first, F.col("var_0")).otherwise(F.col("var_1")).alias("s2"),
        F.when(first, F.col("var_1")).otherwise(F.col("var_0")).alias("s2_other"))
    joined = picked.join(params, arm)
    return joined.select(
        *by, F.lit("eb_spike_slab_selected").alias("estimator"), a.alias("selected_arm"), "naive",
        _selected_posterior_udf("naive", "other", "s2", "s2_other", "pi", "mu0", "tau2")
        .alias("corrected")).withColumn("bias", F.col("naive") - F.col("corrected"))


def eb_failures(errors: DataFrame, by: list[str], lower: float = -5.0,
                upper: float = 5.0) -> DataFrame:
    """Attempted, retained, failed fits and finite outliers per group (val_est NULL = failed)."""
    wc = F.col("val_est") - F.col("val_true")
    inside = F.coalesce((wc > lower) & (wc < upper), F.lit(False))
    return errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(inside).alias("retained"),
        F.count_if(F.col("val_est").isNull()).alias("fit_failures"),
        F.count_if(F.col("val_est").isNotNull() & ~inside).alias("finite_outliers"))
