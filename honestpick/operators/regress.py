"""Descriptive regressions on per-test estimates.

Spark computes cross products of the design columns in one pass; only k x k numbers come to
the driver to be solved, whatever the number of rows.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from honestpick.functions import gauss
from honestpick.functions.columns import bin_arm_count, month_of, safe_ratio, week_of
from honestpick.functions.lineage import save_table
from honestpick.functions.quantiles import exact_quantiles
from honestpick.operators.effects import add_snr, top_two
from honestpick.operators.joins import join_one_to_one
from honestpick.operators.prep import log_columns, quantile_bins

MAX_LEVELS = 1_000   # levels one categorical term may have
WIDE = 16            # design columns beyond which cross products are summed per Arrow batch


# --- analysis table (D1) --------------------------------------------------------------------

def derive(per_test: DataFrame, arms: DataFrame, bias: str = "bias",
           deciles: int = 10) -> DataFrame:
    """Adds SNR, controls, bins and dates to a per-test table (one row per test).

    The joined table is saved once, as the bins read it three times.
    """
    snr = add_snr(top_two(arms)).select("test_id", (100 * F.col("snr")).alias("snr_pct"))
    start = arms.groupBy("test_id").agg(F.min("created_at").alias("date"))
    p = join_one_to_one(join_one_to_one(per_test, snr, ["test_id"]), start, ["test_id"])
    p = p.withColumns({
        "n_per_arm": F.col("total_impressions") / F.col("n_arms"),
        "sigma_all": F.sqrt(F.col("pooled_rate") * (1 - F.col("pooled_rate"))),
        "wc_pp": 100 * F.col(bias), "gap_pp": 100 * F.col("gap"),
        "ctr_pct": 100 * F.col("pooled_rate"), "arm_group": bin_arm_count("n_arms"),
        "week": week_of("date"), "month": month_of("date")})
    p = log_columns(p, {"log_J": "n_arms", "log_n": "n_per_arm", "log_sigma": "sigma_all",
                        "log_total": "total_impressions"})
    return quantile_bins(save_table(p), {"snr_decile": "snr_pct",
                                          "total_decile": "total_impressions"}, deciles)


# --- design columns (D9) ---------------------------------------------------------------------

@dataclass(frozen=True)
class C:
    """Categorical term; the first of its sorted levels is the base."""
    column: str
    levels: tuple = ()


@dataclass(frozen=True)
class Bs:
    """Cubic B-spline of a column with `df` columns (no intercept)."""
    column: str
    df: int = 4
    knots: tuple = ()          # filled in by prepare()


def prepare(df: DataFrame, terms: list) -> list:
    """Fill in categorical levels and spline knots from the data."""
    out = []
    for t in terms:
        if isinstance(t, C) and not t.levels:
            rows = df.select(t.column).where(F.col(t.column).isNotNull()).distinct().limit(
                MAX_LEVELS + 1).collect()
            if len(rows) > MAX_LEVELS:
                raise ValueError(f"{t.column} has more than {MAX_LEVELS} levels")
            t = C(t.column, tuple(sorted(r[0] for r in rows)))
        elif isinstance(t, Bs) and not t.knots:
            inner = t.df - 3
            probs = [i / (inner + 1) for i in range(inner + 2)]
            q = exact_quantiles(df, t.column, probs).first()["q"]
            t = Bs(t.column, t.df, tuple(q))
        out.append(t)
    return out


def bspline(column, knots: tuple) -> list[Column]:
    """Cubic B-spline basis over [knots[0], knots[-1]] by Cox-de Boor, first column dropped."""
    x = F.col(column) if isinstance(column, str) else column
    t = [knots[0]] * 4 + list(knots[1:-1]) + [knots[-1]] * 4
    last = len(t) - 5                                   # interval that includes the upper end
    basis = []
    for i in range(len(t) - 1):
        inside = (x >= t[i]) & ((x <= t[i + 1]) if i == last else (x < t[i + 1]))
        basis.append(F.when(inside, 1.0).otherwise(0.0) if t[i] < t[i + 1] else None)
    for degree in (1, 2, 3):
        nxt = []
        for i in range(len(basis) - 1):
            parts = []
            if basis[i] is not None and t[i + degree] > t[i]:
                parts.append(basis[i] * (x - t[i]) / (t[i + degree] - t[i]))
            if basis[i + 1] is not None and t[i + degree + 1] > t[i + 1]:
                parts.append(basis[i + 1] * (t[i + degree + 1] - x)
                             / (t[i + degree + 1] - t[i + 1]))
            nxt.append(None if not parts else parts[0] if len(parts) == 1
                       else parts[0] + parts[1])
        basis = nxt
    return [b if b is not None else F.lit(0.0) for b in basis[1:]]


def design(terms: list) -> list[tuple[str, Column]]:
    """(name, Column) pairs, the intercept first; terms must be prepared."""
    out = [("Intercept", F.lit(1.0))]
    for t in terms:
        if isinstance(t, C):
            out += [(f"C({t.column})[{v}]", (F.col(t.column) == F.lit(v)).cast("double"))
                    for v in t.levels[1:]]
        elif isinstance(t, Bs):
            out += [(f"bs({t.column})[{i}]", b) for i, b in enumerate(bspline(t.column, t.knots))]
        else:
            out.append((t, F.col(t).cast("double")))
    return out


# --- cross products ---------------------------------------------------------------------------

def cross_products(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sum over rows of the outer product of the named columns, as a k x k array."""
    k = len(columns)
    out = np.zeros((k, k))
    if k <= WIDE:
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{n}")
                       for n, (i, j) in enumerate(pairs)]).first()
        for n, (i, j) in enumerate(pairs):
            out[i, j] = out[j, i] = row[n] or 0.0
        return out

    def partial(batches):
        total = np.zeros((k, k))
        for pdf in batches:
            a = pdf.to_numpy(float)
            total += a.T @ a
        i, j = np.indices((k, k))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    sums = df.select(*[F.col(c).cast("double") for c in columns]).mapInPandas(
        partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for row in sums.collect():                           # k*k numbers
        out[row.i, row.j] = row.v
    return out


@dataclass
class Fit:
    """An OLS fit: names, coefficients, (X'X)^-1 and the pieces robust errors need."""
    y: str
    terms: list
    names: list[str]
    beta: np.ndarray
    bread: np.ndarray
    n: int
    r2: float
    means: np.ndarray
    frame: DataFrame = field(repr=False)

    @property
    def columns(self) -> list[str]:
        return [f"_x{i}" for i in range(len(self.names))]

    def with_residual(self) -> DataFrame:
        fitted = sum((F.col(c) * float(b) for c, b in zip(self.columns, self.beta)), F.lit(0.0))
        return self.frame.withColumn("_e", F.col("_y") - fitted)


def ols(df: DataFrame, y: str, terms: list, keep: list[str] = ()) -> Fit:
    """OLS on rows where y and all terms are present; one pass for the cross products."""
    terms = prepare(df, terms)
    pairs = design(terms)
    names = [n for n, _ in pairs]
    cols = [f"_x{i}" for i in range(len(names))]
    frame = df.select(*dict.fromkeys(keep), F.col(y).cast("double").alias("_y"),
                      *[c.alias(a) for a, (_, c) in zip(cols, pairs)]).na.drop(
        subset=["_y", *cols])
    g = cross_products(frame, [*cols, "_y"])
    xtx, xty, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    scale = 1 / np.sqrt(np.diag(xtx))
    bread = np.linalg.inv(xtx * np.outer(scale, scale)) * np.outer(scale, scale)
    beta = bread @ xty
    n = int(round(xtx[0, 0]))
    rss, tss = yy - beta @ xty, yy - xty[0] ** 2 / n
    return Fit(y, terms, names, beta, bread, n, 1 - rss / tss, xtx[0] / n, frame)


# --- covariance (D3, D4) -------------------------------------------------------------------------

def cluster_cov(fit: Fit, cluster: str) -> tuple[np.ndarray, int]:
    """Cluster-robust covariance with the (G/(G-1))((n-1)/(n-k)) correction, and G.

    Scores are summed per cluster with a grouped sum; their outer products in a second one.
    """
    scores = fit.with_residual().groupBy(cluster).agg(
        *[F.sum(F.col(c) * F.col("_e")).alias(c) for c in fit.columns]).withColumn(
        "_g", F.lit(1.0))
    m = cross_products(scores, [*fit.columns, "_g"])
    groups, k = int(round(m[-1, -1])), len(fit.names)
    factor = groups / (groups - 1) * (fit.n - 1) / (fit.n - k)
    return factor * fit.bread @ m[:-1, :-1] @ fit.bread, groups


def hc3_cov(fit: Fit) -> np.ndarray:
    """HC3: residuals over (1 - leverage); leverage is a quadratic form of the design row."""
    k = len(fit.names)
    if k <= WIDE:
        h = sum((F.col(fit.columns[i]) * F.col(fit.columns[j]) * float(
            fit.bread[i, j] * (1 if i == j else 2)) for i in range(k) for j in range(i, k)),
            F.lit(0.0))
    else:
        bread = fit.bread

        @F.pandas_udf("double")
        def leverage(x: pd.Series) -> pd.Series:
            a = np.stack(x.to_numpy())
            return pd.Series(np.einsum("ni,ij,nj->n", a, bread, a))
        h = leverage(F.array(*fit.columns))
    weighted = fit.with_residual().withColumn("_w", F.col("_e") / (1 - h)).select(
        *[(F.col(c) * F.col("_w")).alias(c) for c in fit.columns])
    return fit.bread @ cross_products(weighted, fit.columns) @ fit.bread


def plain_cov(fit: Fit) -> np.ndarray:
    rss = fit.with_residual().agg(F.sum(F.col("_e") * F.col("_e"))).first()[0]
    return fit.bread * rss / (fit.n - len(fit.names))


# --- tables (D5-D8) -------------------------------------------------------------------------------

def regression_rows(fit: Fit, cov: np.ndarray, covariance: str, sample: str = "all",
                    model: str = "model", clusters: int | None = None) -> DataFrame:
    """One row per term: coefficient, se, normal p-value and 95% interval."""
    se = np.sqrt(np.diag(cov))
    p = gauss.two_sided_p(fit.beta / se)
    z = gauss.NormalDist().inv_cdf(0.975)
    rows = [(sample, model, covariance, name, float(b), float(s), float(q), float(b - z * s),
             float(b + z * s), fit.n, clusters, float(fit.r2))
            for name, b, s, q in zip(fit.names, fit.beta, se, p)]
    return fit.frame.sparkSession.createDataFrame(rows, (
        "sample string, model string, covariance string, term string, coefficient double, "
        "se double, p double, ci_low double, ci_high double, n bigint, clusters bigint, "
        "r_squared double"))


GROUPED_MEANS = {"wc_pp": "raw_wc_pp", "snr_pct": "snr_pct", "n_arms": "arms",
                 "total_impressions": "total_impressions", "n_per_arm": "impressions_per_arm",
                 "ctr_pct": "ctr_pct", "sigma_all": "sigma", "gap_pp": "observed_gap_pp",
                 "selected_winner": "winner_share"}


def grouped(df: DataFrame, by: str) -> DataFrame:
    """Tests and means per bin, the i.i.d. error of the mean, and its share of the mean gap."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("tests"),
        *[F.avg(F.col(c).cast("double")).alias(n) for c, n in GROUPED_MEANS.items()],
        (F.stddev_samp("wc_pp") / F.sqrt(F.count("wc_pp"))).alias("se_iid")).withColumn(
        "pct_of_gap", 100 * safe_ratio("raw_wc_pp", "observed_gap_pp"))


def adjusted_means(fit: Fit, cov: np.ndarray, group: str) -> DataFrame:
    """Predicted mean per level of a categorical term over everybody's other covariates.

    The average design row is known from the cross products, so no further pass is needed.
    """
    term = next(t for t in fit.terms if isinstance(t, C) and t.column == group)
    own = [i for i, n in enumerate(fit.names) if n.startswith(f"C({group})[")]
    rows = []
    for level in term.levels:
        x = fit.means.copy()
        x[own] = 0.0
        name = f"C({group})[{level}]"
        if name in fit.names:
            x[fit.names.index(name)] = 1.0
        rows.append((str(level), *_prediction(x, fit.beta, cov)))
    return fit.frame.sparkSession.createDataFrame(
        rows, f"{group} string, adjusted double, se double, ci_low double, ci_high double")


def _prediction(x, beta, cov):
    mean, se = float(x @ beta), float(np.sqrt(x @ cov @ x))
    return mean, se, mean - 1.96 * se, mean + 1.96 * se


def adjusted_curve(df: DataFrame, fit: Fit, cov: np.ndarray, column: str,
                   transform=None, points: int = 200, geometric: bool = False) -> DataFrame:
    """The same along a grid of a spline term's level, from its 1st to its 99th percentile.

    `column` is the level; the spline may be on `transform(level)` (e.g. its log).
    """
    low, high = exact_quantiles(df, column, [0.01, 0.99]).first()["q"]
    grid = np.geomspace(low, high, points) if geometric else np.linspace(low, high, points)
    term = next(t for t in fit.terms if isinstance(t, Bs))
    own = [i for i, n in enumerate(fit.names) if n.startswith(f"bs({term.column})[")]
    spark = df.sparkSession
    level = F.col("level") if transform is None else transform(F.col("level"))
    basis = spark.createDataFrame([(float(v),) for v in grid], "level double").withColumn(
        "_t", level).select("level", *[b.alias(f"b{i}") for i, b in enumerate(
            bspline("_t", term.knots))]).collect()        # `points` rows
    rows = []
    for r in sorted(basis, key=lambda r: r.level):
        x = fit.means.copy()
        x[own] = [r[f"b{i}"] for i in range(len(own))]
        rows.append((r.level, *_prediction(x, fit.beta, cov)))
    return spark.createDataFrame(
        rows, f"{column} double, adjusted double, se double, ci_low double, ci_high double")


# --- variants and diagnostics (D10-D12) -------------------------------------------------------------

def in_samples(df: DataFrame, samples: dict[str, Column]) -> DataFrame:
    """Every row once per sample it belongs to (samples may overlap)."""
    marks = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
                               for name, cond in samples.items()]), lambda s: s.isNotNull())
    return df.withColumn("sample", F.explode(marks))


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = rows.agg(*[F.corr(columns[i], columns[j]) for i, j in pairs]).first()
    out = np.eye(len(columns))
    for (i, j), v in zip(pairs, row):
        out[i, j] = out[j, i] = v
    return out


def collinearity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, a, b, value): correlations, partial correlations and variance inflation."""
    r = correlations(df, columns)
    inv = np.linalg.inv(r)
    rows = []
    for i, a in enumerate(columns):
        rows.append(("vif", a, a, float(inv[i, i])))
        for j in range(i + 1, len(columns)):
            b = columns[j]
            rows.append(("correlation", a, b, float(r[i, j])))
            rows.append(("partial", a, b, float(-inv[i, j] / np.sqrt(inv[i, i] * inv[j, j]))))
    return df.sparkSession.createDataFrame(rows, "kind string, a string, b string, value double")


def omitted_shift(df: DataFrame, y: str, terms: list[str], omit: str) -> DataFrame:
    """How every coefficient moves when one term is left out."""
    full, short = ols(df, y, terms), ols(df, y, [t for t in terms if t != omit])
    at = dict(zip(full.names, full.beta))
    rows = [(n, float(at[n]), float(b), float(b - at[n])) for n, b in zip(short.names, short.beta)]
    return df.sparkSession.createDataFrame(
        rows, "term string, with_term double, without_term double, shift double")


def decompose(df: DataFrame, by: str, a, b, coefficients: dict[str, float]) -> DataFrame:
    """Coefficient times the change of each covariate's mean between two bins."""
    means = df.where(F.col(by).isin(a, b)).agg(*[
        F.avg(F.when(F.col(by) == v, F.col(c))).alias(f"{c}_{s}")
        for c in coefficients for s, v in (("a", a), ("b", b))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("term"), F.col(f"{c}_a").alias("mean_a"), F.col(f"{c}_b").alias("mean_b"),
        F.lit(float(k)).alias("coefficient")) for c, k in coefficients.items()]))
    return means.select(rows.alias("_r")).select("_r.*").withColumn(
        "contribution", F.col("coefficient") * (F.col("mean_b") - F.col("mean_a")))
