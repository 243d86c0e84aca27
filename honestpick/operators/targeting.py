"""Per-customer options: fit, predict, pick, value and correct a policy.

A customer's effects are arrays over the K arms, so picking an arm needs no shuffle.  The
value of a policy depends on a customer only through the features, so before customers are
combined with draws they are folded to distinct feature vectors with a count.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from honestpick.functions import draws as D
from honestpick.functions.columns import all_of, attach_row
from honestpick.functions.lineage import save_table
from honestpick.operators import selective as S, shrink as H
from honestpick.operators.bootstrap import index_rows
from honestpick.operators.forests import (ForestSettings, forest_value, forests_by_treatment,
                                          grow_forests)
from honestpick.operators.splits import split_rows

OUTLIER = 20.0


# --- fit and predict (T1, T2, T4) -------------------------------------------------------------

def basis(features: list[str], intercept: bool = True) -> list[Column]:
    """Squares, then the features, then 1."""
    cols = [F.col(f) * F.col(f) for f in features] + [F.col(f) for f in features]
    return cols + ([F.lit(1.0)] if intercept else [])


_SOLVED = T.StructType([T.StructField("beta", T.ArrayType(T.DoubleType())),
                        T.StructField("inv", T.ArrayType(T.DoubleType())),
                        T.StructField("sigma2", T.DoubleType())])


@F.pandas_udf(_SOLVED)
def _solve(gram: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Normal equations of a batch of small fits; NULL where the design is singular."""
    out = {"beta": [], "inv": [], "sigma2": []}
    for g, b, total, rows in zip(gram, xy, yy, n):
        k = len(b)
        a = np.zeros((k, k))
        a[np.triu_indices(k)] = g
        a = a + np.triu(a, 1).T
        b = np.asarray(b, float)
        try:
            scale = 1 / np.sqrt(np.diag(a))
            inv = np.linalg.inv(a * np.outer(scale, scale)) * np.outer(scale, scale)
            beta = inv @ b
            s2 = (total - beta @ b) / (rows - k) if rows > k else None
            fine = np.all(np.isfinite(beta)) and np.all(np.isfinite(inv))
        except np.linalg.LinAlgError:
            fine = False
        out["beta"].append(beta if fine else None)
        out["inv"].append(inv.ravel() if fine else None)
        out["sigma2"].append(s2 if fine else None)
    return pd.DataFrame(out)


def fit_arm_ols(train: DataFrame, features: list[str], by: list[str] = (), t: str = "t",
                y: str = "y", weight: str | None = None, intercept: bool = True) -> DataFrame:
    """(by..., arm, n, beta, inv, sigma2): OLS of y per treatment t = 1.., arm = t - 1.

    One grouped sum of cross products (folded on the map side); only those sums are solved.
    """
    x = basis(features, intercept)
    k = len(x)
    w = F.lit(1.0) if weight is None else F.col(weight)
    cols = {f"_x{i}": c for i, c in enumerate(x)}
    rows = train.where(F.col(y).isNotNull()).select(*by, (F.col(t) - 1).alias("arm"), F.col(y).alias("_y"), w.alias("_w"),
                        *[c.alias(n) for n, c in cols.items()])
    names = list(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.groupBy(*by, "arm").agg(
        F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("_yy"),
        *[F.sum(F.col("_w") * F.col(names[i]) * F.col("_y")).alias(f"_b{i}") for i in range(k)],
        *[F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])).alias(f"_g{i}_{j}")
          for i, j in pairs])
    solved = sums.withColumn("_s", _solve(
        F.array(*[f"_g{i}_{j}" for i, j in pairs]), F.array(*[f"_b{i}" for i in range(k)]),
        F.col("_yy"), F.col("n")))
    return solved.select(*by, "arm", "n", "_s.*")


def _coefficients(fits: DataFrame, n_arms: int, by: list[str], variances: bool) -> DataFrame:
    """One row per `by` with a struct column c0..cK-1 per arm."""
    parts = ["beta", "inv", "sigma2"] if variances else ["beta"]
    return fits.groupBy(*by).agg(*[F.first(F.when(F.col("arm") == a, F.struct(*parts)),
                                           ignorenulls=True).alias(f"_c{a}")
                                   for a in range(n_arms)])


def repair_outliers(effects: Column, n_arms: int, threshold: float = OUTLIER) -> Column:
    """Entries beyond the threshold become the mean of the row's other entries, 0 if none."""
    cells = [effects[a] for a in range(n_arms)]
    fine = [F.abs(c) <= threshold for c in cells]
    total = sum((F.when(ok, c).otherwise(0.0) for ok, c in zip(fine, cells)), F.lit(0.0))
    count = sum((ok.cast("int") for ok in fine), F.lit(0))
    mean = F.coalesce(F.try_divide(total, count), F.lit(0.0))
    return F.array(*[F.when(F.abs(c) > threshold, mean).otherwise(c) for c in cells])


def _effects(x: list[Column], n_arms: int, prefix: str = "_c") -> Column:
    return F.array(*[sum((F.col(f"{prefix}{a}.beta")[i] * c for i, c in enumerate(x)),
                         F.lit(0.0)) for a in range(n_arms)])


def _variances(x: list[Column], n_arms: int, prefix: str = "_c") -> Column:
    k = len(x)
    return F.array(*[F.col(f"{prefix}{a}.sigma2") * sum(
        (F.col(f"{prefix}{a}.inv")[i * k + j] * x[i] * x[j] * (1 if i == j else 2)
         for i in range(k) for j in range(i, k)), F.lit(0.0)) for a in range(n_arms)])


def predict_effects(target: DataFrame, fits: DataFrame, features: list[str], n_arms: int,
                    outlier: float | None = OUTLIER, variances: bool = True,
                    intercept: bool = True) -> DataFrame:
    """Target rows with `effects` (and `vars`) arrays over the arms.

    The fitted coefficients of K arms are one row, broadcast to all customers.
    """
    x = basis(features, intercept)
    joined = attach_row(target, _coefficients(fits, n_arms, [], variances))
    out = joined.withColumn("effects", _effects(x, n_arms))
    if variances:
        out = out.withColumn("vars", _variances(x, n_arms))
    if outlier is not None:
        out = out.withColumn("effects", repair_outliers(F.col("effects"), n_arms, outlier))
    return out.drop(*[f"_c{a}" for a in range(n_arms)])


def long_effects(predicted: DataFrame, keys: list[str], n_arms: int) -> DataFrame:
    """(keys..., arm, effect[, var])."""
    fields = ["effects", "vars"] if "vars" in predicted.columns else ["effects"]
    names = {"effects": "effect", "vars": "var"}
    cells = F.array(*[F.struct(F.lit(a).alias("arm"), *[F.col(f)[a].alias(names[f])
                                                        for f in fields]) for a in range(n_arms)])
    return predicted.select(*keys, F.explode(cells).alias("_e")).select(*keys, "_e.*")


def replace_outliers(effects: DataFrame, threshold: float = OUTLIER,
                     key: str = "customer_id") -> DataFrame:
    """The repair on a long table (customer, arm, effect)."""
    w = Window.partitionBy(key)
    fine = F.abs("effect") <= threshold
    mean = F.coalesce(F.avg(F.when(fine, F.col("effect"))).over(w), F.lit(0.0))
    return effects.withColumn("effect", F.when(~fine, mean).otherwise(F.col("effect")))


# --- models (T1-T3) ----------------------------------------------------------------------------

@dataclass(frozen=True)
class QuadraticModel:
    """Ordinary least squares per treatment on squares and features.

    A model has `features`, `n_arms`, fit(rows, by, weight) -> (by..., model, fitted) with one row
    per group, and effects(name) (variances(name), where it has them) as arrays over the arms of
    a row that holds the features and the struct column `name`.  Any object with these can be
    corrected by the functions below.
    """
    features: list[str]
    n_arms: int
    intercept: bool = True

    def fit(self, rows: DataFrame, by: list[str] = (), weight: str | None = None) -> DataFrame:
        fits = fit_arm_ols(rows, self.features, by, weight=weight, intercept=self.intercept)
        packed = _coefficients(fits, self.n_arms, list(by), True)
        arms = range(self.n_arms)
        return packed.select(
            *by, F.struct(*[F.col(f"_c{a}").alias(f"c{a}") for a in arms]).alias("model"),
            all_of([F.col(f"_c{a}.beta").isNotNull() for a in arms]).alias("fitted"))

    def effects(self, name: str) -> Column:
        return _effects(basis(self.features, self.intercept), self.n_arms, f"{name}.c")

    def variances(self, name: str) -> Column:
        return _variances(basis(self.features, self.intercept), self.n_arms, f"{name}.c")


@dataclass(frozen=True)
class ForestModel:
    """A bagged forest per treatment t = 1.., minus that of `control`, if there is one."""
    features: list[str]
    n_arms: int
    control: int | None = None
    settings: ForestSettings = ForestSettings()
    row_key: str = "row_id"
    t: str = "t"
    y: str = "y"

    def fit(self, rows: DataFrame, by: list[str] = (), weight: str | None = None) -> DataFrame:
        if weight is None and by:
            # a resample may hold a row several times
            rows = rows.groupBy(*by, self.row_key, self.t, self.y, *self.features).agg(
                F.count(F.lit(1)).alias("_times"))
            weight = "_times"
        grown = grow_forests(rows, self.features, by, self.t, self.y, self.row_key, weight,
                             self.settings)
        trees = forests_by_treatment(grown, list(by), self.t)
        wanted = [*range(1, self.n_arms + 1), *([] if self.control is None else [self.control])]
        packed = trees.groupBy(*by).agg(*[F.first(F.when(F.col(self.t) == k, F.col("trees")),
                                                  ignorenulls=True).alias(f"c{k}") for k in wanted])
        return packed.select(*by, F.struct(*[f"c{k}" for k in wanted]).alias("model"),
                             all_of([F.col(f"c{k}").isNotNull() for k in wanted]).alias("fitted"))

    def effects(self, name: str) -> Column:
        def value(k):
            return forest_value(F.col(f"{name}.c{k}"), self.features, self.settings.depth)
        base = F.lit(0.0) if self.control is None else value(self.control)
        return F.array(*[value(k) - base for k in range(1, self.n_arms + 1)])


def predict(target: DataFrame, model, fits: DataFrame, outlier: float | None = OUTLIER) -> DataFrame:
    """Target rows with the model's `effects` (and `vars`, where it has variances); `fits` is the
    one row of model.fit()."""
    out = attach_row(target, fits.select(F.col("model").alias("_model")))
    out = out.withColumn("effects", model.effects("_model"))
    if hasattr(model, "variances"):
        out = out.withColumn("vars", model.variances("_model"))
    if outlier is not None:
        out = out.withColumn("effects", repair_outliers(F.col("effects"), model.n_arms, outlier))
    return out.drop("_model")


def fit_forest_effects(train: DataFrame, target: DataFrame, features: list[str], n_arms: int,
                       control: int = 0, depth: int = 5, trees: int = 20, t: str = "t",
                       y: str = "y", seed: int = 42, row_key: str = "row_id",
                       fast: bool = False) -> DataFrame:
    """Target rows with an `effects` array: one forest per treatment minus control's.

    With `control` None the arms' own predictions are returned.
    """
    model = ForestModel(features, n_arms, control, ForestSettings(depth, trees, seed=seed,
                                                                  fast=fast), row_key, t, y)
    return predict(target, model, save_table(model.fit(train)), None)


# --- policies (T5-T7) ---------------------------------------------------------------------------

def best_arm(effects="effects") -> Column:
    """0-based position of the largest entry, the first one on ties."""
    e = F.col(effects) if isinstance(effects, str) else effects
    return (F.array_position(e, F.array_max(e)) - 1).cast("int")


def target_policy(predicted: DataFrame, scores: Column | None = None) -> DataFrame:
    """Adds `arm` and its `value`; `scores` may be any array expression to pick by."""
    pick = best_arm("effects" if scores is None else scores)
    return predicted.withColumn("arm", pick).withColumn(
        "value", F.get("effects", F.col("arm")))


def risk_adjusted(n_arms: int, k: float) -> Column:
    """Scores effect - k * standard error, a pluggable rule for target_policy."""
    return F.array(*[F.col("effects")[a] - k * F.sqrt(F.col("vars")[a]) for a in range(n_arms)])


def policy_value(policy: DataFrame) -> DataFrame:
    return policy.agg(F.count(F.lit(1)).alias("customers"), F.avg("value").alias("value"))


def evaluate_policy(policy: DataFrame, effects: DataFrame,
                    key: str = "customer_id") -> DataFrame:
    """The same picks valued under other (long) effects."""
    return policy.select(key, "arm").join(effects.select(key, "arm", "effect"), [key, "arm"]).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("effect").alias("value"))


# --- bootstrap corrections (T8-T11) ---------------------------------------------------------------

def fold_target(target: DataFrame, features: list[str]) -> DataFrame:
    """Distinct feature vectors with their number of customers."""
    return target.groupBy(*features).agg(F.count(F.lit(1)).alias("_m"))


def draw_biases(target: DataFrame, fits: DataFrame, drawn_fits: DataFrame, model, draws: int,
                scale=1.0, outlier: float | None = OUTLIER, scores: Column | None = None,
                draw: str = "draw") -> DataFrame:
    """(draw, bias): policy of the resampled fit, resampled minus original value.

    The policy picks by `scores`, an array expression over the resample's `effects` and `vars`
    (the effects themselves when None).  A draw in which some arm could not be fitted is left out.
    """
    base = attach_row(fold_target(target, model.features),
                      fits.select(F.col("model").alias("_base")))
    base = base.withColumn("_original", _repaired(model.effects("_base"), model.n_arms, outlier)
                           ).drop("_base")
    # models are saved, so Spark knows their size: they are broadcast if small
    models = save_table(drawn_fits.where("fitted").select(draw, "model"))
    joined = D.with_draws(base, draws, draw).join(models, draw)
    picked = _picked(joined, model, "model", outlier, scores)
    gap = F.get("effects", F.col("_a")) - F.get("_original", F.col("_a"))
    return picked.groupBy(draw).agg(
        (F.sum(F.col("_m") * gap) / F.sum("_m")).alias("_raw")).select(
        draw, (F.col("_raw") * scale).alias("bias"))


def _repaired(effects: Column, n_arms: int, outlier: float | None) -> Column:
    return effects if outlier is None else repair_outliers(effects, n_arms, outlier)


def _picked(rows: DataFrame, model, name: str, outlier: float | None,
            scores: Column | None) -> DataFrame:
    """Adds the model's effects (and vars, for scores) and the picked arm `_a`."""
    out = rows.withColumn("effects", model.effects(name))
    if outlier is not None:
        out = out.withColumn("effects", repair_outliers(F.col("effects"), model.n_arms, outlier))
    if scores is not None and hasattr(model, "variances"):
        out = out.withColumn("vars", model.variances(name))
    return out.withColumn("_a", best_arm("effects" if scores is None else scores))


def _corrected(target, fits, biases, model, estimator, outlier, scores) -> DataFrame:
    naive = policy_value(target_policy(predict(target, model, fits, outlier), scores))
    mean = biases.agg(F.avg("bias").alias("bias"), F.count(F.lit(1)).alias("draws"))
    return attach_row(naive, mean).select(
        F.lit(estimator).alias("estimator"), F.col("value").alias("naive"),
        (F.col("value") - F.col("bias")).alias("corrected"), "bias", "draws")


def policy_correct_standard(train: DataFrame, target: DataFrame, features: list[str],
                            n_arms: int, draws: int, row_key: str = "row_id",
                            outlier: float | None = OUTLIER, seed: int = 42,
                            fast: bool = False, power: float | None = None, model=None,
                            scores: Column | None = None) -> DataFrame:
    """Pooled resampling of the training rows by Poisson weights.

    `model` is any model (see QuadraticModel, the default), `scores` the policy's rule.
    With `power` in (-0.5, 0): the numerical bootstrap, biases scaled by n^power * sqrt(n).
    """
    model = model or QuadraticModel(features, n_arms)
    slim = train.where("y IS NOT NULL").select(row_key, *features, "t", "y")
    fits = save_table(model.fit(slim))
    weighted = D.with_poisson_weights(slim, draws, [row_key], seed,
                                      "policy" if power is None else "policy-num", fast)
    biases = draw_biases(target, fits, model.fit(weighted, ["draw"], "weight"), model, draws,
                         outlier=outlier, scores=scores)
    if power is not None:
        if not -0.5 < power < 0:
            raise ValueError("power must be in (-0.5, 0)")
        size = slim.agg(F.count(F.lit(1)).alias("_n"))
        biases = attach_row(biases, size).withColumn(
            "bias", F.col("bias") * F.pow("_n", F.lit(power)) * F.sqrt("_n")).drop("_n")
    name = "standard" if power is None else "numerical"
    return _corrected(target, fits, biases, model, name, outlier, scores)


def moon_policy_scale(sizes: DataFrame, power: float) -> DataFrame:
    """One row: sqrt(sum m_k / sum n_k) over the arms' sizes n."""
    return sizes.agg(F.sqrt(F.sum(F.floor(F.pow("n", F.lit(power)))) / F.sum("n"))
                     .alias("_scale"))


def policy_correct_moon(train: DataFrame, target: DataFrame, features: list[str], n_arms: int,
                        draws: int, power: float, row_key: str = "row_id",
                        outlier: float | None = OUTLIER, seed: int = 42,
                        fast: bool = False, model=None,
                        scores: Column | None = None) -> DataFrame:
    """floor(n_k^power) rows drawn within every arm; biases scaled by sqrt(sum m / sum n)."""
    if not 0 < power < 1:
        raise ValueError("power must be in (0, 1)")
    model = model or QuadraticModel(features, n_arms)
    train = train.where("y IS NOT NULL")
    fits = save_table(model.fit(train))
    sizes = save_table(train.groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    carry = [*features, "y", *([] if isinstance(model, QuadraticModel) else [row_key])]
    rows = index_rows(train, sizes, draws, ["t"], carry, row_key, [power], seed, "policy-moon",
                      fast)
    biases = attach_row(draw_biases(target, fits, model.fit(rows, ["draw"]), model, draws,
                                    outlier=outlier, scores=scores),
                        moon_policy_scale(sizes, power))
    biases = biases.withColumn("bias", F.col("bias") * F.col("_scale")).drop("_scale")
    return _corrected(target, fits, biases, model, "moon", outlier, scores)


def policy_correct_numerical(*args, power: float = -0.45, **kw) -> DataFrame:
    return policy_correct_standard(*args, power=power, **kw)


def policy_correct(method: str, *args, **kw) -> DataFrame:
    table = {"standard": policy_correct_standard, "moon": policy_correct_moon,
             "numerical": policy_correct_numerical}
    if method not in table:
        raise ValueError(f"unknown method {method!r}")
    return table[method](*args, **kw)


def valid_draws(drawn: DataFrame, rows: DataFrame, strata: list[str], min_count: int,
                wanted: int, weight: str | None = None, draw: str = "draw") -> DataFrame:
    """The first `wanted` draws in which every stratum of `rows` has at least `min_count` rows.

    (draw, rank); fails the job when there are fewer.  `drawn` holds the attempted draws.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    needed = rows.select(*strata).distinct()
    n_strata = needed.agg(F.count(F.lit(1)).alias("_strata"))
    good = (drawn.groupBy(draw, *strata).agg(F.sum(w).alias("_k"))
            .where(F.col("_k") >= min_count).groupBy(draw).agg(F.count(F.lit(1)).alias("_ok")))
    kept = attach_row(good, n_strata).where(F.col("_ok") == F.col("_strata")).select(draw)
    # one row, also when no draw is good, so that falling short always shows
    first = kept.orderBy(draw).limit(wanted).agg(F.sort_array(F.collect_list(draw)).alias("_d"))
    checked = F.when(F.size("_d") < wanted, F.raise_error(F.lit(
        "too few draws with enough rows in every stratum")).cast("array<int>")).otherwise(
        F.col("_d"))
    return first.select(F.explode(checked).alias(draw))


# --- shrinkage, splits, selective inference (T13-T16) -----------------------------------------------

def policy_bayes_normal(policy: DataFrame, mean: float, std: float) -> DataFrame:
    """Picks kept, their effects shrunk to a normal prior.  `policy` has effects, vars, arm."""
    p = float(std) ** 2
    s = p / (p + F.get("vars", F.col("arm")))
    value = s * F.col("value") + (1 - s) * float(mean)
    return policy.agg(F.count(F.lit(1)).alias("customers"), F.avg("value").alias("naive"),
                      F.avg(value).alias("corrected"))


def policy_eb(predicted: DataFrame, prior: str, n_arms: int, key: str = "customer_id",
              **kw) -> DataFrame:
    """Prior per arm over customers: 'normal', 'tweedie' or 'spike_slab'; picks kept.

    The corrected value is NULL when a picked arm's fit failed.  With 'spike_slab', `converged`
    says whether the fits of all arms did within `max_iter` steps.
    """
    long = long_effects(predicted, [key], n_arms)
    fits = None
    if prior == "normal":
        post = H.posterior_eb_normal(long, ["arm"])
    elif prior == "tweedie":
        post = H.posterior_eb_tweedie(long, ["arm"], **kw)
    elif prior == "spike_slab":
        fits = H.spike_slab_fit(long, ["arm"], **kw)
        post = H.posterior_spike_slab(long, fits, ["arm"])
    else:
        raise ValueError(f"unknown prior {prior!r}")
    picks = target_policy(predicted).select(key, "arm")
    out = picks.join(post, [key, "arm"]).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("effect").alias("naive"),
        F.avg("posterior").alias("corrected"),
        F.count_if(F.col("posterior").isNull()).alias("failed"))
    out = out.withColumn("corrected", F.when(F.col("failed") == 0, F.col("corrected")))
    return out if fits is None else attach_row(out, fits.agg(
        F.bool_and("converged").alias("converged")))


def policy_split(train: DataFrame, target: DataFrame, features: list[str], n_arms: int,
                 fraction: float = 0.5, splits: int = 1, row_key: str = "row_id",
                 outlier: float | None = OUTLIER, seed: int = 42, fast: bool = False,
                 model=None, scores: Column | None = None) -> DataFrame:
    """Fit and pick on one part, refit on the rest for the value; one row per split.

    A split whose parts could not both be fitted is left out.
    """
    model = model or QuadraticModel(features, n_arms)
    parts = split_rows(train.where("y IS NOT NULL").select(row_key, *features, "t", "y"), fraction,
                       splits, [], row_key, seed, "policy-split", fast)
    if not isinstance(model, QuadraticModel):
        parts = parts.withColumn("_once", F.lit(1))
    weight = None if isinstance(model, QuadraticModel) else "_once"
    fits = save_table(model.fit(parts, ["split_id", "in_est"], weight).where("fitted"))
    sides = [fits.where(F.col("in_est") == side).select("split_id", F.col("model").alias(name))
             for side, name in ((True, "_est"), (False, "_eval"))]
    joined = D.with_draws(fold_target(target, features), splits, "split_id").join(
        sides[0], "split_id").join(sides[1], "split_id")
    picked = _picked(joined, model, "_est", outlier, scores).withColumn(
        "_v", _repaired(model.effects("_eval"), n_arms, outlier))
    m = F.col("_m")
    return picked.groupBy("split_id").agg(
        (F.sum(m * F.get("effects", F.col("_a"))) / F.sum(m)).alias("est_value"),
        (F.sum(m * F.get("_v", F.col("_a"))) / F.sum(m)).alias("corrected"))


def policy_si(predicted: DataFrame, features: list[str], n_arms: int, method: str = "hybrid",
              q: float = 0.5) -> DataFrame:
    """Selective inference for every customer's pick.

    Customers with equal features share one solve.  An unsolved pick keeps its plain effect and
    is counted.
    """
    folded = predicted.groupBy(*features).agg(
        F.count(F.lit(1)).alias("_m"), F.first("effects").alias("effects"),
        F.first("vars").alias("vars"))
    policy = target_policy(folded)
    ordered = F.sort_array("effects", asc=False)
    rows = policy.select(
        "_m", F.col("value").alias("naive"), F.sqrt(F.get("vars", F.col("arm"))).alias("sd"),
        F.get(ordered, F.lit(1)).alias("runner_up"), F.lit(n_arms).alias("n_arms")).withColumn(
        "status", S.solvable()).withColumn("_c", S.root_column(method, q))
    m = F.col("_m")
    return rows.agg(
        F.sum(m).alias("customers"), (F.sum(m * F.col("naive")) / F.sum(m)).alias("naive"),
        (F.sum(m * F.coalesce("_c", "naive")) / F.sum(m)).alias("corrected"),
        F.coalesce(F.sum(F.when(F.col("_c").isNull(), m)), F.lit(0)).alias("not_converged"))
