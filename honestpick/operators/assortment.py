"""Choice data and assortments under the multinomial logit.

A market's products are columns of an array in a fixed order given by `products`, so counts
are zero-filled without a grid, and an assortment is a bit mask over that order.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from honestpick.functions import draws as D
from honestpick.functions.lineage import save_table
from honestpick.operators.bootstrap import index_rows
from honestpick.operators.joins import join_null_safe, with_grid
from honestpick.operators.splits import split_rows

OUTSIDE = "outside"
MAX_ENUMERATED = 20      # products up to which all 2^n assortments may be listed


# --- counts and intercepts (M1-M3) ---------------------------------------------------------------

def choice_counts(choices: DataFrame, products: list[str], by: list[str] = ("market",),
                  weight: str | None = None) -> DataFrame:
    """(by..., product, n, n_outside) with zero rows for products nobody chose."""
    w = F.lit(1) if weight is None else F.col(weight)
    p = F.col("product")
    wide = choices.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(p == OUTSIDE, w)), F.lit(0)).cast("bigint").alias("n_outside"),
        *[F.coalesce(F.sum(F.when(p == x, w)), F.lit(0)).cast("bigint").alias(f"_n{i}")
          for i, x in enumerate(products)])
    cells = F.array(*[F.struct(F.lit(x).alias("product"), F.lit(i).alias("position"),
                               F.col(f"_n{i}").alias("n")) for i, x in enumerate(products)])
    return wide.select(*by, "n_outside", F.explode(cells).alias("_p")).select(
        *by, "_p.product", "_p.position", "_p.n", "n_outside")


def mnl_fixed_effects(counts: DataFrame) -> DataFrame:
    """Adds v = ln(n / n_outside), the exact maximum likelihood intercept; NULL for zero counts."""
    return counts.withColumn("v", F.when(
        (F.col("n") > 0) & (F.col("n_outside") > 0), F.log(F.col("n") / F.col("n_outside"))))


def mnl_loglik(effects: DataFrame, by: list[str] = ("market",)) -> DataFrame:
    """Log-likelihood of the counts at v, all products offered."""
    return effects.groupBy(*by).agg(
        (F.sum(F.coalesce(F.col("n") * F.col("v"), F.lit(0.0)))
         - (F.sum("n") + F.first("n_outside")) * F.log(1 + F.sum(F.coalesce(
             F.exp("v"), F.lit(0.0))))).alias("loglik"))


# --- probabilities and values (M4-M6) ---------------------------------------------------------------

def purchase_probs(effects: DataFrame, offered: Column, by: list[str] = ("market",)) -> DataFrame:
    """Choice probabilities with the outside option; `offered` marks the assortment's rows."""
    rows = effects.withColumn("_w", F.when(offered, F.coalesce(F.exp("v"), F.lit(0.0)))
                              .otherwise(F.lit(0.0)))
    total = rows.groupBy(*by).agg(F.sum("_w").alias("_t"))
    return rows.join(total, list(by)).withColumn("prob", F.col("_w") / (1 + F.col("_t"))).drop(
        "_w", "_t")


def market_weights(effects: DataFrame, by: list[str] = ("market",)) -> DataFrame:
    """(by..., weights ARRAY): exp(v) per product position, 0 where v is missing."""
    cell = F.struct("position", F.coalesce(F.exp("v"), F.lit(0.0)).alias("w"))
    return effects.groupBy(*by).agg(F.array_sort(F.collect_list(cell)).alias("_w")).select(
        *by, F.col("_w.w").alias("weights"))


def assortments(df: DataFrame, n_products: int, capacity: int) -> DataFrame:
    """Every row once per assortment of at most `capacity` products (bit j = product j)."""
    if n_products > MAX_ENUMERATED:
        raise ValueError(f"listing assortments is limited to {MAX_ENUMERATED} products")
    masks = F.sequence(F.lit(0).cast("bigint"), F.lit(2 ** n_products - 1).cast("bigint"))
    return df.withColumn("mask", F.explode(masks)).where(F.bit_count("mask") <= capacity)


def in_set(mask, j: int) -> Column:
    return F.shiftright(F.col(mask), j).bitwiseAND(F.lit(1)) == 1


def set_value(weights: str, n_products: int, mask: str = "mask") -> Column:
    """Probability that something is bought from the set: s / (1 + s)."""
    s = sum((F.when(in_set(mask, j), F.col(weights)[j]).otherwise(0.0)
             for j in range(n_products)), F.lit(0.0))
    return s / (1 + s)


def assortment_values(weights: DataFrame, n_products: int, capacity: int) -> DataFrame:
    return assortments(weights, n_products, capacity).withColumn(
        "value", set_value("weights", n_products))


# --- best sets (M7, M8) ---------------------------------------------------------------------------------

def best_assortment(effects: DataFrame, capacity: int, by: list[str] = ("market",)) -> DataFrame:
    """(by..., members, value): the `capacity` products with the largest v.

    The value rises with every exp(v), so no enumeration is needed for any number of products.
    Equal v go to the later product, the set an enumeration would meet first.  A market without
    any estimable v has no members and a NULL value.
    """
    w = Window.partitionBy(*by).orderBy(F.col("v").desc(), F.col("position").desc())
    top = (effects.where(F.col("v").isNotNull()).withColumn("_r", F.row_number().over(w))
           .where(F.col("_r") <= capacity))
    s = F.sum(F.exp("v"))
    best = top.groupBy(*by).agg(
        F.array_sort(F.collect_list("product")).alias("members"), (s / (1 + s)).alias("value"))
    return join_null_safe(effects.select(*by).distinct(), best, list(by)).withColumn(
        "members", F.coalesce("members", F.array().cast("array<string>")))


def posterior_assortment(draw_effects: DataFrame, n_products: int, capacity: int,
                         by: list[str] = ("market",), draw: str = "draw") -> DataFrame:
    """Best set by its mean value over a table of posterior draws of v."""
    by = list(by)
    weights = market_weights(draw_effects, [*by, draw])
    means = assortment_values(weights, n_products, capacity).groupBy(*by, "mask").agg(
        F.avg("value").alias("value"))
    # enumeration runs with the first product as the highest digit
    order = sum((F.when(in_set("mask", j), 2 ** (n_products - 1 - j)).otherwise(0)
                 for j in range(n_products)), F.lit(0))
    best = F.max_by(F.struct("mask", "value"), F.struct(F.round("value", 12), -order))
    return means.groupBy(*by).agg(best.alias("_w")).select(*by, "_w.*")


# --- corrections (M9, M10) ----------------------------------------------------------------------------------

def _top_sets(effects: DataFrame, capacities: list[int], keys: list[str]) -> DataFrame:
    """(keys..., capacity, position): members of the best set for every capacity."""
    w = Window.partitionBy(*keys).orderBy(F.col("v").desc(), F.col("position").desc())
    ranked = effects.where(F.col("v").isNotNull()).withColumn("_r", F.row_number().over(w)).where(
        F.col("_r") <= max(capacities))
    return ranked.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in capacities]))
                             ).where(F.col("_r") <= F.col("capacity")).drop("_r")


def _value(total) -> Column:
    return total / (1 + total)


def set_biases(drawn: DataFrame, effects: DataFrame, capacities: list[int],
               by: list[str] = ("market",), perturb: Column | None = None,
               draw_keys: list[str] = ()) -> DataFrame:
    """(by..., draw, capacity, bias): the resample's best set, resampled minus original value.

    `perturb` (a factor) values the set at v + factor * (v* - v) instead of at v*.
    """
    by = list(by)
    keys = [*by, *draw_keys, "draw"]
    picks = _top_sets(drawn, capacities, keys).select(
        *keys, "capacity", "position", F.col("v").alias("_new"))
    joined = picks.join(effects.select(*by, "position", "n_market", F.col("v").alias("_old")),
                        [*by, "position"])
    old = F.coalesce(F.col("_old"), F.lit(float("-inf")))
    new = F.col("_new") if perturb is None else old + perturb * (F.col("_new") - old)
    s_new, s_old = F.sum(F.exp(new)), F.sum(F.exp(old))
    return joined.groupBy(*keys, "capacity", "n_market").agg(
        (_value(s_new) - _value(s_old)).alias("bias"))


def market_effects(choices: DataFrame, products: list[str], by: list[str] = ("market",),
                   weight: str | None = None) -> DataFrame:
    """Intercepts with the market's number of records."""
    counts = choice_counts(choices, products, by, weight)
    total = counts.groupBy(*by).agg((F.sum("n") + F.first("n_outside")).alias("n_market"))
    return mnl_fixed_effects(counts).join(total, list(by))


def assortment_correct(choices: DataFrame, products: list[str], capacities: list[int],
                       draws: int, method: str = "standard", power: float | None = None,
                       by: list[str] = ("market",), seed: int = 42,
                       fast: bool = False) -> DataFrame:
    """Standard (Poisson), m-out-of-n (exact, scaled sqrt(m/N)) or numerical bootstrap.

    Several capacities (rules) share the same resamples and intercepts.
    """
    by = list(by)
    effects = save_table(market_effects(choices, products, by))
    rows = choices.select(*by, "row_id", "product")
    perturb = None
    if method == "moon":
        if power is None or not 0 < power < 1:
            raise ValueError("power must be in (0, 1)")
        sizes = effects.select(*by, F.col("n_market").alias("n")).distinct()
        drawn = index_rows(rows, sizes, draws, by, ["product"], "row_id", [power], seed, "choice-moon",
                           fast)
        counts = choice_counts(drawn, products, [*by, "draw"])
    elif method in ("standard", "numerical"):
        drawn = D.with_poisson_weights(rows, draws, [*by, "row_id"], seed, "choice-" + method,
                                       fast)
        counts = choice_counts(drawn, products, [*by, "draw"], "weight")
        if method == "numerical":
            if power is None or not -0.5 < power < 0:
                raise ValueError("power must be in (-0.5, 0)")
            perturb = F.pow("n_market", F.lit(power)) * F.sqrt("n_market")
    else:
        raise ValueError(f"unknown method {method!r}")
    biases = set_biases(mnl_fixed_effects(counts), effects, capacities, by, perturb)
    if method == "moon":
        biases = biases.withColumn("bias", F.col("bias") * F.sqrt(
            F.floor(F.pow("n_market", F.lit(power))) / F.col("n_market")))
    naive = _top_sets(effects, capacities, by).groupBy(*by, "capacity").agg(
        _value(F.sum(F.exp("v"))).alias("naive"))
    mean = biases.groupBy(*by, "capacity").agg(F.avg("bias").alias("bias"))
    # a market without an estimable set, or without a usable draw, keeps its row
    every = with_grid(effects.select(*by).distinct(), capacity=capacities)
    keys = [*by, "capacity"]
    return join_null_safe(join_null_safe(every, naive, keys), mean, keys).select(
        *by, "capacity", F.lit(method).alias("estimator"), "naive",
        (F.col("naive") - F.col("bias")).alias("corrected"), "bias")


def assortment_split(choices: DataFrame, products: list[str], capacities: list[int],
                     fraction: float = 0.5, splits: int = 1, by: list[str] = ("market",),
                     seed: int = 42, fast: bool = False) -> DataFrame:
    """Pick the set on one part of a market's records, value it on the rest."""
    by = list(by)
    keys = [*by, "split_id"]
    parts = split_rows(choices.select(*by, "row_id", "product"), fraction, splits, by, "row_id",
                       seed, "choice-split", fast)
    effects = save_table(mnl_fixed_effects(choice_counts(parts, products, [*keys, "in_est"])))
    picks = _top_sets(effects.where("in_est"), capacities, keys).select(
        *keys, "capacity", "position", F.col("v").alias("_est"))
    held = effects.where("NOT in_est").select(*keys, "position", F.col("v").alias("_eval"))
    values = picks.join(held, [*keys, "position"]).groupBy(*keys, "capacity").agg(
        _value(F.sum(F.exp("_est"))).alias("est_value"),
        _value(F.sum(F.coalesce(F.exp("_eval"), F.lit(0.0)))).alias("corrected"))
    # a market whose part has no usable counts keeps its row, with NULL values
    every = with_grid(D.with_draws(choices.select(*by).distinct(), splits, "split_id"),
                      capacity=capacities)
    return every.join(values, [*keys, "capacity"], "left")
