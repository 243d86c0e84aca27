"""Resampling corrections.

A draw is a key column, so every correction is: resampled arm means keyed by draw, the best
arm per draw, its resampled minus its original mean, and the average over draws.  Extra keys
(split, outer draw, power) ride along in `by`; nothing loops over them.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from honestpick.functions import draws as D
from honestpick.functions.columns import winner_of
from honestpick.functions.lineage import cut_lineage, save_table
from honestpick.functions.ranks import id_bucket, prefix_bucket, with_position
from honestpick.operators.effects import TEST, arm_effects, select_winner

BLOCK = 50_000       # slots of one draw unfolded at a time
SALTS = {"standard": "std", "moon": "moon", "numerical": "num", "conditional": "cond",
         "outer": "outer", "inner": "inner"}


# --- resampling (B1, B2) ---------------------------------------------------------------

def poisson_draws(rows: DataFrame, draws: int, by: list[str] = TEST, arm: str = "arm",
                  value: str = "y", row_key: list[str] = ("row_id",), seed: int = 42,
                  salt: str = "std", fast: bool = False, first: int = 0) -> DataFrame:
    """(by..., arm, draw, n, effect): weighted means under Poisson(1) row weights.

    Row copies are folded into arm sums before the shuffle, so what moves is arms x draws
    per task however many rows an arm has.
    """
    keys = list(dict.fromkeys([*by, arm, *row_key]))
    slim = observed(rows, value).select(*dict.fromkeys([*keys, value]))
    weighted = D.with_poisson_weights(slim, draws, keys, seed, salt, fast, first=first)
    return weighted.groupBy(*by, arm, "draw").agg(
        F.sum("weight").alias("n"),
        (F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("effect"))


def observed(rows: DataFrame, value: str) -> DataFrame:
    """Rows with an outcome: the others count neither in sizes nor in draws, folds or positions."""
    return rows.where(F.col(value).isNotNull())


def numbered(rows: DataFrame, by: list[str], arm: str, row_key: str) -> DataFrame:
    """Rows with their position inside the arm, in the key's own order, and the arm's size."""
    kind = rows.schema[row_key].dataType
    cut = id_bucket if isinstance(kind, T.NumericType) else prefix_bucket
    return with_position(rows, [*by, arm], [row_key], cut(rows, [*by, arm], row_key))


def slots(sizes: DataFrame, draws: int, strata: list[str],
          powers: list[float] | None = None) -> DataFrame:
    """(strata..., [power,] draw, pos, n): the m slots of every draw, made from sizes alone.

    Slots come in blocks that are spread over the cluster before they are unfolded, so a
    stratum with billions of rows is not one task.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out, m, keys = sizes.select(*strata, "n"), F.col("n"), [*strata, "draw"]
    if powers is not None:
        out = out.withColumn("power", F.explode(F.array(*[F.lit(p) for p in powers])))
        m, keys = F.floor(F.pow("n", "power")), [*strata, "power", "draw"]
    last = F.col("_m") - 1
    blocks = D.with_draws(out.withColumn("_m", m.cast("bigint")).where("_m > 0"), draws).withColumn(
        "_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / BLOCK))))
    start = F.col("_blk") * BLOCK
    return blocks.repartition(parts, *keys, "_blk").select(
        *keys, "n", F.explode(F.sequence(start, F.least(start + BLOCK - 1, last))).alias("pos"))


def index_rows(rows: DataFrame, sizes: DataFrame, draws: int, strata: list[str],
               carry: list[str], row_key: str = "row_id", powers: list[float] | None = None,
               seed: int = 42, salt: str = "moon", fast: bool = False) -> DataFrame:
    """Rows drawn with replacement: n per stratum and draw, or floor(n^power) per power.

    Each slot of a draw hashes to a position and fetches that row by an equi-join on
    (strata, position), whose keys are spread evenly even when one stratum holds most rows.
    `sizes` is (strata..., n); with `powers` a `power` key is added.
    """
    keys = [*strata, "pos", "draw"]
    power_key = []
    if powers is not None:
        keys.append((F.col("power") * 1000).cast("int"))
        power_key = ["power"]
    wanted = slots(sizes, draws, strata, powers).select(
        *strata, *power_key, "draw",
        (D.hash48(keys, seed, salt, fast) % F.col("n")).alias("pos"))
    num = numbered(rows.select(*strata, row_key, *carry), strata[:-1], strata[-1], row_key)
    # Spark takes the slots for as few as the sizes they are unfolded from, and would broadcast them
    return wanted.hint("merge").join(num.select(*strata, "pos", *carry), [*strata, "pos"]).drop("pos")


def index_draws(rows: DataFrame, sizes: DataFrame, draws: int, by: list[str] = TEST,
                arm: str = "arm", value: str = "y", row_key: str = "row_id",
                powers: list[float] | None = None, seed: int = 42, salt: str = "moon",
                fast: bool = False) -> DataFrame:
    """(by..., [power,] arm, draw, n, effect): means of exact resamples within the arm."""
    drawn = index_rows(observed(rows, value), sizes, draws, [*by, arm], [value], row_key, powers,
                       seed, salt, fast)
    return drawn.groupBy(*by, *(["power"] if powers is not None else []), arm, "draw").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("effect"))


def poisson_moon_draws(rows: DataFrame, sizes: DataFrame, draws: int, power: float,
                       by: list[str] = TEST, arm: str = "arm", value: str = "y",
                       row_key: list[str] = ("row_id",), seed: int = 42, salt: str = "moon",
                       fast: bool = False) -> DataFrame:
    """m-out-of-n with Poisson(m/n) weights: one pass, no positions, random draw size.

    `sizes` is (by..., arm, n), e.g. the effects.
    """
    keys = list(dict.fromkeys([*by, arm, *row_key, "draw"]))
    rate = F.floor(F.pow("n", F.lit(power))) / F.col("n")
    joined = observed(rows, value).select(*dict.fromkeys([*by, arm, *row_key, value])).join(
        sizes.select(*by, arm, rate.alias("_rate")), [*by, arm])
    drawn = D.with_draws(joined, draws).withColumn(
        "weight", D.poisson_rate_weight(D.uniform(keys, seed, salt, fast), F.col("_rate")))
    return drawn.where("weight > 0").groupBy(*by, arm, "draw").agg(
        F.sum("weight").alias("n"),
        (F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("effect"))


def count_draws(effects: DataFrame, draws: int, by: list[str] = TEST, arm: str = "arm",
                power: float | None = None, seed: int = 42, salt: int = 101) -> DataFrame:
    """Binomial resampling of 0/1 outcomes from counts alone: cost grows with arms, not rows.

    `effects` has n and effect (the rate).  m = max(1, floor(n^power)).
    """
    size = F.col("n") if power is None else F.greatest(
        F.lit(1), F.floor(F.pow("n", F.lit(power))))
    made = effects.select(*by, arm, size.cast("bigint").alias("n"), "effect").withColumn(
        "_k", D.binomial_array(F.col("n"), F.col("effect"),
                               D.row_seed([*by, arm], seed, salt), draws))
    return made.select(*by, arm, "n", F.posexplode("_k").alias("draw", "_c")).select(
        *by, arm, "draw", "n", (F.col("_c") / F.col("n")).alias("effect"))


DRAW_BLOCK = 100     # draws that one row holds as an array


def count_blocks(effects: DataFrame, draws: int, by: list[str] = TEST, arm: str = "arm",
                 power: float | None = None, seed: int = 42, salt: int = 101) -> DataFrame:
    """(by..., block, n_arms, n_avg, arms): count_draws() as arrays, one row per block of draws.

    `arms` is an array of (arm, m, n, original, clicks), clicks being an array over the block's
    draws, so that what is shuffled is arms x blocks, and a draw's winner is found in its row.
    """
    blocks = -(-draws // DRAW_BLOCK)
    m = F.col("n") if power is None else F.greatest(F.lit(1), F.floor(F.pow("n", F.lit(power))))
    sized = effects.select(*by, arm, "n", m.cast("bigint").alias("_m"), "effect").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # arms meet before they are drawn: few bytes, but much work, so over all partitions
    parts = int(effects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = sized.repartition(parts, *by, "block").withColumn("_k", D.binomial_array(
        F.col("_m"), F.col("effect"), D.row_seed([*by, arm, "block"], seed, salt),
        min(draws, DRAW_BLOCK)))
    wanted = F.least(F.lit(DRAW_BLOCK), F.lit(draws) - F.col("block") * DRAW_BLOCK)
    entry = F.struct(F.col(arm).alias("arm"), F.col("_m").alias("m"), F.col("n").alias("n"),
                     F.col("effect").alias("original"), F.slice("_k", 1, wanted).alias("clicks"))
    return made.groupBy(*by, "block").agg(F.array_sort(F.collect_list(entry)).alias("arms"),
                                          F.avg("n").alias("n_avg"))


def block_biases(blocks: DataFrame, by: list[str] = TEST, scale: Column | None = None) -> DataFrame:
    """(by..., biases): per draw, the best arm's resampled minus original effect, ties to the
    lowest arm."""
    def best(i):
        return F.array_max(F.transform("arms", lambda x: F.struct(
            (F.get(x["clicks"], i) / x["m"]).alias("e"), (-x["arm"]).alias("a"),
            x["original"].alias("o"))))
    draws = F.sequence(F.lit(0), F.size(F.col("arms")[0]["clicks"]) - 1)
    factor = F.lit(1.0) if scale is None else scale
    # the winners are a column of their own, or each would be found again for each of its fields
    won = blocks.select(*by, factor.alias("_s"), F.transform(draws, best).alias("_w"))
    each = won.select(*by, F.transform("_w", lambda x: (x["e"] - x["o"]) * F.col("_s")).alias("_b"))
    return each.groupBy(*by).agg(F.flatten(F.collect_list("_b")).alias("biases"))


def array_stats(table: DataFrame, by: list[str], values: str) -> DataFrame:
    """bias_stats() of an array column: its length is the number of draws, a parameter."""
    v = F.array_sort(values)
    n = F.size("_v")
    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / n
    sd = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("bias"))
                            * (x - F.col("bias"))) / (n - 1))

    def quantile(p):
        at = F.lit(p) * (n - 1)
        lo, hi = (F.get("_v", f(at).cast("int")) for f in (F.floor, F.ceil))
        return lo + (hi - lo) * (at - F.floor(at))
    return table.select(*by, v.alias("_v")).where("size(_v) > 0").withColumn("bias", mean).select(
        *by, n.alias("draws"), "bias", F.when(n > 1, sd).otherwise(F.lit(0.0)).alias("bias_sd"),
        *[quantile(p).alias(name) for p, name in ((0.025, "bias_q025"), (0.5, "bias_q50"),
                                                   (0.975, "bias_q975"))]).withColumn(
        "bias_se", F.col("bias_sd") / F.sqrt("draws"))


# --- bias of the pick (B3, B6, B12) ------------------------------------------------------

def moon_scale(power) -> Column:
    """sqrt(m/n) at the arms' average size n_avg; `power` is a number or a Column."""
    p = power if isinstance(power, Column) else F.lit(float(power))
    return F.sqrt(F.greatest(F.lit(1), F.floor(F.pow("n_avg", p))) / F.col("n_avg"))


def numerical_scale(power: float) -> Column:
    """n^power * sqrt(n) of the picked arm."""
    return F.pow("n", F.lit(power)) * F.sqrt("n")


def bias_draws(drawn: DataFrame, effects: DataFrame, by: list[str] = TEST, arm: str = "arm",
               scale: Column | None = None, draw_keys: list[str] = ()) -> DataFrame:
    """(by..., draw_keys..., draw, selected_arm, draw_effect, original, bias).

    `scale` may use the picked arm's n and the test's average n (n_avg).  A draw in which
    some arm got no row at all is left out, as its winner is undefined.
    `draw_keys` are keys that only the draws have (e.g. power).
    """
    keys = [*by, *draw_keys, "draw"]
    arms = effects.groupBy(*by).agg(F.count(F.lit(1)).alias("n_arms"),
                                    F.avg("n").alias("n_avg"))
    original = effects.select(*by, arm, "n", F.col("effect").alias("original")).join(arms, by)
    best = drawn.groupBy(*keys).agg(winner_of("effect", arm).alias("_w"),
                                    F.count(F.lit(1)).alias("_arms"))
    raw = F.col("draw_effect") - F.col("original")
    picked = best.select(*keys, f"_w.{arm}", F.col("_w.effect").alias("draw_effect"), "_arms")
    return (picked.join(original, [*by, arm]).where(F.col("_arms") == F.col("n_arms"))
            .select(*keys, F.col(arm).alias("selected_arm"), "draw_effect", "original",
                    (raw if scale is None else raw * scale).alias("bias")))


def bias_stats(draws: DataFrame, by: list[str] = TEST) -> DataFrame:
    """Mean, sd (ddof 1, 0 for one draw), se and quantiles over the draws of a group.

    A group is one test's draws, whose number is a parameter, so percentile() is bounded.
    """
    q = F.percentile("bias", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return draws.groupBy(*by).agg(
        F.count(F.lit(1)).alias("draws"), F.avg("bias").alias("bias"),
        F.coalesce(F.stddev_samp("bias"), F.lit(0.0)).alias("bias_sd"), q.alias("_q")).select(
        *by, "draws", "bias", "bias_sd", (F.col("bias_sd") / F.sqrt("draws")).alias("bias_se"),
        F.col("_q")[0].alias("bias_q025"), F.col("_q")[1].alias("bias_q50"),
        F.col("_q")[2].alias("bias_q975"))


def correct(draws: DataFrame, effects: DataFrame, estimator: str, by: list[str] = TEST,
            arm: str = "arm", draw_keys: list[str] = ()) -> DataFrame:
    """Naive value of the original pick minus the mean bias, with the draws' spread."""
    return _with_stats(bias_stats(draws, [*by, *draw_keys]), effects, estimator, by, arm, draw_keys)


def _with_stats(stats, effects, estimator, by, arm, draw_keys=()) -> DataFrame:
    pick = select_winner(effects, by, arm).select(
        *by, F.col(arm).alias("selected_arm"), F.col("effect").alias("naive"))
    return pick.join(stats, by, "left").select(
        *by, *draw_keys, F.lit(estimator).alias("estimator"), "selected_arm", "naive",
        (F.col("naive") - F.col("bias")).alias("corrected"), "bias", "bias_sd", "bias_se",
        "bias_q025", "bias_q50", "bias_q975",
        F.when(F.col("bias").isNull(), "no_draws").otherwise("ok").alias("status"))


# --- correctors on rows (B4-B11) -----------------------------------------------------------

def saved_effects(rows: DataFrame, by: list[str] = TEST, arm: str = "arm",
                  value: str = "y") -> DataFrame:
    """The arm effects, written once: the pick, the sizes and the originals all read them."""
    return save_table(arm_effects(rows, by=by, arm=arm, value=value))


def correct_standard(rows: DataFrame, draws: int, by: list[str] = TEST, arm: str = "arm",
                     value: str = "y", row_key: str = "row_id", mode: str = "poisson",
                     seed: int = 42, fast: bool = False,
                     effects: DataFrame | None = None) -> DataFrame:
    effects = effects or saved_effects(rows, by, arm, value)
    drawn = (poisson_draws(rows, draws, by, arm, value, [row_key], seed, "std", fast)
             if mode == "poisson" else
             index_draws(rows, effects, draws, by, arm, value, row_key, None, seed, "std", fast))
    return correct(bias_draws(drawn, effects, by, arm), effects, "standard", by, arm)


def correct_moon(rows: DataFrame, draws: int, power: float, by: list[str] = TEST,
                 arm: str = "arm", value: str = "y", row_key: str = "row_id",
                 mode: str = "index", seed: int = 42, fast: bool = False,
                 effects: DataFrame | None = None) -> DataFrame:
    _check_power(power)
    effects = effects or saved_effects(rows, by, arm, value)
    drawn = (index_draws(rows, effects, draws, by, arm, value, row_key, [power], seed, "moon", fast)
             .drop("power") if mode == "index" else
             poisson_moon_draws(rows, effects, draws, power, by, arm, value, [row_key], seed,
                                "moon", fast))
    found = bias_draws(drawn, effects, by, arm, moon_scale(power))
    return correct(found, effects, "moon", by, arm)


def correct_numerical(rows: DataFrame, draws: int, power: float = -0.45,
                      by: list[str] = TEST, arm: str = "arm", value: str = "y",
                      row_key: str = "row_id", seed: int = 42, fast: bool = False) -> DataFrame:
    if not -0.5 < power < 0:
        raise ValueError("power must be in (-0.5, 0)")
    effects = saved_effects(rows, by, arm, value)
    drawn = poisson_draws(rows, draws, by, arm, value, [row_key], seed, "num", fast)
    found = bias_draws(drawn, effects, by, arm, numerical_scale(power))
    return correct(found, effects, "numerical", by, arm)


def conditional_draws(rows: DataFrame, draws: int, max_attempts: int | None = None,
                      by: list[str] = TEST, arm: str = "arm", value: str = "y",
                      row_key: str = "row_id", seed: int = 42, fast: bool = False,
                      effects: DataFrame | None = None) -> DataFrame:
    """The first `draws` resamples per test that pick the original winner, plus attempt counts.

    Attempts grow in rounds, each only for tests that are still short; results of a round are
    checkpointed.  (by..., draw, bias, accepted_rank, attempts).
    """
    max_attempts = max_attempts or 100 * draws
    effects = effects or saved_effects(rows, by, arm, value)
    pick = select_winner(effects, by, arm).select(*by, F.col(arm).alias("_original"))
    accepted, end = None, 0
    size, pending = min(max_attempts, 3 * draws), rows
    while True:
        start, end = end, min(max_attempts, end + size)
        drawn = poisson_draws(pending, end, by, arm, value, [row_key], seed, "cond", fast,
                              first=start)
        new = (bias_draws(drawn, effects, by, arm).join(pick, by)
               .where(F.col("selected_arm") == F.col("_original")).drop("_original"))
        accepted = new if accepted is None else accepted.unionByName(new)
        if end >= max_attempts:
            break
        accepted = cut_lineage(accepted)
        short = (pick.select(*by).join(accepted.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_have")), by, "left")
            .where(F.coalesce("_have", F.lit(0)) < draws).select(*by))
        if short.isEmpty():
            break
        pending, size = rows.join(short, by, "left_semi"), 2 * size
    w = Window.partitionBy(*by).orderBy("draw")
    return (accepted.withColumn("accepted_rank", F.row_number().over(w))
            .where(F.col("accepted_rank") <= draws)
            .withColumn("attempts", F.when(F.col("accepted_rank") == draws,
                                           F.col("draw") + 1).otherwise(F.lit(end))))


def correct_conditional(rows: DataFrame, draws: int, max_attempts: int | None = None,
                        by: list[str] = TEST, arm: str = "arm", value: str = "y",
                        row_key: str = "row_id", seed: int = 42,
                        fast: bool = False) -> DataFrame:
    """Adds the acceptance rate; status 'short' when fewer than `draws` were accepted."""
    effects = saved_effects(rows, by, arm, value)
    found = save_table(conditional_draws(rows, draws, max_attempts, by, arm, value, row_key,
                                         seed, fast, effects))
    rates = found.groupBy(*by).agg(F.count(F.lit(1)).alias("accepted"),
                                   F.min("attempts").alias("attempts"))
    out = correct(found, effects, "conditional", by, arm).join(rates, by, "left")
    return out.withColumn("status", F.when(F.col("accepted") < draws, "short")
                          .otherwise(F.col("status"))).withColumn(
        "acceptance_rate", F.col("accepted") / F.col("attempts"))


def moon_power_sweep(rows: DataFrame, draws: int, powers: list[float], by: list[str] = TEST,
                     arm: str = "arm", value: str = "y", row_key: str = "row_id",
                     seed: int = 42, fast: bool = False) -> DataFrame:
    """The m-out-of-n correction for a grid of powers, one row per test and power."""
    for p in powers:
        _check_power(p)
    effects = saved_effects(rows, by, arm, value)
    drawn = index_draws(rows, effects, draws, by, arm, value, row_key, powers, seed, "moon", fast)
    found = bias_draws(drawn, effects, by, arm, moon_scale(F.col("power")), ["power"])
    return correct(found, effects, "moon", by, arm, ["power"])


def nested_draws(rows: DataFrame, outer: int, inner: int, by: list[str] = TEST,
                 arm: str = "arm", value: str = "y", row_key: str = "row_id", seed: int = 42,
                 fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(effects of every outer resample, draws of its own bootstrap), both keyed by `outer`.

    A row that an outer resample holds w times has Poisson(w) weights in the inner ones, so no
    resample is written or unfolded: both tables are sums over the rows as they are.
    """
    slim = observed(rows, value).select(*dict.fromkeys([*by, arm, row_key, value]))
    held = D.with_poisson_weights(slim, outer, [*by, arm, row_key], seed, SALTS["outer"], fast,
                                  draw="outer", weight="times")
    w, y = F.col("times"), F.col(value)
    effects = held.groupBy(*by, "outer", arm).agg(
        F.sum(w).alias("n"), (F.sum(w * y) / F.sum(w)).alias("effect"))
    w = F.col("weight")
    drawn = D.with_rate_weights(held, "times", inner, [*by, "outer", arm, row_key], seed,
                                SALTS["inner"], fast).groupBy(*by, "outer", arm, "draw").agg(
        F.sum(w).alias("n"), (F.sum(w * y) / F.sum(w)).alias("effect"))
    return effects, drawn


def _inner_bias(rows, outer, inner, by, arm, value, row_key, seed, fast) -> DataFrame:
    """Mean inner-bootstrap bias of every outer resample, against its own effects."""
    effects, drawn = nested_draws(rows, outer, inner, by, arm, value, row_key, seed, fast)
    keys = [*by, "outer"]
    return bias_draws(drawn, save_table(effects), keys, arm).groupBy(*keys).agg(
        F.avg("bias").alias("bias")).withColumnRenamed("outer", "draw")


def correct_double(rows: DataFrame, outer: int, inner: int, by: list[str] = TEST,
                   arm: str = "arm", value: str = "y", row_key: str = "row_id",
                   seed: int = 42, fast: bool = False,
                     effects: DataFrame | None = None) -> DataFrame:
    effects = effects or saved_effects(rows, by, arm, value)
    found = _inner_bias(rows, outer, inner, by, arm, value, row_key, seed, fast)
    return correct(found, effects, "double", by, arm)


def correct_double_hall(rows: DataFrame, outer: int, inner: int, by: list[str] = TEST,
                        arm: str = "arm", value: str = "y", row_key: str = "row_id",
                        seed: int = 42, fast: bool = False) -> DataFrame:
    """Bias 2T - T_r: T from the data, T_r from every outer resample's own bootstrap."""
    effects = saved_effects(rows, by, arm, value)
    drawn = poisson_draws(rows, inner, by, arm, value, [row_key], seed, "std", fast)
    t = bias_draws(drawn, effects, by, arm).groupBy(*by).agg(F.avg("bias").alias("_t"))
    t_r = _inner_bias(rows, outer, inner, by, arm, value, row_key, seed, fast)
    found = t_r.join(t, by).withColumn("bias", 2 * F.col("_t") - F.col("bias"))
    return correct(found, effects, "double_hall", by, arm)


def correct_by(rows: DataFrame, method: str, draws: int, **kw) -> DataFrame:
    """Dispatcher; 'double' means the 2T - T_r form."""
    if method == "double":
        return correct_double_hall(rows, kw.pop("outer", draws), draws, **kw)
    table = {"standard": correct_standard, "moon": correct_moon,
             "numerical": correct_numerical, "conditional": correct_conditional}
    if method not in table:
        raise ValueError(f"unknown bootstrap method {method!r}")
    return table[method](rows, draws, **kw)


def correct_counts(effects: DataFrame, draws: int, power: float | None = None,
                   by: list[str] = TEST, arm: str = "arm", seed: int = 42) -> DataFrame:
    """Standard (power None) or m-out-of-n correction from counts, in blocks of draws."""
    if power is not None:
        _check_power(power)
    name, salt, scale = (("standard", 101, None) if power is None
                         else ("moon", 202, moon_scale(power)))
    blocks = count_blocks(effects, draws, by, arm, power, seed, salt)
    stats = array_stats(block_biases(blocks, by, scale), by, "biases")
    return _with_stats(stats, effects, name, by, arm)


def _check_power(power: float) -> None:
    if not 0 < power < 1:
        raise ValueError("power must be in (0, 1)")


# --- user hooks, diagnostics (B12, B14, B15) -------------------------------------------------

def custom_bias(rows: DataFrame, resample, estimate, rule: Column | None = None,
                bias: Column | None = None, accept: Column | None = None,
                by: list[str] = TEST, arm: str = "arm") -> DataFrame:
    """Bootstrap with user hooks, all of them over keyed tables rather than per draw.

    resample(rows) -> rows with `draw` and `weight`; estimate(rows, keys) -> (keys..., arm,
    effect, ...) using `weight`; `rule` orders the arms; `bias` and `accept` are Columns over
    draw_effect, original, selected_arm and original_arm.
    """
    rule = F.col("effect") if rule is None else rule
    bias = F.col("draw_effect") - F.col("original") if bias is None else bias

    def pick(estimates, keys):
        best = F.max_by(F.struct(arm, "effect"), F.struct(rule.alias("_s"), -F.col(arm)))
        return estimates.groupBy(*keys).agg(best.alias("_w"), F.count(F.lit(1)).alias(
            "_arms")).select(*keys, "_w.*", "_arms")

    base = save_table(estimate(rows.withColumn("weight", F.lit(1)), by))
    first = pick(base, by).select(*by, F.col(arm).alias("original_arm"),
                                  F.col("_arms").alias("_all_arms"))
    drawn = pick(estimate(resample(rows), [*by, "draw"]), [*by, "draw"])
    out = (drawn.withColumnRenamed("effect", "draw_effect")
           .join(base.select(*by, arm, F.col("effect").alias("original")), [*by, arm])
           .join(first, by).where(F.col("_arms") == F.col("_all_arms"))
           .drop("_arms", "_all_arms").withColumnRenamed(arm, "selected_arm")
           .withColumn("bias", bias))
    return out if accept is None else out.where(accept)


def winner_agreement(draws: DataFrame, effects: DataFrame, by: list[str] = TEST,
                     arm: str = "arm") -> DataFrame:
    """Share of draws that pick the original winner."""
    pick = select_winner(effects, by, arm).select(*by, F.col(arm).alias("_original"))
    same = (F.col("selected_arm") == F.col("_original")).cast("int")
    return draws.join(pick, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("draws"), F.avg(same).alias("agreement"))


def ks_distance(a: DataFrame, b: DataFrame, by: list[str], value: str = "bias",
                name: str = "ks") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group (groups are sets of draws)."""
    both = a.select(*by, F.col(value).alias("_v"), F.lit(1).alias("_a")).unionByName(
        b.select(*by, F.col(value).alias("_v"), F.lit(0).alias("_a")))
    steps = both.groupBy(*by, "_v").agg(F.sum("_a").alias("_a"),
                                        F.sum(1 - F.col("_a")).alias("_b"))
    run = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    gap = F.abs(F.sum("_a").over(run) / F.sum("_a").over(whole)
                - F.sum("_b").over(run) / F.sum("_b").over(whole))
    return steps.withColumn("_gap", gap).groupBy(*by).agg(F.max("_gap").alias(name))


def choose_m(draws: DataFrame, powers: list[float], by: list[str] = TEST) -> DataFrame:
    """Bickel-Sakov: the power whose draws differ least from those of the next power."""
    sizes = {p: i for i, p in enumerate(powers)}
    index = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("power")]
    keyed = draws.withColumn("m_index", index)
    nxt = keyed.withColumn("m_index", F.col("m_index") - 1).where("m_index >= 0")
    prev = keyed.where(F.col("m_index") < len(powers) - 1)
    ks = ks_distance(prev, nxt, [*by, "m_index"])
    # equal distances differ in the last bit; rounding lets the smaller index win
    best = F.min(F.struct(F.round("ks", 9).alias("ks"), "m_index"))
    return ks.groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.m_index").alias("m_index"),
        F.element_at(F.array(*[F.lit(p) for p in powers]), F.col("_b.m_index") + 1)
        .alias("power"), F.col("_b.ks").alias("ks"))
