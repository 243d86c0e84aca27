"""Sample splitting, cross-validation and backtests on real rows (V1-V9)."""

import math

from pyspark.sql import DataFrame, Window, functions as F

from honestpick.functions import draws as D
from honestpick.functions.columns import attach_row, winner_of
from honestpick.functions.lineage import save_table
from honestpick.functions.quantiles import exact_median
from honestpick.functions.ranks import spread
from honestpick.operators.bootstrap import array_stats, numbered, observed
from honestpick.operators.effects import TEST, select_winner
from honestpick.operators.joins import join_null_safe


def split_cuts(rows: DataFrame, fraction: float, splits: int, strata: list[str],
               row_key: str = "row_id", seed: int = 42, salt: str = "split",
               fast: bool = False, hash_digits: int | None = None) -> DataFrame:
    """(strata..., cuts), saved: per split the last (hash, key) of the estimation part.

    Counts by leading hash digits, made where the rows are, tell the digits in which the quota
    of a stratum and split is reached; only rows with just these digits are moved and ranked.
    With as many digits as make buckets and their rows equally many, both grow with the root of
    the stratum.  A cut is NULL where the quota is 0.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be in (0, 1)")
    if hash_digits is None:
        rows, largest = spread(rows, strata)
        hash_digits = root_digits(largest)
    slim = rows.select(*strata, row_key)
    digits = F.substring("_h", 1, hash_digits).alias("_d")
    hashed = D.with_draws(slim, splits, "split_id").withColumn(
        "_h", _split_hash(row_key, seed, salt, fast))
    group = Window.partitionBy(*strata, "split_id")
    before = F.coalesce(F.sum("_c").over(group.orderBy("_d").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    left = F.floor(F.sum("_c").over(group) * fraction) - before
    ends = hashed.groupBy(*strata, "split_id", digits).agg(F.count(F.lit(1)).alias("_c")).select(
        *strata, "split_id", "_d", "_c", left.alias("_left")).where("0 < _left AND _left <= _c")
    entry = F.struct(F.col("_d").alias("d"), F.col("_left").alias("left"))
    marks = save_table(ends.groupBy(*strata).agg(F.map_from_entries(
        F.collect_list(F.struct("split_id", entry))).alias("_m")))
    # rows whose first digits are those of a cut
    near = _per_split(slim, marks, strata, splits).withColumn(
        "_h", _split_hash(row_key, seed, salt, fast)).where(digits == F.col("_cut.d"))
    place = F.row_number().over(group.orderBy("_h", row_key))
    last = near.withColumn("_rn", place).where(F.col("_rn") == F.col("_cut.left"))
    entry = F.struct(F.col("_h").alias("h"), F.col(row_key).alias("k"))
    return save_table(last.groupBy(*strata).agg(F.map_from_entries(
        F.collect_list(F.struct("split_id", entry))).alias("_m")))


def root_digits(largest: int) -> int:
    """Hex digits that make about as many buckets as rows in each."""
    return max(1, round(math.log(max(largest, 2), 16) / 2))


def _split_hash(row_key: str, seed: int, salt: str, fast: bool):
    if not fast:
        return D.hash_hex([row_key, "split_id"], seed, salt)
    return F.lower(F.lpad(F.hex(F.xxhash64(F.col(row_key), "split_id", F.lit(seed), F.lit(salt))),
                          16, "0"))


def _per_split(rows: DataFrame, marks: DataFrame, strata: list[str], splits: int) -> DataFrame:
    """Every row once per split, with the split's entry of the stratum's map as `_cut`.

    One row per stratum is joined before rows are copied; unfolding the map's entries keeps it
    out of the copies.
    """
    joined = (join_null_safe(rows, marks, strata, "left") if strata
              else attach_row(rows, marks.agg(F.first("_m").alias("_m"))))
    ids = F.sequence(F.lit(0), F.lit(splits - 1))
    entries = F.transform(ids, lambda i: F.try_element_at("_m", i))
    return joined.select(*rows.columns, F.posexplode(entries).alias("split_id", "_cut"))


def split_rows(rows: DataFrame, fraction: float, splits: int, strata: list[str],
               row_key: str = "row_id", seed: int = 42, salt: str = "split",
               fast: bool = False, hash_digits: int | None = None,
               cuts: DataFrame | None = None) -> DataFrame:
    """Every row once per split, `in_est` true for exactly floor(n*fraction) rows per stratum.

    The rows with the smallest hashes of a stratum are the estimation part; each row is decided
    where it is, by comparison with its stratum's cut (see split_cuts).
    """
    if cuts is None:
        rows, largest = spread(rows, strata)
        cuts = split_cuts(rows, fraction, splits, strata, row_key, seed, salt, fast,
                          hash_digits or root_digits(largest))
    own = F.struct(_split_hash(row_key, seed, salt, fast).alias("h"), F.col(row_key).alias("k"))
    return _per_split(rows, cuts, strata, splits).withColumn(
        "in_est", F.coalesce(own <= F.col("_cut"), F.lit(False))).drop("_cut")


def split_effects(rows: DataFrame, fraction: float, splits: int, by: list[str] = TEST,
                  arm: str = "arm", value: str = "y", row_key: str = "row_id",
                  seed: int = 42, fast: bool = False) -> DataFrame:
    """(by..., split_id, arm, est_effect, eval_effect): arm means on both parts."""
    parts = split_rows(rows.select(*by, arm, row_key, value), fraction, splits, [*by, arm],
                       row_key, seed, fast=fast)
    y = F.col(value)
    return parts.groupBy(*by, "split_id", arm).agg(
        F.avg(F.when(F.col("in_est"), y)).alias("est_effect"),
        F.avg(F.when(~F.col("in_est"), y)).alias("eval_effect"))


def split_counts(effects: DataFrame, fraction: float, splits: int, by: list[str] = TEST,
                 arm: str = "arm", seed: int = 42, salt: int = 303) -> DataFrame:
    """The same from counts: hypergeometric clicks of the estimation part, the rest is left."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be in (0, 1)")
    m = F.floor(F.col("n") * fraction)
    small = (m < 1) | (F.col("n") - m < 1)
    sized = effects.select(*by, arm, "n", F.rint(F.col("effect") * F.col("n")).cast("bigint")
                           .alias("clicks"), F.when(small, F.raise_error(F.lit(
                               "each arm needs rows in both parts")).cast("bigint"))
                           .otherwise(m).alias("est_n"))
    made = sized.withColumn("_k", D.hypergeometric_array(
        F.col("clicks"), F.col("n"), F.col("est_n"), D.row_seed([*by, arm], seed, salt), splits))
    return made.select("*", F.posexplode("_k").alias("split_id", "est_clicks")).select(
        *by, "split_id", arm, "est_n", "est_clicks", (F.col("n") - F.col("est_n")).alias("eval_n"),
        (F.col("clicks") - F.col("est_clicks")).alias("eval_clicks"),
        (F.col("est_clicks") / F.col("est_n")).alias("est_effect"),
        ((F.col("clicks") - F.col("est_clicks")) / (F.col("n") - F.col("est_n")))
        .alias("eval_effect"))


def count_split_values(effects: DataFrame, fraction: float, splits: int, by: list[str] = TEST,
                       arm: str = "arm", seed: int = 42, salt: int = 303) -> DataFrame:
    """(by..., full_winner, naive, values) from counts: `values` is the array of a test's splits,
    with (selected_arm, est_value, eval_value, full_winner_value).

    The draws are those of split_counts(), kept as an array per arm; a test's arms meet once.
    """
    m = F.floor(F.col("n") * fraction)
    if not 0 < fraction < 1:
        raise ValueError("fraction must be in (0, 1)")
    sized = effects.select(*by, arm, "n", "effect", F.when(
        (m < 1) | (F.col("n") - m < 1), F.raise_error(F.lit("each arm needs rows in both parts"))
        .cast("bigint")).otherwise(m).alias("_m")).withColumn(
        "_c", F.rint(F.col("effect") * F.col("n")).cast("bigint"))
    parts = int(effects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = sized.repartition(parts, *by).withColumn("_k", D.hypergeometric_array(
        F.col("_c"), F.col("n"), F.col("_m"), D.row_seed([*by, arm], seed, salt), splits))
    arms = made.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col(arm).alias("arm"), F.col("n").alias("n"), F.col("_m").alias("m"),
            F.col("_c").alias("c"), F.col("_k").alias("k")))).alias("_arms"),
        winner_of("effect", arm).alias("_w"))

    def one(i):
        def sides(x):
            k = F.get(x["k"], i)
            return F.struct((k / x["m"]).alias("e"), (-x["arm"]).alias("a"),
                            ((x["c"] - k) / (x["n"] - x["m"])).alias("v"))
        both = F.transform("_arms", sides)
        full = F.get(F.filter(both, lambda x: -x["a"] == F.col(f"_w.{arm}")), F.lit(0))
        best = F.array_max(both)
        return F.struct((-best["a"]).alias("selected_arm"), best["e"].alias("est_value"),
                        best["v"].alias("eval_value"), full["v"].alias("full_winner_value"))
    return arms.select(*by, F.col(f"_w.{arm}").alias("full_winner"),
                       F.col("_w.effect").alias("naive"),
                       F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), one).alias("values"))


def correct_split_counts(effects: DataFrame, fraction: float, splits: int,
                         by: list[str] = TEST, arm: str = "arm", seed: int = 42) -> DataFrame:
    """correct_split() from counts; nothing is shuffled but arms."""
    values = count_split_values(effects, fraction, splits, by, arm, seed)
    gaps = values.withColumn("_g", F.transform("values", lambda x: F.col("naive") - x["eval_value"]))
    stats = array_stats(gaps, [*by, "full_winner", "naive"], "_g")
    return stats.select(
        *by, F.lit("split").alias("estimator"), F.col("full_winner").alias("selected_arm"), "naive",
        (F.col("naive") - F.col("bias")).alias("corrected"), "bias", "bias_sd", "bias_se",
        "bias_q025", "bias_q50", "bias_q975", F.lit("ok").alias("status"))


def split_values(parts: DataFrame, effects: DataFrame, by: list[str] = TEST,
                 arm: str = "arm") -> DataFrame:
    """Per split: the estimation part's pick, its value on both parts, and the full winner's."""
    full = select_winner(effects, by, arm).select(*by, F.col(arm).alias("full_winner"),
                                                  F.col("effect").alias("naive"))
    best = F.max_by(F.struct(arm, "est_effect", "eval_effect"),
                    F.struct("est_effect", -F.col(arm)))
    return parts.join(full, by).groupBy(*by, "split_id", "full_winner", "naive").agg(
        best.alias("_w"),
        F.max(F.when(F.col(arm) == F.col("full_winner"), F.col("eval_effect")))
        .alias("full_winner_value")).select(
        *by, "split_id", F.col(f"_w.{arm}").alias("selected_arm"),
        F.col("_w.est_effect").alias("est_value"), F.col("_w.eval_effect").alias("eval_value"),
        "full_winner", "naive", "full_winner_value")


def correct_split(values: DataFrame, by: list[str] = TEST) -> DataFrame:
    """Average validation value over the splits, in the canonical corrector shape."""
    q = F.percentile(F.col("naive") - F.col("eval_value"),
                     F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = values.groupBy(*by).agg(
        F.first("full_winner").alias("selected_arm"), F.first("naive").alias("naive"),
        F.avg("eval_value").alias("corrected"), F.count("eval_value").alias("_s"),
        F.coalesce(F.stddev_samp("eval_value"), F.lit(0.0)).alias("bias_sd"), q.alias("_q"))
    return out.select(
        *by, F.lit("split").alias("estimator"), "selected_arm", "naive", "corrected",
        (F.col("naive") - F.col("corrected")).alias("bias"), "bias_sd",
        (F.col("bias_sd") / F.sqrt("_s")).alias("bias_se"), F.col("_q")[0].alias("bias_q025"),
        F.col("_q")[1].alias("bias_q50"), F.col("_q")[2].alias("bias_q975"),
        F.lit("ok").alias("status"))


def split_diagnostics(values: DataFrame, by: list[str] = TEST) -> DataFrame:
    same = (F.col("selected_arm") == F.col("full_winner")).cast("int")
    return values.groupBy(*by).agg(
        F.avg(same).alias("full_winner_selection_rate"),
        F.avg(1 - same).alias("disagreement_rate"),
        F.avg(F.col("full_winner_value") - F.col("eval_value")).alias("mean_decision_loss"),
        F.avg("est_value").alias("mean_est_value"), F.avg("eval_value").alias("mean_eval_value"),
        F.avg("full_winner_value").alias("mean_full_winner_value"))


def with_fold(rows: DataFrame, k: int, by: list[str], arm: str, row_key: str) -> DataFrame:
    """Contiguous folds in row order; the first n % k folds are one row longer."""
    num = numbered(rows, by, arm, row_key)
    q, extra = F.floor(F.col("n") / k), F.col("n") % k
    longer = extra * (q + 1)
    fold = F.when(F.col("pos") < longer, F.floor(F.col("pos") / (q + 1))).otherwise(
        extra + F.floor((F.col("pos") - longer) / F.greatest(q, F.lit(1))))
    return num.withColumn("fold", fold.cast("int")).drop("pos", "n")


def correct_kfold(rows: DataFrame, k: int, select_on: str = "fold", by: list[str] = TEST,
                  arm: str = "arm", value: str = "y", row_key: str = "row_id") -> DataFrame:
    """Pick on a fold and score on the rest ('fold'), or the other way round ('rest').

    The complement of a fold is the arm's total minus the fold, so rows are read once.
    """
    folds = (with_fold(rows.select(*by, arm, row_key, value), k, by, arm, row_key)
             .groupBy(*by, arm, "fold").agg(F.count(value).alias("n"), F.sum(value).alias("s")))
    totals = folds.groupBy(*by, arm).agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"))
    inside = F.col("s") / F.col("n")
    outside = F.try_divide(F.col("_s") - F.col("s"), F.col("_n") - F.col("n"))
    pick, score = (inside, outside) if select_on == "fold" else (outside, inside)
    both = folds.join(totals, [*by, arm]).withColumns({"_pick": pick, "_score": score})
    best = F.max_by(F.struct(arm, "_score"), F.struct("_pick", -F.col(arm)))
    return (both.groupBy(*by, "fold").agg(best.alias("_w")).groupBy(*by)
            .agg(F.avg("_w._score").alias("corrected"))
            .select(*by, F.lit("kfold").alias("estimator"), "corrected"))


def correct_jackknife(rows: DataFrame, by: list[str] = TEST, arm: str = "arm",
                      value: str = "y", row_key: str = "row_id") -> DataFrame:
    """Drop position i in every arm, pick on the rest, score the pick's i-th value, average.

    An arm shorter than i keeps its full mean; the best such arm is looked up in the test's
    arm list, so unequal arms need no padding rows.  A pick without an i-th row scores nothing.
    """
    num = numbered(observed(rows, value).select(*by, arm, row_key, value), by, arm, row_key)
    totals = num.groupBy(*by, arm).agg(F.sum(value).alias("_s"))
    arms = (num.groupBy(*by, arm).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_e"))
            .groupBy(*by).agg(F.collect_list(F.struct(
                F.col("_e").alias("e"), (-F.col(arm)).alias("a"), F.col("_n").alias("n")))
                .alias("_arms")))
    left_out = num.join(totals, [*by, arm]).withColumn(
        "_e", F.try_divide(F.col("_s") - F.col(value), F.col("n") - 1))
    best = left_out.groupBy(*by, "pos").agg(F.max(F.struct(
        F.col("_e").alias("e"), (-F.col(arm)).alias("a"), F.col(value).alias("y"))).alias("_b"))
    shorter = F.array_max(F.transform(
        F.filter("_arms", lambda x: x.n <= F.col("pos")),
        lambda x: F.struct(x.e.alias("e"), x.a.alias("a"))))
    beaten = F.coalesce(F.struct(F.col("_b.e").alias("e"), F.col("_b.a").alias("a"))
                        < F.col("_alt"), F.lit(False))
    scored = best.join(arms, by).withColumn("_alt", shorter).withColumn(
        "_score", F.when(~beaten, F.col("_b.y")))
    return scored.groupBy(*by).agg(F.avg("_score").alias("corrected")).select(
        *by, F.lit("jackknife").alias("estimator"), "corrected")


def backtest_errors(estimates: DataFrame, holdout: DataFrame, keys: list[str],
                    arm: str = "arm") -> DataFrame:
    """Corrections made on one half, judged by the pick's value on the other half.

    `estimates`: (keys..., estimator, selected_arm, naive, corrected);
    `holdout`: (keys..., arm, effect).
    """
    joined = estimates.select(*keys, "estimator", "selected_arm", "naive", "corrected").join(
        holdout.select(*keys, F.col(arm).alias("selected_arm"),
                       F.col("effect").alias("holdout_value")), [*keys, "selected_arm"])
    return (joined.withColumn("estimated_bias", F.col("naive") - F.col("corrected"))
            .withColumn("actual_bias", F.col("naive") - F.col("holdout_value"))
            .withColumn("error", F.col("estimated_bias") - F.col("actual_bias"))
            .withColumn("abs_error", F.abs("error"))
            .withColumn("residual", F.col("corrected") - F.col("holdout_value")))


def backtest_summary(errors: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per estimator: means, exact medians, MAE and RMSE of the error over tests and splits."""
    keys = [*by, "estimator"]
    means = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("splits"), F.avg("actual_bias").alias("mean_actual_bias"),
        F.avg("estimated_bias").alias("mean_estimated_bias"),
        F.avg("error").alias("mean_error"), F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg("residual").alias("mean_residual"), F.avg("corrected").alias("mean_corrected"),
        F.avg("holdout_value").alias("mean_holdout_value"))
    measures = ["estimated_bias", "abs_error"]
    medians = exact_median(errors.unpivot(keys, measures, "_m", "_x"), "_x", [*keys, "_m"])
    wide = medians.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_m") == m, F.col("median"))).alias(f"median_{m}") for m in measures])
    return join_null_safe(means, wide, keys)


def pick_shares(errors: DataFrame, arms: list[int], by: list[str] = ()) -> DataFrame:
    """Share of splits in which each arm was picked, one column per arm."""
    return errors.groupBy(*by, "estimator").agg(*[
        F.avg((F.col("selected_arm") == a).cast("int")).alias(f"share_{a}") for a in arms])


def best_method(summary: DataFrame, by: str, absolute: bool = False) -> DataFrame:
    """The estimator with the smallest criterion."""
    c = F.abs(by) if absolute else F.col(by)
    return summary.orderBy(c, "estimator").limit(1)


def stack_outcomes(rows: DataFrame, outcomes: list[str], keep: list[str]) -> DataFrame:
    """Outcome columns as a key: (keep..., outcome, y)."""
    return rows.unpivot(keep, outcomes, "outcome", "y")


def funnel_table(estimates: DataFrame, outcomes: list[str]) -> DataFrame:
    """Estimator by outcome table of corrected values."""
    return estimates.groupBy("estimator").pivot("outcome", outcomes).agg(F.first("corrected"))
