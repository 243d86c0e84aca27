"""Arm effects, winner selection and values."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from honestpick.functions.columns import logistic, logit, safe_ratio
from honestpick.functions.draws import normal, with_draws
from honestpick.operators.prep import add_click_spread

TEST = ["test_id"]


def rollup_arms(rows: DataFrame, by: list[str] = TEST, arm: str = "arm",
                outcome: str = "click") -> DataFrame:
    """Row-level 0/1 outcomes to counts per arm."""
    return rows.groupBy(*by, arm).agg(
        F.count(F.lit(1)).alias("impressions"),
        F.sum(F.col(outcome)).cast("bigint").alias("clicks"))


def arm_effects(rows: DataFrame, kind: str = "continuous", by: list[str] = TEST,
                arm: str = "arm", value: str = "y") -> DataFrame:
    """(by..., arm, n, effect, var): mean and sampling variance (ddof 0) per arm."""
    y = F.col(value)
    if kind == "continuous":
        return rows.groupBy(*by, arm).agg(
            F.count(y).alias("n"), F.avg(y).alias("effect"),
            (F.var_pop(y) / F.count(y)).alias("var"))
    means = rows.groupBy(*by, arm).agg(F.count(y).alias("n"), F.avg(y).alias("p"))
    p, n = F.col("p"), F.col("n")
    if kind == "bernoulli":
        return means.select(*by, arm, "n", p.alias("effect"), (p * (1 - p) / n).alias("var"))
    if kind == "logit":
        inside = (p > 0) & (p < 1)
        return means.select(*by, arm, "n", logit(p).alias("effect"),
                            F.when(inside, 1 / (n * p * (1 - p))).alias("var"))
    raise ValueError(f"unknown response kind {kind!r}")


def arm_effects_from_counts(arms: DataFrame, keep: list[str] = ()) -> DataFrame:
    p, n = F.col("clicks") / F.col("impressions"), F.col("impressions")
    return arms.select("test_id", F.col("arm_ordinal").alias("arm"), "source_row_id", *keep,
                       n.alias("n"), p.alias("effect"), (p * (1 - p) / n).alias("var"))


def sample_effects(rows: DataFrame, by: list[str] = TEST, arm: str = "arm",
                   value: str = "y") -> DataFrame:
    """Means with ddof-1 variance, 95% interval and a flag on the best arm."""
    y = F.col(value)
    out = rows.groupBy(*by, arm).agg(F.count(y).alias("n"), F.avg(y).alias("effect"),
                                     (F.var_samp(y) / F.count(y)).alias("var"))
    se = F.sqrt("var")
    best = F.max("effect").over(Window.partitionBy(*by))
    return (out.withColumn("ci_low", F.col("effect") - 1.96 * se)
            .withColumn("ci_high", F.col("effect") + 1.96 * se)
            .withColumn("selected", F.col("effect") == best))


def select_winner(effects: DataFrame, by: list[str] = TEST, arm: str = "arm",
                  tie: str | None = None) -> DataFrame:
    """(by..., arm, effect, ties): largest effect; equal effects go to the lowest `tie`.

    Equal effects are folded first, so the tie count needs no second look at the arms and
    both levels combine on the map side.
    """
    tie = tie or arm
    first = F.min(F.struct(F.col(tie).alias("_t"), F.col(arm).alias("_arm")))
    folded = (effects.where(F.col("effect").isNotNull()).groupBy(*by, "effect")
              .agg(first.alias("_first"), F.count(F.lit(1)).alias("_ties")))
    return (folded.groupBy(*by).agg(
        F.max(F.struct("effect", "_first", "_ties")).alias("_w"))
        .select(*by, F.col("_w._first._arm").alias(arm), F.col("_w.effect").alias("effect"),
                F.col("_w._ties").alias("ties")))


def apply_rule(effects: DataFrame, rule: Column, by: list[str] = TEST,
               arm: str = "arm") -> DataFrame:
    """Pick by any ordering expression over the effects' columns, e.g. effect - k*sqrt(var)."""
    scored = effects.withColumn("_score", rule)
    pick = F.max_by(F.struct(arm, "effect", "_score"), F.struct("_score", -F.col(arm)))
    return scored.groupBy(*by).agg(pick.alias("_w")).select(
        *by, f"_w.{arm}", "_w.effect", F.col("_w._score").alias("score"))


def value_of(selection: DataFrame, effects: DataFrame, by: list[str] = TEST,
             arm: str = "arm", link: str = "identity") -> DataFrame:
    """Value of the selected arm under the given effects."""
    v = F.col("effect") if link == "identity" else logistic("effect")
    return (selection.select(*by, arm)
            .join(effects.select(*by, arm, "effect"), [*by, arm])
            .select(*by, arm, v.alias("value")))


def uncorrected(effects: DataFrame, by: list[str] = TEST, arm: str = "arm",
                link: str = "identity") -> DataFrame:
    pick = select_winner(effects, by, arm)
    v = F.col("effect") if link == "identity" else logistic("effect")
    return pick.select(*by, F.lit("none").alias("estimator"),
                       F.col(arm).alias("selected_arm"), v.alias("naive"))


def top_two(arms: DataFrame, by: list[str] = TEST) -> DataFrame:
    """Best two arms side by side; the rank filter is applied before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col("rate").desc(), "source_row_id")
    ranked = (add_click_spread(arms).withColumn("_r", F.row_number().over(w))
              .where(F.col("_r") <= 2))
    picks = {"rate": "rate", "sd": "click_sd", "se": "click_se", "n": "impressions",
             "clicks": "clicks", "id": "source_row_id"}
    return ranked.groupBy(*by).agg(*[
        F.max(F.when(F.col("_r") == r, F.col(c))).alias(f"{short}_{r}")
        for short, c in picks.items() for r in (1, 2)])


def add_snr(top: DataFrame) -> DataFrame:
    """Gap of the best two over their pooled spread."""
    pooled = F.sqrt((F.col("sd_1") * F.col("sd_1") + F.col("sd_2") * F.col("sd_2")) / 2)
    return top.withColumn("snr", safe_ratio(F.col("rate_1") - F.col("rate_2"), pooled))


def test_records(arms: DataFrame) -> DataFrame:
    """One record per test: totals, the picked arm, its runner-up, gap and ties.

    Totals, ties and the pick come from one two-level aggregate (equal rates folded first);
    the runner-up from a rank filter that Spark applies before its shuffle.
    """
    n, c = F.col("impressions"), F.col("clicks")
    first = F.min(F.struct(
        F.col("source_row_id").alias("selected_source_row_id"),
        F.col("arm_ordinal").alias("selected_arm"), n.alias("selected_impressions"),
        c.alias("selected_clicks"), F.col("winner").alias("selected_winner"),
        F.col("first_place").alias("selected_first_place")))
    folded = arms.groupBy("test_id", "rate").agg(
        first.alias("_first"), F.count(F.lit(1)).alias("ties"), F.min("split").alias("split"),
        F.sum(n).alias("_n"), F.sum(c).alias("_c"), F.min(n).alias("_lo"), F.max(n).alias("_hi"))
    totals = folded.groupBy("test_id").agg(
        F.min("split").alias("split"), F.sum("ties").alias("n_arms"),
        F.sum("_n").alias("total_impressions"), F.sum("_c").alias("total_clicks"),
        F.min("_lo").alias("min_arm_impressions"), F.max("_hi").alias("max_arm_impressions"),
        F.max(F.struct(F.col("rate").alias("naive"), "ties", "_first")).alias("_w"))
    w = Window.partitionBy("test_id").orderBy(F.col("rate").desc(), "source_row_id")
    second = (arms.select("test_id", "rate", "source_row_id")
              .withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
              .groupBy("test_id").agg(F.max(F.when(F.col("_r") == 2, F.col("rate")))
                                      .alias("runner_up")))
    return totals.join(second, "test_id").select(
        "test_id", "split", "n_arms", "total_impressions", "total_clicks",
        "min_arm_impressions", "max_arm_impressions",
        (F.col("total_clicks") / F.col("total_impressions")).alias("pooled_rate"),
        "_w._first.*", "_w.naive", "runner_up",
        (F.col("_w.naive") - F.col("runner_up")).alias("gap"), "_w.ties")


def distribution_rule(effects: DataFrame, draws: int, by: list[str] = TEST,
                      arm: str = "arm", seed: int = 42, fast: bool = False) -> DataFrame:
    """Pick by the mean of draws from each effect's normal sampling distribution."""
    z = normal([*by, arm, "draw"], seed, "dist", fast)
    drawn = with_draws(effects.select(*by, arm, "effect", "var"), draws).withColumn(
        "_x", F.col("effect") + F.sqrt("var") * z)
    scores = drawn.groupBy(*by, arm).agg(F.first("effect").alias("effect"),
                                         F.avg("_x").alias("score"))
    pick = F.max_by(F.struct(arm, "effect", "score"), F.struct("score", -F.col(arm)))
    return scores.groupBy(*by).agg(pick.alias("_w")).select(*by, "_w.*")


