"""Backtest on real rows: every correction is made on one half and judged on the other."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from honestpick.operators import (bootstrap as B, effects as E, selective as S, shrink as H,
                                  splits as V)

ESTIMATORS = ["none", "standard", "moon", "split", "eb_normal", "hybrid_si"]
_OUT = ["estimator", "selected_arm", "naive", "corrected"]


def corrections(rows: DataFrame, estimators: list[str], keys: list[str], draws: int,
                splits: int = 8, power: float = 0.6, arm: str = "arm", value: str = "y",
                row_key: str = "row_id", seed: int = 42, fast: bool = False) -> DataFrame:
    """Long table (keys..., estimator, selected_arm, naive, corrected) from row data."""
    unknown = set(estimators) - set(ESTIMATORS)
    if unknown:
        raise ValueError(f"unknown estimators: {sorted(unknown)}")
    kw = dict(by=keys, arm=arm, value=value, row_key=row_key, seed=seed, fast=fast)
    effects = B.saved_effects(rows, keys, arm, value)

    def split():
        # inner splits use the column split_id too, so an outer one steps aside
        names = {"split_id": "outer_split"}
        inner = [names.get(k, k) for k in keys]
        parts = V.split_effects(rows.withColumnsRenamed(names), 0.5, splits, inner, arm, value,
                                row_key, seed, fast)
        values = V.split_values(parts, effects.withColumnsRenamed(names), inner, arm)
        return V.correct_split(values, inner).withColumnRenamed("outer_split", "split_id")

    made = {
        "none": lambda: E.uncorrected(effects, keys, arm).withColumn("corrected", F.col("naive")),
        "standard": lambda: B.correct_standard(rows, draws, effects=effects, **kw),
        "moon": lambda: B.correct_moon(rows, draws, power, effects=effects, **kw),
        "split": split,
        "eb_normal": lambda: H.correct_eb_normal(effects, keys, keys, arm),
        "hybrid_si": lambda: S.si_correct(effects, "hybrid", by=keys, arm=arm),
    }
    return reduce(DataFrame.unionByName,
                  [made[name]().select(*keys, *_OUT) for name in estimators])


def backtest(rows: DataFrame, splits: int, estimators: list[str], draws: int,
             by: list[str] = E.TEST, arm: str = "arm", value: str = "y",
             row_key: str = "row_id", seed: int = 42, fast: bool = False, **kw) -> DataFrame:
    """The split is just another key, so one plan covers all splits, tests and estimators."""
    keys = [*by, "split_id"]
    # a row's part is found again by comparison wherever it is read; only cuts are saved
    parts = V.split_rows(rows.select(*by, arm, row_key, value), 0.5, splits, [*by, arm],
                         row_key, seed, "backtest", fast)
    half = parts.where("in_est").drop("in_est")
    holdout = parts.where(~F.col("in_est")).groupBy(*keys, arm).agg(
        F.avg(value).alias("effect"))
    made = corrections(half, estimators, keys, draws, arm=arm, value=value, row_key=row_key,
                       seed=seed, fast=fast, **kw)
    return V.backtest_errors(made, holdout, keys, arm)
