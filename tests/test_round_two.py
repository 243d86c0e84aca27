"""Outcomes, keys and groups that are NULL; keys of any type; sizes of any shape."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from honestpick.functions import draws as D, ranks
from honestpick.operators import bootstrap as B, effects as E, report as Q, selective as S
from honestpick.operators import splits as V, targeting as T


@pytest.fixture(scope="module")
def half_null(spark):
    rows = [("t", a, a * 100 + i, float(10 + a + i % 3) if i % 2 else None)
            for a in range(2) for i in range(40)]
    return spark.createDataFrame(rows, "test_id string, arm int, row_id bigint, y double")


def test_null_outcomes_change_nothing(half_null):
    """As if those rows were not there."""
    there = half_null.where("y IS NOT NULL")
    for run in (lambda d: B.correct_standard(d, 40), lambda d: B.correct_moon(d, 20, 0.6),
                lambda d: B.correct_moon(d, 20, 0.6, mode="poisson"),
                lambda d: V.correct_jackknife(d)):
        a, b = run(half_null).collect(), run(there).collect()
        assert a == b and a[0].corrected == pytest.approx(b[0].corrected)
    drawn = B.poisson_draws(half_null, 300).groupBy("arm").agg(F.avg("effect").alias("m"))
    want = {r.arm: r.effect for r in E.arm_effects(half_null).collect()}
    for r in drawn.collect():
        assert r.m == pytest.approx(want[r.arm], abs=0.1)


def test_null_outcomes_in_a_fit(spark):
    rows = [(i % 2 + 1, float(i % 7), 5.0 if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, x double, y double")
    for r in T.fit_arm_ols(df, ["x"]).collect():
        assert r.n == sum(1 for t, _, y in rows if t == r.arm + 1 and y is not None)
        assert sorted(r.beta)[-1] == pytest.approx(5.0) and sum(r.beta) == pytest.approx(5.0)


def test_folds_follow_the_key_of_any_type(spark):
    rng = np.random.default_rng(0)
    rows = [("t", a, i * 3 + a, float(rng.normal())) for a in range(3) for i in range(33)]
    df = spark.createDataFrame(rows, "test_id string, arm int, row_id bigint, y double")
    keys = {"bigint": F.col("row_id"), "smallint": F.col("row_id").cast("smallint"),
            "decimal": F.col("row_id").cast("decimal(20,2)"),
            "text": F.lpad(F.col("row_id").cast("string"), 8, "0")}
    got = {k: V.correct_kfold(df.withColumn("row_id", c), 5).first().corrected
           for k, c in keys.items()}
    assert len({round(v, 9) for v in got.values()}) == 1


@pytest.mark.parametrize("far", [None, 10 ** 9])
def test_buckets_follow_crowded_ids(spark, monkeypatch, far):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 1_000)
    ids = list(range(20_000)) + ([far] if far else [])
    df = spark.createDataFrame([(i, f"{i:012d}") for i in ids], "i bigint, s string")
    for c, cut in (("i", ranks.id_bucket), ("s", ranks.prefix_bucket)):
        b = cut(df, [], c)
        largest = df.groupBy(b).count().agg(F.max("count")).first()[0]
        assert largest < 2_000
        got = ranks.with_position(df, [], [c], b)
        assert got.where("i < 20000 AND pos <> i OR i >= 20000 AND pos <> 20000").count() == 0


def test_null_groups_keep_their_quantiles(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 7.0), ("a", 1.0)], "g string, v double")
    main = df.groupBy("g").agg(F.count("v").alias("n"))
    out = {r.g: r.m for r in Q.with_quantiles(main, df, "v", {"m": 0.5}, ["g"]).collect()}
    assert out == {None: 6.0, "a": 1.0}
    si = spark.createDataFrame([(None, 10, 1), (None, 10, 3), ("a", 10, None)],
                               "g string, customers int, not_converged int")
    got = {r.g: r.median_not_converged for r in S.si_convergence(si, ["g"]).collect()}
    assert got == {None: 2.0, "a": None}


def test_an_estimator_without_values_stays(spark):
    e = spark.createDataFrame(
        [("a", 1.0, 0.5, 0.5, 0.5, 0.1, 2.0, 1.9), ("b", 1.0, None, None, None, None, None, 1.9)],
        "estimator string, actual_bias double, estimated_bias double, error double, "
        "abs_error double, residual double, corrected double, holdout_value double")
    got = {r.estimator: r.median_abs_error for r in V.backtest_summary(e).collect()}
    assert got == {"a": 0.5, "b": None}


def test_presentation_order(spark):
    names = ["double", "split_50", "hybrid_si", "eb_normal", "standard_x", "moon_0.6", "none",
             "standard", "bayes_normal", "conditional", "conditional_si", "plugin"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, estimator string")
    got = [r.estimator for r in Q.order_estimators(df, "i").collect()]
    assert got == ["none", "standard", "moon_0.6", "eb_normal", "bayes_normal", "hybrid_si",
                   "conditional_si", "split_50", "double", "standard_x", "conditional", "plugin"]


@pytest.mark.parametrize("good, total, sample", [
    (3, 10, 4), (50, 100, 60), (990, 1000, 500), (29, 31, 30), (0, 9, 4), (9, 9, 4),
    (10 ** 9, 3 * 10 ** 9, 10 ** 9), (4 * 10 ** 17, 10 ** 18, 5 * 10 ** 17)])
def test_hypergeometric_at_all_sizes(good, total, sample):
    n = 20_000
    x = D.hypergeometric([1], [good], [total], [sample], n)[0]
    p = good / total
    sd = (sample * p * (1 - p) * (total - sample) / max(1, total - 1)) ** 0.5
    assert abs(x.mean() - sample * p) <= 5 * sd / n ** 0.5 + 1e-9
    assert x.std() == pytest.approx(sd, rel=0.03, abs=1e-9)
    if total <= 100:
        y = np.random.default_rng(2).hypergeometric(good, total - good, sample, n)
        for k in np.unique(y):
            assert abs((x == k).mean() - (y == k).mean()) < 0.02


def test_package_is_found_from_another_folder(tmp_path):
    """A session in another working folder, with the package shipped."""
    code = (f"import sys; sys.path.insert(0, {os.getcwd()!r})\n"
            "from honestpick.session import local_session, ship_package\n"
            "s = local_session('2', 2, '1g'); ship_package(s)\n"
            "from pyspark.sql import functions as F\n"
            "from honestpick.functions.draws import binomial_array\n"
            "d = s.range(3).select(F.size(binomial_array(F.lit(5), F.lit(.5), F.col('id'), 4)))\n"
            "print('sizes', [r[0] for r in d.collect()])\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, timeout=300,
                         capture_output=True, text=True)
    assert "sizes [4, 4, 4]" in out.stdout, out.stderr[-2000:]


def test_markets_without_values_stay(spark):
    """No outside choice was seen in market b, so none of its products has a value."""
    from honestpick.operators import assortment as A
    rows = [("a", i, ["x", "y", "outside"][i % 3]) for i in range(30)]
    rows += [("b", i, "x") for i in range(5)]
    df = spark.createDataFrame(rows, "market string, row_id bigint, product string")
    effects = A.mnl_fixed_effects(A.choice_counts(df, ["x", "y"]))
    got = {r.market: (r.members, r.value) for r in A.best_assortment(effects, 1).collect()}
    assert got["b"] == ([], None) and len(got["a"][0]) == 1
    out = {r.market: r for r in A.assortment_correct(df, ["x", "y"], [1], 10).collect()}
    assert out["b"].naive is None and out["b"].corrected is None and out["a"].corrected is not None
