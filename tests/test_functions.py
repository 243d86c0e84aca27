import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from honestpick.functions import draws as D, gauss, quantiles, ranks
from honestpick.functions.columns import bin_arm_count, coerce_bool, finite, safe_ratio


def test_coerce_bool(spark):
    texts = ["true", " TRUE ", "1", "Yes", "y", "t", "no", "0", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [r[0] for r in df.select(coerce_bool("c")).collect()]
    assert got == [True] * 6 + [False] * 4


def test_safe_ratio_and_finite(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, float("inf")),
                                (1.0, float("nan"))], "a double, b double")
    assert [r[0] for r in df.select(safe_ratio("a", "b")).collect()] == [0.5, None, None, None]
    assert [r[0] for r in df.select(finite("b")).collect()] == [2.0, 0.0, None, None]


def test_arm_count_bins(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 5, 6, 7, 8, 40)], "n int")
    assert [r[0] for r in df.select(bin_arm_count("n")).collect()] == [
        None, "2", "5", "6-7", "6-7", "8+", "8+"]


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_exact_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.lognormal(0, 2, n), 2)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("h", 1.5), ("h", None)],
                               "k string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r.k: r for r in quantiles.exact_quantiles(df, "v", probs, ["k"]).collect()}
    assert got["g"].n == n
    assert np.allclose(got["g"].q, np.quantile(x, probs))
    assert got["h"].q == [1.5] * 7


@pytest.mark.parametrize("limit, bins", [(0, 8), (30, 16), (10_000, 4_096)])
def test_exact_quantiles_by_refinement(spark, limit, bins):
    """Ties, heavy tails, infinities, values that differ in the last bit, any work settings."""
    rng = np.random.default_rng(1)
    groups = {"ties": np.arange(3_000)[::-1] % 79 * 1.0, "one": np.full(50, 2.5),
              "tails": np.exp(rng.normal(0, 60, 900)) * rng.choice([-1, 1], 900),
              "near": np.repeat([1.0, np.nextafter(1, 2), np.nextafter(1, 0)], 20),
              "ends": np.array([-np.inf] * 3 + [0.0, 1.0, 2.0] + [np.inf] * 3),
              "wide": np.array([-1.7e308, -1.0, -5e-324, 0.0, 5e-324, 3.0, 1.7e308]), None: [7.0]}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("no", None)],
                               "k string, v double").repartition(6)
    probs = [0.0, 0.125, 0.5, 0.75, 1.0]
    got = {r.k: (r.n, r.q) for r in quantiles.exact_quantiles(
        df, "v", probs, ["k"], limit=limit, bins=bins).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        x = np.sort(np.array(x))
        at = np.array(probs) * (len(x) - 1)
        lo, hi = x[np.floor(at).astype(int)], x[np.ceil(at).astype(int)]
        with np.errstate(invalid="ignore"):
            want = lo * (1 - at % 1) + hi * (at % 1)
        assert got[k][0] == len(x) and np.allclose(got[k][1], want, rtol=1e-12, atol=0,
                                                   equal_nan=True), k
    whole = quantiles.exact_quantiles(df.where("k = 'ties'"), "v", [0.5], limit=limit,
                                      bins=bins).first()
    assert whole.q == [float(np.median(groups["ties"]))]
    assert quantiles.exact_quantiles(df.where("false"), "v", [0.5]).count() == 0


def test_quantiles_exchange_counters_only(spark):
    df = spark.range(50_000).select((F.col("id") % 7).cast("double").alias("v"), F.lit(1).alias("g"))
    plan = quantiles.exact_quantiles(df, "v", [0.5], ["g"])._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "raise_error" not in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("rows_per_bucket", [10, 500_000])
def test_position_is_global_rank(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", rows_per_bucket)
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7).alias("x"))
    out = ranks.with_position(df, ["g"], ["x"], ranks.id_bucket(df, ["g"], "x")).collect()
    for g in range(3):
        rows = sorted((r for r in out if r.g == g), key=lambda r: r.x)
        assert [r.pos for r in rows] == list(range(len(rows)))
        assert all(r.n == len(rows) for r in rows)


def test_hash_digits_follow_the_largest_group(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 10)
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("g"))
    assert ranks.hex_digits(df, ["g"]) == 2 and ranks.hex_digits(df, []) == 2
    assert ranks.hex_digits(df.limit(5), ["g"]) == 0


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(0, 200).withColumnRenamed("id", "row_id")

    def total(parts, fast):
        w = D.with_poisson_weights(df.repartition(parts), 10, ["row_id"], 1, "s", fast)
        return sorted(map(tuple, w.collect()))
    for fast in (False, True):
        assert total(1, fast) == total(7, fast)


@pytest.mark.parametrize("fast", [False, True])
def test_poisson_weights_have_unit_mean_and_variance(spark, fast):
    df = spark.range(0, 2000)
    w = D.with_poisson_weights(df, 50, ["id"], 3, "m", fast)
    s1, s2 = w.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("weight"))).first()
    n = 2000 * 50
    assert abs(s1 / n - 1) < 0.015
    assert abs(s2 / n - (s1 / n) ** 2 - 1) < 0.03


def test_later_draws_are_the_same_draws(spark):
    df = spark.range(0, 50)
    whole = D.with_poisson_weights(df, 20, ["id"], 1, "s").where("draw >= 9")
    part = D.with_poisson_weights(df, 20, ["id"], 1, "s", first=9)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, part.collect()))


def test_normal_and_small_rate_poisson(spark):
    df = spark.range(0, 20000)
    m, s = df.select(D.normal(["id"], 1, "z").alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(m) < 0.03 and abs(s - 1) < 0.03
    w = D.poisson_rate_weight(D.uniform(["id"], 1, "p"), F.lit(0.3))
    assert abs(df.agg(F.avg(w)).first()[0] - 0.3) < 0.02


def test_binomial_and_hypergeometric_means(spark):
    df = spark.createDataFrame([("a", 100, 0.3), ("b", 50, 0.8)], "k string, n bigint, p double")
    b = df.select("k", F.explode(D.binomial_array(F.col("n"), F.col("p"),
                                                  D.row_seed(["k"], 1, 1), 4000)).alias("x"))
    got = dict(b.groupBy("k").agg(F.avg("x")).collect())
    assert abs(got["a"] - 30) < 0.4 and abs(got["b"] - 40) < 0.3
    h = df.select("k", F.explode(D.hypergeometric_array(
        F.lit(20).cast("bigint"), F.col("n"), F.lit(10).cast("bigint"),
        D.row_seed(["k"], 1, 2), 4000)).alias("x"))
    got = dict(h.groupBy("k").agg(F.avg("x")).collect())
    assert abs(got["a"] - 2) < 0.1 and abs(got["b"] - 4) < 0.1


@settings(max_examples=200, deadline=None)
@given(st.floats(-8, 8))
def test_upper_tail(z):
    assert math.isclose(float(gauss.upper_tail(z)), 0.5 * math.erfc(z / math.sqrt(2)),
                        rel_tol=1e-11, abs_tol=1e-300)


@settings(max_examples=200, deadline=None)
@given(st.floats(-3, 3), st.floats(0.01, 4), st.floats(0.0, 1.0), st.floats(-30, 30))
def test_truncnorm_cdf_is_a_cdf(a, width, share, mu):
    x = a + width * share
    p = float(gauss.truncnorm_cdf(x, a, a + width, mu, 1.0))
    assert -1e-12 <= p <= 1 + 1e-12
    assert float(gauss.truncnorm_cdf(a - 1, a, a + width, mu, 1.0)) == 0
    assert float(gauss.truncnorm_cdf(a + width + 1, a, a + width, mu, 1.0)) == 1


def test_truncnorm_plain_case():
    def phi(z):
        return 0.5 * math.erfc(-z / math.sqrt(2))
    want = (phi(0.5) - phi(-1)) / (phi(2) - phi(-1))
    assert math.isclose(float(gauss.truncnorm_cdf(0.5, -1, 2, 0, 1)), want, rel_tol=1e-12)
    assert math.isnan(float(gauss.truncnorm_cdf(0.5, 2, 2, 0, 1)))


def test_max_abs_quantile():
    assert abs(gauss.max_abs_quantile(2, 0.005) - 3.022962) < 1e-6
