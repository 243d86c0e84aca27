import numpy as np
import pytest
from pyspark.sql import functions as F

from honestpick.operators import prep as P, regress as G, report as Q


def err(spark, rows):
    return spark.createDataFrame(rows, "setting string, estimator string, repeat int, wc double")


def test_error_stats_fixture(spark):
    e = err(spark, [("s", "none", 0, -.02), ("s", "none", 1, .04), ("s", "split", 0, -.01),
                    ("s", "split", 1, .03)]).withColumn("gap", F.lit(0.1))
    mean = {r.estimator: r for r in Q.error_stats(e, ["setting"], gap="gap").collect()}
    mae = {r.estimator: r for r in Q.error_stats(e, ["setting"], "mae").collect()}
    assert abs(mean["none"].mean - 10) < 1e-9 and abs(mean["none"].std - 30) < 1e-9
    assert abs(mae["none"].mean - .03) < 1e-12 and abs(mae["split"].mean - .02) < 1e-12
    with pytest.raises(ValueError):
        Q.error_stats(e, ["setting"], "other")


def test_own_truth(spark):
    est = spark.createDataFrame([("s", 0, "split", 10.0, 9.98), ("s", 1, "split", 10.0, 10.04),
                                 ("s", 0, "none", 10.0, None)],
                                "setting string, repeat int, estimator string, val_est double, "
                                "own_true double")
    truth = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 1.0)],
                                  "setting string, repeat int, naive_true double")
    out = Q.error_measures(est, truth, ["setting", "repeat"])
    assert abs(out.where("estimator = 'split'").agg(F.avg(F.abs("wc"))).first()[0] - .03) < 1e-9
    assert not out.where("estimator = 'none'").first().valid


def test_depth_stats_fixture(spark):
    e = err(spark, [("a", "none", i, w) for i, w in enumerate([-1., 3., 2.])]
            + [("b", "none", i, w) for i, w in enumerate([-2., 4.])] + [("c", "none", 0, 2.)])
    got = {r.setting: r for r in Q.depth_stats(e, ["setting"]).collect()}
    assert (got["b"].repeats, got["b"].mean_wc, got["b"].mae) == (2, 1, 3)
    assert got["b"].mc_se == pytest.approx(3)
    assert got["c"].mc_se is None
    with pytest.raises(ValueError):
        Q.depth_stats(e, ["setting"], gap=0.0)


def test_policy_comparison_fixture(spark):
    e = spark.createDataFrame([("s", r, n, v) for n, vals in (("none", (1., 4., 7.)),
                                                              ("split", (0., 3., 6.)))
                               for r, v in enumerate(vals)],
                              "setting string, repeat int, estimator string, val_true double")
    p = Q.policy_comparison(e, None, ["setting"]).first()
    assert (p.difference, p.difference_se, p.agreement) == (1.0, 0.0, None)
    picks = spark.createDataFrame([("s", r, c, n, (r if n == "none" else 0)) for r in (0, 1)
                                   for c in range(3) for n in ("none", "split")],
                                  "setting string, repeat int, customer_id int, estimator string, "
                                  "arm int")
    rates = Q.agreement_rates(picks, "none", "split", ["setting"])
    p = Q.policy_comparison(e.where("repeat < 2"), rates, ["setting"]).first()
    assert (p.agreement, p.agreement_se) == (0.5, 0.5)
    for bad in (rates.withColumn("rate", F.lit(1.5)), rates.where("repeat = 0")):
        with pytest.raises(Exception, match="one rate in"):
            Q.policy_comparison(e.where("repeat < 2"), bad, ["setting"]).collect()


def test_moon_table_and_order(spark):
    e = spark.createDataFrame(
        [(100, "none", None, w) for w in (1., 3.)] + [(100, "standard", None, w)
                                                      for w in (.5, 1.5)]
        + [(100, "moon", .4, w) for w in (.1, .3)],
        "size int, estimator string, power double, wc double")
    t = Q.moon_table(e, "size", [.4])
    assert t.columns == ["size", "none", "standard", "gamma_0.4"]
    assert abs(t.first()["gamma_0.4"] - .2) < 1e-12
    names = spark.createDataFrame([("split", 0), ("moon", 1), ("none", 2), ("zzz", 3)],
                                  "estimator string, position int")
    assert [r.estimator for r in Q.order_estimators(names, "position").collect()] == [
        "none", "moon", "split", "zzz"]


def test_per_test_estimates_and_summary(arms):
    kw = dict(draws=5, splits=5, seed=42)
    a = Q.per_test_estimates(arms, Q.COUNT_ESTIMATORS, **kw)
    b = Q.per_test_estimates(arms.repartition(3), Q.COUNT_ESTIMATORS, **kw)
    assert a.count() == 10
    cols = ["test_id", "estimator", F.round("corrected", 9), F.round("bias_sd", 9), "status"]
    assert a.select(*cols).exceptAll(b.select(*cols)).isEmpty()
    wide = Q.wide_estimates(a, Q.COUNT_ESTIMATORS)
    assert wide.count() == 2 and "hybrid_si_corrected" in wide.columns
    s = Q.summarize(a).where("group = 'overall' and estimator = 'eb_normal'").first()
    assert s.n_tests == 2 and s.selected_impressions == 20
    with pytest.raises(ValueError, match="unknown estimators"):
        Q.per_test_estimates(arms, ["other"])


def test_compare_to_expected(spark):
    a = spark.createDataFrame([("x", 1.234), ("y", 2.0)], "k string, v double")
    e = spark.createDataFrame([("x", 1.23, 2), ("y", 2.1, 1)],
                              "k string, expected double, digits int")
    got = {r.k: r.matches for r in Q.compare_to_expected(a, e, ["k"], "v").collect()}
    assert got == {"x": True, "y": False}


@pytest.fixture(scope="module")
def regression_data(spark):
    rng = np.random.default_rng(11)
    n = 400
    g, x, z = rng.integers(0, 4, n), rng.normal(size=n), rng.uniform(0, 5, n)
    y = 1 + 0.5 * x + np.array([0, 1, -1, 2])[g] + np.sin(z) + rng.normal(size=n) * (1 + x**2) / 3
    week = rng.integers(0, 25, n)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d), int(w)) for a, b, c, d, w
                                in zip(g, x, z, y, week)],
                               "g int, x double, z double, y double, week int").repartition(3)
    return df, g, x, z, y, week


def robust(X, e, groups=None):
    bread = np.linalg.inv(X.T @ X)
    if groups is None:
        h = np.einsum("ni,ij,nj->n", X, bread, X)
        s = X * (e / (1 - h))[:, None]
        return bread @ (s.T @ s) @ bread
    S = np.array([(X * e[:, None])[groups == k].sum(0) for k in np.unique(groups)])
    n, k, G = len(X), X.shape[1], len(S)
    return bread @ (S.T @ S) @ bread * G / (G - 1) * (n - 1) / (n - k)


@pytest.mark.parametrize("wide", [False, True])
def test_ols_and_robust_errors_match_numpy(regression_data, monkeypatch, wide):
    df, g, x, z, y, week = regression_data
    monkeypatch.setattr(G, "WIDE", 2 if wide else 16)
    fit = G.ols(df, "y", ["x", G.C("g")], keep=["week"])
    X = np.column_stack([np.ones_like(x), x] + [(g == k) * 1.0 for k in (1, 2, 3)])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    assert np.allclose(fit.beta, beta, atol=1e-9)
    e = y - X @ beta
    assert abs(fit.r2 - (1 - e @ e / ((y - y.mean()) @ (y - y.mean())))) < 1e-9
    cov, groups = G.cluster_cov(fit, "week")
    assert groups == 25 and np.allclose(cov, robust(X, e, week), atol=1e-10)
    assert np.allclose(G.hc3_cov(fit), robust(X, e), atol=1e-10)
    adj = {r.g: r for r in G.adjusted_means(fit, cov, "g").collect()}
    mean_x = X.mean(0)
    for k in range(4):
        row = mean_x.copy()
        row[2:] = [k == 1, k == 2, k == 3]
        assert abs(adj[str(k)].adjusted - row @ beta) < 1e-9
        assert abs(adj[str(k)].se - np.sqrt(row @ cov @ row)) < 1e-9
    sizes = np.array([(g == k).sum() for k in range(4)])
    average = sum(sizes[k] * adj[str(k)].adjusted for k in range(4)) / sizes.sum()
    assert abs(average - y.mean()) < 1e-9


def test_bspline_partition_of_unity_and_curve(regression_data):
    df, g, x, z, y, week = regression_data
    term = G.prepare(df, [G.Bs("z", 5)])[0]
    assert len(term.knots) == 4 and np.allclose(term.knots, np.quantile(z, [0, 1/3, 2/3, 1]))
    cols = G.bspline("z", term.knots)
    assert len(cols) == 5
    pdf = df.select("z", *[c.alias(f"b{i}") for i, c in enumerate(cols)]).toPandas()
    b = pdf[[f"b{i}" for i in range(5)]].to_numpy()
    assert (b >= -1e-12).all() and (b.sum(1) <= 1 + 1e-9).all()
    assert abs(b[pdf.z.argmax(), 4] - 1) < 1e-9
    fit = G.ols(df, "y", [G.Bs("z", 5), "x"], keep=["week"])
    cov, _ = G.cluster_cov(fit, "week")
    curve = G.adjusted_curve(df, fit, cov, "z", points=20).toPandas()
    assert len(curve) == 20 and abs(curve.z.iloc[0] - np.quantile(z, 0.01)) < 1e-9
    assert np.abs(curve.adjusted - curve.adjusted.mean()
                  - (np.sin(curve.z) - np.sin(curve.z).mean())).mean() < 0.3


def test_collinearity_and_decompose(regression_data):
    df, g, x, z, y, week = regression_data
    c = {(r.kind, r.a, r.b): r.value for r in G.collinearity(df, ["x", "z", "y"]).collect()}
    inv = np.linalg.inv(np.corrcoef([x, z, y]))
    assert abs(c[("vif", "x", "x")] - inv[0, 0]) < 1e-9
    assert abs(c[("partial", "x", "y")] + inv[0, 2] / np.sqrt(inv[0, 0] * inv[2, 2])) < 1e-9
    d = G.decompose(df, "g", 0, 1, {"x": 2.0}).first()
    assert abs(d.contribution - 2 * (x[g == 1].mean() - x[g == 0].mean())) < 1e-9


def test_samples_may_overlap(spark):
    df = spark.range(4)
    s = G.in_samples(df, {"all": F.lit(True), "big": F.col("id") > 1})
    assert s.count() == 6
    assert P.quantile_bins(df, {"b": "id"}, 2).count() == 4
