import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from honestpick.functions import gauss
from honestpick.operators import effects as E, selective as S, shrink as H


def effects_df(spark, values, sd=None):
    rows = [(t, a, 100, float(e), float(s) ** 2) for t, arm in values.items()
            for a, (e, s) in enumerate(arm)]
    return spark.createDataFrame(rows, "test_id string, arm int, n bigint, effect double, var double")


def test_eb_normal_fixture(arms):
    e = E.arm_effects_from_counts(arms)
    got = {r.test_id: r for r in H.correct_eb_normal(e, tie="source_row_id").collect()}
    reg = got["regular"]
    assert abs(reg.prior_mean - 0.291667) < 1e-6 and abs(reg.corrected - 0.295238) < 1e-6
    # both arms equal: no prior spread, everything is the prior mean
    assert got["tie"].corrected == 0.5 and got["tie"].bias == 0.0


def test_bayes_normal(spark):
    e = effects_df(spark, {"t": [(1.0, 1.0), (2.0, 1.0)]})
    assert H.correct_bayes_normal(e, 0.0, 1.0).first().corrected == 1.0


def em_reference(x, v, pi=0.5, max_iter=30, tol=1e-6):
    def density(y, m, s2):
        return np.exp(-(y - m) ** 2 / (2 * s2)) / np.sqrt(2 * np.pi * s2)
    mu, tau = x.mean(), x.var()
    for _ in range(max_iter):
        a, b = pi * density(x, 0, v), (1 - pi) * density(x, mu, v + tau)
        r = b / (a + b)
        new = (1 - r.mean(), (r * x).sum() / r.sum())
        t = max(1e-6, (r * ((x - new[1]) ** 2 - v)).sum() / r.sum())
        moved = max(abs(new[0] - pi), abs(new[1] - mu), abs(t - tau))
        pi, mu, tau = new[0], new[1], t
        if moved < tol:
            break
    return pi, mu, tau


def test_spike_slab_matches_direct_em(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(200) < 0.5, 0, rng.normal(3, 1, 200)) + rng.normal(0, 0.5, 200)
    df = spark.createDataFrame([("g", i, float(v), 0.25) for i, v in enumerate(x)],
                               "g string, arm int, effect double, var double")
    p = H.spike_slab_fit(df, ["g"], max_iter=30, chunk=10).first()
    want = em_reference(x, np.full(200, 0.25))
    assert np.allclose([p.pi, p.mu0, p.tau2], want, atol=1e-6)
    post = H.posterior_spike_slab(df, H.spike_slab_fit(df, ["g"], max_iter=5), ["g"])
    assert post.where(F.abs("posterior") > F.abs("effect") + 1.5).isEmpty()


def test_selected_posterior_against_grid():
    y, other, s2, so, pi, mu0, tau2 = 0.5, 0.3, 0.04, 0.05, 0.3, 0.2, 0.1
    got = H.selected_posterior(*[np.array([v]) for v in (y, other, s2, so, pi, mu0, tau2)],
                               epsilon=0.01)[0]
    mu = np.linspace(-4, 4, 400_001)

    def pdf(x, m, v):
        return np.exp(-(x - m) ** 2 / (2 * v)) / np.sqrt(2 * np.pi * v)
    prob = np.maximum(gauss.cdf((mu - other) / np.sqrt(s2 + so)), 1e-12)
    g = pdf(y, mu, s2) * (pi * pdf(mu, 0, 0.01) + (1 - pi) * pdf(mu, mu0, tau2)) / prob
    assert abs(got - (mu * g).sum() / g.sum()) < 1e-6


def test_tweedie_shrinks_a_normal_sample(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, np.sqrt(2), 4000)        # prior N(0,1), noise N(0,1)
    df = spark.createDataFrame([(i, float(v), 1.0) for i, v in enumerate(x)],
                               "arm int, effect double, var double")
    out = H.posterior_eb_tweedie(df, [], dof=3, bin_width=0.2).toPandas()
    assert not out.fit_failed.any()
    mid = out[out.effect.abs() < 2]
    assert np.abs(mid.posterior - mid.effect / 2).mean() < 0.15


def test_tweedie_failure_is_null(spark):
    df = spark.createDataFrame([("g", 0, 1.0, 1.0), ("g", 1, 1.1, 1.0)],
                               "g string, arm int, effect double, var double")
    out = H.posterior_eb_tweedie(df, ["g"], bin_width=0.2).collect()
    assert len(out) == 2 and all(r.posterior is None and r.fit_failed for r in out)


def test_tweedie_with_a_far_outlier(spark):
    """The range, hence the number of bins, may be anything; NULL keys are a group."""
    rng = np.random.default_rng(6)
    rows = [(g, i, float(v), 1.0) for g in ("a", None) for i, v in enumerate(
        [*rng.normal(0, 2, 3000), *([1e9] if g is None else [5e3])])]
    df = spark.createDataFrame(rows, "g string, arm int, effect double, var double")
    out = H.posterior_eb_tweedie(df, ["g"]).toPandas()
    assert len(out) == len(rows) and not out.fit_failed.any()


def test_smooth_fit_equals_the_fit_over_all_bins():
    rng = np.random.default_rng(7)
    v = np.sort(rng.normal(0, 40, 3000))
    v -= v[0]
    nb, w = int(np.ceil(v[-1] / 0.2)), 0.2
    bins, counts = np.unique(np.minimum((v / w).astype(int), nb - 1), return_counts=True)
    x = (np.arange(nb) + 0.5) * w
    knots = np.quantile(x, [0, 0.5, 1])
    dense = np.zeros(nb)
    dense[bins] = counts
    x0, scale = x.mean(), x.std()
    want = H._poisson_fit(H._natural_basis((x - x0) / scale, (knots - x0) / scale), dense)
    at = np.arange(nb - 1)
    y, m = H._smooth_fit((bins + 0.5) * w, counts.astype(float), nb, 3, w, at)
    assert np.allclose(y[:nb - 1], want[:-1], atol=1e-3)
    assert np.allclose(m[:nb - 1], H._spline_curvature(want, w)[:-1], atol=1e-4)


def test_spline_curvature_is_natural_interpolation():
    y = np.array([0.0, 1.0, 0.0, 2.0, 1.0])
    m = H._spline_curvature(y, 0.5)
    assert m[0] == 0 and m[-1] == 0
    lhs = m[:-2] + 4 * m[1:-1] + m[2:]
    assert np.allclose(lhs, 6 * (y[2:] - 2 * y[1:-1] + y[:-2]) / 0.25)


def test_selective_fixture(spark):
    e = effects_df(spark, {"a": [(0.98, 0.02), (1.0, 0.02)], "b": [(0.5, 0.02), (1.0, 0.02)],
                           "c": [(0.9999, 0.02), (1.0, 0.02)], "tie": [(1.0, 0.02), (1.0, 0.02)],
                           "one": [(1.0, 0.02)], "flat": [(0.5, 0.0), (1.0, 0.0)]})
    cond = {r.test_id: r for r in S.si_correct(e, "conditional").collect()}
    hyb = {r.test_id: r for r in S.si_correct(e, "hybrid").collect()}
    assert abs(cond["a"].corrected - 0.993726) < 1e-6
    assert abs(hyb["a"].corrected - 0.993782) < 1e-6
    assert abs(cond["b"].corrected - 1.0) < 1e-9
    assert abs(hyb["c"].corrected - 0.939642) < 1e-6
    for t, status in (("tie", "tie"), ("one", "single_arm"), ("flat", "no_spread")):
        assert cond[t].corrected is None and cond[t].status == status
        assert hyb[t].corrected is None and hyb[t].status == status


def test_root_residuals():
    rng = np.random.default_rng(2)
    gap = 10.0 ** rng.uniform(-3, 1, 500)
    x, sd = np.ones(500), np.full(500, 0.1)
    b = x - gap * sd
    for q in (0.025, 0.5, 0.975):
        mu = S.conditional_root(x, sd, b, q)
        ok = np.isfinite(mu)
        assert ok.mean() > 0.9
        assert np.max(np.abs(gauss.tail_ratio((x - mu) / sd, (b - mu) / sd) - q)[ok]) < 1e-9
    mu = S.hybrid_root(x, sd, b, np.full(500, 3), 0.5)
    assert np.isfinite(mu).all()


def test_projection_and_intervals(spark):
    e = effects_df(spark, {"t": [(1.0, 0.3), (2.0, 0.4)]})
    p = S.projection_interval(e, alpha=0.005).first()
    assert abs(p.c_alpha - 3.022962) < 1e-6
    assert math.isclose(p.ci_low, 2 - p.c_alpha * 0.4) and math.isclose(p.ci_high, 2 + p.c_alpha * 0.4)
    kinds = {r.kind: r for r in S.intervals(e).collect()}
    assert set(kinds) == {"conventional", "conditional", "projection", "hybrid"}
    assert all(k.ci_low < k.ci_high for k in kinds.values())
    assert kinds["projection"].width > kinds["conventional"].width


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        S.root_column("other")
