"""Plug-in and shrinkage queries."""

from pyspark.sql import functions as F

from honestpick.operators import effects as E, shrink as H
from honestpick.plans import roles as R
from honestpick.plans.catalog import query, rounded
from honestpick.plans.queries_arms import saved_effects
from honestpick.plans.queries_sources import _ERR, _errors
from honestpick.plans.sqltext import with_

_PAIR = dict(ps="""
  SELECT test_id, avg(y) FILTER (WHERE arm = 0) AS e0, avg(y) FILTER (WHERE arm = 1) AS e1,
    count(*) FILTER (WHERE arm = 0) AS n0, stddev_pop(y) AS sigma FROM pair_rows GROUP BY test_id""",
             pv="SELECT *, sigma * sqrt(2.0::DOUBLE / n0) AS v FROM ps")
_PHI = "exp(-({x}) * ({x}) / 2) / sqrt(2 * pi())"


@query("c1_correct_plugin", with_("pair_rows", **_PAIR) + f"""
SELECT test_id, 'plugin' AS estimator, CASE WHEN e1 > e0 THEN 1 ELSE 0 END AS selected_arm,
  round(greatest(e0, e1), 6) AS naive,
  round(greatest(e0, e1) - v * {_PHI.format(x='(e0 - e1) / v')}, 6) AS corrected,
  round(v * {_PHI.format(x='(e0 - e1) / v')}, 6) AS bias FROM pv""")
def _(spark, sf):
    return rounded(H.correct_plugin(R.pair_rows(spark, sf)), "naive", "corrected", "bias")


@query("c2_correct_plugin_integrated", with_("pair_rows", **_PAIR, num="""
  SELECT test_id, arm, y, row_number() OVER (PARTITION BY test_id, arm ORDER BY row_id) AS pos
  FROM pair_rows""", d=f"""
  SELECT a.test_id, avg({_PHI.format(x='abs(b.y - a.y) / v')}) AS d FROM num a
  JOIN num b ON a.test_id = b.test_id AND a.pos = b.pos AND a.arm = 0 AND b.arm = 1
  JOIN pv ON pv.test_id = a.test_id GROUP BY a.test_id""") + """
SELECT pv.test_id, 'plugin_integrated' AS estimator,
  CASE WHEN e1 > e0 THEN 1 ELSE 0 END AS selected_arm, round(greatest(e0, e1), 6) AS naive,
  round(greatest(e0, e1) - v * d, 6) AS corrected, round(v * d, 6) AS bias
FROM pv JOIN d ON pv.test_id = d.test_id""")
def _(spark, sf):
    return rounded(H.correct_plugin_integrated(R.pair_rows(spark, sf)), "naive", "corrected",
                   "bias")


@query("c3_correct_bayes_normal", with_("reff", "rpick", post="""
  SELECT *, 400.0::DOUBLE / (400 + var) * effect + (1 - 400.0::DOUBLE / (400 + var)) * 180 AS post
  FROM reff""") + """
SELECT p.test_id, 'bayes_normal' AS estimator, p.arm AS selected_arm, round(p.effect, 6) AS naive,
  round(q.post, 6) AS corrected, round(p.effect - q.post, 6) AS bias
FROM rpick p JOIN post q ON p.test_id = q.test_id AND p.arm = q.arm""")
def _(spark, sf):
    e = E.arm_effects(R.order_rows(spark, sf))
    return rounded(H.correct_bayes_normal(e, 180.0, 20.0), "naive", "corrected", "bias")


@query("c4_correct_eb_normal", with_("pick", "eb") + """
SELECT p.test_id, 'eb_normal' AS estimator, p.arm AS selected_arm, round(p.effect, 8) AS naive,
  round(post, 8) AS corrected, round(p.effect - post, 8) AS bias,
  round(prior_mean, 8) AS prior_mean, round(sqrt(prior_var), 8) AS prior_std
FROM pick p JOIN eb e ON p.test_id = e.test_id AND p.arm = e.arm""")
def _(spark, sf):
    e = saved_effects(spark, sf)
    return rounded(H.correct_eb_normal(e, tie="source_row_id"), "naive", "corrected", "bias",
                   "prior_mean", "prior_std", digits=8)


@query("c4b_correct_eb_normal_over_arm", with_("reff", "rpick", post="""
  SELECT *, pv / (pv + var) * effect + (1 - pv / (pv + var)) * pm AS post FROM (
    SELECT *, avg(effect) OVER w AS pm, var_pop(effect) OVER w AS pv FROM reff
    WINDOW w AS (PARTITION BY arm))""") + """
SELECT p.test_id, 'eb_normal' AS estimator, p.arm AS selected_arm, round(p.effect, 6) AS naive,
  round(post, 6) AS corrected, round(p.effect - post, 6) AS bias, round(pm, 6) AS prior_mean,
  round(sqrt(pv), 6) AS prior_std
FROM rpick p JOIN post q ON p.test_id = q.test_id AND p.arm = q.arm""")
def _(spark, sf):
    e = E.arm_effects(R.order_rows(spark, sf))
    return rounded(H.correct_eb_normal(e, over=["arm"]), "naive", "corrected", "bias",
                   "prior_mean", "prior_std")


@query("c5_correct_eb_tweedie")
def _(spark, sf):
    e = E.arm_effects(R.order_rows(spark, sf))
    return H.correct_eb_tweedie(e, over=["arm"], bin_width=10.0)


@query("c6_correct_eb_spike_slab")
def _(spark, sf):
    e = _centred(E.arm_effects(R.order_rows(spark, sf)))
    return H.correct_eb_spike_slab(e, over=["arm"])


def _centred(effects):
    """Effects as differences from the overall mean, so that zero is a meaningful spike."""
    from honestpick.functions.columns import attach_row
    mean = effects.agg(F.avg("effect").alias("_m"))
    return attach_row(effects, mean).withColumn("effect", F.col("effect") - F.col("_m")).drop("_m")


@query("c7_correct_spike_slab_selected")
def _(spark, sf):
    e = _centred(E.arm_effects(R.pair_rows(spark, sf)))
    return H.correct_spike_slab_selected(e)


@query("c8_eb_failures", with_(**_ERR) + """
SELECT setting, estimator, count(*) AS attempted,
  count(*) FILTER (WHERE repeat % 9 <> 0 AND abs(wc) / 10 < 5) AS retained,
  count(*) FILTER (WHERE repeat % 9 = 0) AS fit_failures,
  count(*) FILTER (WHERE repeat % 9 <> 0 AND NOT abs(wc) / 10 < 5) AS finite_outliers
FROM err GROUP BY setting, estimator""")
def _(spark, sf):
    errors = _errors(spark, sf).withColumn("val_est", F.when(
        F.col("repeat") % 9 != 0, F.col("val_true") + F.col("wc") / 10))
    return H.eb_failures(errors, ["setting", "estimator"])
