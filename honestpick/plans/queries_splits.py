"""Split, cross-validation and backtest queries (V1-V9)."""

from pyspark.sql import functions as F

from honestpick.functions.lineage import save_table
from honestpick.operators import bootstrap as B, effects as E, splits as V
from honestpick.plans import backtest, roles as R
from honestpick.plans.catalog import query, rounded
from honestpick.plans.queries_arms import saved_effects
from honestpick.plans.queries_bootstrap import bias_sql, drawn_sql, index_sql
from honestpick.plans.sqltext import hash_sql, with_

SPLITS = 8


def parts_sql(source="rows_", splits=SPLITS, fraction=0.5, by="test_id, arm", salt="split"):
    h = hash_sql("CAST(row_id AS VARCHAR), CAST(split_id AS VARCHAR)", 42, salt)
    return f"""
  SELECT *, rk <= floor(n * {fraction}::DOUBLE) AS in_est FROM (
    SELECT *, row_number() OVER (PARTITION BY {by}, split_id ORDER BY h, row_id) AS rk,
      count(*) OVER (PARTITION BY {by}, split_id) AS n
    FROM (SELECT *, {h} AS h FROM {source},
      (SELECT CAST(range AS INTEGER) AS split_id FROM range({splits}))))"""


_PARTS = dict(parts=parts_sql(), pe="""
  SELECT test_id, split_id, arm, avg(y) FILTER (WHERE in_est) AS est_effect,
    avg(y) FILTER (WHERE NOT in_est) AS eval_effect FROM parts GROUP BY test_id, split_id, arm""")
_VALUES = dict(_PARTS, vals="""
  SELECT b.*, p.arm AS full_winner, p.effect AS naive, f.eval_effect AS full_winner_value FROM (
    SELECT test_id, split_id, arm AS selected_arm, est_effect AS est_value,
      eval_effect AS eval_value FROM (
      SELECT *, row_number() OVER (PARTITION BY test_id, split_id ORDER BY est_effect DESC, arm)
        AS k FROM pe) WHERE k = 1) b
  JOIN rpick p ON b.test_id = p.test_id
  JOIN pe f ON f.test_id = b.test_id AND f.split_id = b.split_id AND f.arm = p.arm""")


def _values(spark, sf):
    data = R.order_rows(spark, sf)
    return V.split_values(V.split_effects(data, 0.5, SPLITS), E.arm_effects(data))


@query("v1_split_rows", with_("rows_", parts=parts_sql(splits=4, fraction=0.3)) + """
SELECT row_id, split_id, in_est FROM parts""")
def _(spark, sf):
    out = V.split_rows(R.order_rows(spark, sf).select("test_id", "arm", "row_id"), 0.3, 4,
                       ["test_id", "arm"])
    return out.select("row_id", "split_id", "in_est")


@query("v2_split_counts")
def _(spark, sf):
    return V.split_counts(saved_effects(spark, sf), 0.5, 20)


@query("v3_correct_split", with_("rpick", **_VALUES) + """
SELECT test_id, 'split' AS estimator, min(full_winner) AS selected_arm,
  round(min(naive), 6) AS naive, round(avg(eval_value), 6) AS corrected,
  round(min(naive) - avg(eval_value), 6) AS bias,
  round(stddev_samp(eval_value), 6) AS bias_sd,
  round(stddev_samp(eval_value) / sqrt(count(*)), 6) AS bias_se,
  round(quantile_cont(naive - eval_value, 0.025), 6) AS bias_q025,
  round(quantile_cont(naive - eval_value, 0.5), 6) AS bias_q50,
  round(quantile_cont(naive - eval_value, 0.975), 6) AS bias_q975, 'ok' AS status
FROM vals GROUP BY test_id""")
def _(spark, sf):
    return rounded(V.correct_split(_values(spark, sf)), "naive", "corrected", "bias", "bias_sd",
                   "bias_se", "bias_q025", "bias_q50", "bias_q975")


@query("v3b_correct_split_counts")
def _(spark, sf):
    return V.correct_split_counts(saved_effects(spark, sf), 0.5, 100)


@query("v4_split_diagnostics", with_("rpick", **_VALUES) + """
SELECT test_id,
  round(avg(CASE WHEN selected_arm = full_winner THEN 1.0::DOUBLE ELSE 0 END), 6)
    AS full_winner_selection_rate,
  round(avg(CASE WHEN selected_arm <> full_winner THEN 1.0::DOUBLE ELSE 0 END), 6)
    AS disagreement_rate,
  round(avg(full_winner_value - eval_value), 6) AS mean_decision_loss,
  round(avg(est_value), 6) AS mean_est_value, round(avg(eval_value), 6) AS mean_eval_value,
  round(avg(full_winner_value), 6) AS mean_full_winner_value FROM vals GROUP BY test_id""")
def _(spark, sf):
    return rounded(V.split_diagnostics(_values(spark, sf)), "full_winner_selection_rate",
                   "disagreement_rate", "mean_decision_loss", "mean_est_value",
                   "mean_eval_value", "mean_full_winner_value")


def _kfold_sql(pick, score, k=5):
    return with_("rows_", f=f"""
  SELECT test_id, arm, y, ntile({k}) OVER (PARTITION BY test_id, arm ORDER BY row_id) - 1 AS fold
  FROM rows_""", s="""
  SELECT test_id, arm, fold, count(*) AS n, sum(y) AS s FROM f GROUP BY test_id, arm, fold""",
                 e="""
  SELECT test_id, arm, fold, s / n AS inside,
    (sum(s) OVER w - s) / (sum(n) OVER w - n) AS outside
  FROM s WINDOW w AS (PARTITION BY test_id, arm)""") + f"""
SELECT test_id, 'kfold' AS estimator, round(avg({score}), 6) AS corrected FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id, fold ORDER BY {pick} DESC, arm) AS k FROM e)
WHERE k = 1 GROUP BY test_id"""


@query("v5_correct_kfold", _kfold_sql("inside", "outside"))
def _(spark, sf):
    return rounded(V.correct_kfold(R.order_rows(spark, sf), 5), "corrected")


@query("v5a_correct_kfold_rest", _kfold_sql("outside", "inside"))
def _(spark, sf):
    return rounded(V.correct_kfold(R.order_rows(spark, sf), 5, select_on="rest"), "corrected")


@query("v5b_correct_jackknife", with_("rows_", p="""
  SELECT test_id, arm, y, row_number() OVER (PARTITION BY test_id, arm ORDER BY row_id) - 1 AS pos,
    count(*) OVER (PARTITION BY test_id, arm) AS n, sum(y) OVER (PARTITION BY test_id, arm) AS s
  FROM rows_""", a="SELECT test_id, arm, count(*) AS n, avg(y) AS e FROM rows_ GROUP BY 1, 2",
                                      cand="""
  SELECT test_id, pos, arm, (s - y) / (n - 1) AS e, y FROM p WHERE n > 1
  UNION ALL
  SELECT q.test_id, q.pos, a.arm, a.e, NULL FROM (SELECT DISTINCT test_id, pos FROM p) q
  JOIN a ON a.test_id = q.test_id AND a.n <= q.pos""") + """
SELECT test_id, 'jackknife' AS estimator, round(avg(y), 6) AS corrected FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id, pos ORDER BY e DESC, arm) AS k FROM cand)
WHERE k = 1 GROUP BY test_id""")
def _(spark, sf):
    return rounded(V.correct_jackknife(R.order_rows(spark, sf)), "corrected")


# Backtest on half A against half B: SQL for the none, standard, moon and EB-normal rows.
_BT_SPLITS, _BT_DRAWS = 4, 12
_BT = dict(
    parts=parts_sql(splits=_BT_SPLITS, salt="backtest"),
    half="SELECT test_id, split_id, arm, row_id, y FROM parts WHERE in_est",
    heff="""SELECT test_id, split_id, arm, count(*) AS n, avg(y) AS effect,
    var_pop(y) / count(*) AS var FROM half GROUP BY test_id, split_id, arm""",
    hold="""SELECT test_id, split_id, arm, avg(y) AS effect FROM parts WHERE NOT in_est
  GROUP BY test_id, split_id, arm""",
    hpick="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id, split_id
    ORDER BY effect DESC, arm) AS k FROM heff) WHERE k = 1""",
    hdrawn=drawn_sql("half", _BT_DRAWS, "std",
                     "test_id, CAST(split_id AS VARCHAR), CAST(arm AS VARCHAR), "
                     "CAST(row_id AS VARCHAR)", "test_id, split_id"),
    hbias=bias_sql(drawn="hdrawn", effects="heff", by="test_id, split_id"),
    heb="""SELECT test_id, split_id, arm, pv / (pv + var) * effect + (1 - pv / (pv + var)) * pm
    AS post FROM (SELECT *, avg(effect) OVER w AS pm, var_pop(effect) OVER w AS pv FROM heff
    WINDOW w AS (PARTITION BY test_id, split_id))""",
    corr="""
  SELECT test_id, split_id, 'none' AS estimator, arm AS selected_arm, effect AS naive,
    effect AS corrected FROM hpick
  UNION ALL
  SELECT p.test_id, p.split_id, 'standard', p.arm, p.effect, p.effect - b.bias FROM hpick p
  LEFT JOIN (SELECT test_id, split_id, avg(bias) AS bias FROM hbias GROUP BY test_id, split_id) b
    ON p.test_id = b.test_id AND p.split_id = b.split_id
  UNION ALL
  SELECT p.test_id, p.split_id, 'eb_normal', p.arm, p.effect, e.post FROM hpick p
  JOIN heb e ON p.test_id = e.test_id AND p.split_id = e.split_id AND p.arm = e.arm""",
    bt="""
  SELECT c.test_id, c.split_id, estimator, selected_arm, naive, corrected,
    h.effect AS holdout_value, naive - corrected AS estimated_bias,
    naive - h.effect AS actual_bias, (naive - corrected) - (naive - h.effect) AS error,
    abs((naive - corrected) - (naive - h.effect)) AS abs_error, corrected - h.effect AS residual
  FROM corr c JOIN hold h ON c.test_id = h.test_id AND c.split_id = h.split_id
    AND c.selected_arm = h.arm""")
_BT_COLS = ("naive", "corrected", "holdout_value", "estimated_bias", "actual_bias", "error",
            "abs_error", "residual")
_SQL_ESTIMATORS = ["none", "standard", "eb_normal"]


def _backtest(spark, sf, estimators=_SQL_ESTIMATORS):
    return backtest.backtest(R.order_rows(spark, sf), _BT_SPLITS, estimators,
                             draws=_BT_DRAWS)


@query("v6_backtest", with_("rows_", **_BT) + f"""
SELECT test_id, split_id, estimator, selected_arm,
  {', '.join(f'round({c}, 6) AS {c}' for c in _BT_COLS)} FROM bt""")
def _(spark, sf):
    return rounded(_backtest(spark, sf), *_BT_COLS)


@query("v6b_backtest_all")
def _(spark, sf):
    return _backtest(spark, sf, backtest.ESTIMATORS)


_SUMMARY = dict(_BT, summ="""
  SELECT estimator, count(*) AS splits, avg(actual_bias) AS mean_actual_bias,
    avg(estimated_bias) AS mean_estimated_bias,
    quantile_cont(estimated_bias, 0.5) AS median_estimated_bias, avg(error) AS mean_error,
    avg(abs_error) AS mae, quantile_cont(abs_error, 0.5) AS median_abs_error,
    sqrt(avg(error * error)) AS rmse, avg(residual) AS mean_residual,
    avg(corrected) AS mean_corrected, avg(holdout_value) AS mean_holdout_value
  FROM bt GROUP BY estimator""")
_SUMMARY_COLS = ("mean_actual_bias", "mean_estimated_bias", "median_estimated_bias", "mean_error",
                 "mae", "median_abs_error", "rmse", "mean_residual", "mean_corrected",
                 "mean_holdout_value")
_R_SUMMARY = ", ".join(f"round({c}, 6) AS {c}" for c in _SUMMARY_COLS)


@query("v7_backtest_summary", with_("rows_", **_SUMMARY) +
       f"SELECT estimator, splits, {_R_SUMMARY} FROM summ")
def _(spark, sf):
    return rounded(V.backtest_summary(save_table(_backtest(spark, sf))), *_SUMMARY_COLS)


@query("v7b_pick_shares", with_("rows_", **_BT) + f"""
SELECT estimator, {', '.join(
    f"round(avg(CASE WHEN selected_arm = {a} THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_{a}"
    for a in range(5))} FROM bt GROUP BY estimator""")
def _(spark, sf):
    return rounded(V.pick_shares(_backtest(spark, sf), list(range(5))),
                   *[f"share_{a}" for a in range(5)])


@query("v8_best_method", with_("rows_", **_SUMMARY) + f"""
SELECT estimator, splits, {_R_SUMMARY} FROM (SELECT * FROM summ ORDER BY summ.mae, estimator
  LIMIT 1)""")
def _(spark, sf):
    return rounded(V.best_method(V.backtest_summary(save_table(_backtest(spark, sf))), "mae"), *_SUMMARY_COLS)


_OUTCOMES = ["visit", "conversion", "spend"]


@query("v9_funnel", with_("prows", long="""
  SELECT arm, row_id, 'visit' AS test_id, visit AS y FROM prows UNION ALL
  SELECT arm, row_id, 'conversion', conversion FROM prows UNION ALL
  SELECT arm, row_id, 'spend', spend FROM prows""",
                          leff="""SELECT test_id, arm, count(*) AS n, avg(y) AS effect,
    var_pop(y) / count(*) AS var FROM long GROUP BY test_id, arm""",
                          lpick="""SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY test_id ORDER BY effect DESC, arm) AS k FROM leff) WHERE k = 1""",
                          **index_sql(20, "moon", [0.7], source="long"),
                          found=bias_sql("sqrt(floor(pow(n_avg, 0.7::DOUBLE)) / n_avg)",
                                         effects="leff"),
                          est="""
  SELECT test_id, 'none' AS estimator, effect AS corrected FROM lpick UNION ALL
  SELECT p.test_id, 'moon', effect - b.bias FROM lpick p JOIN (
    SELECT test_id, avg(bias) AS bias FROM found GROUP BY test_id) b ON p.test_id = b.test_id""")
       + """
SELECT estimator, round(max(CASE WHEN test_id = 'visit' THEN corrected END), 6) AS visit,
  round(max(CASE WHEN test_id = 'conversion' THEN corrected END), 6) AS conversion,
  round(max(CASE WHEN test_id = 'spend' THEN corrected END), 6) AS spend
FROM est GROUP BY estimator""")
def _(spark, sf):
    long = V.stack_outcomes(R.priority_rows(spark, sf), _OUTCOMES, ["arm", "row_id"])
    none = E.uncorrected(E.arm_effects(long, by=["outcome"]), by=["outcome"]).withColumn(
        "corrected", F.col("naive"))
    moon = B.correct_moon(long, 20, 0.7, by=["outcome"])
    cols = ["outcome", "estimator", "corrected"]
    return rounded(V.funnel_table(none.select(*cols).unionByName(moon.select(*cols)), _OUTCOMES),
                   *_OUTCOMES)
