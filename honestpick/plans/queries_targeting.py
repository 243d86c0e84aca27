"""Targeting queries."""

from pyspark.sql import functions as F

from honestpick.functions import draws as D
from honestpick.operators import targeting as T
from honestpick.plans import roles as R
from honestpick.plans.catalog import query, r, rounded
from honestpick.plans.queries_bootstrap import poisson_rows
from honestpick.plans.queries_splits import parts_sql
from honestpick.plans.sqltext import forest_sql, forest_values, hash48_sql, rate_rows, with_

K, X, DRAWS = 3, ["x"], 8


def fit_sql(source, keys="", weight="1"):
    """Quadratic fit per treatment by cofactors of the 3x3 cross-product matrix."""
    k = keys + ", " if keys else ""
    return f"""
  SELECT {k}arm, n, (c00 * y2 + c01 * y1 + c02 * y0) / det AS b0,
    (c01 * y2 + c11 * y1 + c12 * y0) / det AS b1, (c02 * y2 + c12 * y1 + c22 * y0) / det AS b2,
    c00 / det AS v00, c01 / det AS v01, c02 / det AS v02, c11 / det AS v11, c12 / det AS v12,
    c22 / det AS v22, y2, y1, y0, yy FROM (
    SELECT *, s4 * c00 + s3 * c01 + s2 * c02 AS det FROM (
      SELECT *, s2 * n - s1 * s1 AS c00, s1 * s2 - s3 * n AS c01, s3 * s1 - s2 * s2 AS c02,
        s4 * n - s2 * s2 AS c11, s2 * s3 - s4 * s1 AS c12, s4 * s2 - s3 * s3 AS c22 FROM (
        SELECT {k}t - 1 AS arm, sum({weight})::DOUBLE AS n, sum({weight} * x) AS s1,
          sum({weight} * x * x) AS s2, sum({weight} * x * x * x) AS s3,
          sum({weight} * x * x * x * x) AS s4, sum({weight} * y) AS y0,
          sum({weight} * x * y) AS y1, sum({weight} * x * x * y) AS y2,
          sum({weight} * y * y) AS yy FROM {source} GROUP BY {k}t)))"""


_PRED = dict(fit=fit_sql("train"), eff="""
  SELECT customer_id, x, arm, b0 * x * x + b1 * x + b2 AS effect,
    (yy - b0 * y2 - b1 * y1 - b2 * y0) / (n - 3) * (v00 * x * x * x * x + 2 * v01 * x * x * x
      + (2 * v02 + v11) * x * x + 2 * v12 * x + v22) AS var FROM target, fit""", tpick="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY effect DESC, arm)
    AS k FROM eff) WHERE k = 1""")


def pred_sql(**own):
    return with_("train", "target", **_PRED, **own)


def _train(spark, sf):
    return R.targeting_train(spark, sf)


def _predicted(spark, sf):
    return T.predict_effects(R.targeting_target(spark, sf), T.fit_arm_ols(_train(spark, sf), X),
                             X, K)


@query("t1_fit_arm_ols", with_("train", fit=fit_sql("train")) + """
SELECT arm, n, round(b0, 6) AS b_square, round(b1, 6) AS b_linear, round(b2, 6) AS b_intercept,
  round((yy - b0 * y2 - b1 * y1 - b2 * y0) / (n - 3), 6) AS sigma2 FROM fit""")
def _(spark, sf):
    f = T.fit_arm_ols(_train(spark, sf), X)
    return f.select("arm", "n", r(F.col("beta")[0]).alias("b_square"),
                    r(F.col("beta")[1]).alias("b_linear"),
                    r(F.col("beta")[2]).alias("b_intercept"), r("sigma2").alias("sigma2"))


@query("t2_predict_effects", pred_sql() + """
SELECT customer_id, arm, round(effect, 6) AS effect, round(var, 7) AS var FROM eff""")
def _(spark, sf):
    out = T.long_effects(_predicted(spark, sf), ["customer_id"], K)
    return out.withColumns({"effect": r("effect"), "var": r("var", 7)})


_TREES = 5


def _forest_sql(rows="train"):
    """Forests of five trees of depth three on the training rows, and their values."""
    return dict(**forest_sql("f", poisson_rows(f"(SELECT * FROM {rows})", "row_id", _TREES, 42,
                                               "forest").replace("draw", "tree"), "t, tree", 3, "w"),
                **forest_values("f", "t, tree", 3, "target", "customer_id, x"))


@query("t3_fit_forest_effects", with_("train", "target", **_forest_sql()) + """
SELECT customer_id, t - 1 AS arm, round(e, 6) AS effect FROM fe""")
def _(spark, sf):
    out = T.fit_forest_effects(_train(spark, sf), R.targeting_target(spark, sf), X, K,
                               control=None, depth=3, trees=_TREES)
    return rounded(T.long_effects(out, ["customer_id"], K), "effect")


@query("t3b_forest_minus_control", with_("train", "target", **_forest_sql()) + """
SELECT customer_id, CAST(arm AS INTEGER) AS arm, round(e, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY e DESC, arm) AS k FROM (
    SELECT f.customer_id, f.t - 2 AS arm, f.e - c.e AS e FROM fe f
    JOIN fe c ON f.customer_id = c.customer_id AND c.t = 1 WHERE f.t > 1)) WHERE k = 1""")
def _(spark, sf):
    train = _train(spark, sf).withColumn("t", F.col("t") - 1)        # flag A is the control
    out = T.fit_forest_effects(train, R.targeting_target(spark, sf), X, K - 1, control=0,
                               depth=3, trees=_TREES)
    return rounded(T.target_policy(out).select("customer_id", "arm", "value"), "value")


_OUT_SQL = """
  SELECT customer_id, arm, CASE WHEN abs(e) > 20 THEN coalesce(avg(CASE WHEN abs(e) <= 20 THEN e END)
    OVER (PARTITION BY customer_id), 0) ELSE e END AS effect
  FROM (SELECT customer_id, arm, effect * (1 + x * arm) AS e FROM eff)"""


@query("t4_replace_outliers", pred_sql(o=_OUT_SQL) + """
SELECT customer_id, arm, round(effect, 6) AS effect FROM o""")
def _(spark, sf):
    long = T.long_effects(_predicted(spark, sf), ["customer_id", "x"], K).withColumn(
        "effect", F.col("effect") * (1 + F.col("x") * F.col("arm")))
    return rounded(T.replace_outliers(long).select("customer_id", "arm", "effect"), "effect")


@query("t4b_repair_outliers_array", pred_sql(o=_OUT_SQL) + """
SELECT customer_id, arm, round(effect, 6) AS effect FROM o""")
def _(spark, sf):
    p = _predicted(spark, sf).withColumn("effects", F.array(*[
        F.col("effects")[a] * (1 + F.col("x") * a) for a in range(K)])).drop("vars")
    p = p.withColumn("effects", T.repair_outliers(F.col("effects"), K))
    return rounded(T.long_effects(p, ["customer_id"], K), "effect")


@query("t5_target_policy", pred_sql() + """
SELECT customer_id, CAST(arm AS INTEGER) AS arm, round(effect, 6) AS value FROM tpick""")
def _(spark, sf):
    return rounded(T.target_policy(_predicted(spark, sf)).select("customer_id", "arm", "value"),
                   "value")


@query("t5b_policy_value", pred_sql() + """
SELECT count(*) AS customers, round(avg(effect), 6) AS value FROM tpick""")
def _(spark, sf):
    return rounded(T.policy_value(T.target_policy(_predicted(spark, sf))), "value")


@query("t6_evaluate_policy", pred_sql() + """
SELECT count(*) AS customers, round(avg(e.effect * 0.9 + e.arm * 0.01), 6) AS value
FROM tpick p JOIN eff e ON p.customer_id = e.customer_id AND p.arm = e.arm""")
def _(spark, sf):
    p = _predicted(spark, sf)
    other = T.long_effects(p, ["customer_id"], K).withColumn(
        "effect", F.col("effect") * 0.9 + F.col("arm") * 0.01)
    return rounded(T.evaluate_policy(T.target_policy(p), other), "value")


@query("t7_apply_policy_rule", pred_sql(s="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
    ORDER BY effect - 2 * sqrt(var) DESC, arm) AS k FROM eff) WHERE k = 1""") + """
SELECT customer_id, CAST(arm AS INTEGER) AS arm, round(effect, 6) AS value FROM s""")
def _(spark, sf):
    p = T.target_policy(_predicted(spark, sf), T.risk_adjusted(K, 2.0))
    return rounded(p.select("customer_id", "arm", "value"), "value")


def _boot_sql(drawn, weight, scale):
    """Corrected policy value: draws' fits, their picks, value under both fits."""
    return pred_sql(**drawn, dfit=fit_sql("wt", "draw", weight), xs="""
  SELECT x, count(*) AS m FROM target GROUP BY x""", de="""
  SELECT draw, xs.x, m, d.arm, d.b0 * x * x + d.b1 * x + d.b2 AS e,
    f.b0 * x * x + f.b1 * x + f.b2 AS original FROM xs, dfit d JOIN fit f ON d.arm = f.arm""",
                    dp="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY draw, x ORDER BY e DESC, arm) AS k
    FROM de) WHERE k = 1""", db=f"""
  SELECT draw, sum(m * (e - original)) / sum(m) * {scale} AS bias FROM dp GROUP BY draw""")


def _corrected_sql(name):
    return f"""
SELECT '{name}' AS estimator, round(v, 6) AS naive, round(v - b, 6) AS corrected,
  round(b, 6) AS bias, d AS draws FROM (SELECT avg(effect) AS v FROM tpick),
  (SELECT avg(bias) AS b, count(*) AS d FROM db)"""


_BOOT = ("naive", "corrected", "bias")


@query("t8_policy_correct_standard", _boot_sql(
    dict(wt=poisson_rows("train", "row_id", DRAWS, 42, "policy")), "w", "1")
    + _corrected_sql("standard"))
def _(spark, sf):
    return rounded(T.policy_correct_standard(
        _train(spark, sf), R.targeting_target(spark, sf), X, K, DRAWS), *_BOOT)


_T9 = dict(tnum="""
  SELECT t, x, y, row_number() OVER (PARTITION BY t ORDER BY row_id) - 1 AS pos,
    count(*) OVER (PARTITION BY t) AS n FROM train""", tslot=f"""
  SELECT t, draw, {hash48_sql("CAST(t AS VARCHAR), CAST(pos AS VARCHAR), CAST(draw AS VARCHAR), '700'",
                              42, "policy-moon")} % n AS pos
  FROM tnum, (SELECT CAST(range AS INTEGER) AS draw FROM range({DRAWS}))
  WHERE pos < floor(pow(n, 0.7::DOUBLE))""", wt="""
  SELECT s.t, s.draw, x, y FROM tslot s JOIN tnum ON s.t = tnum.t AND s.pos = tnum.pos""")


@query("t9_policy_correct_moon", _boot_sql(_T9, "1", """(
  SELECT sqrt(sum(floor(pow(n, 0.7::DOUBLE))) / sum(n)) FROM fit)""") + _corrected_sql("moon"))
def _(spark, sf):
    return rounded(T.policy_correct("moon", _train(spark, sf), R.targeting_target(spark, sf), X, K,
                                    DRAWS, 0.7), *_BOOT)


@query("t10_policy_correct_numerical", _boot_sql(
    dict(wt=poisson_rows("train", "row_id", DRAWS, 42, "policy-num")), "w", """(
  SELECT pow(sum(n), -0.45::DOUBLE) * sqrt(sum(n)) FROM fit)""") + _corrected_sql("numerical"))
def _(spark, sf):
    return rounded(T.policy_correct("numerical", _train(spark, sf),
                                    R.targeting_target(spark, sf), X, K, DRAWS), *_BOOT)


# A policy that picks by effect minus twice its standard error, in the draws as on the data.
def _risk_sql(fit, x="x"):
    return f"""({fit}.yy - {fit}.b0 * {fit}.y2 - {fit}.b1 * {fit}.y1 - {fit}.b2 * {fit}.y0)
    / ({fit}.n - 3) * ({fit}.v00 * {x} * {x} * {x} * {x} + 2 * {fit}.v01 * {x} * {x} * {x}
      + (2 * {fit}.v02 + {fit}.v11) * {x} * {x} + 2 * {fit}.v12 * {x} + {fit}.v22)"""


_RISK = dict(spick="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
    ORDER BY effect - 2 * sqrt(var) DESC, arm) AS k FROM eff) WHERE k = 1""")


@query("t8b_policy_correct_risk_adjusted", pred_sql(
    wt=poisson_rows("train", "row_id", DRAWS, 42, "policy"), dfit=fit_sql("wt", "draw", "w"),
    xs="SELECT x, count(*) AS m FROM target GROUP BY x", **_RISK, de=f"""
  SELECT draw, xs.x, m, d.arm, d.b0 * x * x + d.b1 * x + d.b2 AS e, {_risk_sql("d")} AS v,
    f.b0 * x * x + f.b1 * x + f.b2 AS original FROM xs, dfit d JOIN fit f ON d.arm = f.arm""",
    dp="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY draw, x
    ORDER BY e - 2 * sqrt(v) DESC, arm) AS k FROM de) WHERE k = 1""",
    db="SELECT draw, sum(m * (e - original)) / sum(m) AS bias FROM dp GROUP BY draw")
    + _corrected_sql("standard").replace("tpick", "spick"))
def _(spark, sf):
    return rounded(T.policy_correct_standard(
        _train(spark, sf), R.targeting_target(spark, sf), X, K, DRAWS,
        scores=T.risk_adjusted(K, 2.0)), *_BOOT)


_F_TREES, _F_DEPTH, _F_DRAWS = 4, 2, 4


def _small_forest():
    return T.ForestModel(X, K, settings=T.ForestSettings(_F_DEPTH, _F_TREES))


@query("t8c_policy_correct_forest", with_("train", "target", xs="""
  SELECT x, count(*) AS m FROM target GROUP BY x""", **forest_sql(
    "f", poisson_rows("train", "row_id", _F_TREES, 42, "forest").replace("draw", "tree"),
    "t, tree", _F_DEPTH, "w"), **forest_values("f", "t, tree", _F_DEPTH, "xs", "x, m"),
    wt=poisson_rows("train", "row_id", _F_DRAWS, 42, "policy"), **forest_sql(
        "d", rate_rows("wt", "CAST(draw AS VARCHAR), row_id", _F_TREES, 42, "forest", "w"),
        "draw, t, tree", _F_DEPTH, "v"),
    **forest_values("d", "draw, t, tree", _F_DEPTH, "xs", "x, m"), dp="""
  SELECT * FROM (SELECT d.draw, d.m, d.e, f.e AS original, row_number() OVER (
      PARTITION BY d.draw, d.x ORDER BY d.e DESC, d.t) AS k
    FROM de d JOIN fe f ON d.t = f.t AND d.x = f.x) WHERE k = 1""",
    db="SELECT draw, sum(m * (e - original)) / sum(m) AS bias FROM dp GROUP BY draw",
    fpick="SELECT x, m, max(e) AS effect FROM fe GROUP BY x, m") + """
SELECT 'standard' AS estimator, round(v, 6) AS naive, round(v - b, 6) AS corrected,
  round(b, 6) AS bias, d AS draws FROM (SELECT sum(m * effect) / sum(m) AS v FROM fpick),
  (SELECT avg(bias) AS b, count(*) AS d FROM db)""")
def _(spark, sf):
    return rounded(T.policy_correct_standard(
        _train(spark, sf), R.targeting_target(spark, sf), X, K, _F_DRAWS,
        model=_small_forest()), *_BOOT)


# Draws of the orders experiment kept when every (arm, status) cell keeps enough rows.
@query("t12_valid_draws", with_("prows", w=poisson_rows(
    "prows", "CAST(row_id AS VARCHAR)", 40, 42, "valid"), c="""
  SELECT draw, arm, conversion, sum(w) AS k FROM w GROUP BY ALL""", lim="""
  SELECT quantile_cont(c, 0.5) * 0.97 AS q FROM (SELECT count(*)::DOUBLE AS c FROM prows
    WHERE conversion = 1 GROUP BY arm)""", ok="""
  SELECT draw FROM c, lim WHERE k >= floor(q) GROUP BY draw
  HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT arm, conversion FROM prows))""") + """
SELECT draw FROM ok ORDER BY draw LIMIT 1""")
def _(spark, sf):
    from honestpick.functions.quantiles import exact_quantiles
    rows = R.priority_rows(spark, sf).select("arm", "row_id", "conversion")
    drawn = D.with_poisson_weights(rows, 40, ["row_id"], 42, "valid")
    sizes = rows.where("conversion = 1").groupBy("arm").agg(F.count(F.lit(1)).alias("c"))
    limit = exact_quantiles(sizes, "c", [0.5]).first()["q"][0]
    return T.valid_draws(drawn, rows, ["arm", "conversion"], int(limit * 0.97), 1, "weight")


@query("t13_policy_bayes_normal", pred_sql() + """
SELECT count(*) AS customers, round(avg(effect), 6) AS naive,
  round(avg(0.04::DOUBLE / (0.04 + var) * effect + (1 - 0.04::DOUBLE / (0.04 + var)) * 5), 6)
    AS corrected FROM tpick""")
def _(spark, sf):
    policy = T.target_policy(_predicted(spark, sf))
    return rounded(T.policy_bayes_normal(policy, 5.0, 0.2), "naive", "corrected")


@query("t14_policy_eb", pred_sql(post="""
  SELECT *, pv / (pv + var) * effect + (1 - pv / (pv + var)) * pm AS post FROM (
    SELECT *, avg(effect) OVER w AS pm, var_pop(effect) OVER w AS pv FROM eff
    WINDOW w AS (PARTITION BY arm))""") + """
SELECT count(*) AS customers, round(avg(p.effect), 6) AS naive, round(avg(q.post), 6) AS corrected,
  CAST(0 AS BIGINT) AS failed
FROM tpick p JOIN post q ON p.customer_id = q.customer_id AND p.arm = q.arm""")
def _(spark, sf):
    return rounded(T.policy_eb(_predicted(spark, sf), "normal", K), "naive", "corrected")


@query("t14b_policy_eb_tweedie")
def _(spark, sf):
    return T.policy_eb(_predicted(spark, sf), "tweedie", K, bin_width=0.02)


@query("t14c_policy_eb_spike_slab")
def _(spark, sf):
    return T.policy_eb(_predicted(spark, sf), "spike_slab", K)


@query("t15_policy_split", with_("train", "target", parts=parts_sql(
    "train", 3, 0.5, "1", "policy-split").replace("CAST(row_id AS VARCHAR)", "row_id"),
    sfit=fit_sql("parts", "split_id, in_est"), se="""
  SELECT a.split_id, customer_id, a.arm, a.b0 * x * x + a.b1 * x + a.b2 AS e,
    b.b0 * x * x + b.b1 * x + b.b2 AS v FROM target, sfit a
  JOIN sfit b ON a.split_id = b.split_id AND a.arm = b.arm AND a.in_est AND NOT b.in_est""", sp="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split_id, customer_id
    ORDER BY e DESC, arm) AS k FROM se) WHERE k = 1""") + """
SELECT split_id, round(avg(e), 6) AS est_value, round(avg(v), 6) AS corrected
FROM sp GROUP BY split_id""")
def _(spark, sf):
    out = T.policy_split(_train(spark, sf), R.targeting_target(spark, sf), X, K, splits=3)
    return rounded(out, "est_value", "corrected")


@query("t15b_policy_split_risk_adjusted", with_("train", "target", parts=parts_sql(
    "train", 3, 0.5, "1", "policy-split").replace("CAST(row_id AS VARCHAR)", "row_id"),
    sfit=fit_sql("parts", "split_id, in_est"), se=f"""
  SELECT a.split_id, customer_id, a.arm, a.b0 * x * x + a.b1 * x + a.b2 AS e, {_risk_sql("a")} AS r,
    b.b0 * x * x + b.b1 * x + b.b2 AS v FROM target, sfit a
  JOIN sfit b ON a.split_id = b.split_id AND a.arm = b.arm AND a.in_est AND NOT b.in_est""", sp="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split_id, customer_id
    ORDER BY e - 2 * sqrt(r) DESC, arm) AS k FROM se) WHERE k = 1""") + """
SELECT split_id, round(avg(e), 6) AS est_value, round(avg(v), 6) AS corrected
FROM sp GROUP BY split_id""")
def _(spark, sf):
    out = T.policy_split(_train(spark, sf), R.targeting_target(spark, sf), X, K, splits=3,
                         scores=T.risk_adjusted(K, 2.0))
    return rounded(out, "est_value", "corrected")


_SPLIT_KEYS = "split_id, in_est, t, tree"


@query("t15c_policy_split_forest", with_("train", "target", parts=parts_sql(
    "train", 2, 0.5, "1", "policy-split").replace("CAST(row_id AS VARCHAR)", "row_id"),
    xs="SELECT x, count(*) AS m FROM target GROUP BY x", once="SELECT *, 1 AS once FROM parts",
    **forest_sql("s", rate_rows(
        "once", "CAST(split_id AS VARCHAR), CAST(in_est AS VARCHAR), row_id", _F_TREES, 42, "forest",
        "once"), _SPLIT_KEYS, _F_DEPTH, "v"),
    **forest_values("s", _SPLIT_KEYS, _F_DEPTH, "xs", "x, m"), sp="""
  SELECT * FROM (SELECT a.split_id, a.m, a.e, b.e AS v, row_number() OVER (
      PARTITION BY a.split_id, a.x ORDER BY a.e DESC, a.t) AS k
    FROM se a JOIN se b ON a.split_id = b.split_id AND a.t = b.t AND a.x = b.x
      AND a.in_est AND NOT b.in_est) WHERE k = 1""") + """
SELECT split_id, round(sum(m * e) / sum(m), 6) AS est_value,
  round(sum(m * v) / sum(m), 6) AS corrected FROM sp GROUP BY split_id""")
def _(spark, sf):
    out = T.policy_split(_train(spark, sf), R.targeting_target(spark, sf), X, K, splits=2,
                         model=_small_forest())
    return rounded(out, "est_value", "corrected")


@query("t16_policy_si")
def _(spark, sf):
    return T.policy_si(_predicted(spark, sf), X, K)
