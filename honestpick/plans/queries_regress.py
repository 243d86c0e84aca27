"""Analysis table and regression queries."""

from pyspark.sql import functions as F

from honestpick.functions.lineage import save_table
from honestpick.operators import effects as E, prep as P, regress as G, shrink as H
from honestpick.plans import roles as R
from honestpick.plans.catalog import query, r, rounded
from honestpick.plans.sqltext import SUPPLIER_ARMS, with_


def supplier_tests(spark, sf):
    """The arm table, saved once: everything downstream reads it several times."""
    return save_table(P.prepare_arms(R.supplier_arms(spark, sf)))


def eb_estimates(arms):
    """Records with the EB-normal correction."""
    eb = H.correct_eb_normal(E.arm_effects_from_counts(arms), tie="source_row_id").select(
        "test_id", "corrected", "bias")
    return E.test_records(arms).join(eb, "test_id")


def analysis(spark, sf):
    arms = supplier_tests(spark, sf)
    p = G.derive(eb_estimates(arms), arms)
    return save_table(p.join(R.supplier_nations(spark, sf), "test_id", "left"))


def _edges(c):
    return ", ".join(f"quantile_cont({c}::DOUBLE, {i / 10})" for i in range(11))


def _bin(c, e):
    return (f"CAST(1 + len(list_filter({e}[2:len({e})-1], lambda x: {c} > x)) AS INTEGER)")


ANALYSIS = dict(
    base="""
  SELECT e.*, eb_bias AS bias, eb_corrected AS corrected,
    100 * CASE WHEN sd_1 * sd_1 + sd_2 * sd_2 > 0 THEN
      (rate_1 - rate_2) / sqrt((sd_1 * sd_1 + sd_2 * sd_2) / 2) END AS snr_pct,
    e.created_at AS date, total_impressions::DOUBLE / n_arms AS n_per_arm,
    sqrt(pooled_rate * (1 - pooled_rate)) AS sigma_all, 100 * eb_bias AS wc_pp,
    100 * gap AS gap_pp, 100 * pooled_rate AS ctr_pct,
    CASE WHEN n_arms <= 1 THEN NULL WHEN n_arms <= 5 THEN CAST(n_arms AS VARCHAR)
         WHEN n_arms <= 7 THEN '6-7' ELSE '8+' END AS arm_group
  FROM est e JOIN two t ON e.test_id = t.test_id""",
    logs="""
  SELECT *, ln(n_arms) AS "log_J", ln(n_per_arm) AS log_n, ln(sigma_all) AS log_sigma,
    ln(total_impressions) AS log_total FROM base""",
    edges=f"""SELECT list_sort(list_distinct([{_edges('snr_pct')}])) AS es,
    list_sort(list_distinct([{_edges('total_impressions')}])) AS et FROM logs""",
    an=f"""SELECT logs.*, {_bin('snr_pct', 'es')} AS snr_decile,
    {_bin('total_impressions', 'et')} AS total_decile, s_nationkey AS nation
  FROM logs CROSS JOIN edges LEFT JOIN supplier ON logs.test_id = 'S' || s_suppkey""")


def analysis_sql(**own):
    return with_("est", "two", raw=SUPPLIER_ARMS, **ANALYSIS, **own)


_D1 = ("snr_pct", "n_per_arm", "sigma_all", "wc_pp", "gap_pp", "ctr_pct", "log_J", "log_n",
       "log_sigma", "log_total")


@query("d1_derive", analysis_sql() + f"""
SELECT test_id, n_arms, {', '.join(f'round({c}, 6) AS "{c}"' for c in _D1)}, arm_group,
  snr_decile, total_decile, strftime(date_trunc('week', date), '%Y-%m-%d') || '/'
    || strftime(date_trunc('week', date) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
  strftime(date, '%Y-%m') AS month FROM an""")
def _(spark, sf):
    return rounded(analysis(spark, sf).select(
        "test_id", "n_arms", *_D1, "arm_group", "snr_decile", "total_decile", "week", "month"),
        *_D1)


# Two regressors by the textbook formulas: slopes from centred moments.
_TWO = dict(mom="""
  SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS saa,
    var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby,
    var_pop(y) AS syy
  FROM (SELECT l_extendedprice / 10000 AS y, l_quantity / 10 AS a, l_discount * 10 AS b
        FROM lineitem)""", co="""
  SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS b1,
    (saa * sby - sab * say) / (saa * sbb - sab * sab) AS b2 FROM mom""")


def _lines(spark, sf):
    return R.table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_quantity") / 10).alias("a"),
        (F.col("l_discount") * 10).alias("b"), "l_suppkey", "l_returnflag")


@query("d2_ols", with_(**_TWO) + """
SELECT term, round(coefficient, 6) AS coefficient, n, round((b1 * say + b2 * sby) / syy, 6)
  AS r_squared FROM (
  SELECT 'Intercept' AS term, my - b1 * ma - b2 * mb AS coefficient, * FROM co UNION ALL
  SELECT 'a', b1, * FROM co UNION ALL SELECT 'b', b2, * FROM co)""")
def _(spark, sf):
    fit = G.ols(_lines(spark, sf), "y", ["a", "b"])
    rows = G.regression_rows(fit, G.plain_cov(fit), "iid")
    return rounded(rows.select("term", "coefficient", "n", "r_squared"), "coefficient", "r_squared")


@query("d2b_ols_terms")
def _(spark, sf):
    p = analysis(spark, sf)
    fit = G.ols(p, "wc_pp", ["snr_pct", G.C("arm_group"), G.Bs("log_n", 4), G.Bs("log_sigma", 4)])
    return G.regression_rows(fit, G.plain_cov(fit), "iid", model="flexible")


_ONE = dict(d="""SELECT l_suppkey AS g, l_extendedprice / 10000 AS y, l_quantity / 10 AS x
  FROM lineitem""", m="""
  SELECT count(*)::DOUBLE AS n, avg(x) AS mx, regr_slope(y, x) AS b1,
    regr_intercept(y, x) AS b0, var_pop(x) * count(*) AS sxx FROM d""")


@query("d3_cluster_se", with_(**_ONE, s="""
  SELECT g, sum(y - b0 - b1 * x) AS s0, sum((x - mx) * (y - b0 - b1 * x)) AS s1
  FROM d, m GROUP BY g""", v="""
  SELECT sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11, count(*) AS g FROM s""") + """
SELECT term, round(coefficient, 6) AS coefficient, round(sqrt(f * w), 6) AS se, g AS clusters FROM (
  SELECT *, (g::DOUBLE / (g - 1)) * (n - 1) / (n - 2) AS f FROM (
    SELECT 'x' AS term, b1 AS coefficient, m11 / (sxx * sxx) AS w, g, n FROM v, m UNION ALL
    SELECT 'Intercept', b0, m00 / (n * n) - 2 * mx * m01 / (n * sxx) + mx * mx * m11 / (sxx * sxx),
      g, n FROM v, m))""")
def _(spark, sf):
    rows = _lines(spark, sf).withColumnRenamed("a", "x")
    fit = G.ols(rows, "y", ["x"], keep=["l_suppkey"])
    cov, groups = G.cluster_cov(fit, "l_suppkey")
    out = G.regression_rows(fit, cov, "cluster", clusters=groups)
    return rounded(out.select("term", "coefficient", "se", "clusters"), "coefficient", "se")


@query("d4_hc3_se", with_(**_ONE, e="""
  SELECT x, y - b0 - b1 * x AS e, 1 / n + (x - mx) * (x - mx) / sxx AS h FROM d, m""", v="""
  SELECT sum(power(e / (1 - h), 2)) AS m00, sum((x - mx) * power(e / (1 - h), 2)) AS m01,
    sum((x - mx) * (x - mx) * power(e / (1 - h), 2)) AS m11 FROM e, m""") + """
SELECT term, round(coefficient, 6) AS coefficient, round(sqrt(w), 6) AS se FROM (
  SELECT 'x' AS term, b1 AS coefficient, m11 / (sxx * sxx) AS w FROM v, m UNION ALL
  SELECT 'Intercept', b0, m00 / (n * n) - 2 * mx * m01 / (n * sxx) + mx * mx * m11 / (sxx * sxx)
  FROM v, m)""")
def _(spark, sf):
    rows = _lines(spark, sf).withColumnRenamed("a", "x")
    fit = G.ols(rows, "y", ["x"])
    out = G.regression_rows(fit, G.hc3_cov(fit), "HC3")
    return rounded(out.select("term", "coefficient", "se"), "coefficient", "se")


@query("d5_regression_rows")
def _(spark, sf):
    p = analysis(spark, sf)
    models = {"short": ["snr_pct", "log_J"], "size": ["snr_pct", "log_J", "log_n"],
              "full": ["snr_pct", "log_J", "log_n", "log_sigma"]}
    out = None
    for name, terms in models.items():
        fit = G.ols(p, "wc_pp", terms, keep=["nation"])
        cov, groups = G.cluster_cov(fit, "nation")
        t = G.regression_rows(fit, cov, "cluster", model=name, clusters=groups).unionByName(
            G.regression_rows(fit, G.hc3_cov(fit), "HC3", model=name))
        out = t if out is None else out.unionByName(t)
    return out


_GROUPED = list(G.GROUPED_MEANS.values())
_G_SQL = ", ".join(f"round(avg({c}::DOUBLE), 6) AS {n}" if c != "selected_winner" else
                   "round(avg(CASE WHEN selected_winner THEN 1.0::DOUBLE ELSE 0 END), 6) AS "
                   + n for c, n in G.GROUPED_MEANS.items())
_G_TAIL = """round(stddev_samp(wc_pp) / sqrt(count(*)), 6) AS se_iid,
  round(100 * avg(wc_pp) / nullif(avg(gap_pp), 0), 6) AS pct_of_gap"""


@query("d6_grouped", analysis_sql() + f"""
SELECT snr_decile, count(*) AS tests, {_G_SQL}, {_G_TAIL} FROM an GROUP BY snr_decile""")
def _(spark, sf):
    return rounded(G.grouped(analysis(spark, sf).withColumn(
        "selected_winner", F.col("selected_winner").cast("int")), "snr_decile"),
        *_GROUPED, "se_iid", "pct_of_gap")


@query("d7_adjusted_means", with_(d="""
  SELECT l_returnflag AS f, l_extendedprice / 10000 AS y, l_quantity / 10 AS a FROM lineitem""",
    within="""
  SELECT sum((a - ma) * (y - my)) / sum((a - ma) * (a - ma)) AS b FROM (
    SELECT *, avg(a) OVER (PARTITION BY f) AS ma, avg(y) OVER (PARTITION BY f) AS my FROM d)""") + """
SELECT f AS l_returnflag, round(avg(y) + b * ((SELECT avg(a) FROM d) - avg(a)), 6) AS adjusted
FROM d, within GROUP BY f, b""")
def _(spark, sf):
    fit = G.ols(_lines(spark, sf), "y", [G.C("l_returnflag"), "a"], keep=["l_suppkey"])
    cov, _ = G.cluster_cov(fit, "l_suppkey")
    return G.adjusted_means(fit, cov, "l_returnflag").select(
        "l_returnflag", r("adjusted").alias("adjusted"))


@query("d7b_adjusted_means_cluster")
def _(spark, sf):
    p = analysis(spark, sf)
    fit = G.ols(p, "wc_pp", [G.C("arm_group"), "snr_pct", "log_n", "log_sigma"], keep=["nation"])
    cov, _ = G.cluster_cov(fit, "nation")
    return G.adjusted_means(fit, cov, "arm_group")


@query("d8_adjusted_curve")
def _(spark, sf):
    p = analysis(spark, sf)
    fit = G.ols(p, "wc_pp", [G.Bs("snr_pct", 5), "log_J", "log_n", "log_sigma"], keep=["nation"])
    cov, _ = G.cluster_cov(fit, "nation")
    return G.adjusted_curve(p, fit, cov, "snr_pct", points=50)


# Cubic B-spline with one inner knot: the truncated-power space has the same fitted values, but
# the basis itself is checked here through de Boor's recursion written out for df = 4.
def _bspline_sql():
    """Cox-de Boor for knots (a,a,a,a,m,b,b,b,b) spelled out as SQL."""
    t = ["lo"] * 4 + ["mid"] + ["hi"] * 4
    rank = {"lo": 0, "mid": 1, "hi": 2}
    basis = []
    for i in range(8):
        if rank[t[i]] < rank[t[i + 1]]:
            top = "<=" if t[i + 1] == "hi" else "<"
            basis.append(f"(CASE WHEN x >= {t[i]} AND x {top} {t[i + 1]} THEN 1.0::DOUBLE ELSE 0 END)")
        else:
            basis.append(None)
    for d in (1, 2, 3):
        nxt = []
        for i in range(len(basis) - 1):
            parts = []
            if basis[i] and t[i + d] != t[i]:
                parts.append(f"{basis[i]} * (x - {t[i]}) / ({t[i + d]} - {t[i]})")
            if basis[i + 1] and t[i + d + 1] != t[i + 1]:
                parts.append(f"{basis[i + 1]} * ({t[i + d + 1]} - x) / ({t[i + d + 1]} - {t[i + 1]})")
            nxt.append("(" + " + ".join(parts) + ")" if parts else None)
        basis = nxt
    return ", ".join(f"round({b}, 6) AS b{i}" for i, b in enumerate(basis[1:]))


@query("d9_bspline", with_(k="""
  SELECT min(o_totalprice / 1000) AS lo, quantile_cont(o_totalprice / 1000, 0.5) AS mid,
    max(o_totalprice / 1000) AS hi FROM orders""") + f"""
SELECT o_orderkey, {_bspline_sql()} FROM (SELECT o_orderkey, o_totalprice / 1000 AS x FROM orders), k""")
def _(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x"))
    term = G.prepare(o, [G.Bs("x", 4)])[0]
    return o.select("o_orderkey", *[r(b).alias(f"b{i}") for i, b in enumerate(
        G.bspline("x", term.knots))])


@query("d10_sample_variants", analysis_sql(s="""
  SELECT 'all' AS sample, * FROM an UNION ALL
  SELECT 'without_top_snr', * FROM an WHERE snr_decile < 10 UNION ALL
  SELECT 'four_arms', * FROM an WHERE n_arms = 4 UNION ALL
  SELECT 'early', * FROM an WHERE date < TIMESTAMP '1995-01-10'""") + """
SELECT sample, total_decile, count(*) AS tests, round(avg(wc_pp), 6) AS raw_wc_pp,
  round(avg(gap_pp), 6) AS gap_pp FROM s GROUP BY sample, total_decile""")
def _(spark, sf):
    p = analysis(spark, sf)
    s = G.in_samples(p, {"all": F.lit(True), "without_top_snr": F.col("snr_decile") < 10,
                         "four_arms": F.col("n_arms") == 4,
                         "early": F.col("date") < F.to_timestamp_ntz(F.lit("1995-01-10 00:00:00"))})
    return s.groupBy("sample", "total_decile").agg(
        F.count(F.lit(1)).alias("tests"), r(F.avg("wc_pp")).alias("raw_wc_pp"),
        r(F.avg("gap_pp")).alias("gap_pp"))


@query("d11_collinearity", with_(d="""
  SELECT l_quantity AS q, l_discount AS d, l_extendedprice AS p FROM lineitem""", c="""
  SELECT corr(q, d) AS qd, corr(q, p) AS qp, corr(d, p) AS dp FROM d""", v="""
  SELECT *, 1 + 2 * qd * qp * dp - qd * qd - qp * qp - dp * dp AS det FROM c""") + """
SELECT * FROM (
  SELECT 'correlation' AS kind, 'q' AS a, 'd' AS b, round(qd, 6) AS value FROM v UNION ALL
  SELECT 'correlation', 'q', 'p', round(qp, 6) FROM v UNION ALL
  SELECT 'correlation', 'd', 'p', round(dp, 6) FROM v UNION ALL
  SELECT 'vif', 'q', 'q', round((1 - dp * dp) / det, 6) FROM v UNION ALL
  SELECT 'vif', 'd', 'd', round((1 - qp * qp) / det, 6) FROM v UNION ALL
  SELECT 'vif', 'p', 'p', round((1 - qd * qd) / det, 6) FROM v UNION ALL
  SELECT 'partial', 'q', 'd', round((qd - qp * dp) / sqrt((1 - qp * qp) * (1 - dp * dp)), 6) FROM v
  UNION ALL
  SELECT 'partial', 'q', 'p', round((qp - qd * dp) / sqrt((1 - qd * qd) * (1 - dp * dp)), 6) FROM v
  UNION ALL
  SELECT 'partial', 'd', 'p', round((dp - qd * qp) / sqrt((1 - qd * qd) * (1 - qp * qp)), 6) FROM v)""")
def _(spark, sf):
    d = R.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"),
        F.col("l_extendedprice").alias("p"))
    return rounded(G.collinearity(d, ["q", "d", "p"]), "value")


@query("d11b_omitted_shift", with_(**_TWO) + """
SELECT term, round(w, 6) AS with_term, round(o, 6) AS without_term, round(o - w, 6) AS shift FROM (
  SELECT 'a' AS term, b1 AS w, say / saa AS o FROM co UNION ALL
  SELECT 'Intercept', my - b1 * ma - b2 * mb, my - say / saa * ma FROM co)""")
def _(spark, sf):
    return rounded(G.omitted_shift(_lines(spark, sf), "y", ["a", "b"], "b"), "with_term",
                   "without_term", "shift")


@query("d12_decompose", analysis_sql() + """
SELECT term, round(a, 6) AS mean_a, round(b, 6) AS mean_b, k AS coefficient,
  round(k * (b - a), 6) AS contribution FROM (
  SELECT 'snr_pct' AS term, avg(snr_pct) FILTER (WHERE total_decile = 1) AS a,
    avg(snr_pct) FILTER (WHERE total_decile = 2) AS b, -0.2::DOUBLE AS k FROM an UNION ALL
  SELECT 'log_n', avg(log_n) FILTER (WHERE total_decile = 1),
    avg(log_n) FILTER (WHERE total_decile = 2), -0.5::DOUBLE FROM an)""")
def _(spark, sf):
    out = G.decompose(analysis(spark, sf), "total_decile", 1, 2,
                      {"snr_pct": -0.2, "log_n": -0.5})
    return rounded(out, "mean_a", "mean_b", "contribution")
