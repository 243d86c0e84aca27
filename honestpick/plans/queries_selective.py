"""Selective-inference queries."""

from pyspark.sql import functions as F, types as T
import numpy as np
import pandas as pd

from honestpick.functions import gauss
from honestpick.operators import effects as E, selective as S
from honestpick.plans import roles as R
from honestpick.plans.catalog import query, r, rounded
from honestpick.plans.queries_arms import saved_effects
from honestpick.plans.sqltext import hash_sql, with_
from honestpick.functions import draws as D


def _effects(spark, sf):
    return saved_effects(spark, sf)


@F.pandas_udf(T.DoubleType())
def _truncnorm(x: pd.Series, a: pd.Series, b: pd.Series, mu: pd.Series,
               sd: pd.Series) -> pd.Series:
    p = gauss.truncnorm_cdf(*[c.to_numpy(float) for c in (x, a, b, mu, sd)])
    return pd.Series(np.where(np.isfinite(p), p, None), dtype=object)


@query("i1_truncnorm_cdf")
def _(spark, sf):
    rows = S.pick_summary(_effects(spark, sf))
    c = 3 * F.col("sd")
    return rows.select("test_id", "naive", _truncnorm(
        F.col("naive"), F.col("runner_up"), F.col("naive") + c, F.col("runner_up"), F.col("sd"))
        .alias("cdf"))


@query("i2_max_abs_normal_quantile")
def _(spark, sf):
    return S.with_critical_value(S.pick_summary(_effects(spark, sf)), 0.005).select(
        "test_id", "n_arms", "c_alpha")


@query("i3_conditional_estimate")
def _(spark, sf):
    return S.si_correct(_effects(spark, sf), "conditional", tie="source_row_id")


@query("i4_hybrid_estimate")
def _(spark, sf):
    return S.si_correct(_effects(spark, sf), "hybrid", tie="source_row_id")


@query("i5_projection_interval")
def _(spark, sf):
    return S.projection_interval(_effects(spark, sf))


@query("i6_intervals")
def _(spark, sf):
    return S.intervals(_effects(spark, sf))


@query("i7_si_correct")
def _(spark, sf):
    e = E.arm_effects(R.order_rows(spark, sf))
    return S.si_correct(e, "hybrid").unionByName(S.si_correct(e, "conditional"))


# Convergence counts: a customer's month is a repeat, an order still open did not converge.
_REPEATS = """
  SELECT substr(o_orderpriority, 1, 1) AS setting, date_trunc('month', o_orderdate) AS month,
    count(*) AS customers, count(*) FILTER (WHERE o_totalprice > 480000) AS not_converged
  FROM orders GROUP BY ALL"""


@query("i8_si_convergence", with_(t=_REPEATS) + """
SELECT setting, count(*) AS repeats, round(avg(customers), 6) AS customers,
  round(avg(not_converged), 6) AS mean_not_converged,
  round(avg(not_converged::DOUBLE / customers), 8) AS mean_rate,
  round(max(not_converged::DOUBLE / customers), 8) AS worst_rate,
  round(avg(CASE WHEN not_converged > 0 THEN 1.0::DOUBLE ELSE 0 END), 8) AS share_affected,
  quantile_cont(not_converged::DOUBLE, 0.5) AS median_not_converged
FROM t GROUP BY setting""")
def _(spark, sf):
    t = R.table(spark, sf, "orders").groupBy(
        F.substring("o_orderpriority", 1, 1).alias("setting"),
        F.date_trunc("month", "o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("o_totalprice") > 480000).alias("not_converged"))
    out = S.si_convergence(t, ["setting"])
    return rounded(rounded(out, "customers", "mean_not_converged"), "mean_rate", "worst_rate",
                   "share_affected", digits=8)


# Coverage: intervals from a hashed half of each test's rows, truth from all of its rows.
@query("i9_coverage", with_("rows_", half=f"""
  SELECT test_id, arm, avg(y) AS effect, var_samp(y) / count(*) AS var FROM rows_
  WHERE {hash_sql("CAST(row_id AS VARCHAR)", 42, "half")} < '8' GROUP BY test_id, arm""",
                            whole="SELECT test_id, arm, avg(y) AS truth FROM rows_ GROUP BY 1, 2",
                            b="""
  SELECT h.arm, truth, effect, effect - 1.96 * sqrt(var) AS lo, effect + 1.96 * sqrt(var) AS hi
  FROM half h JOIN whole w ON h.test_id = w.test_id AND h.arm = w.arm""") + """
SELECT arm, count(*) AS n,
  round(avg(CASE WHEN truth BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END), 8) AS coverage,
  round(avg(CASE WHEN effect > truth THEN 1.0::DOUBLE ELSE 0 END), 8) AS over_share,
  round(avg(effect - truth), 6) AS mean_error,
  round(quantile_cont(effect - truth, 0.5), 6) AS median_error,
  round(quantile_cont(hi - lo, 0.5), 6) AS median_width FROM b GROUP BY arm""")
def _(spark, sf):
    data = R.order_rows(spark, sf)
    half = E.sample_effects(data.where(D.hash_hex(["row_id"], 42, "half") < "8"))
    truth = E.arm_effects(data).select("test_id", "arm", F.col("effect").alias("truth"))
    out = S.coverage(half.join(truth, ["test_id", "arm"]), "truth", ["arm"], "effect")
    return out.select("arm", "n", r("coverage", 8).alias("coverage"),
                      r("over_share", 8).alias("over_share"),
                      *[r(c).alias(c) for c in ("mean_error", "median_error", "median_width")])
