"""Reading, writing, resuming and merging."""

import uuid

from pyspark.sql import functions as F

from honestpick.functions.lineage import save_table, shared_dir
from honestpick.operators import bootstrap as B, effects as E, prep as P
from honestpick.plans import roles as R
from honestpick.plans.catalog import query, r, rounded
from honestpick.plans.queries_arms import arms
from honestpick.plans.sqltext import with_
from honestpick.sources import arms as SA, results as SR


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_read_arms", with_("arms") + """
SELECT test_id, split, source_row_id, impressions, clicks, round(rate, 8) AS rate, first_place,
  winner, arm_ordinal FROM arms""")
def _(spark, sf):
    path = scratch(spark, "arms-csv")
    SA.write_estimates(R.raw_arms(spark, sf), path, "csv")
    read = P.prepare_arms(SA.read_arms(spark, path, "csv"))
    return rounded(read.drop("created_at"), "rate", digits=8)


@query("s2_read_rows", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
GROUP BY o_orderpriority""")
def _(spark, sf):
    rows = SA.read_rows(spark, f"{sf}/orders.parquet")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"),
                                               r(F.sum("o_totalprice"), 2).alias("total"))


@query("s3_pruned_read", "SELECT l_partkey, l_returnflag FROM lineitem")
def _(spark, sf):
    return SA.read_rows(spark, f"{sf}/lineitem.parquet", ["l_partkey", "l_returnflag"])


@query("s5_write_estimates", with_("records") + """
SELECT test_id, selected_arm, round(naive, 8) AS naive, round(gap, 8) AS gap FROM records""")
def _(spark, sf):
    path = scratch(spark, "records-json")
    rec = rounded(E.test_records(arms(spark, sf)).select("test_id", "selected_arm", "naive",
                                                         "gap"), "naive", "gap", digits=8)
    SA.write_estimates(rec, path, "json")
    return spark.read.schema(rec.schema).json(path)


@query("s6_write_draws")
def _(spark, sf):
    a = arms(spark, sf)
    effects = E.arm_effects_from_counts(a)
    draws = B.bias_draws(B.count_draws(effects, 20), effects).withColumn(
        "estimator", F.lit("standard"))
    path = scratch(spark, "draws")
    SA.write_draws(SR.complete_estimators(draws, a), path)
    return spark.read.parquet(path)


@query("s7_run_incremental", with_("records") + """
SELECT test_id, selected_arm, round(naive, 8) AS naive FROM records""")
def _(spark, sf):
    path, sig = scratch(spark, "resume"), SR.signature_of(min_arms=2)
    a = arms(spark, sf)

    def estimate(pending):
        return rounded(E.test_records(pending).select("test_id", "selected_arm", "naive"),
                       "naive", digits=8)
    SR.run_incremental(a.where("split = 'exploratory'"), estimate, path, sig)
    return SR.run_incremental(a, estimate, path, sig).drop("signature")


_errors = R.error_table


_ERR = dict(err_wide="""
  SELECT o_orderstatus AS setting,
    CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS repeat,
    avg(o_totalprice / 1370) AS a, max(o_totalprice / 1370) AS b, min(o_totalprice / 1370) AS c
  FROM orders GROUP BY ALL""", err="""
  SELECT setting, repeat, estimator, val_est, 250.0::DOUBLE AS val_true, val_est - 250 AS wc FROM (
    SELECT setting, repeat, 'none' AS estimator, a AS val_est FROM err_wide UNION ALL
    SELECT setting, repeat, 'split', b FROM err_wide UNION ALL
    SELECT setting, repeat, 'standard', c FROM err_wide)""")


@query("s8_merge_estimates", with_(**_ERR) + """
SELECT setting, repeat, estimator, round(val_est, 4) AS val_est FROM err WHERE estimator = 'none'
UNION ALL
SELECT setting, repeat, estimator, round(val_est + 1, 4) FROM err WHERE estimator = 'standard'""")
def _(spark, sf):
    base = _errors(spark, sf)
    delta = base.where("estimator <> 'split'").withColumn("val_est", F.col("val_est") + 1)
    out = SR.merge_estimates(base, delta, drop=["split"])
    return rounded(out.select("setting", "repeat", "estimator", "val_est"), "val_est", digits=4)


@query("s9_replace_estimator", with_(**_ERR) + """
SELECT setting, repeat, estimator, round(CASE WHEN estimator <> 'split' THEN val_est
    WHEN repeat % 5 <> 0 THEN 250 + (val_est - 250) / 100 END, 4) AS val_est,
  CASE WHEN estimator <> 'split' THEN true WHEN repeat % 5 <> 0
    THEN (val_est - 250) / 100 > -5 AND (val_est - 250) / 100 < 5 ELSE false END AS valid,
  estimator = 'split' AND repeat % 5 = 0 AS failed
FROM err""")
def _(spark, sf):
    base = _errors(spark, sf)
    new = base.where("estimator = 'split'").select("setting", "repeat", F.when(
        F.col("repeat") % 5 != 0, 250 + F.col("wc") / 100).alias("val_est"))
    out = SR.replace_estimator(base, new, "split")
    return rounded(out.select("setting", "repeat", "estimator", "val_est", "valid", "failed"),
                   "val_est", digits=4)


@query("s9b_unchanged", with_(**_ERR) + """
SELECT count(*) AS rows_before, count(*) AS rows_after, true AS unchanged FROM err
WHERE estimator <> 'split'""")
def _(spark, sf):
    # written once, as an average may differ in its last bit when it is made again
    base = save_table(_errors(spark, sf))
    new = base.where("estimator = 'split'").select("setting", "repeat", F.lit(250.5).alias(
        "val_est"))
    return SR.unchanged(base, SR.replace_estimator(base, new, "split"), "split")


def _runs(spark, sf):
    ev = R.table(spark, sf, "events")
    return SR.parse_runs(ev.select(
        F.concat_ws("_", "event_type", F.when(F.col("event_id") % 7 == 0, F.lit("estsubset")),
                    F.date_format("ts", "yyyyMMdd_HHmmss")).alias("dir"),
        (F.col("value") > 3).alias("has_config"),
        F.when(F.col("event_id") % 4 == 1, "raw").when(F.col("event_id") % 4 == 2, "amended")
         .when(F.col("event_id") % 4 == 3, "slim").alias("file")))


_RUNS = dict(runs="""
  SELECT *, regexp_extract(dir, '^(.*)_(\\d{8}_\\d{6})$', 1) AS name,
    regexp_extract(dir, '^(.*)_(\\d{8}_\\d{6})$', 2) AS ts FROM (
    SELECT concat_ws('_', event_type, CASE WHEN event_id % 7 = 0 THEN 'estsubset' END,
        strftime(ts, '%Y%m%d_%H%M%S')) AS dir, value > 3 AS has_config,
      CASE event_id % 4 WHEN 1 THEN 'raw' WHEN 2 THEN 'amended' WHEN 3 THEN 'slim' END AS file
    FROM events)""")


@query("s10_latest_run", with_(**_RUNS) + """
SELECT CASE name WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'sales' ELSE 'sales' END
    AS experiment, max(ts) AS ts, max(ts || '#' || dir)[17:] AS dir
FROM runs WHERE name IN ('click', 'purchase', 'signup') AND has_config AND file IS NOT NULL
GROUP BY 1""")
def _(spark, sf):
    return SR.latest_run(_runs(spark, sf), {"click": "clicks", "purchase": "sales",
                                            "signup": "sales"})


@query("s11_preferred_artifact", with_(**_RUNS) + """
SELECT name, CASE min(CASE file WHEN 'slim' THEN 0 WHEN 'amended' THEN 1 ELSE 2 END)
  WHEN 0 THEN 'slim' WHEN 1 THEN 'amended' ELSE 'raw' END AS file
FROM (SELECT name || substr(ts, 1, 11) AS name, file FROM runs) WHERE file IS NOT NULL
GROUP BY name""")
def _(spark, sf):
    files = _runs(spark, sf).withColumn("name", F.concat("name", F.substring("ts", 1, 11)))
    return SR.preferred_artifact(files, run="name")


@query("s12_run_manifest")
def _(spark, sf):
    return SR.run_manifest(R.raw_arms(spark, sf), {"draws": 50, "power": 0.5, "seed": 42})
