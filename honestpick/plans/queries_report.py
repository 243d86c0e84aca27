"""Summary queries."""

from pyspark.sql import functions as F

from honestpick.functions import columns as C
from honestpick.functions.lineage import save_table
from honestpick.operators import effects as E, report as Q, shrink as H
from honestpick.plans import roles as R
from honestpick.plans.catalog import query, r, rounded
from honestpick.plans.queries_regress import ANALYSIS, analysis, supplier_tests
from honestpick.plans.queries_sources import _ERR
from honestpick.plans.queries_splits import _VALUES, _values
from honestpick.plans.sqltext import SUPPLIER_ARMS, with_

_PRIOR_MEAN, _PRIOR_STD = 0.33, 0.02


def estimates(spark, sf):
    """Long per-test table of two corrections that SQL can repeat, saved once."""
    arms = supplier_tests(spark, sf)
    effects = E.arm_effects_from_counts(arms)
    keep = ["test_id", "estimator", "corrected", "bias"]
    made = H.correct_eb_normal(effects, tie="source_row_id").select(*keep).unionByName(
        H.correct_bayes_normal(effects, _PRIOR_MEAN, _PRIOR_STD).select(*keep))
    return save_table(E.test_records(arms).join(made, "test_id").withColumn(
        "bias_pct", C.safe_ratio("bias", "naive")))


_P2 = f"{_PRIOR_STD ** 2!r}::DOUBLE"
LONG = dict(bay=f"""
  SELECT test_id, arm, {_P2} / ({_P2} + var) * effect
    + (1 - {_P2} / ({_P2} + var)) * {_PRIOR_MEAN}::DOUBLE AS post FROM effects""", long="""
  SELECT r.*, 'eb_normal' AS estimator, e.post AS corrected, r.naive - e.post AS bias,
    (r.naive - e.post) / nullif(r.naive, 0) AS bias_pct FROM records r
  JOIN eb e ON r.test_id = e.test_id AND r.selected_arm = e.arm
  UNION ALL
  SELECT r.*, 'bayes_normal', b.post, r.naive - b.post, (r.naive - b.post) / nullif(r.naive, 0)
  FROM records r JOIN bay b ON r.test_id = b.test_id AND r.selected_arm = b.arm""")


def long_sql(**own):
    return with_("records", "eb", raw=SUPPLIER_ARMS, **LONG, **own)


@query("r1_per_test_estimates")
def _(spark, sf):
    arms = supplier_tests(spark, sf)
    return Q.per_test_estimates(arms, Q.COUNT_ESTIMATORS, draws=100, splits=20)


@query("r1b_wide_estimates", long_sql() + """
SELECT test_id, round(max(corrected) FILTER (WHERE estimator = 'eb_normal'), 8)
    AS eb_normal_corrected,
  round(max(bias) FILTER (WHERE estimator = 'eb_normal'), 8) AS eb_normal_bias,
  round(max(corrected) FILTER (WHERE estimator = 'bayes_normal'), 8) AS bayes_normal_corrected,
  round(max(bias) FILTER (WHERE estimator = 'bayes_normal'), 8) AS bayes_normal_bias
FROM long GROUP BY test_id""")
def _(spark, sf):
    wide = Q.wide_estimates(estimates(spark, sf), ["eb_normal", "bayes_normal"],
                            ("corrected", "bias"))
    return rounded(wide, *[c for c in wide.columns if c != "test_id"], digits=8)


_SUM = ("mean_bias", "median_bias", "mean_corrected", "mean_naive", "mean_bias_pct",
        "weighted_mean_bias", "weighted_mean_naive", "weighted_mean_bias_pct",
        "aggregate_bias_pct")
SUMMARY = dict(tq="""
  SELECT test_id, min(total_impressions) AS t FROM long GROUP BY test_id""", qe="""
  SELECT list_sort(list_distinct([quantile_cont(t::DOUBLE, 0.0), quantile_cont(t::DOUBLE, 0.25),
    quantile_cont(t::DOUBLE, 0.5), quantile_cont(t::DOUBLE, 0.75),
    quantile_cont(t::DOUBLE, 1.0)])) AS e FROM tq""", cells="""
  SELECT unnest(['overall', 'split', 'arm_count_bin', 'impression_bin', 'selected_winner',
      'selected_first_place']) AS grp,
    unnest(['all', split, CASE WHEN n_arms <= 5 THEN CAST(n_arms AS VARCHAR)
        WHEN n_arms <= 7 THEN '6-7' ELSE '8+' END,
      CAST(1 + len(list_filter(e[2:len(e)-1], lambda x: total_impressions > x)) AS VARCHAR),
      CAST(selected_winner AS VARCHAR), CAST(selected_first_place AS VARCHAR)]) AS group_value,
    long.* FROM long, qe WHERE bias IS NOT NULL""", summ="""
  SELECT grp, group_value, estimator, count(*) AS n_tests, avg(bias) AS mean_bias,
    quantile_cont(bias, 0.5) AS median_bias, avg(corrected) AS mean_corrected,
    avg(naive) AS mean_naive, avg(bias_pct) AS mean_bias_pct,
    sum(selected_impressions * bias) / sum(selected_impressions) AS weighted_mean_bias,
    sum(selected_impressions * naive) / sum(selected_impressions) AS weighted_mean_naive,
    sum(selected_impressions * bias_pct) / sum(selected_impressions) AS weighted_mean_bias_pct,
    sum(selected_impressions * bias) / sum(selected_impressions * naive) AS aggregate_bias_pct,
    CAST(sum(selected_impressions) AS BIGINT) AS selected_impressions
  FROM cells GROUP BY grp, group_value, estimator""")


@query("r2_summarize", long_sql(**SUMMARY) + f"""
SELECT grp AS "group", group_value, estimator, n_tests, selected_impressions,
  {', '.join(f'round({c}, 7) AS {c}' for c in _SUM)} FROM summ""")
def _(spark, sf):
    return rounded(Q.summarize(estimates(spark, sf)), *_SUM, digits=7)


_RATIO_SE = ("sqrt(greatest(var_samp({n}) - 2 * (avg({n}) / avg({d})) * covar_samp({n}, {d}) "
             "+ power(avg({n}) / avg({d}), 2) * var_samp({d}), 0) / count(*)) / abs(avg({d}))")
_HEAD = ("mean_naive", "mean_corrected", "se_corrected", "mean_bias", "se_bias", "bias_pct",
         "se_bias_pct")


@query("r3_headline", long_sql() + f"""
SELECT estimator, count(*) AS n_tests, round(avg(naive), 7) AS mean_naive,
  round(avg(corrected), 7) AS mean_corrected,
  round(stddev_samp(corrected) / sqrt(count(*)), 7) AS se_corrected,
  round(avg(bias), 7) AS mean_bias, round(stddev_samp(bias) / sqrt(count(*)), 7) AS se_bias,
  round(100 * avg(bias) / avg(naive), 7) AS bias_pct,
  round(100 * {_RATIO_SE.format(n='bias', d='naive')}, 7) AS se_bias_pct
FROM long GROUP BY estimator""")
def _(spark, sf):
    return rounded(Q.headline(estimates(spark, sf)), *_HEAD, digits=7)


@query("r4_mean_se", """
SELECT l_suppkey, round(stddev_samp(l_extendedprice) / sqrt(count(*)), 5) AS se,
  count(*) AS n FROM lineitem GROUP BY l_suppkey""")
def _(spark, sf):
    return R.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        r(Q.mean_se("l_extendedprice"), 5).alias("se"), F.count(F.lit(1)).alias("n"))


@query("r5_ratio_of_means", f"""
SELECT l_returnflag, round(avg(l_extendedprice) / avg(l_quantity), 6) AS ratio,
  round({_RATIO_SE.format(n='l_extendedprice', d='l_quantity')}, 6) AS se
FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    return R.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        r(Q.ratio_of_means("l_extendedprice", "l_quantity")).alias("ratio"),
        r(Q.ratio_of_means_se("l_extendedprice", "l_quantity")).alias("se"))


@query("r6_bias_distribution", long_sql() + """
SELECT estimator, count(DISTINCT test_id) AS n_tests, round(avg(bias), 7) AS mean_bias,
  round(quantile_cont(bias, 0.25), 7) AS p25, round(quantile_cont(bias, 0.5), 7) AS median_bias,
  round(quantile_cont(bias, 0.75), 7) AS p75, round(avg(bias_pct), 7) AS mean_bias_pct,
  round(quantile_cont(bias_pct, 0.5), 7) AS median_bias_pct,
  round(avg(CASE WHEN bias < 0 THEN 1.0::DOUBLE ELSE 0 END), 7) AS negative_share
FROM long GROUP BY estimator""")
def _(spark, sf):
    return rounded(Q.bias_distribution(estimates(spark, sf)), "mean_bias", "p25", "median_bias",
                   "p75", "mean_bias_pct", "median_bias_pct", "negative_share", digits=7)


def _an_sql(**own):
    return with_("est", "two", raw=SUPPLIER_ARMS, **ANALYSIS, **own)


@query("r7_mean_ci_by", _an_sql() + """
SELECT snr_decile, count(*) AS n, round(avg(bias), 7) AS mean, round(stddev_samp(bias), 7) AS sd,
  round(stddev_samp(bias) / sqrt(count(*)), 7) AS se, round(avg(snr_pct), 6) AS mean_snr_pct,
  round(avg(gap), 7) AS mean_gap,
  round(avg(bias) - 1.96 * stddev_samp(bias) / sqrt(count(*)), 7) AS ci_low,
  round(avg(bias) + 1.96 * stddev_samp(bias) / sqrt(count(*)), 7) AS ci_high,
  round(100 * avg(bias) / nullif(avg(gap), 0), 4) AS pct_of_gap FROM an GROUP BY snr_decile""")
def _(spark, sf):
    out = Q.mean_ci_by(analysis(spark, sf), ["snr_decile"], "bias", "snr_pct", "gap")
    out = rounded(out, "mean", "sd", "se", "mean_gap", "ci_low", "ci_high", digits=7)
    return rounded(rounded(out, "mean_snr_pct"), "pct_of_gap", digits=4)


@query("r8_heatmap", _an_sql() + "SELECT arm_group, " + ", ".join(
    f'round(avg(bias) FILTER (WHERE snr_decile = {d}), 7) AS "{d}"' for d in range(1, 11))
    + " FROM an GROUP BY arm_group")
def _(spark, sf):
    h = Q.heatmap(analysis(spark, sf), "arm_group", "snr_decile", list(range(1, 11)), "bias")
    return rounded(h, *[str(d) for d in range(1, 11)], digits=7)


@query("r9_distribution_stats", """
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean,
  round(stddev_samp(l_extendedprice), 4) AS sd, min(l_extendedprice) AS min,
  max(l_extendedprice) AS max, count(*) FILTER (WHERE l_extendedprice > 50000) AS n_high,
  round(avg(CASE WHEN l_extendedprice > 50000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_high,
  round(quantile_cont(l_extendedprice, 0.01), 4) AS p01,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    out = Q.distribution_stats(
        R.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"),
        "l_extendedprice", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, {"high": 50000.0},
        ["l_returnflag"])
    return rounded(rounded(out, "mean", "sd", "p01", "p50", "p99", digits=4), "share_high")


@query("r10_histogram", """
SELECT CAST(floor(l_extendedprice / 2500.0::DOUBLE) AS BIGINT) AS bin, count(*) AS n,
  floor(l_extendedprice / 2500.0::DOUBLE) * 2500.0::DOUBLE AS "left" FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    return Q.histogram(R.table(spark, sf, "lineitem"), "l_extendedprice", 2500.0)


@query("r11_long_estimates", long_sql() +
       "SELECT test_id, estimator, round(bias, 7) AS value FROM long")
def _(spark, sf):
    names = ["eb_normal", "bayes_normal"]
    wide = Q.wide_estimates(estimates(spark, sf), names)
    return rounded(Q.long_estimates(wide, ["test_id"], "bias", names), "value", digits=7)


@query("r12_validation_checks", long_sql(c="""
  SELECT count(*) AS a, count(*) - count(DISTINCT test_id) AS b,
    count(*) FILTER (WHERE bias IS NULL) AS c, count(*) FILTER (WHERE runner_up IS NULL) AS d,
    count(*) FILTER (WHERE ties > 1) AS e, count(*) FILTER (WHERE bias < 0) AS f FROM long""") + """
SELECT 'rows' AS "check", a AS n FROM c UNION ALL SELECT 'repeated_ids', b FROM c UNION ALL
SELECT 'missing_bias', c FROM c UNION ALL SELECT 'missing_runner_up', d FROM c UNION ALL
SELECT 'ties', e FROM c UNION ALL SELECT 'negative_bias', f FROM c""")
def _(spark, sf):
    return Q.validation_checks(estimates(spark, sf), ["bias", "runner_up"])


@query("r13_data_audit", with_("prows") + """
SELECT count(*) AS rows, 6 AS columns, 0 AS missing_cells,
  count(*) FILTER (WHERE visit > 0) AS visit_positive,
  count(*) FILTER (WHERE spend > 0) AS spend_positive, max(visit) AS visit_max,
  max(spend) AS spend_max FROM prows""")
def _(spark, sf):
    return Q.data_audit(R.priority_rows(spark, sf), ["visit", "spend"])


@query("r13b_arm_summary", with_("prows") + """
SELECT test_id, arm, count(*) AS n, round(avg(visit), 7) AS visit_mean,
  round(avg(spend), 6) AS spend_mean, round(stddev_samp(visit), 7) AS visit_sd,
  round(stddev_samp(spend), 6) AS spend_sd, round(avg(visit), 7) AS visit_positive_rate,
  round(avg(CASE WHEN spend > 0 THEN 1.0::DOUBLE ELSE 0 END), 7) AS spend_positive_rate,
  round(count(*)::DOUBLE / (SELECT count(*) FROM prows), 7) AS share
FROM prows GROUP BY test_id, arm""")
def _(spark, sf):
    out = Q.arm_summary(R.priority_rows(spark, sf), ["visit", "spend"])
    out = rounded(out, "visit_mean", "visit_sd", "visit_positive_rate", "spend_positive_rate",
                  "share", digits=7)
    return rounded(out, "spend_mean", "spend_sd")


@query("r14_subgroup_table", long_sql(**SUMMARY) + """
SELECT group_value, estimator, n_tests, round(mean_bias, 7) AS mean_bias,
  round(median_bias, 7) AS median_bias FROM summ
WHERE grp = 'split' AND estimator = 'eb_normal'""")
def _(spark, sf):
    s = Q.summarize(estimates(spark, sf))
    return rounded(Q.subgroup_table(s, "split", ["eb_normal"]), "mean_bias", "median_bias",
                   digits=7)


@query("r15_error_measures", with_(**_ERR) + """
SELECT setting, repeat, estimator, round(val_est, 4) AS val_est,
  CASE WHEN estimator = 'split' THEN 245.0::DOUBLE ELSE 250.0::DOUBLE END AS val_true,
  round(val_est - CASE WHEN estimator = 'split' THEN 245 ELSE 250 END, 4) AS wc,
  abs(val_est - CASE WHEN estimator = 'split' THEN 245 ELSE 250 END) < 5 AS valid FROM err""")
def _(spark, sf):
    e = R.error_table(spark, sf)
    truths = e.where("estimator = 'none'").select("setting", "repeat", F.col("val_true").alias(
        "naive_true"))
    est = e.select("setting", "repeat", "estimator", "val_est", F.when(
        F.col("estimator") == "split", 245.0).alias("own_true"))
    return rounded(Q.error_measures(est, truths, ["setting", "repeat"]), "val_est", "wc", digits=4)


def _with_gap(e):
    return e.withColumn("gap", F.when(F.col("setting") == "F", 50.0)
                        .when(F.col("setting") == "O", 100.0).otherwise(0.0))


_GAP = "CASE setting WHEN 'F' THEN 2.0::DOUBLE WHEN 'O' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE END"


def _stats_sql(e, by="setting"):
    return f"""
SELECT {by}, estimator, count(*) AS repeats, round(avg({e}), 4) AS mean,
  round(stddev_pop({e}), 4) AS std, round(quantile_cont({e}, 0.5), 4) AS median
FROM err GROUP BY {by}, estimator"""


@query("r16_error_stats", with_(**_ERR) + _stats_sql(f"(wc * {_GAP})"))
def _(spark, sf):
    s = Q.error_stats(_with_gap(R.error_table(spark, sf)), ["setting"], gap="gap")
    return rounded(s, "mean", "std", "median", digits=4)


@query("r16b_error_stats_mae", with_(**_ERR) + _stats_sql("abs(wc)"))
def _(spark, sf):
    s = Q.error_stats(R.error_table(spark, sf), ["setting"], metric="mae")
    return rounded(s, "mean", "std", "median", digits=4)


@query("r16c_error_stats_pivot", with_(**_ERR) + """
SELECT estimator, round(avg(wc) FILTER (WHERE setting = 'F'), 4) AS "F",
  round(avg(wc) FILTER (WHERE setting = 'O'), 4) AS "O",
  round(avg(wc) FILTER (WHERE setting = 'P'), 4) AS "P" FROM err GROUP BY estimator""")
def _(spark, sf):
    s = Q.error_stats(R.error_table(spark, sf), ["setting"])
    return rounded(Q.pivot_stats(s, "setting", ["F", "O", "P"]), "F", "O", "P", digits=4)


# Errors by number of arms: holdout error of each supplier test's naive pick and EB value.
@query("r17_error_stats_by_arms", long_sql(g="""
  SELECT test_id, (max(effect) - min(effect)) / (count(*) - 1) AS step FROM effects
  GROUP BY test_id""") + """
SELECT n_arms, estimator, count(*) AS repeats, round(avg(x), 4) AS mean,
  round(stddev_pop(x), 4) AS std, round(quantile_cont(x, 0.5), 4) AS median FROM (
  SELECT n_arms, estimator, (corrected - pooled_rate) *
    CASE WHEN step <> 0 THEN 100 / step ELSE 1 END AS x FROM long JOIN g USING (test_id))
GROUP BY n_arms, estimator""")
def _(spark, sf):
    arms = supplier_tests(spark, sf)
    gaps = Q.arm_gap(E.arm_effects_from_counts(arms), ["test_id"]).select("test_id", "gap")
    errors = estimates(spark, sf).drop("gap").join(gaps, "test_id").withColumn(
        "wc", F.col("corrected") - F.col("pooled_rate"))
    return rounded(Q.error_stats(errors, ["n_arms"], gap="gap"), "mean", "std", "median",
                   digits=4)


@query("r18_depth_stats", with_(**_ERR) + """
SELECT setting, repeat % 7 AS depth, count(*) AS repeats, round(2 * avg(wc), 4) AS mean_wc,
  round(2 * stddev_samp(wc) / sqrt(count(*)), 4) AS mc_se, round(2 * avg(abs(wc)), 4) AS mae
FROM err WHERE estimator = 'none' GROUP BY setting, repeat % 7""")
def _(spark, sf):
    e = R.error_table(spark, sf).where("estimator = 'none'").withColumn(
        "depth", F.col("repeat") % 7)
    return rounded(Q.depth_stats(e, ["setting", "depth"], gap=50.0), "mean_wc", "mc_se", "mae",
                   digits=4)


# Policies: repeat = order month, customer = order; two rules pick an arm from price and size.
_POL = dict(sel="""
  SELECT o_orderstatus AS setting, CAST(12 * year(o_orderdate) + month(o_orderdate) AS INTEGER)
      AS repeat, o_orderkey,
    CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS a,
    CASE WHEN o_totalprice > 300000 OR o_orderpriority < '2' THEN 1 ELSE 0 END AS b, o_totalprice
  FROM orders""", rt="""
  SELECT setting, repeat, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS rate,
    avg(o_totalprice / 1370 * (1 + a)) AS va, avg(o_totalprice / 1370 * (1 + b)) AS vb
  FROM sel GROUP BY setting, repeat""")


@query("r19_policy_comparison", with_(**_POL) + """
SELECT setting, count(*) AS repeats, round(avg(va), 5) AS focal_value,
  round(avg(vb), 5) AS other_value, round(avg(va - vb), 5) AS difference,
  round(stddev_samp(va - vb) / sqrt(count(*)), 5) AS difference_se,
  round(avg(rate), 7) AS agreement, round(stddev_samp(rate) / sqrt(count(*)), 7) AS agreement_se
FROM rt GROUP BY setting""")
def _(spark, sf):
    o = R.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("setting"),
        (12 * F.year("o_orderdate") + F.month("o_orderdate")).alias("repeat"),
        F.col("o_orderkey").alias("customer_id"), "o_totalprice",
        F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("none"),
        F.when((F.col("o_totalprice") > 300000) | (F.col("o_orderpriority") < "2"), 1)
        .otherwise(0).alias("split"))
    keys = ["setting", "repeat", "customer_id", "o_totalprice"]
    picks = o.unpivot(keys, ["none", "split"], "estimator", "arm")
    rates = Q.agreement_rates(picks, "none", "split", ["setting"])
    errors = picks.groupBy("setting", "repeat", "estimator").agg(
        F.avg(F.col("o_totalprice") / R.PRICE_UNIT * (1 + F.col("arm"))).alias("val_true"))
    out = Q.policy_comparison(errors, rates, ["setting"])
    out = rounded(out, "focal_value", "other_value", "difference", "difference_se", digits=5)
    return rounded(out, "agreement", "agreement_se", digits=7)


@query("r20_moon_table", with_(**_ERR) + """
SELECT setting, round(avg(wc) FILTER (WHERE estimator = 'none'), 4) AS none,
  round(avg(wc) FILTER (WHERE estimator = 'standard'), 4) AS standard,
  round(avg(wc) FILTER (WHERE estimator = 'split' AND repeat % 2 = 0), 4) AS "gamma_0.4",
  round(avg(wc) FILTER (WHERE estimator = 'split' AND repeat % 2 = 1), 4) AS "gamma_0.6"
FROM err GROUP BY setting""")
def _(spark, sf):
    e = R.error_table(spark, sf).withColumns({
        "power": F.when(F.col("repeat") % 2 == 0, 0.4).otherwise(0.6),
        "estimator": F.when(F.col("estimator") == "split", "moon").otherwise(F.col("estimator"))})
    t = Q.moon_table(e, "setting", [0.4, 0.6])
    return t.select("setting", *[r(F.col(f"`{c}`"), 4).alias(c) for c in t.columns[1:]])


@query("r21_order_estimators", with_(**_ERR) + """
SELECT estimator, n, CASE estimator WHEN 'none' THEN 0 WHEN 'standard' THEN 1 WHEN 'split' THEN 5 ELSE 6 END
  AS family
FROM (SELECT estimator, count(*) AS n FROM err GROUP BY estimator)""")
def _(spark, sf):
    counts = R.error_table(spark, sf).groupBy("estimator").agg(F.count(F.lit(1)).alias("n"))
    return Q.order_estimators(counts, "estimator")


_STAR_SQL = """CASE WHEN abs(m / s) > 2.58 THEN '***' WHEN abs(m / s) > 1.96 THEN '**'
  WHEN abs(m / s) > 1.645 THEN '*' ELSE '' END"""


@query("r22_significance", f"""
SELECT l_suppkey, {_STAR_SQL} AS stars, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**'
  WHEN p < 0.1 THEN '*' ELSE '' END AS p_stars FROM (
  SELECT l_suppkey, avg(l_discount) - 0.05 AS m, stddev_samp(l_discount) / sqrt(count(*)) AS s,
    avg(l_tax) AS p FROM lineitem GROUP BY l_suppkey)""")
def _(spark, sf):
    g = R.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        (F.avg("l_discount") - 0.05).alias("m"), Q.mean_se("l_discount").alias("s"),
        F.avg("l_tax").alias("p"))
    return g.select("l_suppkey", C.stars_from_z("m", "s").alias("stars"),
                    C.stars_from_p("p").alias("p_stars"))


@query("r23_ttest_1samp")
def _(spark, sf):
    return Q.ttest_1samp(R.error_table(spark, sf), ["setting", "estimator"])


@query("r24_compare_to_expected", with_(**_ERR, m="""
  SELECT setting, estimator, avg(wc) AS mean, median(wc) AS med FROM err
  GROUP BY setting, estimator""") + """
SELECT setting, count(*) AS total,
  count(*) FILTER (WHERE round(mean / 10) * 10 = round(med / 10) * 10) AS matches
FROM m GROUP BY setting""")
def _(spark, sf):
    s = Q.error_stats(R.error_table(spark, sf), ["setting"])
    expected = s.select("setting", "estimator", (F.round(F.col("median") / 10) * 10).alias(
        "expected"), F.lit(-1).alias("digits"))
    out = Q.compare_to_expected(s.select("setting", "estimator", "mean"), expected,
                                ["setting", "estimator"], "mean")
    return Q.match_counts(out, ["setting"])


@query("r25_winner_change_rate", with_("rpick", **_VALUES) + """
SELECT test_id, round(100 * avg(CASE WHEN selected_arm <> full_winner THEN 1.0::DOUBLE ELSE 0 END),
  6) AS change_pct FROM vals GROUP BY test_id""")
def _(spark, sf):
    return rounded(Q.winner_change_rate(_values(spark, sf), ["test_id"]), "change_pct")


