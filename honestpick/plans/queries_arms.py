"""Preparation and join queries."""

from pyspark.sql import functions as F

from honestpick.functions import columns as C
from honestpick.functions.lineage import save_table
from honestpick.operators import effects as E, joins as J, prep as P
from honestpick.plans import roles as R
from honestpick.plans.catalog import query, r, rounded
from honestpick.plans.sqltext import with_


def arms(spark, sf):
    return P.prepare_arms(R.raw_arms(spark, sf))


def saved_effects(spark, sf):
    """Effects of the arm table, written once for queries that read them several times."""
    return save_table(E.arm_effects_from_counts(arms(spark, sf)))


def many(spark, sf):
    return P.prepare_arms(R.many_arms(spark, sf))


@query("p1_coerce_bool", with_("raw_arms") + """
SELECT test_id, source_row_id,
  coalesce(lower(trim(winner)) IN ('true','1','yes','y','t'), false) AS winner,
  coalesce(lower(trim(first_place)) IN ('true','1','yes','y','t'), false) AS first_place
FROM raw_arms""")
def _(spark, sf):
    return R.raw_arms(spark, sf).select(
        "test_id", "source_row_id", C.coerce_bool("winner").alias("winner"),
        C.coerce_bool("first_place").alias("first_place"))


@query("p3_cast_arms", with_("arms") + """
SELECT test_id, source_row_id, impressions, clicks, winner FROM arms""")
def _(spark, sf):
    text = R.raw_arms(spark, sf).withColumns({
        c: F.col(c).cast("string") for c in ("source_row_id", "impressions", "clicks")})
    return P.cast_arms(text).select("test_id", "source_row_id", "impressions", "clicks", "winner")


@query("p4_validate_arms", with_("arms") + """
SELECT test_id, count(*) AS n_arms, CAST(sum(impressions) AS BIGINT) AS impressions,
  count(*) FILTER (WHERE clicks < 0 OR clicks > impressions) AS bad
FROM arms GROUP BY test_id""")
def _(spark, sf):
    checked = P.validate_arms(P.cast_arms(R.raw_arms(spark, sf)))
    return checked.groupBy("test_id").agg(
        F.count(F.lit(1)).alias("n_arms"), F.sum("impressions").alias("impressions"),
        F.count_if(P.bad_counts()).alias("bad"))


@query("p5_add_rate", with_("arms") +
       "SELECT test_id, source_row_id, round(rate, 9) AS rate FROM arms")
def _(spark, sf):
    return P.add_rate(P.cast_arms(R.raw_arms(spark, sf))).select(
        "test_id", "source_row_id", r("rate", 9).alias("rate"))


@query("p6_add_arm_ordinal", with_("arms") + "SELECT test_id, source_row_id, arm_ordinal FROM arms")
def _(spark, sf):
    return P.add_arm_ordinal(P.cast_arms(R.raw_arms(spark, sf))).select(
        "test_id", "source_row_id", "arm_ordinal")


@query("p7_eligible_tests", with_("arms") + """
, keep AS (SELECT test_id FROM arms GROUP BY test_id
           HAVING count(*) >= 2 AND min(impressions) >= 150 ORDER BY test_id LIMIT 12)
SELECT a.test_id, source_row_id,
  CAST(row_number() OVER (PARTITION BY a.test_id ORDER BY source_row_id) - 1 AS INTEGER)
    AS arm_ordinal, impressions, clicks
FROM arms a JOIN keep k ON a.test_id = k.test_id""")
def _(spark, sf):
    return P.eligible_tests(arms(spark, sf), 2, 150, limit_tests=12).select(
        "test_id", "source_row_id", "arm_ordinal", "impressions", "clicks")


@query("p8_eligibility_summary", with_("arms") + """
, s AS (SELECT test_id, count(*) AS k, min(impressions) AS m FROM arms GROUP BY test_id)
SELECT count(*) AS total_tests, CAST(sum(k) AS BIGINT) AS total_arms,
  count(*) FILTER (WHERE k >= 6 AND m >= 150) AS eligible_tests,
  CAST(coalesce(sum(k) FILTER (WHERE k >= 6 AND m >= 150), 0) AS BIGINT) AS eligible_arms,
  count(*) FILTER (WHERE NOT (k >= 6 AND m >= 150)) AS excluded_tests,
  count(*) FILTER (WHERE k < 6) AS single_arm_tests,
  count(*) FILTER (WHERE k >= 6 AND m < 150) AS low_impression_tests FROM s""")
def _(spark, sf):
    return P.eligibility_summary(arms(spark, sf), 6, 150)


@query("p9_click_spread", with_("ranked") + """
SELECT test_id, source_row_id, round(click_sd, 8) AS click_sd, round(click_se, 8) AS click_se
FROM ranked""")
def _(spark, sf):
    return rounded(P.add_click_spread(arms(spark, sf)).select(
        "test_id", "source_row_id", "click_sd", "click_se"), "click_sd", "click_se", digits=8)


@query("p10_bin_arm_count", with_("arms") + """
SELECT test_id, count(*) AS n_big,
  CASE WHEN count(*) <= 1 THEN NULL WHEN count(*) <= 5 THEN CAST(count(*) AS VARCHAR)
       WHEN count(*) <= 7 THEN '6-7' ELSE '8+' END AS arm_bin
FROM arms WHERE impressions > 300 GROUP BY test_id""")
def _(spark, sf):
    sizes = arms(spark, sf).where("impressions > 300").groupBy("test_id").agg(
        F.count(F.lit(1)).alias("n_big"))
    return P.add_arm_bin(sizes, "n_big")


_EDGES = ", ".join(f"quantile_cont(total_impressions::DOUBLE, {i / 10})" for i in range(11))


@query("p11_quantile_bin", with_("per_test", edges=f"""
  SELECT list_sort(list_distinct([{_EDGES}])) AS e FROM per_test""") + """
SELECT test_id, total_impressions,
  CAST(1 + len(list_filter(e[2:len(e)-1], lambda x: total_impressions > x)) AS INTEGER) AS decile
FROM per_test, edges""")
def _(spark, sf):
    totals = arms(spark, sf).groupBy("test_id").agg(
        F.sum("impressions").alias("total_impressions"))
    return P.quantile_bin(totals, "total_impressions", 10, name="decile")


@query("p11b_quantile_bin_by_split", with_("arms", edges="""
  SELECT split, list_sort(list_distinct([quantile_cont(c, 0.0), quantile_cont(c, 0.25),
    quantile_cont(c, 0.5), quantile_cont(c, 0.75), quantile_cont(c, 1.0)])) AS e
  FROM (SELECT split, greatest(least(clicks::DOUBLE, 200), 40) AS c FROM arms) GROUP BY split""") + """
SELECT test_id, source_row_id, split, CASE WHEN len(e) > 1 THEN CAST(1 + len(list_filter(
  e[2:len(e)-1], lambda x: greatest(least(clicks::DOUBLE, 200), 40) > x)) AS INTEGER) END
  AS quartile
FROM arms JOIN edges USING (split)""")
def _(spark, sf):
    return P.quantile_bin(arms(spark, sf), "clicks", 4, by=["split"], clip=(40, 200),
                          name="quartile").select("test_id", "source_row_id", "split", "quartile")


@query("p12_unit_columns", with_("arms") + """
SELECT test_id, source_row_id, round(rate, 6) AS rate, round(rate * 100, 6) AS rate_pp FROM arms""")
def _(spark, sf):
    return rounded(P.unit_columns(arms(spark, sf), ["rate"]).select(
        "test_id", "source_row_id", "rate", "rate_pp"), "rate", "rate_pp")


@query("p13_drop_nonfinite", with_("two") + """
SELECT test_id, round(1 / (n_1 - n_2)::DOUBLE, 8) AS x FROM two WHERE n_1 <> n_2""")
def _(spark, sf):
    two = E.top_two(arms(spark, sf)).withColumn(
        "x", F.when(F.col("n_1") == F.col("n_2"), float("inf"))
        .otherwise(F.try_divide(F.lit(1.0), F.col("n_1") - F.col("n_2"))))
    return P.drop_nonfinite(two, ["x"]).select("test_id", r("x", 8).alias("x"))


@query("p14_time_parts", with_("many") + """
SELECT test_id, source_row_id, strftime(date_trunc('week', created_at), '%Y-%m-%d') || '/'
    || strftime(date_trunc('week', created_at) + INTERVAL 6 DAY, '%Y-%m-%d') AS week,
  strftime(created_at, '%Y-%m') AS month,
  created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1998-01-11' AS in_period
FROM many""")
def _(spark, sf):
    return many(spark, sf).select(
        "test_id", "source_row_id", C.week_of("created_at").alias("week"),
        C.month_of("created_at").alias("month"),
        C.between_left("created_at", "1997-01-01 00:00:00", "1998-01-11 00:00:00")
        .alias("in_period"))


@query("p15_log_columns", with_("per_test") + """
SELECT test_id, round(ln(n_arms), 8) AS log_arms, round(ln(total_impressions), 8) AS log_total,
  round(ln(sqrt(pooled_rate * (1 - pooled_rate))), 8) AS log_sigma FROM per_test""")
def _(spark, sf):
    rec = arms(spark, sf).groupBy("test_id").agg(
        F.count(F.lit(1)).alias("n_arms"), F.sum("impressions").alias("total"),
        (F.sum("clicks") / F.sum("impressions")).alias("p"))
    rec = rec.withColumn("sigma", F.sqrt(F.col("p") * (1 - F.col("p"))))
    out = P.log_columns(rec, {"log_arms": "n_arms", "log_total": "total", "log_sigma": "sigma"})
    return rounded(out.select("test_id", "log_arms", "log_total", "log_sigma"),
                   "log_arms", "log_total", "log_sigma", digits=8)


@query("p16_safe_ratio", with_("ranked") + """
SELECT test_id, source_row_id, CASE WHEN k <> 1 THEN round(rate / (k - 1), 8) END AS ratio
FROM ranked""")
def _(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("test_id").orderBy(F.col("rate").desc(), "source_row_id")
    ranked = arms(spark, sf).withColumn("k1", F.row_number().over(w) - 1)
    return P.ratio_column(ranked, "rate", "k1", "ratio").select(
        "test_id", "source_row_id", r("ratio", 8).alias("ratio"))


@query("p17_truncate_errors", """
SELECT o_orderkey, round(o_totalprice / 50000 - 5, 6) AS wc,
  o_totalprice / 50000 - 5 > -5 AND o_totalprice / 50000 - 5 < 5 AS valid FROM orders""")
def _(spark, sf):
    errors = R.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 50000 - 5).alias("wc"))
    return rounded(P.truncate_errors(errors, flag_only=True), "wc")


@query("p18_cap_outliers", """
SELECT o_orderkey, round(least(o_totalprice, q), 4) AS price_capped
FROM orders, (SELECT quantile_cont(o_totalprice, 0.99) AS q FROM orders)""")
def _(spark, sf):
    orders = R.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.cap_outliers(orders, "o_totalprice", 0.99, name="price_capped").select(
        "o_orderkey", r("price_capped", 4).alias("price_capped"))


@query("j1_semi_eligible", with_("arms") + """
SELECT test_id, source_row_id, clicks FROM arms WHERE test_id IN (
  SELECT test_id FROM arms GROUP BY test_id HAVING min(impressions) >= 160)""")
def _(spark, sf):
    a = arms(spark, sf)
    keep = P.test_sizes(a).where("min_impressions >= 160")
    return a.join(keep, "test_id", "left_semi").select("test_id", "source_row_id", "clicks")


@query("j2_join_one_to_one", with_("per_test", "two") + """
SELECT p.test_id, total_impressions, round(rate_1 - rate_2, 8) AS gap
FROM per_test p JOIN two t ON p.test_id = t.test_id""")
def _(spark, sf):
    a = arms(spark, sf)
    totals = a.groupBy("test_id").agg(F.sum("impressions").alias("total_impressions"))
    gaps = E.top_two(a).select("test_id", (F.col("rate_1") - F.col("rate_2")).alias("gap"))
    return rounded(J.join_one_to_one(totals, gaps, ["test_id"]), "gap", digits=8)


@query("j3_join_many_to_one", with_("arms", "per_test") + """
SELECT a.test_id, a.source_row_id, a.impressions, p.total_impressions
FROM arms a LEFT JOIN (SELECT * FROM per_test WHERE min_arm_impressions >= 150) p
  ON a.test_id = p.test_id""")
def _(spark, sf):
    a = arms(spark, sf)
    totals = (a.groupBy("test_id").agg(F.sum("impressions").alias("total_impressions"),
                                       F.min("impressions").alias("m"))
              .where("m >= 150").select("test_id", "total_impressions"))
    return J.join_many_to_one(a.select("test_id", "source_row_id", "impressions"), totals,
                              ["test_id"])


@query("j4_join_summaries", with_("arms") + """
SELECT x.split, x.n_arms, y.mean_rate FROM
  (SELECT split, count(*) AS n_arms FROM arms GROUP BY split) x LEFT JOIN
  (SELECT split, round(avg(rate), 8) AS mean_rate FROM arms WHERE winner GROUP BY split) y
  ON x.split = y.split""")
def _(spark, sf):
    a = arms(spark, sf)
    counts = a.groupBy("split").agg(F.count(F.lit(1)).alias("n_arms"))
    means = a.where("winner").groupBy("split").agg(r(F.avg("rate"), 8).alias("mean_rate"))
    return J.join_summaries(counts, means, keys=["split"])


@query("j5_align_runs", with_("rpick", alt="""
  SELECT test_id, max(m) AS effect FROM (
    SELECT test_id, arm, sum(y) / count(*) AS m FROM rows_ GROUP BY test_id, arm)
  GROUP BY test_id""") + """
SELECT count(*) FILTER (WHERE b.test_id IS NULL) AS only_a,
  count(*) FILTER (WHERE a.test_id IS NULL) AS only_b,
  count(*) FILTER (WHERE a.test_id IS NOT NULL AND b.test_id IS NOT NULL) AS matched,
  coalesce(max(abs(a.effect - b.effect)), 0) < 1e-9 AS aligned
FROM rpick a FULL JOIN alt b ON a.test_id = b.test_id""")
def _(spark, sf):
    rows = R.order_rows(spark, sf)
    a = E.select_winner(E.arm_effects(rows)).select("test_id", "effect")
    b = (rows.groupBy("test_id", "arm").agg((F.sum("y") / F.count("y")).alias("m"))
         .groupBy("test_id").agg(F.max("m").alias("effect")))
    return J.align_runs(a, b, ["test_id"], "effect", tolerance=1e-9).drop("max_abs_diff")


@query("j6_compare_summaries", with_("arms") + """
SELECT count(*) AS n_rows, round(max(abs(a.m - b.m)), 8) AS mean_rate_max_abs_diff FROM
  (SELECT split, avg(rate) AS m FROM arms GROUP BY split) a JOIN
  (SELECT split, sum(clicks)::DOUBLE / sum(impressions) AS m FROM arms GROUP BY split) b
  ON a.split = b.split""")
def _(spark, sf):
    a = arms(spark, sf)
    x = a.groupBy("split").agg(F.avg("rate").alias("mean_rate"))
    y = a.groupBy("split").agg((F.sum("clicks") / F.sum("impressions")).alias("mean_rate"))
    return rounded(J.compare_summaries(x, y, ["split"], ["mean_rate"]),
                   "mean_rate_max_abs_diff", digits=8)


@query("j7_with_grid", with_("arms") + """
SELECT test_id, source_row_id, power, size, CAST(floor(pow(impressions, power)) AS BIGINT) AS m
FROM arms, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE]) AS power),
  (SELECT unnest([100, 200]) AS size)""")
def _(spark, sf):
    grid = J.with_grid(arms(spark, sf), power=[0.5, 0.7], size=[100, 200])
    return grid.select("test_id", "source_row_id", "power", "size",
                       F.floor(F.pow("impressions", "power")).alias("m"))
