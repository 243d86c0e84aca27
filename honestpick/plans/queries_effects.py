"""Effects, selection and record queries."""

from pyspark.sql import functions as F

from honestpick.operators import effects as E, prep as P
from honestpick.plans import roles as R
from honestpick.plans.catalog import query, r, rounded
from honestpick.plans.queries_arms import arms
from honestpick.plans.sqltext import normal_sql, with_


@query("s4_rollup_arms", with_("rows_") + """
SELECT test_id, arm, count(*) AS impressions, CAST(sum(click) AS BIGINT) AS clicks
FROM rows_ GROUP BY test_id, arm""")
def _(spark, sf):
    return E.rollup_arms(R.order_rows(spark, sf))


@query("e1_arm_effects", with_("reff") + """
SELECT test_id, arm, n, round(effect, 6) AS effect, round(var, 6) AS var FROM reff""")
def _(spark, sf):
    return rounded(E.arm_effects(R.order_rows(spark, sf)), "effect", "var")


@query("e1b_arm_effects_bernoulli", with_("rows_") + """
SELECT test_id, arm, count(*) AS n, round(avg(click), 8) AS effect,
  round(avg(click) * (1 - avg(click)) / count(*), 10) AS var FROM rows_ GROUP BY test_id, arm""")
def _(spark, sf):
    e = E.arm_effects(R.order_rows(spark, sf), "bernoulli", value="click")
    return e.select("test_id", "arm", "n", r("effect", 8).alias("effect"), r("var", 10).alias("var"))


@query("e2_arm_effects_logit", with_("rows_", m="""
  SELECT test_id, arm, count(*) AS n, avg(click) AS p FROM rows_ GROUP BY test_id, arm""") + """
SELECT test_id, arm, n, CASE WHEN p > 0 AND p < 1 THEN round(ln(p / (1 - p)), 6) END AS effect,
  CASE WHEN p > 0 AND p < 1 THEN round(1 / (n * p * (1 - p)), 6) END AS var FROM m""")
def _(spark, sf):
    return rounded(E.arm_effects(R.order_rows(spark, sf), "logit", value="click"),
                   "effect", "var")


@query("e3_arm_effects_from_counts", with_("effects") + """
SELECT test_id, arm, source_row_id, n, round(effect, 8) AS effect, round(var, 10) AS var
FROM effects""")
def _(spark, sf):
    e = E.arm_effects_from_counts(arms(spark, sf))
    return e.withColumns({"effect": r("effect", 8), "var": r("var", 10)})


@query("e4_sample_effects", with_("rows_", e="""
  SELECT test_id, arm, count(y) AS n, avg(y) AS effect, var_samp(y) / count(y) AS var
  FROM rows_ GROUP BY test_id, arm""") + """
SELECT test_id, arm, n, round(effect, 6) AS effect, round(var, 6) AS var,
  round(effect - 1.96 * sqrt(var), 6) AS ci_low, round(effect + 1.96 * sqrt(var), 6) AS ci_high,
  effect = max(effect) OVER (PARTITION BY test_id) AS selected FROM e""")
def _(spark, sf):
    return rounded(E.sample_effects(R.order_rows(spark, sf)), "effect", "var", "ci_low", "ci_high")


@query("e5_select_winner", with_("pick", "effects") + """
SELECT p.test_id, p.arm, round(p.effect, 8) AS effect,
  (SELECT count(*) FROM effects e WHERE e.test_id = p.test_id AND e.effect = p.effect) AS ties
FROM pick p""")
def _(spark, sf):
    pick = E.select_winner(E.arm_effects_from_counts(arms(spark, sf)), tie="source_row_id")
    return rounded(pick, "effect", digits=8)


@query("e6_apply_rule", with_("effects") + """
SELECT test_id, arm, round(effect, 8) AS effect, round(score, 8) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, arm) AS k FROM (
    SELECT *, effect - 1.5 * sqrt(var) AS score FROM effects)) WHERE k = 1""")
def _(spark, sf):
    e = E.arm_effects_from_counts(arms(spark, sf))
    return rounded(E.apply_rule(e, F.col("effect") - 1.5 * F.sqrt("var")), "effect", "score",
                   digits=8)


@query("e7_value_of", with_("rows_", m="""
  SELECT test_id, arm, avg(click) AS p, avg(y) AS effect FROM rows_ GROUP BY test_id, arm""",
       pick_="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id
  ORDER BY effect DESC, arm) AS k FROM m) WHERE k = 1""") + """
SELECT test_id, arm, CASE WHEN p > 0 AND p < 1 THEN round(p, 8) END AS value FROM pick_""")
def _(spark, sf):
    rows = R.order_rows(spark, sf)
    pick = E.select_winner(E.arm_effects(rows))
    rates = E.arm_effects(rows, "logit", value="click")
    return rounded(E.value_of(pick, rates, link="logit"), "value", digits=8)


_RECORD = """test_id, split, n_arms, total_impressions, total_clicks, min_arm_impressions,
  max_arm_impressions, round(pooled_rate, 8) AS pooled_rate, selected_arm,
  selected_source_row_id, selected_impressions, selected_clicks, round(naive, 8) AS naive,
  selected_winner, selected_first_place, round(runner_up, 8) AS runner_up,
  round(gap, 8) AS gap, ties"""


@query("e8_test_records", with_("records") + f"SELECT {_RECORD} FROM records")
def _(spark, sf):
    return rounded(E.test_records(arms(spark, sf)), "pooled_rate", "naive", "runner_up", "gap",
                   digits=8)


@query("e9_uncorrected", with_("rpick") + """
SELECT test_id, 'none' AS estimator, arm AS selected_arm, round(effect, 6) AS naive FROM rpick""")
def _(spark, sf):
    return rounded(E.uncorrected(E.arm_effects(R.order_rows(spark, sf))), "naive")


@query("e10_top_two", with_("two") + """
SELECT test_id, round(rate_1, 8) AS rate_1, round(rate_2, 8) AS rate_2, round(sd_1, 8) AS sd_1,
  round(sd_2, 8) AS sd_2, round(se_1, 8) AS se_1, round(se_2, 8) AS se_2, n_1, n_2,
  clicks_1, clicks_2, id_1, id_2 FROM two""")
def _(spark, sf):
    return rounded(E.top_two(arms(spark, sf)), "rate_1", "rate_2", "sd_1", "sd_2", "se_1",
                   "se_2", digits=8)


@query("e11_empirical_snr", with_("two") + """
SELECT test_id, CASE WHEN sd_1 * sd_1 + sd_2 * sd_2 > 0 THEN
  round((rate_1 - rate_2) / sqrt((sd_1 * sd_1 + sd_2 * sd_2) / 2), 8) END AS snr FROM two""")
def _(spark, sf):
    return E.add_snr(E.top_two(arms(spark, sf))).select("test_id", r("snr", 8).alias("snr"))


@query("e12_distribution_rule", with_("reff", d=f"""
  SELECT test_id, arm, effect, effect + sqrt(var) * {normal_sql(
      "test_id, CAST(arm AS VARCHAR), CAST(draw AS VARCHAR)", 42, "dist")} AS x
  FROM reff, (SELECT range AS draw FROM range(40))""", s="""
  SELECT test_id, arm, min(effect) AS effect, avg(x) AS score FROM d GROUP BY test_id, arm""") + """
SELECT test_id, arm, round(effect, 6) AS effect, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, arm) AS k FROM s)
WHERE k = 1""")
def _(spark, sf):
    out = E.distribution_rule(E.arm_effects(R.order_rows(spark, sf)), 40)
    return rounded(out, "effect", "score")
