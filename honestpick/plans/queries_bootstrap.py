"""Resampling queries."""

from pyspark.sql import functions as F

from honestpick.functions import draws as D
from honestpick.operators import bootstrap as B, effects as E
from honestpick.plans import roles as R
from honestpick.plans.catalog import query, rounded
from honestpick.plans.queries_arms import saved_effects
from honestpick.plans.sqltext import hash48_sql, hash_sql, poisson_rows, with_

DRAWS = 20
_KEYS = "test_id, CAST(arm AS VARCHAR), CAST(row_id AS VARCHAR)"
_STATS = ("naive", "corrected", "bias", "bias_sd", "bias_se", "bias_q025", "bias_q50",
          "bias_q975")


def drawn_sql(source, draws, salt, keys=_KEYS, by="test_id", value="y"):
    return (f"SELECT {by}, arm, draw, CAST(sum(w) AS BIGINT) AS n, sum(w * {value}) / sum(w) "
            f"AS effect FROM ({poisson_rows(source, keys, draws, 42, salt)}) "
            f"GROUP BY {by}, arm, draw")


def index_sql(draws, salt, powers=None, source="rows_", value="y"):
    """Exact resampling by hashing slots to positions."""
    slot_keys = "test_id, CAST(arm AS VARCHAR), CAST(pos AS VARCHAR), CAST(draw AS VARCHAR)"
    num = (f"SELECT test_id, arm, {value} AS v, row_number() OVER (PARTITION BY test_id, arm "
           f"ORDER BY row_id) - 1 AS pos, count(*) OVER (PARTITION BY test_id, arm) AS n "
           f"FROM {source}")
    if powers is None:
        grid, keep, key, hashed = "", "", "", slot_keys
    else:
        grid = f", (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in powers)}]) AS power)"
        keep = "WHERE pos < floor(pow(n, power))"
        key = "power, "
        hashed = slot_keys + ", CAST(CAST(power * 1000 AS INTEGER) AS VARCHAR)"
    slots = (f"SELECT test_id, {key}arm, draw, {hash48_sql(hashed, 42, salt)} % n AS pos "
             f"FROM num{grid}, (SELECT CAST(range AS INTEGER) AS draw FROM range({draws})) {keep}")
    return dict(num=num, slots=slots, drawn=f"""
  SELECT s.test_id, {key}s.arm, s.draw, count(*) AS n, avg(v) AS effect
  FROM slots s JOIN num ON s.test_id = num.test_id AND s.arm = num.arm AND s.pos = num.pos
  GROUP BY s.test_id, {key}s.arm, s.draw""")


def bias_sql(scale="1.0::DOUBLE", drawn="drawn", effects="reff", by="test_id", extra=""):
    """draws(by, extra, draw, selected_arm, draw_effect, original, bias)."""
    keys = f"{by}, {extra}draw"
    on = " AND ".join(f"b.{k.strip()} = e.{k.strip()}" for k in by.split(","))
    return f"""
  SELECT {', '.join('b.' + k.strip() for k in keys.split(','))}, b.arm AS selected_arm,
    b.effect AS draw_effect, e.effect AS original, (b.effect - e.effect) * {scale} AS bias
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY effect DESC, arm) AS k,
          count(*) OVER (PARTITION BY {keys}) AS drawn_arms FROM {drawn}) b
  JOIN (SELECT *, count(*) OVER (PARTITION BY {by}) AS n_arms,
          avg(n) OVER (PARTITION BY {by}) AS n_avg FROM {effects}) e ON {on} AND b.arm = e.arm
  WHERE k = 1 AND drawn_arms = n_arms"""


def correct_sql(estimator, draws="found", by="test_id", extra="", pick="rpick"):
    keys = f"{by}{', ' + extra if extra else ''}"
    on = " AND ".join(f"s.{k.strip()} = p.{k.strip()}" for k in by.split(","))
    return f"""
SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, '{estimator}' AS estimator,
  p.arm AS selected_arm, round(p.effect, 6) AS naive,
  round(p.effect - s.bias, 6) AS corrected, round(s.bias, 6) AS bias,
  round(coalesce(sd, 0), 6) AS bias_sd, round(coalesce(sd, 0) / sqrt(c), 6) AS bias_se,
  round(q1, 6) AS bias_q025, round(q2, 6) AS bias_q50, round(q3, 6) AS bias_q975, 'ok' AS status
FROM {pick} p JOIN (
  SELECT {keys}, avg(bias) AS bias, stddev_samp(bias) AS sd, count(*) AS c,
    quantile_cont(bias, 0.025) AS q1, quantile_cont(bias, 0.5) AS q2,
    quantile_cont(bias, 0.975) AS q3 FROM {draws} GROUP BY {keys}) s ON {on}"""


def rows(spark, sf):
    return R.order_rows(spark, sf)


@query("b1_resample_rows", with_("rows_", drawn=drawn_sql("rows_", DRAWS, "std")) + """
SELECT test_id, arm, draw, n, round(effect, 6) AS effect FROM drawn""")
def _(spark, sf):
    return rounded(B.poisson_draws(rows(spark, sf), DRAWS), "effect")


@query("b1b_resample_rows_index", with_("rows_", **index_sql(DRAWS, "std")) + """
SELECT test_id, arm, draw, n, round(effect, 6) AS effect FROM drawn""")
def _(spark, sf):
    data = rows(spark, sf)
    return rounded(B.index_draws(data, B.saved_effects(data), DRAWS, salt="std"), "effect")


@query("b2_resample_counts")
def _(spark, sf):
    return B.count_draws(saved_effects(spark, sf), DRAWS)


@query("b3_bootstrap_bias", with_("rows_", "reff", drawn=drawn_sql("rows_", DRAWS, "std"),
                                  found=bias_sql()) + """
SELECT test_id, draw, selected_arm, round(draw_effect, 6) AS draw_effect,
  round(original, 6) AS original, round(bias, 6) AS bias FROM found""")
def _(spark, sf):
    data = rows(spark, sf)
    found = B.bias_draws(B.poisson_draws(data, DRAWS), E.arm_effects(data))
    return rounded(found, "draw_effect", "original", "bias")


@query("b4_correct_standard", with_("rpick", drawn=drawn_sql("rows_", DRAWS, "std"),
                                    found=bias_sql()) + correct_sql("standard"))
def _(spark, sf):
    return rounded(B.correct_standard(rows(spark, sf), DRAWS), *_STATS)


@query("b4b_correct_standard_counts")
def _(spark, sf):
    return B.correct_counts(saved_effects(spark, sf), 200)


MOON_SCALE = "sqrt(greatest(1, floor(pow(n_avg, {p}))) / n_avg)"


@query("b5_correct_moon", with_("rpick", **index_sql(DRAWS, "moon", [0.6]), found=bias_sql(
    MOON_SCALE.format(p="0.6::DOUBLE"))) + correct_sql("moon"))
def _(spark, sf):
    return rounded(B.correct_moon(rows(spark, sf), DRAWS, 0.6), *_STATS)


@query("b5b_correct_moon_counts")
def _(spark, sf):
    return B.correct_counts(saved_effects(spark, sf), 200, power=0.6)


@query("b6_correct_numerical", with_("rpick", drawn=drawn_sql("rows_", DRAWS, "num"),
                                     found=bias_sql("pow(e.n, -0.45::DOUBLE) * sqrt(e.n::DOUBLE)"))
       + correct_sql("numerical"))
def _(spark, sf):
    return rounded(B.correct_numerical(rows(spark, sf), DRAWS, -0.45), *_STATS)


@query("b7_correct_conditional", with_(
    "rpick", drawn=drawn_sql("rows_", 400, "cond"), all_found=bias_sql(), found="""
  SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY a.test_id ORDER BY draw) AS rk
    FROM all_found a JOIN rpick p ON a.test_id = p.test_id AND a.selected_arm = p.arm)
  WHERE rk <= 20""") + """
SELECT t.*, accepted, attempts, round(accepted / attempts::DOUBLE, 6) AS acceptance_rate FROM (
""" + correct_sql("conditional").replace("'ok' AS status", """
  CASE WHEN c < 20 THEN 'short' ELSE 'ok' END AS status""") + """) t
JOIN (SELECT test_id, count(*) AS accepted,
        CASE WHEN count(*) = 20 THEN max(draw) + 1 ELSE 400 END AS attempts
      FROM found GROUP BY test_id) a ON t.test_id = a.test_id""")
def _(spark, sf):
    out = B.correct_conditional(rows(spark, sf), DRAWS, max_attempts=400)
    return rounded(out, *_STATS, "acceptance_rate")


_POWERS = [0.5, 0.7, 0.9]


@query("b8_moon_power_sweep", with_("rpick", **index_sql(DRAWS, "moon", _POWERS), found=bias_sql(
    MOON_SCALE.format(p="power"), extra="power, ")) + correct_sql("moon", extra="power"))
def _(spark, sf):
    return rounded(B.moon_power_sweep(rows(spark, sf), DRAWS, _POWERS), *_STATS)


_OUTER, _INNER = 4, 8
_LANE = hash_sql("test_id, CAST(outer_ AS VARCHAR), CAST(arm AS VARCHAR), CAST(row_id AS VARCHAR), "
                 "'0', CAST(draw // 4 AS VARCHAR)", 42, "inner")
# a row with weight w in the outer draw has a Poisson(w) weight in the inner ones: the number of
# values of the distribution function, in units of 2^-32, that are not above a 32-bit hash
_NESTED = dict(
    held=f"SELECT test_id, arm, row_id, y, w, draw AS outer_ FROM "
         f"({poisson_rows('rows_', _KEYS, _OUTER, 42, 'outer')})",
    oeff="""SELECT test_id, outer_, arm, sum(w) AS n, sum(w * y) / sum(w) AS effect FROM held
  GROUP BY test_id, outer_, arm""",
    cdf="""
  SELECT w, list(floor(f * 4294967296.0::DOUBLE) ORDER BY k) AS cuts FROM (
    SELECT w, k, sum(exp(-w + k * ln(w::DOUBLE) - lgamma(k + 1.0::DOUBLE)))
      OVER (PARTITION BY w ORDER BY k) AS f
    FROM (SELECT range AS w FROM range(1, 14)), (SELECT range AS k FROM range(60)))
  WHERE f < 1 - pow(2.0::DOUBLE, -32) GROUP BY w""",
    odrawn=f"""
  SELECT test_id, outer_, arm, draw, sum(v) AS n, sum(v * y) / sum(v) AS effect FROM (
    SELECT l.*, len(list_filter(cuts, lambda c: c <= lane)) AS v FROM (
      SELECT *, ('0x' || substr({_LANE}, CAST(1 + 8 * (draw % 4) AS BIGINT), 8))::BIGINT AS lane
      FROM held, (SELECT CAST(range AS INTEGER) AS draw FROM range({_INNER}))) l
    JOIN cdf ON l.w = cdf.w) WHERE v > 0 GROUP BY test_id, outer_, arm, draw""",
    obias=bias_sql(drawn="odrawn", effects="oeff", by="test_id, outer_"),
    inner_bias="SELECT test_id, outer_, avg(bias) AS bias FROM obias GROUP BY test_id, outer_")


@query("b9_correct_double", with_("rpick", **_NESTED)
       + correct_sql("double", draws="inner_bias"))
def _(spark, sf):
    return rounded(B.correct_double(rows(spark, sf), _OUTER, _INNER), *_STATS)


@query("b10_correct_double_hall", with_(
    "rpick", **_NESTED, drawn=drawn_sql("rows_", _INNER, "std"), tbias=bias_sql(), found="""
  SELECT i.test_id, i.outer_, 2 * t.bias - i.bias AS bias FROM inner_bias i
  JOIN (SELECT test_id, avg(bias) AS bias FROM tbias GROUP BY test_id) t
    ON i.test_id = t.test_id""") + correct_sql("double_hall"))
def _(spark, sf):
    return rounded(B.correct_by(rows(spark, sf), "double", _INNER, outer=_OUTER), *_STATS)


@query("b12_custom_bias", with_(
    "rows_", leff="SELECT test_id, arm, count(*) AS n, avg(ln(y)) AS effect FROM rows_ "
    "GROUP BY test_id, arm", drawn=drawn_sql("rows_", DRAWS, "custom", value="ln(y)"),
    found=bias_sql("0.5::DOUBLE", effects="leff"), lpick="""
  SELECT test_id, arm FROM (SELECT *, row_number() OVER (PARTITION BY test_id
    ORDER BY effect DESC, arm) AS k FROM leff) WHERE k = 1""") + """
SELECT f.test_id, draw, selected_arm, round(bias, 8) AS bias FROM found f
JOIN lpick p ON f.test_id = p.test_id AND f.selected_arm = p.arm""")
def _(spark, sf):
    def resample(data):
        return D.with_poisson_weights(data.select("test_id", "arm", "row_id", "y"), DRAWS,
                                      ["test_id", "arm", "row_id"], 42, "custom")

    def log_means(data, keys):
        w = F.col("weight")
        return data.groupBy(*keys, "arm").agg(
            (F.sum(w * F.log("y")) / F.sum(w)).alias("effect"))
    out = B.custom_bias(rows(spark, sf), resample, log_means,
                        bias=(F.col("draw_effect") - F.col("original")) * 0.5,
                        accept=F.col("selected_arm") == F.col("original_arm"))
    return rounded(out.select("test_id", "draw", "selected_arm", "bias"), "bias", digits=8)


@query("b13_bias_stats", with_("rows_", "reff", drawn=drawn_sql("rows_", DRAWS, "std"),
                               found=bias_sql()) + """
SELECT test_id, count(*) AS draws, round(avg(bias), 6) AS bias,
  round(stddev_samp(bias), 6) AS bias_sd, round(stddev_samp(bias) / sqrt(count(*)), 6) AS bias_se,
  round(quantile_cont(bias, 0.025), 6) AS bias_q025, round(quantile_cont(bias, 0.5), 6) AS bias_q50,
  round(quantile_cont(bias, 0.975), 6) AS bias_q975 FROM found GROUP BY test_id""")
def _(spark, sf):
    data = rows(spark, sf)
    found = B.bias_draws(B.poisson_draws(data, DRAWS), B.saved_effects(data))
    return rounded(B.bias_stats(found), *_STATS[2:])


@query("b14_winner_agreement", with_("rpick", drawn=drawn_sql("rows_", DRAWS, "std"),
                                     found=bias_sql()) + """
SELECT f.test_id, count(*) AS draws,
  round(avg(CASE WHEN f.selected_arm = p.arm THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement
FROM found f JOIN rpick p ON f.test_id = p.test_id GROUP BY f.test_id""")
def _(spark, sf):
    data = rows(spark, sf)
    effects = B.saved_effects(data)
    found = B.bias_draws(B.poisson_draws(data, DRAWS), effects)
    return rounded(B.winner_agreement(found, effects), "agreement")


_M_POWERS = [0.5, 0.65, 0.8, 0.95]


@query("b15_choose_m", with_(
    "reff", **index_sql(DRAWS, "moon", _M_POWERS),
    found=bias_sql(MOON_SCALE.format(p="power"), extra="power, "),
    keyed="SELECT *, dense_rank() OVER (ORDER BY power) - 1 AS m FROM found",
    sides="""SELECT test_id, m AS pair, bias, 1 AS a FROM keyed WHERE m < 3 UNION ALL
  SELECT test_id, m - 1, bias, 0 FROM keyed WHERE m > 0""",
    gaps="""
  SELECT test_id, pair, max(abs(fa - fb)) AS ks FROM (
    SELECT test_id, pair, bias,
      sum(a) OVER w / sum(a) OVER (PARTITION BY test_id, pair) AS fa,
      sum(1 - a) OVER w / sum(1 - a) OVER (PARTITION BY test_id, pair) AS fb
    FROM sides WINDOW w AS (PARTITION BY test_id, pair ORDER BY bias
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY test_id, pair""") + f"""
SELECT test_id, CAST(pair AS INTEGER) AS m_index,
  ({_M_POWERS}::DOUBLE[])[CAST(pair + 1 AS BIGINT)] AS power, round(ks, 6) AS ks FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(ks, 9), pair) AS k FROM gaps)
WHERE k = 1""")
def _(spark, sf):
    data = rows(spark, sf)
    effects = B.saved_effects(data)
    drawn = B.index_draws(data, effects, DRAWS, powers=_M_POWERS)
    found = B.bias_draws(drawn, effects, scale=B.moon_scale(F.col("power")),
                         draw_keys=["power"])
    return rounded(B.choose_m(found, _M_POWERS), "ks")
