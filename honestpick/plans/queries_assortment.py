"""Choice-data queries."""

from pyspark.sql import functions as F

from honestpick.functions import draws as D
from honestpick.operators import assortment as A
from honestpick.plans import roles as R
from honestpick.plans.catalog import query, r, rounded
from honestpick.plans.sqltext import hash48_sql, hash_sql, poisson_rows, with_

PRODUCTS = ["click", "error", "purchase", "signup"]
N, DRAWS, CAPS = len(PRODUCTS), 10, [1, 2]
_LIST = "(SELECT unnest(['click','error','purchase','signup']) AS product, unnest([0,1,2,3]) AS position)"


def counts_sql(source="choices", keys="market", weight="1"):
    return f"""
  SELECT {', '.join('k.' + x.strip() for x in keys.split(','))}, p.product, p.position,
    CAST(coalesce(sum(CASE WHEN c.product = p.product THEN {weight} END), 0) AS BIGINT) AS n,
    CAST(coalesce(sum(CASE WHEN c.product = 'outside' THEN {weight} END), 0) AS BIGINT) AS n_outside
  FROM (SELECT DISTINCT {keys} FROM {source}) k, {_LIST} p JOIN {source} c ON
    {' AND '.join(f'c.{x.strip()} = k.{x.strip()}' for x in keys.split(','))}
  GROUP BY ALL"""


def v_sql(counts):
    return (f"SELECT *, CASE WHEN n > 0 AND n_outside > 0 THEN ln(n::DOUBLE / n_outside) END AS v "
            f"FROM {counts}")


_V = dict(cnt=counts_sql(), fx=v_sql("cnt"))


def _choices(spark, sf):
    return R.choices(spark, sf)


def _effects(spark, sf):
    return A.mnl_fixed_effects(A.choice_counts(_choices(spark, sf), PRODUCTS))


@query("m1_choice_counts", with_("choices", **_V) +
       "SELECT market, product, CAST(position AS INTEGER) AS position, n, n_outside FROM cnt")
def _(spark, sf):
    return A.choice_counts(_choices(spark, sf), PRODUCTS)


@query("m2_mnl_fixed_effects", with_("choices", **_V) +
       "SELECT market, product, n, n_outside, round(v, 8) AS v FROM fx")
def _(spark, sf):
    return rounded(_effects(spark, sf).drop("position"), "v", digits=8)


@query("m3_mnl_loglik", with_("choices", **_V) + """
SELECT market, round(sum(coalesce(n * v, 0)) - (sum(n) + min(n_outside))
  * ln(1 + sum(coalesce(exp(v), 0))), 6) AS loglik FROM fx GROUP BY market""")
def _(spark, sf):
    return rounded(A.mnl_loglik(_effects(spark, sf)), "loglik")


@query("m4_purchase_probs", with_("choices", **_V) + """
SELECT market, product, round(w / (1 + sum(w) OVER (PARTITION BY market)), 8) AS prob FROM (
  SELECT *, CASE WHEN product <> 'error' THEN coalesce(exp(v), 0) ELSE 0 END AS w FROM fx)""")
def _(spark, sf):
    p = A.purchase_probs(_effects(spark, sf), F.col("product") != "error")
    return p.select("market", "product", r("prob", 8).alias("prob"))


_SETS = dict(sets="""
  SELECT CAST(range AS BIGINT) AS mask FROM range(16) WHERE bit_count(CAST(range AS BIGINT)) <= 2""",
             sv="""
  SELECT market, mask, s / (1 + s) AS value FROM (
    SELECT market, mask, sum(CASE WHEN (mask >> CAST(position AS BIGINT)) & 1 = 1
      THEN coalesce(exp(v), 0) ELSE 0 END) AS s FROM fx, sets GROUP BY market, mask)""")


@query("m5_assortments", with_("choices", **_V, sets=_SETS["sets"]) + """
SELECT DISTINCT market, mask FROM choices, sets""")
def _(spark, sf):
    markets = _choices(spark, sf).select("market").distinct()
    return A.assortments(markets, N, 2)


@query("m6_assortment_values", with_("choices", **_V, **_SETS) +
       "SELECT market, mask, round(value, 8) AS value FROM sv")
def _(spark, sf):
    w = A.market_weights(_effects(spark, sf))
    return rounded(A.assortment_values(w, N, 2).drop("weights"), "value", digits=8)


@query("m7_best_assortment", with_("choices", **_V, rk="""
  SELECT *, row_number() OVER (PARTITION BY market ORDER BY v DESC, position DESC) AS k FROM fx
  WHERE v IS NOT NULL""") + """
SELECT market, list_sort(list(product)) AS members, round(sum(exp(v)) / (1 + sum(exp(v))), 8) AS value
FROM rk WHERE k <= 2 GROUP BY market""")
def _(spark, sf):
    return rounded(A.best_assortment(_effects(spark, sf), 2), "value", digits=8)


_PKEY = "CAST(market AS VARCHAR), CAST(row_id AS VARCHAR)"


def _boot_v(salt):
    return dict(pw=poisson_rows("choices", _PKEY, DRAWS, 42, salt),
                dcnt=counts_sql("pw", "market, draw", "w"), dfx=v_sql("dcnt"))


@query("m8_posterior_assortment", with_("choices", **_V, **_boot_v("posterior"), sets=_SETS["sets"],
                                        dv="""
  SELECT market, draw, mask, s / (1 + s) AS value FROM (
    SELECT market, draw, mask, sum(CASE WHEN (mask >> CAST(position AS BIGINT)) & 1 = 1
      THEN coalesce(exp(v), 0) ELSE 0 END) AS s FROM dfx, sets GROUP BY market, draw, mask)""",
                                        mv="""
  SELECT market, mask, avg(value) AS value, (mask & 1) * 8 + ((mask >> 1) & 1) * 4
    + ((mask >> 2) & 1) * 2 + ((mask >> 3) & 1) AS ord FROM dv GROUP BY market, mask""") + """
SELECT market, mask, round(value, 8) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY market ORDER BY round(value, 12) DESC, ord) AS k FROM mv)
WHERE k = 1""")
def _(spark, sf):
    rows = _choices(spark, sf)
    drawn = D.with_poisson_weights(rows, DRAWS, ["market", "row_id"], 42, "posterior")
    posterior = A.mnl_fixed_effects(A.choice_counts(drawn, PRODUCTS, ["market", "draw"], "weight"))
    return rounded(A.posterior_assortment(posterior, N, 2), "value", digits=8)


def _correct_sql(method, drawn, new="d._new", scale="1"):
    return with_("choices", **_V, tot="""
  SELECT market, count(*) AS n_market FROM choices GROUP BY market""", **drawn, caps="""
  SELECT unnest([1, 2]) AS capacity""", dtop="""
  SELECT market, draw, capacity, position, v AS _new FROM (
    SELECT *, row_number() OVER (PARTITION BY market, draw ORDER BY v DESC, position DESC) AS k
    FROM dfx WHERE v IS NOT NULL), caps WHERE k <= capacity""", bias=f"""
  SELECT market, draw, capacity, (sn / (1 + sn) - so / (1 + so)) * {scale} AS bias FROM (
    SELECT d.market, d.draw, d.capacity, n_market, sum(exp({new})) AS sn, sum(exp(fx.v)) AS so
    FROM dtop d JOIN fx ON d.market = fx.market AND d.position = fx.position
    JOIN tot ON tot.market = d.market GROUP BY ALL)""", top="""
  SELECT market, capacity, sum(exp(v)) / (1 + sum(exp(v))) AS naive FROM (
    SELECT *, row_number() OVER (PARTITION BY market ORDER BY v DESC, position DESC) AS k
    FROM fx WHERE v IS NOT NULL), caps WHERE k <= capacity GROUP BY market, capacity""") + f"""
SELECT t.market, t.capacity, '{method}' AS estimator, round(naive, 8) AS naive,
  round(naive - b, 8) AS corrected, round(b, 8) AS bias FROM top t JOIN (
  SELECT market, capacity, avg(bias) AS b FROM bias GROUP BY market, capacity) USING (market, capacity)"""


_COLS = ("naive", "corrected", "bias")


@query("m9_assortment_correct_standard", _correct_sql("standard", _boot_v("choice-standard")))
def _(spark, sf):
    return rounded(A.assortment_correct(_choices(spark, sf), PRODUCTS, CAPS, DRAWS), *_COLS,
                   digits=8)


_MOON = dict(cnum="""
  SELECT market, product, row_number() OVER (PARTITION BY market ORDER BY row_id) - 1 AS pos,
    count(*) OVER (PARTITION BY market) AS n FROM choices""", cslot=f"""
  SELECT market, draw, {hash48_sql("CAST(market AS VARCHAR), CAST(pos AS VARCHAR), CAST(draw AS VARCHAR), '800'",
                                   42, "choice-moon")} % n AS pos
  FROM cnum, (SELECT CAST(range AS INTEGER) AS draw FROM range({DRAWS}))
  WHERE pos < floor(pow(n, 0.8::DOUBLE))""", pw="""
  SELECT s.market, s.draw, product FROM cslot s JOIN cnum c ON s.market = c.market
    AND s.pos = c.pos""", dcnt=counts_sql("pw", "market, draw"), dfx=v_sql("dcnt"))


@query("m9b_assortment_correct_moon", _correct_sql(
    "moon", _MOON, scale="sqrt(floor(pow(n_market, 0.8::DOUBLE)) / n_market)"))
def _(spark, sf):
    return rounded(A.assortment_correct(_choices(spark, sf), PRODUCTS, CAPS, DRAWS, "moon", 0.8),
                   *_COLS, digits=8)


@query("m9c_assortment_correct_numerical", _correct_sql(
    "numerical", _boot_v("choice-numerical"),
    new="fx.v + pow(n_market, -0.4::DOUBLE) * sqrt(n_market::DOUBLE) * (d._new - fx.v)"))
def _(spark, sf):
    return rounded(A.assortment_correct(_choices(spark, sf), PRODUCTS, CAPS, DRAWS, "numerical",
                                        -0.4), *_COLS, digits=8)


_H = hash_sql("CAST(row_id AS VARCHAR), CAST(split_id AS VARCHAR)", 42, "choice-split")


@query("m10_assortment_split", with_("choices", parts=f"""
  SELECT *, rk <= floor(n * 0.5::DOUBLE) AS in_est FROM (
    SELECT *, row_number() OVER (PARTITION BY market, split_id ORDER BY h, row_id) AS rk,
      count(*) OVER (PARTITION BY market, split_id) AS n FROM (
      SELECT *, {_H} AS h FROM choices, (SELECT CAST(range AS INTEGER) AS split_id FROM range(4))))""",
                                     pc=counts_sql("parts", "market, split_id, in_est"),
                                     pf=v_sql("pc"), caps="SELECT unnest([1, 2]) AS capacity", top="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market, split_id
      ORDER BY v DESC, position DESC) AS k FROM pf WHERE in_est AND v IS NOT NULL), caps
  WHERE k <= capacity""", every="""
  SELECT * FROM (SELECT DISTINCT market FROM choices),
    (SELECT CAST(range AS INTEGER) AS split_id FROM range(4)), caps""") + """
SELECT market, split_id, capacity, round(se / (1 + se), 8) AS est_value,
  round(sv / (1 + sv), 8) AS corrected FROM every LEFT JOIN (
  SELECT t.market, t.split_id, t.capacity, sum(exp(t.v)) AS se, sum(coalesce(exp(e.v), 0)) AS sv
  FROM top t JOIN pf e ON t.market = e.market AND t.split_id = e.split_id
    AND t.position = e.position AND NOT e.in_est GROUP BY ALL) USING (market, split_id, capacity)""")
def _(spark, sf):
    out = A.assortment_split(_choices(spark, sf), PRODUCTS, CAPS, splits=4)
    return rounded(out, "est_value", "corrected", digits=8)
