"""SQL building blocks: the roles of plans/roles.py as common table expressions."""

from honestpick.functions.draws import hex_threshold, poisson_thresholds

_TRUE = "('true','1','yes','y','t')"

CTES = {
    "raw_arms": """
  SELECT p_brand AS test_id,
    CASE WHEN right(p_brand,1) IN ('1','2','3') THEN 'exploratory'
         WHEN right(p_brand,1) IN ('4','5','6') THEN 'confirmatory' ELSE 'holdout' END AS split,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS source_row_id,
    count(*) AS impressions,
    count(*) FILTER (WHERE l_returnflag = 'R') AS clicks,
    CASE WHEN count(*) % 3 = 0 THEN 'T' END AS first_place,
    CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') % 2 = 0 THEN ' Yes ' ELSE 'no' END
      AS winner,
    min(l_shipdate) AS created_at
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type""",
    "arms": f"""
  SELECT test_id, split, source_row_id, impressions, clicks,
    clicks::DOUBLE / impressions AS rate,
    coalesce(lower(trim(first_place)) IN {_TRUE}, false) AS first_place,
    coalesce(lower(trim(winner)) IN {_TRUE}, false) AS winner,
    CAST(row_number() OVER (PARTITION BY test_id ORDER BY source_row_id) - 1 AS INTEGER)
      AS arm_ordinal,
    created_at
  FROM raw_arms""",
    "many": """
  SELECT test_id, 'all' AS split, arm + 1 AS source_row_id, count(*) AS impressions,
    CAST(sum(click) AS BIGINT) AS clicks, CAST(sum(click) AS DOUBLE) / count(*) AS rate,
    false AS first_place, false AS winner,
    CAST(row_number() OVER (PARTITION BY test_id ORDER BY arm) - 1 AS INTEGER) AS arm_ordinal,
    min(o_orderdate) AS created_at
  FROM rows_ GROUP BY test_id, arm""",
    "effects": """
  SELECT test_id, arm_ordinal AS arm, source_row_id, impressions AS n, rate AS effect,
    rate * (1 - rate) / impressions AS var FROM arms""",
    "rows_": """
  SELECT concat_ws('-', c_mktsegment, CAST(year(o_orderdate) AS VARCHAR)) AS test_id,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS arm, o_orderkey AS row_id,
    o_totalprice / 1370.0::DOUBLE AS y,
    CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS click,
    o_orderstatus AS status, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "pair_rows": """
  SELECT test_id, CASE WHEN arm < 2 THEN 0 ELSE 1 END AS arm, row_id, y, click FROM rows_""",
    "prows": """
  SELECT 'orders' AS test_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS arm,
    o_orderkey AS row_id,
    CASE WHEN o_orderstatus <> 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS visit,
    CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS conversion,
    o_totalprice / 1370.0::DOUBLE AS spend
  FROM orders""",
    "train": """
  SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR,
      l_suppkey::VARCHAR, l_returnflag,
      CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS row_id,
    p_size / 10.0::DOUBLE AS x,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS t,
    l_extendedprice / 10000.0::DOUBLE AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "target": "SELECT p_partkey AS customer_id, p_size / 10.0::DOUBLE AS x FROM part",
    "choices": """
  SELECT user_id AS market, event_id AS row_id,
    CASE WHEN event_type = 'view' THEN 'outside' ELSE event_type END AS product FROM events""",
    "reff": """
  SELECT test_id, arm, count(y) AS n, avg(y) AS effect, var_pop(y) / count(y) AS var
  FROM rows_ GROUP BY test_id, arm""",
    "rpick": """
  SELECT test_id, arm, effect FROM (
    SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY effect DESC, arm) AS k FROM reff)
  WHERE k = 1""",
    "pick": """
  SELECT test_id, arm, effect, var, n FROM (
    SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY effect DESC, source_row_id) AS k
    FROM effects) WHERE k = 1""",
    "per_test": """
  SELECT test_id, min(split) AS split, count(*) AS n_arms,
    CAST(sum(impressions) AS BIGINT) AS total_impressions,
    CAST(sum(clicks) AS BIGINT) AS total_clicks,
    min(impressions) AS min_arm_impressions, max(impressions) AS max_arm_impressions,
    sum(clicks)::DOUBLE / sum(impressions) AS pooled_rate,
    min(created_at) AS created_at
  FROM arms GROUP BY test_id""",
    "ranked": """
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY rate DESC, source_row_id) AS k,
    sqrt(clicks::DOUBLE * (impressions - clicks)
         / (impressions::DOUBLE * (impressions - 1))) AS click_sd,
    sqrt(clicks::DOUBLE * (impressions - clicks)
         / (impressions::DOUBLE * (impressions - 1))) / sqrt(impressions::DOUBLE) AS click_se
  FROM arms""",
    "two": """
  SELECT test_id, max(CASE WHEN k = 1 THEN rate END) AS rate_1,
    max(CASE WHEN k = 2 THEN rate END) AS rate_2,
    max(CASE WHEN k = 1 THEN click_sd END) AS sd_1,
    max(CASE WHEN k = 2 THEN click_sd END) AS sd_2,
    max(CASE WHEN k = 1 THEN click_se END) AS se_1,
    max(CASE WHEN k = 2 THEN click_se END) AS se_2,
    max(CASE WHEN k = 1 THEN impressions END) AS n_1,
    max(CASE WHEN k = 2 THEN impressions END) AS n_2,
    max(CASE WHEN k = 1 THEN clicks END) AS clicks_1,
    max(CASE WHEN k = 2 THEN clicks END) AS clicks_2,
    max(CASE WHEN k = 1 THEN source_row_id END) AS id_1,
    max(CASE WHEN k = 2 THEN source_row_id END) AS id_2
  FROM ranked WHERE k <= 2 GROUP BY test_id""",
    "records": """
  SELECT p.test_id, p.split, p.n_arms, p.total_impressions, p.total_clicks,
    p.min_arm_impressions, p.max_arm_impressions, p.pooled_rate, p.created_at,
    a.arm_ordinal AS selected_arm, a.source_row_id AS selected_source_row_id,
    a.impressions AS selected_impressions, a.clicks AS selected_clicks, a.rate AS naive,
    a.winner AS selected_winner, a.first_place AS selected_first_place,
    t.rate_2 AS runner_up, a.rate - t.rate_2 AS gap,
    (SELECT count(*) FROM arms b WHERE b.test_id = p.test_id AND b.rate = a.rate) AS ties
  FROM per_test p JOIN ranked a ON a.test_id = p.test_id AND a.k = 1
  JOIN two t ON t.test_id = p.test_id""",
    "eb": """
  SELECT test_id, arm, effect, shrink * effect + (1 - shrink) * prior_mean AS post,
    prior_mean, prior_var FROM (
    SELECT *, CASE WHEN prior_var + var > 0 THEN prior_var / (prior_var + var) ELSE 0 END
      AS shrink FROM (
      SELECT *, avg(effect) OVER (PARTITION BY test_id) AS prior_mean,
        var_pop(effect) OVER (PARTITION BY test_id) AS prior_var FROM effects))""",
    # per-test records with the EB-normal correction, the report section's input
    "est": """
  SELECT r.*, e.post AS eb_corrected, r.naive - e.post AS eb_bias,
    CASE WHEN r.naive <> 0 THEN (r.naive - e.post) / r.naive END AS eb_pct
  FROM records r JOIN eb e ON e.test_id = r.test_id AND e.arm = r.selected_arm""",
}

_NEEDS = {"arms": ["raw_arms"], "many": ["rows_"], "effects": ["arms"],
          "pair_rows": ["rows_"], "reff": ["rows_"], "rpick": ["reff"], "pick": ["effects"],
          "per_test": ["arms"], "ranked": ["arms"], "two": ["ranked"],
          "records": ["per_test", "ranked", "two"], "eb": ["effects"],
          "est": ["records", "eb"]}


SUPPLIER_ARMS = """
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS test_id,
    CASE WHEN l_suppkey % 10 < 4 THEN 'exploratory' WHEN l_suppkey % 10 < 7 THEN 'confirmatory'
         ELSE 'holdout' END AS split,
    least(CAST(l_linenumber AS BIGINT), 2 + l_suppkey % 6) AS source_row_id,
    count(*) AS impressions, count(*) FILTER (WHERE l_returnflag = 'R') AS clicks,
    CASE WHEN count(*) % 3 = 0 THEN 'T' END AS first_place,
    CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') % 2 = 0 THEN ' Yes ' ELSE 'no' END
      AS winner,
    min(l_shipdate) AS created_at
  FROM lineitem GROUP BY l_suppkey, least(CAST(l_linenumber AS BIGINT), 2 + l_suppkey % 6)"""


def with_(*names: str, raw: str | None = None, **own: str) -> str:
    """WITH clause: the named blocks and what they need, then own blocks in order.

    `raw` replaces the arm table all arm-level blocks start from.
    """
    out: list[str] = []

    def add(name):
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in out:
            out.append(name)

    for n in names:
        add(n)
    text = {**CTES, **({"raw_arms": raw} if raw else {})}
    parts = [f"{n} AS ({text[n]})" for n in out] + [f"{k} AS ({v})" for k, v in own.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def hash_sql(keys: str, seed: int, salt: str) -> str:
    return f"md5(concat_ws('|', {keys}, '{seed}', '{salt}'))"


def hash48_sql(keys: str, seed: int, salt: str) -> str:
    return f"('0x' || substr({hash_sql(keys, seed, salt)}, 1, 12))::BIGINT"


def uniform_sql(keys: str, seed: int, salt: str) -> str:
    return f"(({hash48_sql(keys, seed, salt)})::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"


def normal_sql(keys: str, seed: int, salt: str) -> str:
    u1, u2 = uniform_sql(keys, seed, salt + "-r"), uniform_sql(keys, seed, salt + "-a")
    return f"sqrt(-2.0::DOUBLE * ln({u1})) * cos(2.0::DOUBLE * pi() * ({u2}))"


def weight_case(lane: str) -> str:
    whens = " ".join(f"WHEN {lane} < '{hex_threshold(t)}' THEN {k}"
                     for k, t in enumerate(poisson_thresholds()))
    return f"CASE {whens} ELSE {len(poisson_thresholds())} END"


def poisson_rows(source: str, keys: str, draws: int, seed: int, salt: str) -> str:
    """SELECT of every source row per draw with its weight w >= 1."""
    lane = (f"substr({hash_sql(keys + ', CAST(draw // 4 AS VARCHAR)', seed, salt)}, "
            "CAST(1 + 8 * (draw % 4) AS BIGINT), 8)")
    return (f"SELECT * FROM (SELECT *, {weight_case('lane')} AS w FROM (SELECT *, {lane} AS lane "
            f"FROM {source}, (SELECT CAST(range AS INTEGER) AS draw FROM range({draws})))) "
            "WHERE w > 0")


def rate_rows(source: str, keys: str, draws: int, seed: int, salt: str, rate: str) -> str:
    """The same with Poisson(rate) weights v: a weight is the number of values of the
    distribution function, in units of 2^-32, that are not above a 32-bit hash."""
    lane = (f"('0x' || substr({hash_sql(keys + ", '0', CAST(tree // 4 AS VARCHAR)", seed, salt)}, "
            "CAST(1 + 8 * (tree % 4) AS BIGINT), 8))::BIGINT")
    return f"""
  SELECT l.*, len(list_filter(cuts, lambda c: c <= lane_)) AS v FROM (
    SELECT *, {lane} AS lane_
    FROM {source}, (SELECT CAST(range AS INTEGER) AS tree FROM range({draws}))) l
  JOIN (SELECT rate, list(floor(f * 4294967296.0::DOUBLE) ORDER BY k) AS cuts FROM (
    SELECT rate, k, sum(exp(-rate + k * ln(rate::DOUBLE) - lgamma(k + 1.0::DOUBLE)))
      OVER (PARTITION BY rate ORDER BY k) AS f
    FROM (SELECT range AS rate FROM range(1, 14)), (SELECT range AS k FROM range(60)))
    WHERE f < 1 - pow(2.0::DOUBLE, -32) GROUP BY rate) cdf ON l.{rate} = cdf.rate
  WHERE len(list_filter(cuts, lambda c: c <= lane_)) > 0"""


def forest_sql(name: str, rows: str, keys: str, depth: int, weight: str) -> dict[str, str]:
    """Trees on one feature x: CTEs <name>s (keys, node, cut) and <name>v (keys, node, value).

    `rows` is a SELECT with the keys (t and tree among them), x, y and the weight.
    """
    ctes = {f"{name}n0": f"SELECT {keys}, x, y, {weight} AS w, 0 AS node FROM ({rows})"}
    for level in range(depth):
        ctes[f"{name}b{level}"] = f"""
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys}, node ORDER BY gain DESC, x) AS k FROM (
      SELECT *, CASE WHEN nl < nn THEN round(sl * sl / nl + (ss - sl) * (ss - sl) / (nn - nl)
        - ss * ss / nn, 9) ELSE -1 END AS gain FROM (
        SELECT {keys}, node, x, sum(n) OVER run AS nl, sum(s) OVER run AS sl,
          sum(n) OVER whole AS nn, sum(s) OVER whole AS ss FROM (
          SELECT {keys}, node, x, sum(w)::DOUBLE AS n, sum(w * y) AS s FROM {name}n{level}
          GROUP BY {keys}, node, x)
        WINDOW whole AS (PARTITION BY {keys}, node), run AS (PARTITION BY {keys}, node ORDER BY x))))
  WHERE k = 1 AND gain > 0"""
        on = " AND ".join(f"n.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
        ctes[f"{name}n{level + 1}"] = f"""
  SELECT n.* EXCLUDE (node), 2 * n.node + 1 + CASE WHEN n.x > b.x THEN 1 ELSE 0 END AS node
  FROM {name}n{level} n JOIN {name}b{level} b ON {on} AND n.node = b.node"""
    ctes[f"{name}s"] = " UNION ALL ".join(f"SELECT {keys}, node, x AS cut FROM {name}b{level}"
                                          for level in range(depth))
    ctes[f"{name}v"] = " UNION ALL ".join(
        f"SELECT {keys}, node, sum(w * y) / sum(w) AS value FROM {name}n{level} "
        f"GROUP BY {keys}, node" for level in range(depth + 1))
    return ctes


def forest_values(name: str, keys: str, depth: int, target: str, columns: str) -> dict[str, str]:
    """CTE <name>e: (keys without tree, columns of the target rows, value e)."""
    each = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"p.{k} = q.{k}" for k in each)
    ctes = {f"{name}p0": f"SELECT *, 0 AS node FROM (SELECT {columns} FROM {target}), "
                         f"(SELECT DISTINCT {keys} FROM {name}v)"}
    for level in range(depth):
        ctes[f"{name}p{level + 1}"] = f"""
  SELECT p.* EXCLUDE (node), CASE WHEN q.cut IS NULL THEN p.node
    ELSE 2 * p.node + 1 + CASE WHEN x > q.cut THEN 1 ELSE 0 END END AS node
  FROM {name}p{level} p LEFT JOIN {name}s q ON {on} AND p.node = q.node"""
    rest = ", ".join(f"p.{k}" for k in each if k != "tree")
    cols = ", ".join(f"p.{c.strip()}" for c in columns.split(","))
    ctes[f"{name}e"] = f"""
  SELECT {rest}, {cols}, avg(value) AS e FROM {name}p{depth} p JOIN {name}v q
    ON {on} AND p.node = q.node GROUP BY {rest}, {cols}"""
    return ctes
