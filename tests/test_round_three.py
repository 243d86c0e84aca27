"""Quota splits, nested bootstrap weights, level-wise forests, policy hooks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from honestpick.functions import draws as D
from honestpick.operators import bootstrap as B, splits as V, targeting as T
from honestpick.operators.forests import ForestSettings, candidate_cuts, grow_forests


def test_quota_by_prefix_counts(spark):
    """Strata of 0 to 900 rows, a NULL stratum, any number of digits: the smallest hashes win."""
    rows = [(k, (k or 9) * 10_000 + i) for k, n in ((1, 1), (2, 3), (3, 900), (None, 40))
            for i in range(n)]
    df = spark.createDataFrame(rows, "g int, row_id bigint").repartition(3)
    hashed = D.with_draws(df, 4, "split_id").withColumn("h", D.hash_hex(["row_id", "split_id"], 42,
                                                                        "split"))
    want = set()
    by = {}
    for r in hashed.collect():
        by.setdefault((r.g, r.split_id), []).append((r.h, r.row_id))
    for (_, s), members in by.items():
        want |= {(i, s) for _, i in sorted(members)[:math.floor(len(members) * 0.35)]}
    for digits in (None, 1, 3):
        got = V.split_rows(df, 0.35, 4, ["g"], hash_digits=digits)
        assert {(r.row_id, r.split_id) for r in got.where("in_est").collect()} == want
        assert got.count() == 4 * len(rows)
    whole = V.split_rows(df, 0.5, 2, []).groupBy("split_id").agg(F.count_if("in_est").alias("m"))
    assert {r.m for r in whole.collect()} == {len(rows) // 2}
    assert V.split_rows(df.where("false"), 0.5, 2, ["g"]).count() == 0


def test_split_moves_only_boundary_rows(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("row_id"))
    cuts = V.split_cuts(rows, 0.5, 3, ["g"])
    assert cuts.count() == 2
    plan = V.split_rows(rows, 0.5, 3, ["g"], cuts=cuts)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("fast", [False, True])
@pytest.mark.parametrize("rate", [1, 3, 12, 40])
def test_whole_rate_weights(spark, fast, rate):
    rows = spark.range(2_000).select(F.col("id"), F.lit(rate).alias("r"))
    got = D.with_rate_weights(rows, "r", 4, ["id"], 5, "x", fast).groupBy("id", "draw").agg(
        F.sum("weight").alias("w")).toPandas()
    w = np.zeros(8_000)
    w[:len(got)] = got.w
    assert abs(w.mean() - rate) < 5 * math.sqrt(rate / 8_000)
    assert abs(w.var() - rate) < 0.1 * rate
    if rate < 5:
        zero = (w == 0).mean()
        assert abs(zero - math.exp(-rate)) < 5 * math.sqrt(math.exp(-rate) / 8_000)


def test_rate_one_table_is_poisson_one():
    assert D.poisson_thresholds(rate=1) == D.poisson_thresholds()
    assert D.MAX_RATE == len(D.poisson_thresholds())


def test_nested_draws_in_numpy(spark, noisy_rows):
    effects, drawn = B.nested_draws(noisy_rows, 3, 5)
    y = {r.row_id: r.y for r in noisy_rows.collect()}
    held = D.with_poisson_weights(noisy_rows, 3, ["test_id", "arm", "row_id"], 42, "outer",
                                  draw="outer").collect()
    for e in effects.collect():
        mine = [(r.weight, y[r.row_id]) for r in held if (r.outer, r.arm) == (e.outer, e.arm)]
        assert e.n == sum(w for w, _ in mine)
        assert e.effect == pytest.approx(sum(w * v for w, v in mine) / e.n)
    n = drawn.groupBy().agg(F.sum("n")).first()[0]
    total = 5 * sum(r.weight for r in held)
    assert abs(n - total) < 5 * math.sqrt(total)


# forests -------------------------------------------------------------------------------------
def best_cut(x, y, w):
    """The exact least-squares cut of weighted rows."""
    found = []
    for c in sorted(set(x))[:-1]:
        low = x <= c
        found.append((round(sum((w[m] * y[m]).sum() ** 2 / w[m].sum() for m in (low, ~low))
                            - (w * y).sum() ** 2 / w.sum(), 9), -c))
    return max(found) if found else (0.0, None)


def grow(x, y, w, depth):
    gain, cut = best_cut(x[w > 0], y[w > 0], w[w > 0])
    if depth == 0 or cut is None or gain <= 0:
        value = (w * y).sum() / w.sum()
        return lambda v: value
    low = x <= -cut
    a, b = (grow(x[m], y[m], w[m], depth - 1) for m in (low, ~low))
    return lambda v: a(v) if v <= -cut else b(v)


@pytest.fixture(scope="module")
def forest_data(spark):
    rng = np.random.default_rng(8)
    x, t = rng.integers(0, 12, 400) / 4, rng.integers(1, 3, 400)
    y = np.where(x > 1.4, t, 0) + rng.normal(0, 0.3, 400)
    df = spark.createDataFrame([(i, float(a), int(b), float(c)) for i, (a, b, c) in enumerate(
        zip(x, t, y, strict=True))], "row_id bigint, x double, t int, y double")
    return df, x, t, y


def test_exact_cuts_of_one_feature(spark, forest_data):
    df, x, t, y = forest_data
    weights = D.with_poisson_weights(df, 3, ["row_id"], 42, "forest", draw="tree").collect()
    out = T.fit_forest_effects(df, df, ["x"], 2, control=None, depth=3, trees=3).collect()
    for k in (1, 2):
        trees = []
        for tree in range(3):
            w = np.zeros(len(x))
            for r in weights:
                if r.tree == tree:
                    w[r.row_id] = r.weight
            m = t == k
            trees.append(grow(x[m], y[m], w[m], 3))
        for r in out:
            assert r.effects[k - 1] == pytest.approx(np.mean([f(r.x) for f in trees]), abs=1e-9)


def test_many_forests_and_features(spark, forest_data):
    """Forests of several groups are those of each group alone; a useless feature is not cut."""
    df, *_ = forest_data
    rows = df.withColumn("z", F.lit(1.0)).withColumn("y", F.when(F.col("row_id") % 50 > 0, F.col("y")))
    both = D.with_draws(rows, 2, "g").withColumn("y", F.col("y") * (1 + F.col("g")))
    s = ForestSettings(depth=2, trees=2)
    grown = {(r.g, r.t, r.tree): r.nodes for r in grow_forests(both, ["z", "x"], ["g"],
                                                             settings=s).collect()}
    assert len(grown) == 2 * 2 * 2 and all(len(n) == 7 for n in grown.values())
    assert all(n.f in (None, 1) for nodes in grown.values() for n in nodes)
    alone = grow_forests(both.where("g = 1"), ["z", "x"], ["g"], settings=s).collect()
    for r in alone:
        assert [(n.f, n.cut) for n in r.nodes] == [(n.f, n.cut) for n in grown[1, r.t, r.tree]]
    stump = grow_forests(rows, ["x"], settings=ForestSettings(depth=0, trees=1)).collect()
    assert all(len(r.nodes) == 1 and r.nodes[0].f is None for r in stump)
    tried = grow_forests(rows, ["z", "x"], settings=ForestSettings(
        depth=2, trees=4, features_per_node=1)).collect()
    assert {n.f for r in tried for n in r.nodes} >= {None, 1}
    assert grow_forests(rows.where("false"), ["x"], settings=s).count() == 0


def test_cuts_of_many_values(spark):
    df = spark.range(5_000).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("b"),
                                   F.lit(None).cast("double").alias("c"))
    a, b, c = candidate_cuts(df, ["a", "b", "c"], 16)
    assert 8 <= len(a) <= 16 and b == [3.0] and c == []


def test_missing_feature_goes_low(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 5.0, 1, float(i % 2)) for i in range(80)],
                               "row_id int, x double, t int, y double")
    out = T.fit_forest_effects(df, df, ["x"], 1, control=None, depth=1, trees=1)
    # 5.0 is the only value, so nothing can be cut off
    assert len({round(r.effects[0], 9) for r in out.collect()}) == 1


def test_rule_and_model_hooks(spark, forest_data):
    """A rule that never takes arm 0; a model that is not one of the library's."""
    df, *_ = forest_data
    target = df.select(F.col("row_id").alias("customer_id"), "x")
    rule = F.array(F.lit(0.0), F.lit(1.0))
    got = T.policy_correct_standard(df, target, ["x"], 2, 4, scores=rule, outlier=None).first()
    p = T.predict_effects(target, T.fit_arm_ols(df, ["x"]), ["x"], 2, outlier=None)
    assert got.naive == pytest.approx(p.agg(F.avg(F.col("effects")[1])).first()[0])

    class Means:
        features, n_arms = ["x"], 2

        def fit(self, rows, by=(), weight=None):
            w = F.lit(1) if weight is None else F.col(weight)
            means = [(F.sum(F.when(F.col("t") == k, w * F.col("y")))
                      / F.sum(F.when(F.col("t") == k, w))).alias(f"m{k}") for k in (1, 2)]
            return rows.groupBy(*by).agg(*means).select(
                *by, F.struct("m1", "m2").alias("model"), F.lit(True).alias("fitted"))

        def effects(self, name):
            return F.array(F.col(f"{name}.m1"), F.col(f"{name}.m2"))
    out = T.policy_correct_standard(df, target, ["x"], 2, 6, model=Means()).first()
    w = D.with_poisson_weights(df, 6, ["row_id"], 42, "policy").toPandas()
    y = df.toPandas().groupby("t").y.mean()
    bias = []
    for _, d in w.groupby("draw"):
        m = d.groupby("t").apply(lambda g: np.average(g.y, weights=g.weight), include_groups=False)
        bias.append(m.max() - y[m.idxmax()])
    assert out.naive == pytest.approx(y.max()) and out.bias == pytest.approx(np.mean(bias))
    forest = T.ForestModel(["x"], 2, settings=ForestSettings(2, 3))
    moon = T.policy_correct("moon", df, target, ["x"], 2, 3, 0.8, model=forest).first()
    assert moon.draws == 3 and moon.corrected == pytest.approx(moon.naive - moon.bias)


# draw blocks ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def count_effects(spark):
    rng = np.random.default_rng(5)
    rows = [(f"t{i}", a, int(n), float(rng.binomial(n, 0.1 + 0.01 * a) / n))
            for i in range(6) for a, n in enumerate(rng.integers(40, 400, 2 + i % 4))]
    return spark.createDataFrame(rows, "test_id string, arm int, n bigint, effect double")


def test_split_arrays_are_the_long_splits(count_effects):
    long = V.split_values(V.split_counts(count_effects, 0.4, 30), count_effects)
    want = {(r.test_id, r.split_id): (r.selected_arm, r.est_value, r.eval_value, r.full_winner_value)
            for r in long.collect()}
    got = {(r.test_id, i): tuple(v) for r in V.count_split_values(
        count_effects, 0.4, 30).collect() for i, v in enumerate(r["values"])}
    assert got == want
    a = {r.test_id: r for r in V.correct_split(long).collect()}
    for r in V.correct_split_counts(count_effects, 0.4, 30).collect():
        for c, v in r.asDict().items():
            assert v == (pytest.approx(a[r.test_id][c], abs=1e-12) if isinstance(v, float)
                         else a[r.test_id][c]), c


@pytest.mark.parametrize("draws", [7, 100, 230])
def test_blocks_of_draws(count_effects, draws):
    blocks = B.count_blocks(count_effects, draws, power=0.8, salt=202).collect()
    want = {}
    for b in sorted(blocks, key=lambda b: b.block):
        e = np.array([np.array(x.clicks) / x.m for x in b.arms])
        assert all(x.m == max(1, math.floor(x.n ** 0.8)) for x in b.arms)
        best = e.argmax(0)
        gap = e.max(0) - np.array([x.original for x in b.arms])[best]
        scale = math.sqrt(max(1, math.floor(b.n_avg ** 0.8)) / b.n_avg)
        want.setdefault(b.test_id, []).extend(gap * scale)
    got = B.correct_counts(count_effects, draws, 0.8).collect()
    assert len(got) == 6
    for r in got:
        x = np.array(want[r.test_id])
        assert len(x) == draws and r.bias == pytest.approx(x.mean())
        assert r.bias_sd == pytest.approx(x.std(ddof=1))
        assert (r.bias_q025, r.bias_q50, r.bias_q975) == pytest.approx(
            tuple(np.quantile(x, [0.025, 0.5, 0.975])))
        assert r.corrected == pytest.approx(r.naive - r.bias)
    one = B.correct_counts(count_effects, 1).collect()
    assert all(r.bias_sd == 0 and r.bias_q50 == r.bias for r in one)


def test_counts_move_arms_not_draws(count_effects):
    plan = B.correct_counts(count_effects, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "percentile" not in plan
