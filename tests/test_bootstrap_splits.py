import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from honestpick.operators import bootstrap as B, effects as E, shrink as H, splits as V


def h48(*keys):
    text = "|".join(str(k) for k in keys)
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def samples(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.arm, r.row_id)):
        out.setdefault(r.arm, []).append(r.y)
    return {a: np.array(v) for a, v in out.items()}


def test_moon_by_hand(spark):
    rows = [("t", 0, i, float(i)) for i in range(16)]
    rows += [("t", 1, 100 + i, i + 0.2) for i in range(16)]
    df = spark.createDataFrame(rows, "test_id string, arm int, row_id bigint, y double")
    out = B.correct_moon(df, 30, 0.5).first()
    arms, bias = samples(df), []
    for d in range(30):
        means = [arms[a][[h48("t", a, p, d, 500, 42, "moon") % 16 for p in range(4)]].mean()
                 for a in (0, 1)]
        pick = int(np.argmax(means))
        bias.append((means[pick] - arms[pick].mean()) * 0.5)
    assert abs(out.bias - np.mean(bias)) < 1e-9
    assert abs(out.corrected - (arms[1].mean() - np.mean(bias))) < 1e-9
    assert abs(out.bias_sd - np.std(bias, ddof=1)) < 1e-9


def test_slots_unfold_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 7)
    sizes = spark.createDataFrame([("t", 0, 20), ("t", 1, 3)], "test_id string, arm int, n bigint")
    got = B.slots(sizes, 2, ["test_id", "arm"]).collect()
    for arm, n in ((0, 20), (1, 3)):
        for d in (0, 1):
            assert sorted(r.pos for r in got if r.arm == arm and r.draw == d) == list(range(n))


def test_modes_agree(noisy_rows):
    poisson = B.correct_standard(noisy_rows, 400).first()
    index = B.correct_standard(noisy_rows, 400, mode="index").first()
    assert abs(poisson.bias - index.bias) < 4 * np.hypot(poisson.bias_se, index.bias_se)
    moon = B.correct_moon(noisy_rows, 400, 0.7).first()
    approx = B.correct_moon(noisy_rows, 400, 0.7, mode="poisson").first()
    assert abs(moon.bias - approx.bias) < 4 * np.hypot(moon.bias_se, approx.bias_se)


def test_counts_agree_with_rows(spark):
    rows = [("t", a, a * 1000 + i, 1.0 if i < c else 0.0)
            for a, (n, c) in enumerate([(200, 60), (200, 66), (180, 50)]) for i in range(n)]
    df = spark.createDataFrame(rows, "test_id string, arm int, row_id bigint, y double")
    by_rows = B.correct_standard(df, 500, mode="index").first()
    by_counts = B.correct_counts(E.arm_effects(df, "bernoulli"), 2000).first()
    assert abs(by_rows.bias - by_counts.bias) < 4 * np.hypot(by_rows.bias_se, by_counts.bias_se)
    again = B.correct_counts(E.arm_effects(df.repartition(3), "bernoulli"), 2000).first()
    assert abs(again.bias - by_counts.bias) < 1e-12      # only summation order differs


def test_partition_and_order_do_not_matter(noisy_rows):
    a = B.correct_standard(noisy_rows, 20).first()
    b = B.correct_standard(noisy_rows.orderBy(F.desc("y")).repartition(5), 20).first()
    assert abs(a.corrected - b.corrected) < 1e-12


def test_conditional_rounds_match_one_long_run(noisy_rows):
    small = B.correct_conditional(noisy_rows, 10, max_attempts=400).first()
    effects = E.arm_effects(noisy_rows)
    drawn = B.poisson_draws(noisy_rows, 400, salt="cond")
    win = E.select_winner(effects).first().arm
    kept = (B.bias_draws(drawn, effects).where(F.col("selected_arm") == win)
            .orderBy("draw").limit(10).toPandas())
    assert abs(small.bias - kept.bias.mean()) < 1e-9
    assert small.accepted == 10 and small.attempts == kept.draw.max() + 1
    short = B.correct_conditional(noisy_rows, 50, max_attempts=12).first()
    assert short.status == "short" and short.attempts == 12


def test_hall_double(noisy_rows):
    hall = B.correct_by(noisy_rows, "double", 10, outer=3).first()
    plain = B.correct_double(noisy_rows, 3, 10).first()
    t = B.bias_stats(B.bias_draws(B.poisson_draws(noisy_rows, 10),
                                  E.arm_effects(noisy_rows))).first().bias
    assert abs(hall.bias - (2 * t - plain.bias)) < 1e-9


@pytest.mark.parametrize("call", [
    lambda df: B.correct_moon(df, 5, 1.0), lambda df: B.correct_numerical(df, 5, 0.2),
    lambda df: B.correct_by(df, "other", 5), lambda df: V.split_rows(df, 1.0, 2, ["arm"])])
def test_bad_parameters(hand_rows, call):
    with pytest.raises(ValueError):
        call(hand_rows)


def test_one_draw_has_zero_sd(hand_rows):
    draws = hand_rows.select("test_id", F.lit(1.5).alias("bias")).limit(1)
    s = B.bias_stats(draws).first()
    assert (s.bias, s.bias_sd, s.bias_q50) == (1.5, 0.0, 1.5)


def test_ks_and_choose_m(spark):
    rows = [("t", 0.5, d, float(d)) for d in range(10)] + [
        ("t", 0.7, d, float(d + 5)) for d in range(10)] + [
        ("t", 0.9, d, float(d + 6)) for d in range(10)]
    df = spark.createDataFrame(rows, "test_id string, power double, draw int, bias double")
    got = B.choose_m(df, [0.5, 0.7, 0.9]).first()
    assert (got.m_index, got.power) == (1, 0.7) and abs(got.ks - 0.1) < 1e-9


def test_hand_small_cases(hand_rows):
    plug = H.correct_plugin(hand_rows).first()
    assert abs(plug.bias - 0.298984) < 1e-6 and abs(plug.corrected - 1.701016) < 1e-6
    assert V.correct_jackknife(hand_rows).first().corrected == 2.0
    assert V.correct_kfold(hand_rows, 2).first().corrected == 2.0


def test_jackknife_unequal_arms_brute_force(spark):
    rng = np.random.default_rng(3)
    arms = {0: rng.normal(0, 1, 9), 1: rng.normal(0.2, 1, 5), 2: rng.normal(0.1, 1, 7)}
    rows = [("t", a, a * 100 + i, float(y)) for a, v in arms.items() for i, y in enumerate(v)]
    df = spark.createDataFrame(rows, "test_id string, arm int, row_id bigint, y double")
    scores = []
    for i in range(9):
        means = [np.delete(v, i).mean() if i < len(v) else v.mean() for v in arms.values()]
        k = int(np.argmax(means))
        if i < len(arms[k]):
            scores.append(arms[k][i])
    assert abs(V.correct_jackknife(df).first().corrected - np.mean(scores)) < 1e-9


def test_split_sizes_and_partition(noisy_rows):
    parts = V.split_rows(noisy_rows, 0.3, 5, ["test_id", "arm"])
    sizes = parts.groupBy("split_id", "arm").agg(F.count_if("in_est").alias("m"),
                                                 F.count(F.lit(1)).alias("n")).collect()
    assert len(sizes) == 15 and all((r.m, r.n) == (12, 40) for r in sizes)
    other = V.split_rows(noisy_rows.repartition(3), 0.3, 5, ["test_id", "arm"], hash_digits=2)
    key = ["row_id", "split_id", "in_est"]
    assert parts.select(*key).exceptAll(other.select(*key)).isEmpty()


def test_split_counts_add_up(spark):
    e = spark.createDataFrame([("t", 0, 10, 0.3), ("t", 1, 12, 4 / 12)],
                              "test_id string, arm int, n bigint, effect double")
    out = V.split_counts(e, 0.5, 25).collect()
    assert len(out) == 50
    for r in out:
        assert (r.est_n, r.eval_n) == ((5, 5) if r.arm == 0 else (6, 6))
        assert r.est_clicks + r.eval_clicks == (3 if r.arm == 0 else 4)
    v = V.split_values(V.split_counts(e, 0.5, 25), e)
    assert {r.full_winner for r in v.collect()} == {1}
    d = V.split_diagnostics(v).first()
    assert abs(d.full_winner_selection_rate + d.disagreement_rate - 1) < 1e-12
