import pytest
from pyspark.sql import functions as F

from honestpick.operators import effects as E, joins as J, prep as P


def test_eligibility(raw_arms):
    s = P.eligibility_summary(P.prepare_arms(raw_arms), 2, 2).first()
    assert (s.total_tests, s.eligible_tests, s.single_arm_tests, s.low_impression_tests) == (
        4, 2, 1, 1)
    kept = P.eligible_tests(P.prepare_arms(raw_arms), 2, 2)
    assert {r.test_id for r in kept.collect()} == {"regular", "tie"}
    first = P.eligible_tests(P.prepare_arms(raw_arms), 2, 2, limit_tests=1)
    assert {r.test_id for r in first.collect()} == {"regular"}


@pytest.mark.parametrize("change", [{"impressions": 0}, {"clicks": -1}, {"clicks": 999}])
def test_bad_counts_fail(raw_arms, change):
    bad = raw_arms.withColumns({c: F.lit(v).cast("bigint") for c, v in change.items()})
    with pytest.raises(Exception, match="impossible counts"):
        P.prepare_arms(bad).collect()


def test_bad_text_and_missing_column_fail(raw_arms):
    with pytest.raises(Exception):
        P.cast_arms(raw_arms.withColumn("clicks", F.lit("many"))).collect()
    with pytest.raises(ValueError, match="missing columns"):
        P.prepare_arms(raw_arms.drop("clicks"))


def test_records(arms):
    rec = {r.test_id: r for r in E.test_records(arms).collect()}
    tie, reg = rec["tie"], rec["regular"]
    assert (tie.selected_source_row_id, tie.ties, tie.naive, tie.gap) == (10, 2, 0.5, 0.0)
    assert tie.selected_winner and tie.selected_first_place
    assert reg.selected_source_row_id == 2
    assert abs(reg.naive - 1 / 3) < 1e-12 and abs(reg.gap - 1 / 12) < 1e-12
    assert reg.runner_up == 0.25 and reg.total_impressions == 24


def test_counts_equal_rows(spark):
    counts = [(5, 2), (4, 1), (6, 0)]
    rows = [("t", a, i, 1.0 if i < c else 0.0) for a, (n, c) in enumerate(counts)
            for i in range(n)]
    df = spark.createDataFrame(rows, "test_id string, arm int, row_id bigint, y double")
    got = {r.arm: r for r in E.arm_effects(df, "bernoulli").collect()}
    assert [round(got[a].effect, 10) for a in range(3)] == [0.4, 0.25, 0.0]
    assert [round(got[a].var, 10) for a in range(3)] == [0.048, 0.046875, 0.0]
    cont = {r.arm: r for r in E.arm_effects(df).collect()}
    assert all(abs(cont[a].var - got[a].var) < 1e-12 for a in range(3))
    logit = {r.arm: r for r in E.arm_effects(df, "logit").collect()}
    assert logit[2].effect is None and logit[2].var is None
    rolled = {r.arm: (r.impressions, r.clicks) for r in E.rollup_arms(df, outcome="y").collect()}
    assert rolled == dict(enumerate(counts))


def test_selection_ties_and_rules(spark):
    e = spark.createDataFrame([("t", 0, 1.0, 0.04), ("t", 1, 2.0, 4.0), ("t", 2, 2.0, 0.01)],
                              "test_id string, arm int, effect double, var double")
    w = E.select_winner(e).first()
    assert (w.arm, w.ties) == (1, 2)
    assert E.apply_rule(e, F.col("effect") - F.sqrt("var")).first().arm == 2
    v = E.value_of(E.select_winner(e), e, link="logit").first().value
    assert abs(v - 0.8807970779) < 1e-9


def test_quantile_bins_like_qcut(spark):
    x = [1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 10.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double")
    got = {r.i: r.b for r in P.quantile_bin(df, "v", 4, name="b").collect()}
    # edges 1, 1, 2, 3.5, 10 with the duplicate dropped
    assert [got[i] for i in range(8)] == [1, 1, 1, 1, 2, 3, 3, None]
    constant = P.quantile_bin(df.withColumn("v", F.lit(5.0)), "v", 4, name="b")
    assert {r.b for r in constant.collect()} == {None}


def test_cap_truncate_and_unit_columns(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "wc double")
    assert P.cap_outliers(df, "wc", 0.5, name="c").agg(F.max("c")).first()[0] == 50.0
    assert P.truncate_errors(df).count() == 5
    flags = P.truncate_errors(df, flag_only=True)
    assert flags.count() == 101 and flags.where("valid").count() == 5
    assert P.unit_columns(df, ["wc"]).agg(F.max("wc_pp")).first()[0] == 10000.0


def test_joins_enforce_cardinality(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, b double")
    with pytest.raises(Exception, match="key is not unique"):
        J.join_one_to_one(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="key is not unique"):
        J.join_many_to_one(a, b, ["k"]).collect()
    assert J.join_many_to_one(b, a, ["k"]).count() == 2


def test_align_runs(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (3, 2.0)], "k int, v double")
    r = J.align_runs(a, b, ["k"], "v").first()
    assert (r.only_a, r.only_b, r.matched, r.aligned) == (1, 1, 1, False)
    assert J.align_runs(a, a, ["k"], "v").first().aligned
