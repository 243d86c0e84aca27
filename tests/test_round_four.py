"""Slots that are not broadcast, folded forests, tables read twice, shared medians."""

import random

from pyspark.sql import functions as F

from honestpick.functions import draws as D
from honestpick.functions.quantiles import exact_quantiles
from honestpick.operators import bootstrap as B, forests, selective as S
from honestpick.plans import queries_sources as Q, roles as R
from honestpick.plans.catalog import load_all


def test_slots_are_not_broadcast(spark):
    """The unfolded slots come from a table of a few bytes, which says nothing about their number."""
    rows = spark.range(4_000).select(F.lit("t").alias("test_id"), (F.col("id") % 2).alias("arm"),
                                     F.col("id").alias("row_id"), F.rand(1).alias("y"))
    sizes = B.saved_effects(rows)
    plan = B.index_rows(rows, sizes, 20, ["test_id", "arm"], ["y"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line and "pos" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    assert plan.count() == 4_000 * 20


def unsteady(column):
    """Values whose last bits differ each time they are made, as sums of doubles may."""
    made = F.udf(lambda v: v + random.random() * 1e-9, "double").asNondeterministic()
    return made(F.col(column).cast("double"))


def test_quantiles_of_unsteady_values(spark):
    df = spark.range(300).select((F.col("id") % 100).alias("g"), F.col("id").alias("v")).select(
        "g", unsteady("v").alias("v"))
    got = {r.g: (r.n, r.q[0]) for r in exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got.keys() == set(range(100))
    assert all(n == 3 and q is not None and abs(q - (g + 100)) < 1e-6 for g, (n, q) in got.items())


def test_coverage_of_unsteady_effects(spark):
    df = spark.range(60).select((F.col("id") % 20).alias("g"), F.col("id").alias("v")).select(
        "g", unsteady("v").alias("effect"), F.lit(0.0).alias("truth")).select(
        "*", (F.col("effect") - 1).alias("ci_low"), (F.col("effect") + 1).alias("ci_high"))
    got = S.coverage(df, "truth", ["g"], "effect").collect()
    assert len(got) == 20
    assert all(abs(r.median_error - (r.g + 20)) < 1e-6 and abs(r.median_width - 2) < 1e-6 for r in got)


def test_unchanged_with_unsteady_estimates(spark, monkeypatch):
    made = R.error_table
    monkeypatch.setattr(Q, "_errors", lambda *a: made(*a).withColumn("val_est", unsteady("val_est")))
    row = load_all()["s9b_unchanged"].run(spark, "/root/testdata/sf0.001").first()
    assert row.unchanged and row.rows_before == row.rows_after > 0


def test_rate_weights_are_short(spark):
    """No long chain of conditions for every rate: a few conditions decide nearly all lanes."""
    df = spark.range(100).select("id", (1 + F.col("id") % 20).alias("r"))
    text = D.with_rate_weights(df, "r", 4, ["id"], 5, "x")._jdf.queryExecution().executedPlan().toString()
    assert 0 < text.count("WHEN") <= 4 * D.LANES


def unfolded(spark):
    return spark.range(800).select(
        F.col("id").alias("row_id"), (1 + F.col("id") % 2).alias("t"), (F.col("id") * 7 % 31).alias("x"),
        F.when(F.col("id") % 9 > 0, F.col("id") * 5 % 11).alias("z")).withColumn(
        "y", F.when(F.col("x") > 12, 3.0).otherwise(1.0) + F.coalesce("z", F.lit(4)) / 8
        + F.col("row_id") % 17 / 64)


def test_folded_forests_are_the_same(spark, monkeypatch):
    """Two features, one with missing values: sums per combination of bins, and rows as they are."""
    grown = []
    for limit in (10_000, 0):
        monkeypatch.setattr(forests, "FOLDED", limit)
        got = forests.grow_forests(unfolded(spark), ["x", "z"],
                                   settings=forests.ForestSettings(depth=3, trees=3)).collect()
        grown.append({(r.t, r.tree): [n and (n.f, n.cut, n.value and round(n.value, 9)) for n in r.nodes]
                      for r in got})
    assert grown[0] == grown[1] and len(grown[0]) == 6


def test_forests_weigh_rows_once(spark, monkeypatch):
    """Levels read sums of bins: the rows are weighed and hashed once, not on every level."""
    seen = spark.sparkContext.accumulator(0)

    def counted(keys, *args, made=D.hash_hex):
        def mark(v):
            seen.add(1)
            return v
        return F.udf(mark, "string").asNondeterministic()(made(keys, *args))
    monkeypatch.setattr(D, "hash_hex", counted)
    forests.grow_forests(unfolded(spark), ["x"], settings=forests.ForestSettings(depth=3, trees=4))
    assert seen.value == 800
