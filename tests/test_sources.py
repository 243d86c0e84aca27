import uuid

import pytest
from pyspark.sql import functions as F

from honestpick.functions.lineage import shared_dir
from honestpick.operators import prep as P
from honestpick.sources import arms as SA, results as SR


def path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def test_gzip_csv_round_trip_and_bad_numbers(spark, raw_arms):
    p = path(spark, "arms")
    full = raw_arms.select("test_id", "split", "source_row_id", "impressions", "clicks",
                           "first_place", "winner", F.lit(None).cast("timestamp_ntz")
                           .alias("created_at"))
    SA.write_estimates(full, p, "csv")
    back = SA.read_arms(spark, p)
    assert back.exceptAll(full).isEmpty() and full.exceptAll(back).isEmpty()
    bad = path(spark, "bad")
    SA.write_estimates(full.withColumn("clicks", F.lit("many")), bad, "csv")
    with pytest.raises(Exception):
        P.prepare_arms(SA.read_arms(spark, bad)).collect()


def test_incremental_resumes_and_refuses(spark):
    tests = spark.createDataFrame([(f"t{i}",) for i in range(6)], "test_id string")
    p, calls = path(spark, "inc"), []

    def estimate(df):
        calls.append(df.count())
        return df.withColumn("v", F.length("test_id"))
    SR.run_incremental(tests.where("test_id < 't2'"), estimate, p, "a")
    assert SR.run_incremental(tests, estimate, p, "a").count() == 6
    assert calls == [2, 4]
    with pytest.raises(ValueError, match="other parameters"):
        SR.run_incremental(tests, estimate, p, "b")


def test_incremental_goes_on_after_a_lost_slice(spark):
    """The estimator dies in its third slice; the first two are not made again."""
    tests = spark.range(400).select(F.concat(F.lit("t"), "id").alias("test_id"))
    p, seen, stop = path(spark, "slices"), [], [True]

    def estimate(df):
        names = {r.test_id for r in df.collect()}
        if len(seen) == 2 and stop[0]:
            raise RuntimeError("lost")
        seen.append(names)
        return df.withColumn("v", F.length("test_id"))
    with pytest.raises(RuntimeError, match="lost"):
        SR.run_incremental(tests, estimate, p, "a", tests_per_slice=80)
    # a slice whose results were written but not entered does not count
    tests.limit(3).withColumn("v", F.lit(0)).withColumn("signature", F.lit("a")).write.parquet(
        f"{p}/slices/not-entered")
    stop[0] = False
    out = SR.run_incremental(tests, estimate, p, "a", tests_per_slice=80)
    assert out.count() == 400 == out.select("test_id").distinct().count()
    assert sum(map(len, seen)) == 400 and not (seen[0] | seen[1]) & set().union(*seen[2:])
    assert len(seen) > 4 and out.where("v = 0").isEmpty()
    n = len(seen)
    assert SR.run_incremental(tests, estimate, p, "a").count() == 400 and len(seen) == n
    none = path(spark, "none")
    assert SR.run_incremental(tests.limit(0), lambda df: df, none, "a").count() == 0


def errors(spark, settings, estimators):
    return spark.createDataFrame([(s, e, r, 1.0 * r, 0.5, r - 0.5) for s in settings
                                  for e in estimators for r in range(3)],
                                 "setting string, estimator string, repeat int, val_est double, "
                                 "val_true double, wc double")


def test_merge_rules(spark):
    base = errors(spark, ["a", "b"], ["none", "split", "moon"])
    delta = errors(spark, ["a", "b"], ["none", "moon"]).withColumn("val_est", F.lit(9.0))
    out = SR.merge_estimates(base, delta, drop=["split"])
    got = {(r.estimator, r.val_est) for r in out.collect()}
    assert out.count() == 12
    assert {v for e, v in got if e == "moon"} == {9.0}
    assert 9.0 not in {v for e, v in got if e == "none"} and "split" not in {e for e, _ in got}
    only_a = delta.where("setting = 'a'")
    with pytest.raises(ValueError):
        SR.merge_estimates(base, only_a)
    assert SR.merge_estimates(base, only_a, allow_partial=True).count() == 18
    extra = errors(spark, ["c"], ["moon"])
    with pytest.raises(ValueError):
        SR.merge_estimates(base, extra, allow_partial=True)


def test_replacement_flags_and_proof(spark):
    base = spark.createDataFrame([("s", e, r, 0.0, float(r), 0.0) for e in ("none", "eb")
                                  for r in (1, 2, 3)],
                                 "setting string, estimator string, repeat int, val_est double, "
                                 "val_true double, wc double")
    new = spark.createDataFrame([("s", 1, 1.02), ("s", 2, None), ("s", 3, 20.0)],
                                "setting string, repeat int, val_est double")
    out = SR.replace_estimator(base, new, "eb")
    got = {r.repeat: r for r in out.where("estimator = 'eb'").collect()}
    assert [round(got[1].wc, 9), got[2].wc, got[3].wc] == [0.02, None, 17.0]
    assert [got[r].valid for r in (1, 2, 3)] == [True, False, False]
    assert [got[r].failed for r in (1, 2, 3)] == [False, True, False]
    assert SR.unchanged(base, out.drop("valid", "failed"), "eb").first().unchanged
    touched = out.drop("valid", "failed").withColumn("val_true", F.lit(0.0))
    assert not SR.unchanged(base, touched, "eb").first().unchanged
    with pytest.raises(Exception, match="no replacement"):
        SR.replace_estimator(base, new.where("repeat < 3"), "eb").collect()


def test_run_catalogue(spark):
    runs = spark.createDataFrame([
        ("ab_20260101_000000", True, "raw"), ("ab_20260301_000000", False, "raw"),
        ("ab_20260201_000000", True, "raw"), ("ab_estsubset_20260401_000000", True, "raw"),
        ("ab_old_20260215_000000", True, "slim")], "dir string, has_config boolean, file string")
    got = SR.latest_run(SR.parse_runs(runs), {"ab": "ab", "ab_old": "ab"}).collect()
    assert [(r.experiment, r.dir) for r in got] == [("ab", "ab_old_20260215_000000")]
    files = spark.createDataFrame([("x", "raw"), ("x", "slim"), ("y", "raw"), ("y", "amended"),
                                   ("z", "notes")], "dir string, file string")
    assert {(r.dir, r.file) for r in SR.preferred_artifact(files).collect()} == {
        ("x", "slim"), ("y", "amended")}


def test_digest_sees_duplicates_and_draw_sets(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    assert SR.content_digest(a).first() == SR.content_digest(a.orderBy(F.desc("k"))).first()
    assert SR.content_digest(a).first() != SR.content_digest(a.unionAll(a)).first()
    draws = spark.createDataFrame([("full", "t1"), ("full", "t2"), ("part", "t1")],
                                  "estimator string, test_id string")
    kept = SR.complete_estimators(draws, draws.select("test_id"))
    assert {r.estimator for r in kept.collect()} == {"full"}
