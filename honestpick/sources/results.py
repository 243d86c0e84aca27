"""Result tables: resume, merge, replace, catalogues of runs."""

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from honestpick.functions.columns import attach_row
from honestpick.sources.arms import write_estimates

# Which artifact of a run to prefer, best first.
ARTIFACT_PRIORITY = ("slim", "amended", "raw")


def complete_estimators(draws: DataFrame, tests: DataFrame, by: list[str] = ("test_id",)
                        ) -> DataFrame:
    """Draws of those estimators that ran for every test."""
    by = list(by)
    done = draws.select("estimator", *by).distinct().groupBy("estimator").agg(
        F.count(F.lit(1)).alias("_done"))
    total = tests.select(*by).distinct().agg(F.count(F.lit(1)).alias("_total"))
    full = attach_row(done, total).where(F.col("_done") == F.col("_total")).select("estimator")
    return draws.join(full, "estimator", "left_semi")


def check_signature(done: DataFrame, signature: str) -> None:
    """Refuses to resume on results made with other parameters; stops at the first one."""
    other = done.where(~F.col("signature").eqNullSafe(signature)).limit(1).count()
    if other:
        raise ValueError("earlier results were made with other parameters")


def signature_of(**params) -> str:
    return json.dumps(params, sort_keys=True, default=str)


def pending(tests: DataFrame, done: DataFrame, keys: list[str] = ("test_id",)) -> DataFrame:
    return tests.join(done.select(*keys).distinct(), list(keys), "left_anti")


def _parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def run_incremental(tests: DataFrame, estimate, path: str, signature: str,
                    keys: list[str] = ("test_id",), tests_per_slice: int = 10_000) -> DataFrame:
    """Estimates only the tests not yet under `path`, returns the whole table.

    `estimate` maps the rows of some pending tests to a DataFrame.  Pending tests are cut into
    slices by a hash of their keys; a slice's results are written to a folder of their own, and
    count once the slice is entered in the table of finished ones, after they are whole.  A run
    that is stopped loses the slice at work; the next run skips the finished ones.
    """
    spark, keys = tests.sparkSession, list(keys)
    log = f"{path}/finished"

    def results() -> DataFrame | None:
        finished = _parquet(spark, log)
        if finished is None:
            return None
        check_signature(finished, signature)
        # one name per slice
        return spark.read.parquet(*[f"{path}/slices/{r.slice}" for r in finished.collect()])

    done = results()
    todo = tests if done is None else pending(tests, done, keys)
    n = todo.select(*keys).distinct().count()
    slices, run = -(-n // tests_per_slice), uuid.uuid4().hex
    part = F.pmod(F.xxhash64(*keys, F.lit(run)), F.lit(max(slices, 1)))
    for k in range(slices):
        name = f"{run}-{k}"
        write_estimates(estimate(todo.where(part == k)).withColumn(
            "signature", F.lit(signature)), f"{path}/slices/{name}")
        spark.createDataFrame([(name, signature)], "slice string, signature string").coalesce(
            1).write.mode("append").parquet(log)
    done = results()
    return (estimate(todo).withColumn("signature", F.lit(signature)) if done is None else done)


def merge_estimates(base: DataFrame, delta: DataFrame, drop: list[str] = (),
                    allow_partial: bool = False, setting: str = "setting",
                    shared: str = "none") -> DataFrame:
    """Upsert: delta's estimators replace base's rows setting by setting.

    Rows of the shared no-correction estimator always stay as in base.  A setting that only
    delta has is an error; so is one delta lacks, unless `allow_partial`.
    """
    base = base.where(~F.col("estimator").isin(list(drop))) if drop else base
    delta = delta.where(F.col("estimator") != shared)
    keys = (base.select(setting, F.lit(1).alias("_b")).distinct()
            .join(delta.select(setting, F.lit(1).alias("_d")).distinct(), setting, "full"))
    bad = F.col("_b").isNull() if allow_partial else F.col("_b").isNull() | F.col("_d").isNull()
    if keys.where(bad).limit(1).count():
        raise ValueError("the two result tables cover different settings")
    replaced = delta.select(setting, "estimator").distinct()
    return base.join(replaced, [setting, "estimator"], "left_anti").unionByName(delta)


def replace_estimator(base: DataFrame, new: DataFrame, estimator: str,
                      keys: list[str] = ("setting", "repeat")) -> DataFrame:
    """Swap one estimator's estimates, keeping every repeat, with validity and failure flags.

    `new` is (keys..., val_est), NULL where the fit failed.  Truths come from base.  A repeat
    without a new row fails the job.
    """
    keys = list(keys)
    old = base.where(F.col("estimator") == estimator)
    fresh = new.select(*keys, F.col("val_est").alias("_new"), F.lit(1).alias("_seen"))
    joined = old.join(fresh, keys, "left")
    present = F.when(F.col("_seen").isNull(), F.raise_error(
        F.lit("a repeat has no replacement")).cast("boolean")).otherwise(F.lit(True))
    wc = F.col("_new") - F.col("val_true")
    swapped = joined.where(present).select(*[
        F.col("_new").alias(c) if c == "val_est" else wc.alias(c) if c == "wc" else F.col(c)
        for c in base.columns],
        F.coalesce((wc > -5) & (wc < 5), F.lit(False)).alias("valid"),
        F.col("_new").isNull().alias("failed"))
    rest = base.where(F.col("estimator") != estimator).select(
        *base.columns, F.lit(True).alias("valid"), F.lit(False).alias("failed"))
    return rest.unionByName(swapped)


def content_digest(df: DataFrame) -> DataFrame:
    """One row: row count and an order-free digest (a decimal sum, so copies do not cancel)."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("digest"))


def unchanged(before: DataFrame, after: DataFrame, estimator: str) -> DataFrame:
    """One row telling whether all other estimators' rows are the same in both tables."""
    cols = before.columns
    b = content_digest(before.where(F.col("estimator") != estimator).select(*cols))
    a = content_digest(after.where(F.col("estimator") != estimator).select(*cols))
    both = attach_row(b.withColumnsRenamed({"n_rows": "rows_before", "digest": "_b"}),
                      a.withColumnsRenamed({"n_rows": "rows_after", "digest": "_a"}))
    return both.select("rows_before", "rows_after", (
        F.col("_b").eqNullSafe(F.col("_a"))
        & (F.col("rows_before") == F.col("rows_after"))).alias("unchanged"))


def parse_runs(runs: DataFrame) -> DataFrame:
    """Split a run folder name into experiment name and timestamp."""
    pattern = r"^(.*)_(\d{8}_\d{6})$"
    return runs.withColumns({"name": F.regexp_extract("dir", pattern, 1),
                             "ts": F.regexp_extract("dir", pattern, 2)})


def latest_run(runs: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Newest complete run per experiment; `aliases` maps folder names to experiments.

    Names must match exactly; a run needs its configuration and a result file.
    """
    pairs = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    complete = (runs.where(F.col("name").isin(list(aliases)) & F.col("has_config")
                           & F.col("file").isNotNull())
                .withColumn("experiment", pairs[F.col("name")]))
    return complete.groupBy("experiment").agg(F.max(F.struct("ts", "dir")).alias("_w")).select(
        "experiment", "_w.ts", "_w.dir")


def preferred_artifact(files: DataFrame, run: str = "dir") -> DataFrame:
    """One file per run, by priority."""
    rank = F.when(F.lit(False), F.lit(0))
    for i, kind in enumerate(ARTIFACT_PRIORITY):
        rank = rank.when(F.col("file") == kind, i)
    best = F.min(F.struct(rank.alias("rank"), F.col("file").alias("file")))
    return (files.where(F.col("file").isin(*ARTIFACT_PRIORITY)).groupBy(run)
            .agg(best.alias("_b")).select(run, "_b.file"))


def run_manifest(df: DataFrame, params: dict) -> DataFrame:
    """Provenance: row count and digest of the input, and the parameters as JSON."""
    return content_digest(df).withColumn("params", F.lit(signature_of(**params)))


