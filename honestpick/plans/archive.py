"""The archive run: arm table in, every test's corrected winner out."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from honestpick.operators import bootstrap as B, effects as E, prep as P
from honestpick.plans import roles as R


def flagship(spark: SparkSession, sf_dir: str, draws: int = 50, power: float = 0.6,
             min_impressions: int = 8) -> DataFrame:
    """Row outcomes -> counts -> eligible tests -> m-out-of-n corrected rate of the pick."""
    rows = R.order_rows(spark, sf_dir).select("test_id", "arm", "row_id", "click")
    counts = E.rollup_arms(rows).select(
        "test_id", F.lit("all").alias("split"), F.col("arm").cast("bigint").alias("source_row_id"),
        "impressions", "clicks", F.lit("no").alias("first_place"), F.lit("no").alias("winner"))
    keep = P.eligible_tests(P.prepare_arms(counts), 2, min_impressions).select(
        "test_id").distinct()
    eligible = rows.join(keep, "test_id", "left_semi")
    return B.correct_moon(eligible, draws, power, value="click")
