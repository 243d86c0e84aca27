"""Experiment tables derived from the generic star-schema tables.

Arm table: parts' brands are tests, part types are arms, line items are impressions and
returned items are clicks.  Row table: orders, with market segment and year as the test and
order priority as the arm.  Choices: events, one market per user.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


# Prices are counted in thousands at this rate; its prime factor keeps averages away from
# exact decimals, where two engines may round the last digit differently.
PRICE_UNIT = 1370.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arm-level table as it would arrive: text flags, one row per test and arm."""
    per_part = (table(spark, sf_dir, "lineitem")
                .groupBy("l_partkey")      # combine before the join
                .agg(F.count(F.lit(1)).alias("n"),
                     F.count_if(F.col("l_returnflag") == "R").alias("c"),
                     F.min("l_shipdate").alias("first_seen")))
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("test_id"),
        F.col("p_type").alias("arm_label"))
    arms = (per_part.join(part, "l_partkey").groupBy("test_id", "arm_label")
            .agg(F.sum("n").alias("impressions"), F.sum("c").alias("clicks"),
                 F.min("first_seen").alias("created_at")))
    by_label = Window.partitionBy("test_id").orderBy("arm_label")
    digit = F.substring("test_id", -1, 1)
    return arms.select(
        "test_id",
        F.when(digit.isin("1", "2", "3"), "exploratory")
         .when(digit.isin("4", "5", "6"), "confirmatory").otherwise("holdout").alias("split"),
        F.row_number().over(by_label).cast("bigint").alias("source_row_id"),
        "impressions", "clicks",
        F.when(F.col("impressions") % 3 == 0, "T").alias("first_place"),
        F.when(F.col("clicks") % 2 == 0, " Yes ").otherwise("no").alias("winner"),
        "created_at")


def supplier_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests with two to seven arms: suppliers are tests, line numbers fold into the arms."""
    test = F.col("l_suppkey")
    arm = F.least(F.col("l_linenumber").cast("bigint"), 2 + test % 6)
    line = table(spark, sf_dir, "lineitem")
    return (line.groupBy(test.alias("supplier"), arm.alias("source_row_id"))
            .agg(F.count(F.lit(1)).alias("impressions"),
                 F.count_if(F.col("l_returnflag") == "R").alias("clicks"),
                 F.min("l_shipdate").alias("created_at"))
            .select(F.concat(F.lit("S"), "supplier").alias("test_id"),
                    F.when(F.col("supplier") % 10 < 4, "exploratory")
                     .when(F.col("supplier") % 10 < 7, "confirmatory")
                     .otherwise("holdout").alias("split"),
                    "source_row_id", "impressions", "clicks",
                    F.when(F.col("impressions") % 3 == 0, "T").alias("first_place"),
                    F.when(F.col("clicks") % 2 == 0, " Yes ").otherwise("no").alias("winner"),
                    "created_at"))


def supplier_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every supplier test."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("test_id"), F.col("s_nationkey").alias("nation"))


def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long result table: setting = order status, repeat = day, truth 250, three estimators."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("setting"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
        .alias("repeat"), (F.col("o_totalprice") / PRICE_UNIT).alias("spend"))
    means = o.groupBy("setting", "repeat").agg(
        F.avg("spend").alias("none"), F.max("spend").alias("split"),
        F.min("spend").alias("standard"))
    return means.unpivot(["setting", "repeat"], ["none", "split", "standard"], "estimator",
                         "val_est").select(
        "setting", "repeat", "estimator", "val_est", F.lit(250.0).alias("val_true"),
        (F.col("val_est") - 250.0).alias("wc"))


def many_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small tests: segment and year, arm = order priority, click = finished order."""
    o = order_rows(spark, sf_dir)
    return (o.groupBy("test_id", "arm")
            .agg(F.count(F.lit(1)).alias("impressions"),
                 F.sum("click").cast("bigint").alias("clicks"),
                 F.min("o_orderdate").alias("created_at"))
            .select("test_id", F.lit("all").alias("split"),
                    (F.col("arm") + 1).cast("bigint").alias("source_row_id"),
                    "impressions", "clicks", F.lit("no").alias("first_place"),
                    F.lit("no").alias("winner"), "created_at"))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(test_id, arm, row_id, y, click, status, price, o_orderdate), one row per order."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return o.join(c, "o_custkey").select(
        F.concat_ws("-", "c_mktsegment", F.year("o_orderdate").cast("string")).alias("test_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("arm"),
        F.col("o_orderkey").alias("row_id"),
        (F.col("o_totalprice") / PRICE_UNIT).alias("y"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("click"),
        F.col("o_orderstatus").alias("status"), "o_orderdate")


def priority_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store-wide experiment: arm = order priority; three outcome columns."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return orders.select(
        F.lit("orders").alias("test_id"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("arm"),
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderstatus") != "O", 1.0).otherwise(0.0).alias("visit"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("conversion"),
        (F.col("o_totalprice") / PRICE_UNIT).alias("spend"))


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-arm tests on orders: urgent and high priority (arm 0) against the rest (arm 1)."""
    return order_rows(spark, sf_dir).withColumn(
        "arm", F.when(F.col("arm") < 2, 0).otherwise(1))


def targeting_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, x, t, y): part size, return flag as treatment, line price.

    The key holds all that matters about a line, so lines that share it are interchangeable.
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag",
        "l_extendedprice")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return line.join(part, "l_partkey").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                            "l_returnflag")],
                    F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
                    ).alias("row_id"),
        (F.col("p_size") / 10.0).alias("x"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2)
         .otherwise(3).alias("t"),
        (F.col("l_extendedprice") / 10000.0).alias("y"))


def targeting_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("customer_id"), (F.col("p_size") / 10.0).alias("x"))


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market, row_id, product): a user's events, viewing is the outside option."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return events.select(
        F.col("user_id").alias("market"), F.col("event_id").alias("row_id"),
        F.when(F.col("event_type") == "view", "outside")
         .otherwise(F.col("event_type")).alias("product"))
