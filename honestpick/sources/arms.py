"""Reading and writing experiment tables."""

from pyspark.sql import DataFrame, SparkSession, types as T

from honestpick.schema import RAW_ARM_COLUMNS

RAW_ARM_SCHEMA = T.StructType([
    T.StructField("test_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("source_row_id", T.LongType()),
    T.StructField("impressions", T.LongType()),
    T.StructField("clicks", T.LongType()),
    T.StructField("first_place", T.StringType()),
    T.StructField("winner", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType())])


def read_arms(spark: SparkSession, path: str, format: str = "csv",
              schema: T.StructType = RAW_ARM_SCHEMA, **options) -> DataFrame:
    """Arm-level table from CSV (plain or gzip) or Parquet, with an explicit schema.

    A bad number fails the job (FAILFAST) instead of turning into NULL.
    """
    reader = spark.read
    if format == "csv":
        return reader.schema(schema).options(header=True, mode="FAILFAST", **options).csv(path)
    df = reader.options(**options).format(format).load(path)
    missing = sorted(set(RAW_ARM_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_rows(spark: SparkSession, path: str, columns: list[str] | None = None,
              format: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Row-level experiment data; only the named columns are read from the files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.options(**({"header": True} if format == "csv" else {})).format(format).load(path)
    return df.select(*columns) if columns else df


def write_estimates(df: DataFrame, path: str, format: str = "parquet",
                    mode: str = "errorifexists", partition_by: list[str] = ()) -> None:
    """Parquet, gzip CSV or gzip JSON lines; every task writes its own part."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "parquet":
        writer.parquet(path)
    elif format == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
    elif format == "json":
        writer.option("compression", "gzip").json(path)
    else:
        raise ValueError(f"unknown format {format!r}")


def write_draws(draws: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The long draw table, one folder per estimator."""
    draws.write.mode(mode).partitionBy("estimator").parquet(path)
