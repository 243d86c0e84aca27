"""Exact duplicates by a stateful stream.

Every row leaves one thin record in a log: the SHA-256 of its text, its id, and the place of its
content (file and row).  A stream follows the log and keeps, for each digest and without expiry,
how many rows had it and the id and place of the row that stays; the state lies on disk
(RocksDB) and in its checkpoint in the shared folder, so a restarted stream goes on where it was
and new files of the log are added to old state.  A digest seen more than once is a hit: the
full text of every such row is compared with that of the row that stays, and rows that differ
are grouped by the text itself.

DataFrame and SQL functions only.  Sums and maxima are combined before each shuffle, and joins
of rows with their group may be split by Spark where one group is large.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from honestpick.functions.lineage import save_table, shared_dir

_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """digest, doc_id, file, row, text of every row; a null text is empty.

    Places are those of the files that `docs` is a plain scan of; any other frame is first
    written to the shared folder.
    """
    def pick(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
        return df.select(digest(body).alias("digest"), F.col(f"`{doc_id}`").alias("doc_id"),
                         at["file_path"].alias("file"), at["row_index"].alias("row"),
                         body.alias("text"))
    try:
        return pick(docs)
    except AnalysisException:
        return pick(save_table(docs))


def follow(spark: SparkSession, log: str, state: str,
           files_per_batch: int | None = None) -> DataFrame:
    """Read what is new in the log folder; digest, keep_id, file, row, n of all digests so far.

    Of equal rows the one with the largest id stays (a null id is the smallest); among equal ids
    the last place.  Batches that ran before are not read again.
    """
    session = spark.newSession()
    settings = _STATE_STORE | {
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        # with one batch only, a store is closed as soon as its partition is done
        "spark.sql.streaming.stateStore.unloadOnCommit": str(files_per_batch is None).lower()}
    for k, v in settings.items():
        session.conf.set(k, v)
    reader = session.readStream.schema(session.read.parquet(log).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    last = F.max(F.struct("doc_id", "file", "row")).alias("last")
    seen = reader.parquet(log).groupBy("digest").agg(last, F.count(F.lit(1)).alias("n"))

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state}/changes/batch={batch}")

    (seen.writeStream.outputMode("update").foreachBatch(put)
     .option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
     .awaitTermination())
    changes = spark.read.parquet(f"{state}/changes")
    # counts only grow, so the largest count is a digest's newest line
    newest = changes.groupBy("digest").agg(F.max(F.struct("n", "last")).alias("s"))
    return newest.select("digest", F.col("s.last.doc_id").alias("keep_id"),
                         F.col("s.last.file").alias("keep_file"),
                         F.col("s.last.row").alias("keep_row"), F.col("s.n").alias("n"))


def unequal(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose full text differs from that of the row that stays (normally none)."""
    hits = save_table(groups.where("n > 1").select("digest", "keep_file", "keep_row"))
    # always by a merge join: hits grow with the data, and one plan should hold at every size
    members = save_table(rows.join(hits.hint("merge"), "digest"))
    kept = members.where("file = keep_file AND row = keep_row").select(
        "digest", F.col("text").alias("kept_text"))
    return save_table(members.join(kept, "digest").where("text <> kept_text")
                      .select("digest", "doc_id", "file", "row", "text"))


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               digest: Callable[[Column], Column] = sha256,
               files_per_batch: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, file, row: one row per row of `docs`.

    Texts are equal when identical; a null text equals an empty one.  Of equal texts one row
    stays: that with the largest id, among equal or null ids the last in place.  An empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/exact-{uuid.uuid4().hex}"
    rows = located(docs, doc_id, text, digest)
    rows.drop("text").write.parquet(f"{folder}/log")
    groups = save_table(follow(spark, f"{folder}/log", f"{folder}/state", files_per_batch))
    log = spark.read.parquet(f"{folder}/log")
    joined = log.join(groups, "digest")
    odd = unequal(rows, groups)
    if not odd.isEmpty():           # two texts with one digest: group these by the text itself
        own = odd.groupBy("digest", "text").agg(
            F.max(F.struct("doc_id", "file", "row")).alias("last"),
            F.count(F.lit(1)).alias("own_n"))
        own = (odd.select("digest", "text", "file", "row").join(own, ["digest", "text"])
               .drop("digest", "text"))
        fewer = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("odd_n"))
        joined = (joined.join(fewer, "digest", "left").join(own, ["file", "row"], "left")
                  .withColumn("n", F.coalesce("own_n", F.col("n") - F.coalesce("odd_n",
                                                                             F.lit(0)))))
        for k, f in (("keep_id", "doc_id"), ("keep_file", "file"), ("keep_row", "row")):
            joined = joined.withColumn(k, F.when(F.col("own_n").isNull(), F.col(k))
                                       .otherwise(F.col(f"last.{f}")))
    return joined.select("doc_id", "keep_id", F.col("n").alias("group_size"),
                         F.expr("file = keep_file AND row = keep_row").alias("kept"),
                         F.lower(F.hex("digest")).alias("digest"), "file", "row")


def distinct_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns unchanged."""
    try:
        docs.select(docs.metadataColumn("_metadata"))
    except AnalysisException:
        docs = save_table(docs)
    gone = save_table(duplicates(docs, doc_id, text).where("NOT kept")
                      .select(F.col("file").alias("_f"), F.col("row").alias("_r")))
    at = docs.metadataColumn("_metadata")
    return docs.join(gone, (at["file_path"] == gone["_f"]) & (at["row_index"] == gone["_r"]),
                     "left_anti")
