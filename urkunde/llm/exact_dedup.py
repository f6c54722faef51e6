"""Exact duplicates by a stream with keyed state on disk.

Digests of all rows go through a streaming aggregation whose state, in RocksDB and without expiry, keeps for
each digest the number of rows, the identifier of the row that stays and where its content is (its row
number in the staged table, which holds the texts). Further batches may follow into the same state. On hits, and
only there, the full bytes are compared; rows whose digest agrees but not their bytes are grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, keep_rows, may_have, release, remove, staged, text_of, work_dir

#: The state lives in RocksDB. No space is set aside for its files, and its memory is bounded and given back when a task ends.
STREAMING = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def absorb(rows: DataFrame, folder: str, state: str) -> DataFrame:
    """Runs the rows of `folder` (digest, id, row) that the state has not seen through it; gives the state: digest, n, keep."""
    spark = rows.sparkSession
    was = {k: spark.conf.get(k, None) for k in STREAMING}
    for k, v in STREAMING.items():
        spark.conf.set(k, v)
    try:
        (
            spark.readStream.schema(rows.schema)
            .parquet(folder)
            .groupBy("digest")
            .agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("keep"))
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
        found = spark.read.format("statestore").load(state)
        fields = found.schema["value"].dataType.names
        return cut(found.select(F.col("key.digest").alias("digest"), F.col(f"value.`{fields[0]}`").alias("n"), F.col(f"value.`{fields[1]}`").alias("keep")))
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def groups(df: DataFrame, id_column: str, text: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """id, text_sha256, keep_id, group_size, kept for each row of df; see duplicates()."""
    spark, folders = df.sparkSession, []
    own = df.select(digest(text_of(text)).alias("digest"), F.col(f"`{id_column}`").alias("id"), sha256(text_of(text)).alias("sha"), text_of(text).alias("text"))
    rows = staged(own.withColumn("row", F.monotonically_increasing_id()), folders, "digests")
    folders.append(work_dir(spark, "state"))
    known = absorb(rows.select("digest", "id", "row"), folders[0], folders[1])
    total = known.agg(F.sum("n")).first()[0] or 0
    several = known.filter("n > 1")

    # Only texts of hits move. A group's texts are the one at the state's locator if the least and the greatest are
    # the same bytes; copies meet before the shuffle.
    hits = may_have(rows.select("digest", "text"), F.col("digest"), F.col("digest"), several).filter("may")
    bytes_of = hits.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    differ = cut(bytes_of.filter("least <> greatest").join(several, "digest", "left_semi").select("digest"))
    release(spark)

    narrow = rows.select("digest", "id", "row", "sha")
    hot = F.broadcast(several.filter(F.col("n") > max(1, int(total * HOT_SHARE))))
    rest = several.filter(F.col("n") <= max(1, int(total * HOT_SHARE)))
    found = narrow.join(hot, "digest").unionByName(
        narrow.join(hot, "digest", "left_anti").join(rest, "digest", "left"), allowMissingColumns=True
    )
    if not differ.isEmpty():
        texts = rows.select("digest", "id", "row", "text").join(differ, "digest", "left_semi")
        apart = texts.join(
            texts.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("keep")), ["digest", "text"]
        ).select("row", "n", "keep")
        found = found.join(differ, "digest", "left_anti").unionByName(narrow.join(differ, "digest", "left_semi").join(apart, "row"))
    out = cut(
        found.select(
            "id",
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            (F.col("n").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
    for folder in folders:
        remove(spark, folder)
    return out


def duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of df: the id, keep_id (id of the row that stays), group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id
    stays (null is the smallest); of rows with the same id and text, one. An empty table gives an empty
    result. Other columns of df are not read. The texts are staged once, and only those of hits are shuffled.
    Copies of one text may be any share of the rows: they are counted before the shuffle, and texts that hold over
    a thousandth of all rows are joined by broadcast.
    """
    return groups(df, id_column, text, digest).withColumnRenamed("id", id_column)


def deduplicate(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with df's columns; see duplicates()."""
    found = groups(df, id_column, text)
    decided = found.filter("group_size > 1").select("id", F.col("text_sha256").alias("node"), "kept")
    return keep_rows(df, decided, id_column, sha256(text_of(text)))
