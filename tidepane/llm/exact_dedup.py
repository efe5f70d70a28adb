"""Exact deduplication as a stateful stream (operator 5).

A file stream is aggregated by digest in update mode. Its keyed state lives in RocksDB (on disk,
snapshots in the shared checkpoint folder), never expires, and holds per digest: the stable
identifier that stays (the largest ``doc_id``), the content locator of that row (file and row in
the file) and the number of rows. The digest is aggregated before the shuffle, so a text that a
third of all rows share costs one row per task. Rows whose digest was hit are then compared byte
by byte with the content found at the locator; rows that differ although their digests agree form
groups of their own.

Defined results: null text counts as empty; null ``doc_id`` is smaller than any other; of rows
equal in text and id, the one whose locator is largest stays; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepane.sources.shared import fresh_path, stage

#: State on disk; small write buffers, and no space reserved ahead for files that stay small.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "16",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(df: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(
        digest(text).alias("digest"),
        F.struct(
            F.col("doc_id").alias("id"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("who"),
        text.alias("text"),
    )


def digest_state(
    spark: SparkSession, path: str, schema: T.StructType, digest: Callable[[Column], Column] = sha256,
    checkpoint: str | None = None, max_files: int | None = None,
) -> DataFrame:
    """Run the stream over all files below ``path``: one row per digest with ``best`` and ``size``.

    A later call with the same ``checkpoint`` only reads files that have come since.
    """
    checkpoint = checkpoint or fresh_path(spark, "dedup-stream")
    session = spark.newSession()
    for name, value in STATE_STORE.items():
        session.conf.set(name, value)
    reader = session.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # As a pattern that only fits itself, the path may name a folder or a single file.
    exact = f"{path[:-1]}[{path[-1]}]"
    state = (
        _rows(reader.parquet(exact), digest).groupBy("digest")
        .agg(F.max("who").alias("best"), F.count(F.lit(1)).alias("size"))
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{checkpoint}/changes/batch={number}")

    query = (
        state.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    written = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/changes")
    if not written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(written):
        return spark.createDataFrame([], state.schema)  # there was no file
    # A digest's later rows in the log of changes have more members and a larger identifier.
    changes = spark.read.schema(state.schema).parquet(f"{checkpoint}/changes")
    return changes.groupBy("digest").agg(F.max("best").alias("best"), F.max("size").alias("size"))


def exact_groups(
    spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, **stream: object
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, digest``."""
    table = spark.read.parquet(path)
    schema = T.StructType([f for f in table.schema if f.name in ("doc_id", "text")])
    state = stage(digest_state(spark, path, schema, digest, **stream), "dedup-state")
    rows = _rows(table, digest)

    hits = state.where("size > 1")
    found = rows.join(hits, "digest")
    content = found.where(F.col("who") == F.col("best")).select("digest", F.col("text").alias("content"))
    differs = stage(
        found.join(content, "digest").where(F.col("text").cast("binary") != F.col("content").cast("binary"))
        .select("digest", "who", "text"),
        "dedup-collisions",
    )
    # Groups of texts that only share their digest with the content that was kept; rarely any.
    apart = differs.groupBy("digest", "text").agg(F.max("who").alias("b"), F.count(F.lit(1)).alias("n"))
    apart_rows = differs.join(apart, ["digest", "text"]).select("digest", "who", "b", "n")
    lost = differs.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))

    plain = (
        rows.select("digest", "who").join(state, "digest")
        .join(lost, "digest", "left").join(apart_rows, ["digest", "who"], "left")
    )
    best = F.coalesce("b", "best")
    return plain.select(
        F.col("who.id").alias("doc_id"),
        best["id"].alias("keep_id"),
        F.coalesce("n", F.col("size") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        (F.col("who") == best).alias("kept"),
        "digest",
    )
