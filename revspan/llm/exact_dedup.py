"""Exact deduplication as a stream with keyed state on disk.

A streaming aggregation keeps one entry per digest in RocksDB, without watermark and so without
expiry: how many rows had it, and of the row to keep the stable identifier and the content
locator (file and row number in it). State and offsets live in a shared folder, so a stream that
is started again goes on where it stopped and reads new files only. Digests seen more than once
are hits: their rows are compared byte for byte with the content at the locator, and rows that
only share the digest are grouped again by their whole text. All of it is DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from revspan.llm.common import checkpointed, marked, shared_folder, shuffle_partitions

MAX_AGE = "36500d"  # the file source ignores new files that are older than the newest by more (7 days by default)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # An idle store keeps 4 MB of disk; a run over all available files needs each store once.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; NULL counts as empty.

    lower() does just that where all characters are ASCII; elsewhere it would change other letters."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def _located(docs: DataFrame) -> DataFrame:
    """doc_id, content and the locator of every row of a scan of files."""
    return docs.select(
        F.col("doc_id").cast("long"), normalised(F.col("text")).alias("content"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"),
    )


def _stream_path(spark: SparkSession, path: str) -> str:
    """path for a stream of files: a folder as it is; a single file as a pattern that only its name meets."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(place).isDirectory():
        return path
    name = "".join(f"\\{c}" if c in "{}[]*?\\," else c for c in place.getName()[1:])
    return f"{place.getParent()}/[{place.getName()[0]}]{name}"


def state_partitions(parts: int) -> int:
    """State stores for a session of so many shuffle partitions: an entry is much smaller than a text, and each store
    costs files at every commit and read."""
    return max(1, parts // 4)


def update_state(spark: SparkSession, path: str, schema: StructType, state: str, digest=digest) -> None:
    """Read the Parquet files under path that the state has not seen, and update its entries.

    path may be a folder or a single file. state is a folder that all executors share."""
    session = spark.newSession()
    for key, value in {**_STATE, "spark.sql.shuffle.partitions": str(state_partitions(shuffle_partitions(spark)))}.items():
        session.conf.set(key, value)
    rows = _located(session.readStream.schema(schema).option("maxFileAge", MAX_AGE).parquet(_stream_path(spark, path)))
    entries = rows.groupBy(digest(F.col("content")).alias("digest")).agg(
        F.max(F.struct("doc_id", "file", "place")).alias("keep"), F.count("*").alias("n"))
    query = entries.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option(
        "checkpointLocation", state).start()
    query.awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """digest, keep (doc_id, file, place) and n of every entry."""
    entries = spark.read.format("statestore").load(state)
    (key,), (keep, n) = (entries.schema[side].dataType.names for side in ("key", "value"))
    return entries.select(
        F.col("key")[key].alias("digest"), F.col("value")[keep].alias("keep"), F.col("value")[n].alias("n"))


def _collisions(docs: DataFrame, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Digests of which some row differs from the content at the entry's locator.

    Only hits are compared: their texts are fetched by locator once, and meet by digest."""
    is_kept = (F.col("file") == F.col("keep.file")) & (F.col("place") == F.col("keep.place"))
    hits = checkpointed(rows.join(entries.where("n > 1"), "digest").select("digest", "file", "place", is_kept.alias("is_kept")))
    place = ["file", "place"]
    near = marked(_located(docs).drop("doc_id"), hits, place, place, "may_hit").where("may_hit").drop("may_hit")
    texts = checkpointed(near.join(hits, ["file", "place"]).select("digest", "content", "is_kept"))
    kept = texts.where("is_kept").select("digest", F.col("content").alias("original"))
    return texts.where("not is_kept").join(kept, "digest").where("content <> original").select("digest").distinct()


def exact_dedup(spark: SparkSession, path: str, state: str, digest=digest) -> DataFrame:
    """Per row of the Parquet files under path: doc_id, digest, keep_id, group_size, kept.

    Rows are equal when their texts are after lower-casing A-Z (NULL counts as empty). Of equal rows
    the one with the largest doc_id stays, a NULL doc_id being the smallest; among rows with the
    same doc_id too, the last by file and place. keep_id is its doc_id. Other columns are not read.
    An empty table gives no rows. digest may be any function of the content: equality never rests on it."""
    docs = spark.read.parquet(path)
    update_state(spark, path, docs.select("doc_id", "text").schema, state, digest)
    entries = read_state(spark, state)
    rows = checkpointed(_located(docs).withColumn("digest", digest(F.col("content"))).drop("content"))
    collided = checkpointed(_collisions(docs, rows, entries))
    if collided.isEmpty():
        grouped = rows.join(entries, "digest")
    else:
        sure = rows.join(collided, "digest", "left_anti").join(entries, "digest")
        unsure = _located(docs).withColumn("digest", digest(F.col("content"))).join(collided, "digest", "left_semi")
        regrouped = unsure.groupBy("digest", "content").agg(
            F.max(F.struct("doc_id", "file", "place")).alias("keep"), F.count("*").alias("n"))
        grouped = sure.unionByName(unsure.join(regrouped, ["digest", "content"]).drop("content"))
    return grouped.select(
        "doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("file") == F.col("keep.file")) & (F.col("place") == F.col("keep.place"))).alias("kept"),
    )


def state_folder(spark: SparkSession) -> str:
    """A new folder for a stream's state in the shared folder."""
    return f"{shared_folder(spark)}/exact-dedup-{uuid.uuid4().hex}"
