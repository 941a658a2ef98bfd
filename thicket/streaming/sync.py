"""Change feeds: pending edits saved in batches, newest file versions followed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sync import CHANGE_DDL, coalesce_pending, fold_changes
from ..session import materialize, shared_dir
from ..sources.versions import write_changes

CHANGE_SCHEMA = "event_id long, ts timestamp_ntz, node_id long, kind string, snapshot string"


def merge_pending(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pending rows of two periods as one: flags merge with OR, removal wins."""
    return _merged(a.unionByName(b))


def _merged(saved: DataFrame) -> DataFrame:
    merged = saved.groupBy("node_id").agg(
        F.bool_or("prop").alias("prop"), F.bool_or("buff").alias("buff"), F.bool_or("hier").alias("hier"),
        F.bool_and("is_update").alias("is_update"), F.bool_or("removed").alias("removed"),
    )
    keep = ~F.col("removed")
    return merged.select("node_id", *[(F.col(c) & keep).alias(c) for c in ("prop", "buff", "hier")], "is_update", "removed")


def stream_sync(
    changes: DataFrame, out: str, trigger: dict | None = None, checkpoint: str | None = None
) -> StreamingQuery:
    """Save dirty nodes periodically.

    Each micro-batch is merged to one row per node and written under its batch
    id, so a batch replayed after a failure replaces itself. ``trigger`` is that
    of ``writeStream.trigger``; the default saves once a minute.
    """
    spark = changes.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        coalesce_pending(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        changes.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/thicket-stream-{uuid.uuid4().hex}")
        .trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )


def stream_to_store(
    changes: DataFrame, root: str, feed: str, trigger: dict | None = None, checkpoint: str | None = None
) -> StreamingQuery:
    """Apply changes to the versioned store under ``root`` as they come; a version per micro-batch.

    ``changes`` has the columns of ``CHANGE_DDL``, each batch later than the one before. The
    store's manifest holds the last batch of ``feed``: one that is replayed after a failure
    changes nothing, and one that failed half-way has left no trace in the store. ``feed`` is
    to be new if the checkpoint is, as batch numbers start again with it.
    """
    spark = changes.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        write_changes(spark, root, *fold_changes(batch), feed=feed, batch_id=batch_id)

    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/thicket-stream-{uuid.uuid4().hex}")
        .trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Change files with contents (``CHANGE_DDL``) as a stream."""
    return spark.readStream.schema(CHANGE_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def pending_of_batches(spark: SparkSession, out: str) -> DataFrame:
    """All saved batches merged: what a store has to write."""
    return _merged(spark.read.option("recursiveFileLookup", "true").parquet(out))


def change_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Change log files as a stream."""
    return spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest_versions(files: DataFrame, read_only: DataFrame | None = None) -> DataFrame:
    """Newest row per path by modification time; rows of read-only nodes are refused.

    ``files``: path, node_id, mtime, content.
    """
    if read_only is not None:
        files = files.join(read_only.select("node_id").distinct(), "node_id", "left_anti")
    newest = F.max_by(F.struct("node_id", "mtime", "content"), F.struct("mtime", "content"))
    return files.groupBy("path").agg(newest.alias("v")).select("path", "v.node_id", "v.mtime", "v.content")


def stream_latest_version(
    files: DataFrame, out: str, read_only: DataFrame | None = None, trigger: dict | None = None, checkpoint: str | None = None
) -> StreamingQuery:
    """Keep the newest version of each path as files change.

    Batches write their own winners; :func:`latest_of_batches` picks among them.
    """
    spark = files.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        latest_versions(batch, read_only).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        files.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/thicket-stream-{uuid.uuid4().hex}")
        .trigger(**(trigger or {"processingTime": "5 seconds"})).start()
    )


def latest_of_batches(spark: SparkSession, out: str) -> DataFrame:
    return latest_versions(spark.read.option("recursiveFileLookup", "true").parquet(out))


def watched_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as a stream: path, node_id (NULL), mtime, content. Each path is taken once."""
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    )
    return files.select("path", F.lit(None).cast("long").alias("node_id"), F.col("modificationTime").alias("mtime"), "content")


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.withColumnRenamed("modificationTime", "mtime")


_KNOWN = "path string, node_id long, mtime timestamp, length long, content binary, gone boolean"


def _saved(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """What polls have saved, or those before one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.listStatus(place):
        return spark.createDataFrame([], f"{_KNOWN}, poll int")
    saved = spark.read.schema(_KNOWN + ", poll int").option("basePath", out).parquet(out)
    return saved if before is None else saved.where(F.col("poll") < before)


def _newest(saved: DataFrame, *columns: str) -> DataFrame:
    """The last row of each path; only the columns named are read."""
    return saved.groupBy("path").agg(F.max_by(F.struct(*columns), "poll").alias("v")).select("path", "v.*")


def poll_versions(spark: SparkSession, folder: str, out: str, poll: int, nodes: DataFrame | None = None, read_only: DataFrame | None = None, pattern: str = "*") -> int:
    """Looks at a folder once and saves, as poll number ``poll``, the files that are new, changed or gone; how many.

    Paths, times and lengths are listed without contents and held against what earlier polls
    have saved; contents are read of files no older than the oldest change, and kept of those
    that changed. A poll that is repeated replaces itself. ``nodes`` (path, node_id) names the
    nodes that hold the files; those of ``read_only`` nodes are refused.
    """
    listed = _files(spark, folder, pattern).select("path", "mtime", "length")
    known = _newest(_saved(spark, out, poll), "mtime", "length", "gone").select("path", F.col("mtime").alias("was"), F.col("length").alias("was_length"), "gone")
    both = listed.join(known, "path", "full")
    came = F.col("mtime").isNotNull() & (F.col("was").isNull() | F.col("gone") | (F.col("mtime") > F.col("was")) | (F.col("length") != F.col("was_length")))
    went = F.col("mtime").isNull() & ~F.coalesce("gone", F.lit(False))
    changed = materialize(both.where(came | went).select("path", "mtime", "length", went.alias("gone")), "changed")
    if nodes is not None:
        changed = changed.join(nodes.select("path", "node_id"), "path", "left")
    else:
        changed = changed.withColumn("node_id", F.lit(None).cast("long"))
    if read_only is not None:
        changed = changed.join(read_only.select("node_id").distinct(), "node_id", "left_anti")
    first = changed.agg(F.min("mtime")).head()[0]
    texts = _files(spark, folder, pattern).where(F.col("mtime") >= F.lit(first)).select("path", "content") if first is not None else spark.createDataFrame([], "path string, content binary")
    rows = materialize(changed.join(texts, "path", "left").select("path", "node_id", "mtime", "length", "content", "gone"), "changed")
    n = rows.count()
    if n:
        rows.write.mode("overwrite").parquet(f"{out}/poll={poll}")
    return n


def latest_files(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of each file that is still there: path, node_id, mtime, content."""
    return _newest(_saved(spark, out), "node_id", "mtime", "content", "gone").where("NOT gone").drop("gone")


def watch_versions(
    spark: SparkSession, folder: str, out: str, nodes: DataFrame | None = None, read_only: DataFrame | None = None, pattern: str = "*",
    trigger: dict | None = None, checkpoint: str | None = None,
) -> StreamingQuery:
    """:func:`poll_versions` at each trigger, every 5 seconds by default, also of files that are overwritten.

    The batch number is that of the poll, so one that is replayed after a failure replaces itself.
    """

    def save(_: DataFrame, batch_id: int) -> None:
        poll_versions(spark, folder, out, batch_id, nodes, read_only, pattern)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint or f"{shared_dir(spark)}/thicket-stream-{uuid.uuid4().hex}")
        .trigger(**(trigger or {"processingTime": "5 seconds"})).start()
    )
