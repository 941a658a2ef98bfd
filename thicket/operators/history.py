"""Bounded histories over log tables: snapshots, visits, recent items, backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import BACKUPS_KEPT, UNDO_LIMIT
from ..plans.scan import Running, running


def _newest(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "age") -> DataFrame:
    """The newest ``k`` rows per key with their age, 0 for the newest.

    The filter on row_number lets every map task drop all but its own k newest
    rows of a key before the shuffle, so a hot key stays small.
    """
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return df.withColumn(name, rn).where(F.col(name) <= k).withColumn(name, (F.col(name) - 1).cast("long"))


def history(log: DataFrame, limit: int = UNDO_LIMIT) -> DataFrame:
    """Snapshots per node without equal neighbours, newest ``limit`` kept.

    ``log``: node_id, ts, event_id, snapshot.
    """
    seen = running(
        log, ["node_id"], [F.col("ts"), F.col("event_id")],
        {"prev": Running("last", F.struct("snapshot"), exclusive=True)},
    )
    kept = seen.where(F.col("prev").isNull() | ~F.col("prev.snapshot").eqNullSafe(F.col("snapshot"))).drop("prev")
    return _newest(kept, ["node_id"], [F.col("ts"), F.col("event_id")], limit)


def undo_at(hist: DataFrame, k: int) -> DataFrame:
    """State ``k`` undos back per node; the oldest kept state when there are fewer."""
    oldest = hist.groupBy("node_id").agg(F.max("age").alias("oldest"))
    return hist.join(oldest, "node_id").where(F.col("age") == F.least(F.lit(k), F.col("oldest"))).drop("oldest")


def redo_at(hist: DataFrame, undone: int, k: int) -> DataFrame:
    """State reached by ``k`` redos after ``undone`` undos."""
    oldest = hist.groupBy("node_id").agg(F.max("age").alias("oldest"))
    at = F.greatest(F.least(F.lit(undone), F.col("oldest")) - k, F.lit(0))
    return hist.join(oldest, "node_id").where(F.col("age") == at).drop("oldest")


def push_after_undo(hist: DataFrame, undone: int, new: DataFrame, limit: int = UNDO_LIMIT) -> DataFrame:
    """History after ``undone`` undos and one new state per node of ``new``.

    The undone states are cut for those nodes; ``new``: node_id, ts, event_id, snapshot.
    """
    oldest = hist.groupBy("node_id").agg(F.max("age").alias("oldest"))
    marked = hist.join(oldest, "node_id").join(new.select(F.col("node_id"), F.lit(True).alias("__new")), "node_id", "left")
    cut = F.coalesce("__new", F.lit(False)) & (F.col("age") < F.least(F.lit(undone), F.col("oldest")))
    cols = ["node_id", "ts", "event_id", "snapshot"]
    return _newest(marked.where(~cut).select(*cols).unionByName(new.select(*cols)), ["node_id"], [F.col("ts"), F.col("event_id")], limit)


def visited(log: DataFrame) -> DataFrame:
    """Visited nodes, each at its last visit; order by ``last_event`` for the list."""
    last = log.groupBy("node_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.select("node_id", F.col("m.ts").alias("last_ts"), F.col("m.event_id").alias("last_event"))


def recent(log: DataFrame, item: str, n: int) -> DataFrame:
    """The ``n`` most recent distinct items, newest first: a top-n, not a full sort."""
    last = log.groupBy(item).agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return last.orderBy(F.col("m").desc()).limit(n).select(item, F.col("m.event_id").alias("last_event"))


def rotate_backups(versions: DataFrame, keep: int = BACKUPS_KEPT) -> DataFrame:
    """Newest ``keep`` versions per path, named by age with ``~`` suffixes.

    ``versions``: path, ts, version.
    """
    kept = _newest(versions, ["path"], [F.col("ts"), F.col("version")], keep)
    return kept.withColumn("backup_name", F.concat("path", F.array_join(F.array_repeat(F.lit("~"), (F.col("age") + 1).cast("int")), "")))
