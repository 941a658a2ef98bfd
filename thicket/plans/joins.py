"""Joins that look up a unique key from rows whose keys may be heavily skewed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: A key with more rows than this on the left side is spread over ``FANOUT`` tasks.
HOT_ROWS = 1_000_000
FANOUT = 64


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All keys with more than ``hot_rows`` rows, as a written table of one column.

    Counts are combined before the shuffle.
    """
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > hot_rows) & F.col(key).isNotNull())
    return materialize(found.select(F.col(key).alias("__hot")), "hot")


#: Id frames up to this many rows (some tens of megabytes) may be broadcast.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, name: str = "ids", rows: int = BROADCAST_ROWS) -> DataFrame:
    """A slim frame written once and, only if its counted size allows, marked for
    broadcast. The other side (often node texts) then need not be shuffled;
    beyond the limit the join stays an ordinary shuffle join."""
    kept = materialize(df, name)
    return F.broadcast(kept) if kept.count() <= rows else kept


def dealt(df: DataFrame, read: bool = False) -> DataFrame:
    """Rows dealt out to as many tasks as a shuffle has, for work that takes longer than moving
    its rows: a table of short texts is a small file, which few tasks read. With ``read`` a frame
    that reads no files stays in the tasks that its maker gave it."""
    if read and not df.inputFiles():
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    fanout: int = FANOUT,
    check: bool = True,
) -> DataFrame:
    """Join ``left`` to the rows of ``right`` with ``left_key = right_key``.

    ``right_key`` is unique (or nearly so) in ``right``. Hot left keys are
    salted over ``fanout`` partitions and only their right rows are copied, so
    one key holding a third of ``left`` does not end in one task. Finding hot
    keys reads the key column of ``left`` once; with ``check`` off the join is
    left to the engine's own skew handling (for lefts that are dear to compute).
    """
    hot = hot_keys(left, left_key, hot_rows) if check else None
    n_hot = hot.count() if check else 0
    if not n_hot:
        return left.join(right, F.col(left_key) == F.col(right_key), how)
    hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if c != left_key]), F.lit(fanout))
    lsalt = left.join(hot, F.col(left_key) == F.col("__hot"), "left")
    lsalt = lsalt.withColumn("__salt", F.when(F.col("__hot").isNotNull(), spread).otherwise(F.lit(0)).cast("int")).drop("__hot")
    copies = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(fanout - 1))).otherwise(F.array(F.lit(0)))
    rsalt = right.join(hot, F.col(right_key) == F.col("__hot"), "left").withColumn("__rsalt", F.explode(copies)).drop("__hot")
    cond = (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__rsalt"))
    return lsalt.join(rsalt, cond, how).drop("__salt", "__rsalt")
