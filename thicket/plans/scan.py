"""Ordered running aggregates whose groups may be far larger than one task.

A plain window puts a whole group into one task. Here rows are cut into ordered
buckets, the window runs per (group, bucket), and a small table with one row per
(group, bucket) carries the totals of the earlier buckets. sum, count, max, min
and last are associative, so the result equals that of the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_BUCKET = "__bucket"


@dataclass(frozen=True)
class Running:
    """One running value: ``op`` over ``expr`` up to the row (or just before it)."""

    op: str  # sum | count | max | min | last
    expr: Column
    exclusive: bool = False


def _window_agg(op: str, col: Column) -> Column:
    if op == "last":
        return F.last(col, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[op](col)


def _merge(op: str, carry: Column, local: Column) -> Column:
    if op == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if op == "count":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if op == "max":
        return F.greatest(carry, local)
    if op == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    outputs: dict[str, Running],
    bucket: Column | None = None,
    cheap: bool = False,
) -> DataFrame:
    """Add ``outputs`` to ``df``: running values per ``keys`` in ``order``.

    ``order`` must be total within a group. ``bucket`` may give a deterministic
    value that never decreases along ``order`` (such as ``offset div 100000``).
    Without it the rows are range-partitioned, so that every bucket fits a task.
    The rows are needed twice, so they are written once to the shared folder;
    ``cheap`` with a ``bucket`` skips that for inputs that cost little to redo.
    """
    if bucket is None:
        ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
        cut = materialize(ranged.withColumn(_BUCKET, F.spark_partition_id()), "ranges")
    else:
        cut = df.withColumn(_BUCKET, bucket)
        cut = cut if cheap else materialize(cut, "buckets")
    group = [*keys, _BUCKET]
    local = Window.partitionBy(*group).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    whole = local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    inner = cut
    for name, run in outputs.items():
        inner = inner.withColumn(
            f"__l_{name}", _window_agg(run.op, run.expr).over(before if run.exclusive else upto)
        )
    # The bucket totals need no ordered window except for "last".
    totals_src = cut
    aggs = []
    for name, run in outputs.items():
        if run.op == "last":
            totals_src = totals_src.withColumn(f"__t_{name}", _window_agg("last", run.expr).over(whole))
            aggs.append(F.first(f"__t_{name}").alias(f"__c_{name}"))
        else:
            aggs.append(_window_agg(run.op, run.expr).alias(f"__c_{name}"))
    totals = totals_src.groupBy(*group).agg(*aggs)
    # One row per (group, bucket): small even for a group of any size.
    carry_w = (
        (Window.partitionBy(*keys) if keys else Window.partitionBy())
        .orderBy(_BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals
    for name, run in outputs.items():
        op = "sum" if run.op == "count" else run.op
        carry = carry.withColumn(f"__c_{name}", _window_agg(op, F.col(f"__c_{name}")).over(carry_w))
    joined = inner.join(carry, group, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            _merge(run.op, F.col(f"__c_{name}"), F.col(f"__l_{name}")).alias(name)
            for name, run in outputs.items()
        ],
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "rn", bucket: Column | None = None,
    cheap: bool = False,
) -> DataFrame:
    """``row_number`` per ``keys`` in ``order`` for groups of any size (1-based)."""
    out = running(df, keys, order, {name: Running("count", F.lit(1))}, bucket, cheap)
    return out.withColumn(name, F.col(name).cast("long"))
