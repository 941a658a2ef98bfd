"""Stores kept as versions: tables in buckets of node_id, and a manifest per version.

Texts are a table of their own that nodes name them in, so copies are kept once; a change adds its texts.
A change rewrites the buckets that hold its nodes; the new manifest points to those and, for
the rest, to the files of earlier versions. A version counts once its manifest has its final
name, which one rename gives it; files of an attempt that failed are pointed to by none.
Readers hold on to the version they have opened.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TABLES
from ..operators.merge import store_diff
from ..operators.object_index import INDEX_DDL, ObjectIndex, build_index
from ..plans.joins import sized
from ..session import materialize
from .store import ROW_DDL, TEXT_DDL, Store, align_schema, join_texts, named_texts, plain_parts, schema_of, split_texts

#: Buckets of each table; fixed when a store is created. A manifest lists so many folders per table at most.
BUCKETS = 256
_BUCKET = "bucket"


@dataclass(frozen=True)
class Version:
    """A version's number, the last batch of each feed that is in it, and the folder of each table's buckets."""

    number: int
    buckets: int
    folders: dict[str, dict[int, str]]
    batches: dict[str, int] = field(default_factory=dict)


def _bucket_of(buckets: int):
    return F.pmod(F.xxhash64(F.col("node_id").cast("long")), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    """A path and its file system, in whatever store it is."""
    out = spark._jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def version_numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions under ``root``, oldest first."""
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{root}/manifests") if n.endswith(".json"))


def open_version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version, the newest by default."""
    if number is None:
        known = version_numbers(spark, root)
        if not known:
            raise FileNotFoundError(f"no version under {root}")
        number = known[-1]
    text = spark.read.option("wholetext", True).text(f"{root}/manifests/{number:012d}.json").head()[0]
    said = json.loads(text)
    return Version(said["number"], said["buckets"], {t: {int(b): f for b, f in held.items()} for t, held in said["folders"].items()}, said["batches"])


def _commit(spark: SparkSession, root: str, version: Version) -> Version:
    """Gives a version its name; fails if another writer has taken the number."""
    text = json.dumps({"number": version.number, "buckets": version.buckets, "folders": version.folders, "batches": version.batches})
    draft, fs = _path(spark, f"{root}/manifests/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    final, _ = _path(spark, f"{root}/manifests/{version.number:012d}.json")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    never_over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(draft, final, never_over)
    return version


def _write(spark: SparkSession, root: str, table: str, rows: DataFrame, buckets: int) -> dict[int, str]:
    """Writes rows by bucket; the folder of each bucket that has any. Large buckets are split over tasks."""
    folder = f"data/{table}/{uuid.uuid4().hex}"
    rows.withColumn(_BUCKET, _bucket_of(buckets)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{root}/{folder}")
    made = [n for n in _names(spark, f"{root}/{folder}") if n.startswith(f"{_BUCKET}=")]
    return {int(n.split("=")[1]): f"{folder}/{n}" for n in made}


def _write_texts(spark: SparkSession, root: str, texts: DataFrame, number: int) -> dict[int, str]:
    """Writes the texts that version ``number`` adds; their folder by that number."""
    folder = f"data/text/{uuid.uuid4().hex}/{_BUCKET}={number}"
    texts.write.parquet(f"{root}/{folder}")
    return {number: folder}


_PLAIN_DDL = INDEX_DDL | {"text": TEXT_DDL, "rows": ROW_DDL}


def _schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_PLAIN_DDL[table]) if table in _PLAIN_DDL else schema_of(table)


def _parts(spark: SparkSession, root: str, version: Version, only: set[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Node rows of a version, or of those of its buckets, and its texts."""
    if "text" not in version.folders:  # written when rows still held their texts
        return split_texts(_read(spark, root, version, "node", only))
    return _read(spark, root, version, "node", only, "rows"), _read(spark, root, version, "text")


def _parts_of(spark: SparkSession, root: str, version: Version, only: set[int]) -> tuple[DataFrame, DataFrame]:
    """Node rows of some buckets, and the texts that they name; others aren't moved."""
    rows, texts = _parts(spark, root, version, only)
    return rows, texts.join(sized(rows.select("text_id").distinct(), "text-ids"), "text_id", "left_semi")


def create_versions(store: Store, root: str, buckets: int = BUCKETS, indexed: bool = True) -> Version:
    """Writes a store as the first version under ``root``, with the index of its objects unless ``indexed`` is off."""
    spark = store.node.sparkSession
    rows, texts = plain_parts(store)
    tables = store.tables() | {"node": rows.drop("stored")}
    folders = {name: _write(spark, root, name, df if name == "node" else align_schema(df, schema_of(name)), buckets) for name, df in tables.items()}
    folders["text"] = _write_texts(spark, root, named_texts(rows, texts), 1)
    if indexed:
        index = build_index(store)
        folders |= {name: _write(spark, root, name, getattr(index, name), buckets) for name in INDEX_DDL}
    return _commit(spark, root, Version(1, buckets, folders))


def _read(spark: SparkSession, root: str, version: Version, table: str, only: set[int] | None = None, schema: str | None = None) -> DataFrame:
    """A table of a version, or those of its buckets; columns and rows are pruned as in any Parquet table."""
    held = version.folders[table]
    paths = [f"{root}/{f}" for b, f in sorted(held.items()) if only is None or b in only]
    schema = _schema(schema or table)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, root: str, number: int | None = None) -> Store:
    """The store as of a version, the newest by default."""
    version = open_version(spark, root, number)
    store = Store(**{t: _read(spark, root, version, t) for t in TABLES})
    return store.with_parts(*_parts(spark, root, version)) if "text" in version.folders else store


def read_index(spark: SparkSession, root: str, number: int | None = None) -> ObjectIndex:
    """The places of a version's objects, as kept with it."""
    version = open_version(spark, root, number)
    return ObjectIndex(*[_read(spark, root, version, t) for t in ("place", "step")])


def write_changes(spark: SparkSession, root: str, pending: DataFrame, changed: Store, feed: str | None = None, batch_id: int | None = None) -> Version:
    """The next version: ``pending`` nodes written from ``changed``.

    ``pending`` is what :func:`coalesce_pending` gives: node_id, prop, buff, hier, is_update,
    removed. prop writes the properties, buff the text and the objects, hier the place in the
    tree; removed nodes go from all tables. A node that is no update (``is_update`` false)
    replaces all that the store has of it. Updates of nodes that the store doesn't have are
    ignored, as a removal cancels them. Bookmarks go with a removal, also (column ``dropped``)
    if the node was created again after it. A batch that ``feed`` has in the store already changes
    nothing, so batches may be replayed.

    Reads and writes the buckets of those nodes alone, and of the index those whose texts or
    objects change.
    """
    now = open_version(spark, root)
    if feed is not None and now.batches.get(feed, -1) >= batch_id:
        return now
    if "dropped" not in pending.columns:
        pending = pending.withColumn("dropped", F.col("removed"))
    pending = materialize(pending.withColumn(_BUCKET, _bucket_of(now.buckets)), "pending")
    all_buckets = {r[0] for r in pending.select(_BUCKET).distinct().collect()}
    known = _read(spark, root, now, "children", all_buckets).select("node_id", F.lit(True).alias("known"))
    live = pending.join(known, "node_id", "left").where("known OR NOT is_update OR removed")
    live = sized(live.select("node_id", "prop", "buff", "hier", (~F.col("is_update")).alias("whole"), "removed", "dropped", _BUCKET), "live")

    def buckets(condition: str) -> set[int]:
        return {r[0] for r in live.where(condition).select(_BUCKET).distinct().collect()}

    def ids(condition: str) -> DataFrame:
        return live.where(condition).select("node_id")

    folders = {}

    def replace(table: str, touched: set[int], rows: DataFrame) -> None:
        kept = {b: f for b, f in now.folders[table].items() if b not in touched}
        folders[table] = kept | (_write(spark, root, table, rows, now.buckets) if touched else {})

    touched = buckets("removed OR hier")
    rows = _read(spark, root, now, "children", touched).join(ids("removed OR hier"), "node_id", "left_anti")
    replace("children", touched, rows.unionByName(align_schema(changed.children, schema_of("children")).join(ids("hier AND NOT removed"), "node_id", "left_semi")))

    touched = buckets("removed OR prop OR buff") if "text" in now.folders else set(now.folders["node"]) | buckets("removed OR prop OR buff")
    columns = [f.name for f in _schema("rows") if f.name not in ("node_id", "stored")]
    old_rows, old_texts = _parts(spark, root, now, touched)
    old = old_rows.select("node_id", F.struct(*columns).alias("old"))
    fresh = changed.with_parts(*plain_parts(changed)) if changed.parts else changed.with_tables(node=align_schema(changed.node, schema_of("node")))
    new_rows, new_texts = fresh.split_of(ids("(prop OR buff) AND NOT removed"))
    new_rows = align_schema(new_rows, ROW_DDL)
    new = new_rows.select("node_id", F.struct(*columns).alias("new"))
    flags = live.where("removed OR prop OR buff").select("node_id", "prop", "buff", "whole", "removed")
    both = old.join(flags.join(new, "node_id", "left"), "node_id", "full").where("NOT coalesce(removed, false) AND (old IS NOT NULL OR new IS NOT NULL)")
    written = lambda c: F.col("whole") | F.col("old").isNull() | F.col("buff" if c == "text_id" else "prop")
    pick = [F.when(F.col("new").isNotNull() & written(c), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns]
    replace("node", touched, both.select("node_id", *pick))
    known_texts = now.folders.get("text") or _write_texts(spark, root, old_texts, now.number)
    folders["text"] = known_texts | (_write_texts(spark, root, named_texts(new_rows, new_texts), now.number + 1) if touched else {})

    touched = buckets("removed OR buff")
    for table in ("codebox", "grid", "image"):
        rows = _read(spark, root, now, table, touched).join(ids("removed OR buff"), "node_id", "left_anti")
        replace(table, touched, rows.unionByName(align_schema(getattr(changed, table), schema_of(table)).join(ids("buff AND NOT removed"), "node_id", "left_semi")))

    if "place" in now.folders:
        # objects stand where their node's text and objects put them, and those are in the buckets just written
        after = Version(now.number + 1, now.buckets, folders)
        part = Store(**{t: _read(spark, root, after, t, touched) if t in folders and t != "children" else _read(spark, root, now, t, set()) for t in TABLES})
        part = part.with_parts(*_parts_of(spark, root, after, touched))
        index = build_index(part) if touched else None
        for table in INDEX_DDL:
            replace(table, touched, getattr(index, table, None))

    touched = buckets("dropped")
    replace("bookmark", touched, _read(spark, root, now, "bookmark", touched).join(ids("dropped"), "node_id", "left_anti"))
    batches = now.batches if feed is None else now.batches | {feed: batch_id}
    return _commit(spark, root, Version(now.number + 1, now.buckets, folders, batches))


def version_diff(spark: SparkSession, root: str, older: int, newer: int) -> DataFrame:
    """Rows that only one of two versions has (left: the older), as :func:`store_diff` gives them.

    Buckets that both versions point to are equal; no other is read.
    """
    a, b = open_version(spark, root, older), open_version(spark, root, newer)
    apart = {t: {k for k in a.folders[t].keys() | b.folders[t].keys() if a.folders[t].get(k) != b.folders[t].get(k)} for t in TABLES}
    stores = [Store(**{t: join_texts(*_parts_of(spark, root, v, apart[t])) if t == "node" else _read(spark, root, v, t, apart[t]) for t in TABLES}) for v in (a, b)]
    return store_diff(*stores)


def compact_texts(spark: SparkSession, root: str) -> Version:
    """The next version, with no texts but those that its nodes name, in one folder."""
    now = open_version(spark, root)
    rows, texts = _parts(spark, root, now)
    named = texts.join(sized(rows.select("text_id").distinct(), "text-ids"), "text_id", "left_semi").distinct()
    folders = now.folders | {"text": _write_texts(spark, root, named, now.number + 1)}
    return _commit(spark, root, Version(now.number + 1, now.buckets, folders, now.batches))


def forget_versions(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Drops all but the newest ``keep`` versions and every folder that those don't point to; what was dropped.

    No writer or reader of older versions may be at work meanwhile.
    """
    numbers = version_numbers(spark, root)
    used = {f for n in numbers[-keep:] for held in open_version(spark, root, n).folders.values() for f in held.values()}
    gone = [f"manifests/{n:012d}.json" for n in numbers[:-keep]] + [f"manifests/{n}" for n in _names(spark, f"{root}/manifests") if n.startswith(".draft-")]
    for table in [*TABLES, *INDEX_DDL, "text"]:
        for folder in _names(spark, f"{root}/data/{table}"):
            buckets = [n for n in _names(spark, f"{root}/data/{table}/{folder}") if n.startswith(f"{_BUCKET}=")]
            dead = [n for n in buckets if f"data/{table}/{folder}/{n}" not in used]
            gone += [f"data/{table}/{folder}"] if len(dead) == len(buckets) else [f"data/{table}/{folder}/{n}" for n in dead]
    for name in gone:
        path, fs = _path(spark, f"{root}/{name}")
        fs.delete(path, True)
    return gone
