"""Where embedded objects stand in their texts, kept as two tables per store version.

A buffer counts each object as one symbol, the searched text has none. The index holds each
object's rank, place and line, and for each stretch of a text how many objects stand before
and in it; so a search looks up the stretches of its matches and ranks nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, prefix_sums
from ..plans.joins import sized
from ..plans.scan import numbered
from ..session import materialize
from ..sources.store import Store, image_kind

#: Symbols in a stretch of text; a stretch holds few rows whatever its objects.
STRETCH = 100_000
#: Columns of the two tables.
INDEX_DDL = {
    "place": "node_id long, offset long, kind string, obj_rank long, text_pos long, line_num long",
    "step": "node_id long, stretch long, base long, steps array<struct<pos:bigint,n:bigint>>",
}


@dataclass(frozen=True)
class ObjectIndex:
    """``place``: a row per object. ``step``: a row per stretch of each text with objects; ``n`` counts from the stretch's start."""

    place: DataFrame
    step: DataFrame


def all_objects(store: Store) -> DataFrame:
    """Every embedded object: node_id, offset, kind and a number that splits ties."""
    code = store.codebox.select("node_id", "offset", F.lit("codebox").alias("kind"), F.xxhash64("txt", "syntax").alias("obj_id"))
    grid = store.grid.select(
        "node_id", "offset",
        F.when(F.coalesce("is_light", F.lit(False)), F.lit("grid_light")).otherwise(F.lit("grid_heavy")).alias("kind"),
        F.xxhash64("cells").alias("obj_id"),
    )
    image = store.image.select("node_id", "offset", image_kind().alias("kind"), F.xxhash64("anchor", "filename", "link", "png").alias("obj_id"))
    return code.unionByName(grid).unionByName(image)


def object_positions(objects: DataFrame) -> DataFrame:
    """``text_pos`` of each object: its offset without the objects before it.

    Ranks within a node are taken over ranges, so one node may own most objects.
    """
    ranked = numbered(objects, ["node_id"], [F.col("offset"), F.col("kind"), F.col("obj_id")], "obj_rank")
    return ranked.withColumn("text_pos", F.col("offset") - F.col("obj_rank") + 1)


def _stretch(pos: str) -> Column:
    return F.greatest(F.floor(F.col(pos) / STRETCH), F.lit(0).cast("long"))


def build_index(store: Store, nodes: DataFrame | None = None) -> ObjectIndex:
    """The index of a store, or of its ``nodes`` (node_id, distinct) alone.

    Objects are ranked and line starts counted once; both tables are written.
    """
    if nodes is not None:
        store = store.with_tables(**{t: getattr(store, t).join(nodes, "node_id", "left_semi") for t in ("codebox", "grid", "image")})
    return index_of(all_objects(store), store)


def index_of(objects: DataFrame, texts: DataFrame | Store) -> ObjectIndex:
    """The index of objects (as :func:`all_objects` gives them) in texts (node_id, txt) or those of a store."""
    placed = materialize(object_positions(objects), "places")
    owners = sized(placed.select("node_id").distinct(), "owners")
    owned = texts.nodes(owners) if isinstance(texts, Store) else texts.join(owners, "node_id", "left_semi")
    texts = owned.select("node_id", F.coalesce("txt", F.lit("")).alias("txt"))
    # line starts of each stretch, and the lines begun before it; only these leave the text's row
    ends = prefix_sums(F.transform(F.split("txt", "\n"), lambda x: (F.length(x) + 1).cast("long")))
    ends = let(ends, lambda e: F.slice(e, F.lit(1), F.size(e) - 1))
    texts = texts.select("node_id", F.floor(F.length("txt") / STRETCH).alias("last"), ends.alias("ends"))
    starts = lambda k: let(F.filter("ends", lambda e: F.floor(e / STRETCH) == k), lambda own: F.struct(k.alias("stretch"), own.alias("starts"), F.size(F.filter("ends", lambda e: F.floor(e / STRETCH) < k)).alias("lines")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("stretch"), F.col("ends").alias("starts"), F.lit(0).alias("lines")))
    stretches = texts.select("node_id", "last", F.explode(F.when(F.col("last") == 0, whole).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), "last"), starts))).alias("s")).select("node_id", "last", "s.*")
    stretches = materialize(stretches, "stretches")

    lasts = stretches.where("stretch = 0").select("node_id", "last")
    at = placed.join(lasts, "node_id", "left").withColumn("stretch", F.least(_stretch("text_pos"), F.coalesce("last", F.lit(0).cast("long"))))
    lined = at.join(stretches.select("node_id", "stretch", "starts", "lines"), ["node_id", "stretch"], "left")
    line = F.coalesce(F.col("lines") + F.size(F.filter("starts", lambda x: x <= F.col("text_pos"))), F.lit(0)) + 1
    place = materialize(lined.select("node_id", "offset", "kind", "obj_rank", "text_pos", line.cast("long").alias("line_num")), "place")

    counts = at.groupBy("node_id", "stretch", "text_pos").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("node_id", "stretch").agg(F.array_sort(F.collect_list(F.struct(F.col("text_pos").alias("pos"), "n"))).alias("list"), F.sum("n").alias("total"))
    filled = stretches.select("node_id", "stretch").join(listed, ["node_id", "stretch"], "left")
    # objects of nodes that have no text row still count
    filled = filled.unionByName(listed.join(lasts, "node_id", "left_anti"), allowMissingColumns=True)
    before = _with_base(filled)
    sums = prefix_sums(F.transform("list", lambda x: x["n"]))
    steps = F.when(F.col("list").isNull(), F.array().cast("array<struct<pos:bigint,n:bigint>>")).otherwise(
        F.transform(F.arrays_zip("list", sums.alias("sum")), lambda x: F.struct(x["list"]["pos"].alias("pos"), x["sum"].alias("n"))))
    return ObjectIndex(place, materialize(before.select("node_id", "stretch", "base", steps.alias("steps")), "step"))


def _with_base(filled: DataFrame) -> DataFrame:
    """Add ``base``: the objects in earlier stretches of the text; a window over a text's stretches, one per 100,000 symbols."""
    earlier = Window.partitionBy("node_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    return filled.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)).cast("long"))


def objects_before(points: DataFrame, index: ObjectIndex, at: str = "match_start") -> DataFrame:
    """Add ``n_before``: objects of the node at or before text position ``at``.

    A point takes the row of its stretch; where few nodes have points only their rows are read.
    """
    columns = points.columns
    nodes = sized(points.select("node_id").distinct(), "nodes")
    step = index.step.join(nodes, "node_id", "left_semi")
    found = points.withColumn("stretch", _stretch(at)).join(step, ["node_id", "stretch"], "left")
    inside = F.get("steps", F.size(F.filter("steps", lambda x: x["pos"] <= F.col(at))) - 1)["n"]
    return found.select(*columns, (F.coalesce("base", F.lit(0)) + F.coalesce(inside, F.lit(0))).cast("long").alias("n_before"))


def object_lines(hits: DataFrame, index: ObjectIndex) -> DataFrame:
    """(node_id, offset, line_num) of the objects at the offsets ``hits``: the line of the first at each."""
    place = index.place.join(sized(hits.select("node_id").distinct(), "nodes"), "node_id", "left_semi")
    return place.join(hits.select("node_id", "offset").distinct(), ["node_id", "offset"], "left_semi").groupBy("node_id", "offset").agg(F.min_by("line_num", "text_pos").alias("line_num"))
