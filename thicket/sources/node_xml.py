"""Stores in XML read whole: the mixed content of nodes split into texts and objects, six tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import header_anchor_level, is_true, to_int
from ..model import LATEX_FILENAME, RICH_SYNTAX
from ..operators.aggregates import has_flags
from ..plans.joins import sized
from ..session import materialize
from .html import decode_xml_entities
from .outline import xml_attrs
from .store import ROW_DDL, Store, align_schema, encode_node_bits, schema_of, text_id
from .xml_store import in_listed_order, multifile_bodies, multifile_bookmarks, parse_grid_xml, read_multifile, xml_bookmarks, xml_corpus

#: An element of a node's content, up to its own end; none of them nests in another.
_PIECE = r"(?s)<(rich_text|codebox|table|encoded_png)(?:\s(?:[^>/]|/(?!>))*)?(?:/>|>.*?</\1>)"
#: One node in so many keeps its text where it is read; most texts that many nodes show are among them.
TEXT_IN = 4
# Attributes of the objects, as written.
_CODE = ["char_offset", "justification", "frame_width", "frame_height", "width_in_pixels", "syntax_highlighting", "highlight_brackets", "show_line_numbers"]
_IMAGE = ["char_offset", "justification", "link", "anchor", "state", "filename", "time", "sha256sum"]
_TABLE = ["char_offset", "justification", "col_min", "col_max"]


def _pieces(body: str) -> Column:
    return F.regexp_extract_all(F.col(body), F.lit(_PIECE), F.lit(0))


def _inside(piece: Column | str) -> Column:
    """What stands between an element's tags."""
    c = F.col(piece) if isinstance(piece, str) else piece
    return F.regexp_extract(c, r"(?s)^<\w+(?:\s(?:[^>/]|/(?!>))*)?>(.*)</\w+>\z", 1)


def body_text(body: str = "body") -> Column:
    """The text of a node: that of its runs, in order."""
    runs = F.filter(_pieces(body), lambda p: p.startswith("<rich_text"))
    return F.array_join(F.transform(runs, lambda p: decode_xml_entities(_inside(p))), "")


def body_objects(bodies: DataFrame, blobs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The code boxes, grids and images of nodes (node_id, pieces), with their offsets.

    ``pieces`` are the elements of a body that are no run. ``blobs`` (node_id, sha, content)
    has the files of node folders; without it blobs are written in the body.
    """
    head = F.regexp_extract("piece", r"^(<(?:[^>/]|/(?!>))*/?>)", 1)
    pieces = bodies.select("node_id", F.explode("pieces").alias("piece")).withColumn("head", head)
    just = F.when(F.col("a.justification") == "", F.lit("left")).otherwise(F.col("a.justification"))
    flag = lambda c: F.coalesce(is_true(f"a.{c}"), F.lit(False))
    number = lambda c: to_int(F.col(f"a.{c}"))

    code = pieces.where("piece LIKE '<codebox%'").withColumn("a", xml_attrs(F.col("head"), _CODE))
    code = code.select(
        "node_id", number("char_offset").alias("offset"), just.alias("justification"), decode_xml_entities(_inside("piece")).alias("txt"), F.col("a.syntax_highlighting").alias("syntax"),
        number("frame_width").alias("width"), number("frame_height").alias("height"), flag("width_in_pixels").alias("is_width_pix"),
        flag("highlight_brackets").alias("do_highl_bra"), flag("show_line_numbers").alias("do_show_linenum"),
    )
    grid = parse_grid_xml(pieces.where("piece LIKE '<table%'"), "piece").withColumn("a", xml_attrs(F.col("head"), _TABLE))
    grid = grid.select("node_id", number("char_offset").alias("offset"), just.alias("justification"), number("col_min").alias("col_min"), number("col_max").alias("col_max"), "cells", "is_light", "col_widths")

    image = pieces.where("piece LIKE '<encoded_png%'").withColumn("a", xml_attrs(F.col("head"), _IMAGE))
    anchor, latex = F.col("a.anchor") != "", F.col("a.filename") == LATEX_FILENAME
    text = _inside("piece")
    image = image.withColumn("inline", F.when(anchor, None).when(latex, decode_xml_entities(text).cast("binary")).otherwise(F.unbase64(F.when(text != "", text))))
    if blobs is None:
        png = F.col("inline")
    else:
        image = image.join(blobs.select(F.col("node_id").alias("bid"), F.col("sha"), F.col("content").alias("blob")), (F.col("node_id") == F.col("bid")) & (F.col("a.sha256sum") == F.col("sha")), "left")
        png = F.when(latex, F.col("inline")).otherwise(F.col("blob"))
    collapsed = anchor & (header_anchor_level(F.col("a.anchor")) > 0) & (F.col("a.state") == "coll")
    image = image.select(
        "node_id", number("char_offset").alias("offset"), just.alias("justification"), F.col("a.anchor").alias("anchor"), png.alias("png"), F.col("a.filename").alias("filename"),
        F.when(collapsed, F.lit("state:coll")).otherwise(F.col("a.link")).alias("link"), F.coalesce(F.col("a.time").try_cast("long"), F.lit(0).cast("long")).alias("time"),
    )
    return {"codebox": code, "grid": grid, "image": image}


def _store_of(nodes: DataFrame, bookmark: DataFrame, blobs: DataFrame | None, files: DataFrame | None = None) -> Store:
    """Six tables of nodes with their attributes, place and body; ``files`` tell the order of siblings, if ``nodes`` don't.

    Bodies are not kept: a node's row holds its objects and the name of its text. One node in
    ``TEXT_IN`` keeps its text too; the texts that none of them has are read again, each from one node.
    """
    holds = F.coalesce("master_id", F.lit(0)) <= 0
    rich = holds & (F.col("syntax") == RICH_SYNTAX)
    read = nodes.withColumns({"txt": F.when(holds, body_text()), "pieces": F.when(rich, F.filter(_pieces("body"), lambda p: ~p.startswith("<rich_text")))}).drop("body")
    shows = F.pmod(F.xxhash64("node_id"), F.lit(TEXT_IN)) == 0
    read = materialize(read.withColumns({"text_id": text_id("txt"), "txt": F.when(shows, F.col("txt"))}), "read-nodes")
    texts = materialize(read.where("txt IS NOT NULL").select("text_id", "txt").distinct(), "texts")
    read = read.drop("txt")
    lacking = read.where(holds).groupBy("text_id").agg(F.min("node_id").alias("node_id")).join(texts.select("text_id"), "text_id", "left_anti")
    lacking = sized(lacking, "text-nodes")
    if not lacking.isEmpty():
        # Filters wait until the texts are written: below, they would repeat all that makes a body in the plan.
        more = nodes.join(lacking.select("node_id"), "node_id", "left_semi").select(F.when(holds, body_text()).alias("txt"))
        more = materialize(more.select(text_id("txt").alias("text_id"), "txt").distinct(), "texts").where("txt IS NOT NULL")
        if not lacking.join(more.select("text_id"), "text_id", "left_anti").isEmpty():
            raise RuntimeError("files changed while they were read")
        texts = texts.unionByName(more)

    placed = read.select("node_id", "father_id", "master_id", *([] if files is not None else ["sequence"]))
    placed = placed if files is None else in_listed_order(placed, files)
    children = placed.select("node_id", "father_id", "sequence", F.coalesce("master_id", F.lit(0).cast("long")).alias("master_id"))
    holders = read.where(holds)
    objects = {t: align_schema(df, schema_of(t)) for t, df in body_objects(holders.where(F.col("syntax") == RICH_SYNTAX).select("node_id", "pieces"), blobs).items()}
    plain = holders.withColumns({"is_rich": F.col("syntax") == RICH_SYNTAX, "exclude_me": F.coalesce("exclude_me", F.lit(False)), "exclude_children": F.coalesce("exclude_children", F.lit(False)), "kind": F.lit("")})
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("read_only", "is_bold")} | {"custom_icon_id": F.coalesce("custom_icon_id", F.lit(0).cast("long")), "foreground": F.coalesce("foreground", F.lit(""))}
    rows = align_schema(encode_node_bits(plain.withColumns(flags)).withColumn("stored", F.lit(False)), ROW_DDL)
    store = Store(node=rows, children=align_schema(children, schema_of("children")), bookmark=align_schema(bookmark, schema_of("bookmark")), **objects)
    store = store.with_parts(rows, texts)
    flagged = rows.drop("has_codebox", "has_table", "has_image").join(has_flags(store), "node_id").select(*rows.columns)
    return store.with_parts(flagged, texts)


def multifile_store(files: DataFrame | dict[str, DataFrame]) -> Store:
    """The store that the files (path, content) of a folder form hold, objects and blobs included.

    Files may be given by kind, as :func:`multifile_kinds` makes them, so that no reader of one makes the others.
    """
    kinds = files if isinstance(files, dict) else dict.fromkeys(("node", "list", "mark", "blob"), files)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    blobs = kinds["blob"].withColumn("name", name).where(F.col("name").rlike(r"^[0-9a-f]{64}(?:\.[^/]*)?$"))
    blobs = blobs.select(F.regexp_extract("path", r"(\d+)/[^/]*$", 1).try_cast("long").alias("node_id"), F.substring("name", 1, 64).alias("sha"), "content").dropDuplicates(["node_id", "sha"])
    return _store_of(multifile_bodies(kinds["node"]), multifile_bookmarks(kinds["mark"]), blobs, kinds["list"])


def load_multifile_store(spark: SparkSession, folder: str) -> Store:
    """:func:`multifile_store` of a folder."""
    return multifile_store(read_multifile(spark, folder))


def xml_corpus_store(files: DataFrame, keep_ids: bool = False) -> Store:
    """The store that single-file stores (path, text) hold together, objects included.

    Ids are fresh over all files; with ``keep_ids``, for one file, they are its own (repeats
    replaced). Masters and bookmarks follow the ids of their file.
    """
    rows = materialize(xml_corpus(files), "corpus")
    new = F.col("fixed_id") if keep_ids else F.col("node_id")
    known = rows.select(F.col("path").alias("kp"), F.col("unique_id").alias("ku"), new.alias("kn"), "fixed_id").where("ku = fixed_id").drop("fixed_id")
    fathers = rows.select(F.col("node_id").alias("fn"), new.alias("father_new"))
    linked = rows.join(known, (F.col("path") == F.col("kp")) & (F.col("master_id") == F.col("ku")), "left").join(fathers, F.col("father_id") == F.col("fn"), "left")
    columns = [c for c in rows.columns if c not in ("node_id", "father_id", "master_id")]
    nodes = linked.select(new.alias("node_id"), F.coalesce("father_new", F.lit(0).cast("long")).alias("father_id"), F.coalesce("kn", F.lit(0).cast("long")).alias("master_id"), *columns)
    marks = xml_bookmarks(files).join(known, (F.col("path") == F.col("kp")) & (F.col("node_id") == F.col("ku"))).select(F.col("kn").alias("node_id"), "sequence")
    return _store_of(nodes, marks, None)


def load_xml_corpus_store(spark: SparkSession, pattern: str, keep_ids: bool = False) -> Store:
    """:func:`xml_corpus_store` over files."""
    files = spark.read.text(pattern, wholetext=True)
    return xml_corpus_store(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), keep_ids)
