"""Stores kept as XML: single files, node folders, grids, runs, note files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import header_first
from ..functions.text import is_true, to_int
from ..model import RUN_ATTRIBUTES
from ..operators.merge import fix_duplicate_ids
from ..plans.scan import Running, numbered, running
from ..session import materialize
from .html import decode_xml_entities
from .outline import outline_to_tree, xml_attrs, xml_tree_rows

GRID_SCHEMA = "_col_widths string, _is_light string, row array<struct<cell: array<string>>>"
# XML attributes that are read, with their column.
NODE_ATTRIBUTES = {
    "name": "name", "prog_lang": "syntax", "tags": "tags", "readonly": "read_only", "custom_icon_id": "custom_icon_id",
    "is_bold": "is_bold", "foreground": "foreground", "nosearch_me": "exclude_me", "nosearch_ch": "exclude_children",
    "ts_creation": "ts_creation", "ts_lastsave": "ts_lastsave", "master_id": "master_id",
}


def parse_grid_xml(df: DataFrame, xml: str = "txt") -> DataFrame:
    """Add cells, is_light and col_widths from a grid's XML; empty grids drop out.

    Stores keep the header row last; it comes first here.
    """
    parsed = df.withColumn("__x", F.from_xml(F.col(xml), GRID_SCHEMA, {"ignoreSurroundingSpaces": "false"}))
    rows = F.transform("__x.row", lambda r: F.transform(r["cell"], lambda c: F.coalesce(c, F.lit(""))))
    widths = F.when(F.coalesce(F.col("__x._col_widths"), F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split("__x._col_widths", ","), to_int)
    )
    return (
        parsed.withColumn("cells", header_first(rows))
        .withColumn("is_light", F.coalesce(is_true("__x._is_light"), F.lit(False)))
        .withColumn("col_widths", widths).where("size(cells) > 0").drop("__x")
    )


def parse_runs_xml(df: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """Rich-text runs: run_idx, start_offset, text, attrs. Unknown attributes and
    empty runs are dropped. A node's runs come from one row, so its offsets are
    summed inside the row."""
    from ..functions.arrays import let, prefix_sums

    pieces = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<rich_text(?:\s[^>]*)?/>|<rich_text(?:\s[^>]*)?>.*?</rich_text>"), F.lit(0))

    def run(p: Column) -> Column:
        known = xml_attrs(F.regexp_extract(p, r"^(<rich_text[^>]*>)", 1), RUN_ATTRIBUTES)
        as_map = lambda a: F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), a[n].alias("value")) for n in RUN_ATTRIBUTES]))
        attrs = F.map_filter(let(known, as_map), lambda _, v: v != "")
        text = decode_xml_entities(F.regexp_extract(p, r"(?s)^<rich_text[^>]*>(.*)</rich_text>\z", 1))
        return F.struct(text.alias("text"), attrs.alias("attrs"))

    def with_offsets(runs: Column) -> Column:
        sizes = F.transform(runs, lambda r: F.length(r["text"]).cast("long"))
        return let(F.struct(runs.alias("runs"), prefix_sums(sizes).alias("ends")), lambda s: F.transform(
            s["runs"], lambda r, i: F.struct((F.get(s["ends"], i) - F.length(r["text"])).alias("start_offset"), r["text"].alias("text"), r["attrs"].alias("attrs"))
        ))

    found = let(F.filter(F.transform(pieces, run), lambda r: r["text"] != ""), with_offsets)
    return df.select(*keep, F.posexplode(found).alias("run_idx", "r")).select(
        *keep, F.col("run_idx").cast("long").alias("run_idx"), "r.start_offset", "r.text", "r.attrs"
    )


def run_links(runs: DataFrame) -> DataFrame:
    """Links of text runs: node_id, offset, link."""
    return runs.where(F.col("attrs").getItem("link").isNotNull()).select(
        "node_id", F.col("start_offset").alias("offset"), F.col("attrs").getItem("link").alias("link")
    )


def _with_node_columns(df: DataFrame, head: Column) -> DataFrame:
    """Add the attributes of a node's open tag as typed columns."""
    read = df.withColumn("__a", xml_attrs(head, ["unique_id", *NODE_ATTRIBUTES]))
    text = {c: F.col(f"__a.{a}") for a, c in NODE_ATTRIBUTES.items()}
    out = {c: text[c] for c in ("name", "syntax", "tags", "foreground")}
    out |= {c: is_true(text[c]) for c in ("read_only", "is_bold", "exclude_me", "exclude_children")}
    out |= {c: to_int(text[c]) for c in ("custom_icon_id", "ts_creation", "ts_lastsave", "master_id")}
    out["unique_id"] = to_int(F.col("__a.unique_id"))
    return read.select("*", *[c.alias(n) for n, c in out.items()]).drop("__a")


def xml_corpus(files: DataFrame) -> DataFrame:
    """Nodes of many single-file stores (path, text), nested ``<node>`` by ``<node>``.

    Ids are fresh and dense over the whole corpus; ``unique_id`` keeps the
    file's id with repeats replaced (``fixed_id``). ``body`` holds the node's own
    XML content.
    """
    rows = xml_tree_rows(files, "text", ["path"], "node")
    # Ranking reads its input twice (to find range bounds), parsing should run once.
    rows = materialize(_with_node_columns(rows, F.col("head")).drop("head"), "xml-rows")
    tree = materialize(outline_to_tree(rows.withColumn("doc", F.col("path")), "doc", "pos", "level"), "xml-nodes")
    per_file = tree.withColumn("global_id", F.col("node_id"))
    # Ids repeat only within a file; numbering restarts per file.
    occ = numbered(
        per_file.select("global_id", "path", "unique_id"), ["path", "unique_id"], [F.col("global_id")], "occ"
    )
    top = tree.groupBy("path").agg(F.max("unique_id").alias("top"))
    extra = running(
        occ.withColumn("dup", (F.col("occ") > 1).cast("long")), ["path"], [F.col("global_id")], {"n_dup": Running("sum", F.col("dup"))}
    )
    fixed = extra.join(top, "path").select(
        "global_id", F.when(F.col("dup") == 1, F.col("top") + F.col("n_dup")).otherwise(F.col("unique_id")).alias("fixed_id")
    )
    return tree.join(fixed, F.col("node_id") == F.col("global_id")).drop("global_id", "doc")


def load_xml_corpus(spark: SparkSession, pattern: str) -> DataFrame:
    """:func:`xml_corpus` over files."""
    files = spark.read.text(pattern, wholetext=True)
    return xml_corpus(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def _located(files: DataFrame) -> DataFrame:
    """Files with the ids of their folders and their name."""
    parts = F.split("path", "/")
    ids = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.rlike(r"^\d+$"))
    return files.withColumns({"ids": ids, "base": F.element_at(parts, -1), "text": F.col("content").cast("string")})


def multifile_bodies(files: DataFrame) -> DataFrame:
    """Nodes of the folder form with their bodies, without their order among siblings."""
    node = _located(files).where("base = 'node.xml'")
    head = F.regexp_extract("text", r"(<node(?:\s[^>]*)?>)", 1)
    return _with_node_columns(node, head).select(
        F.element_at("ids", -1).cast("long").alias("node_id"),
        F.when(F.size("ids") > 1, F.element_at("ids", -2).cast("long")).otherwise(F.lit(0)).cast("long").alias("father_id"),
        (F.size("ids") - 1).cast("long").alias("depth"), *NODE_ATTRIBUTES.values(),
        F.regexp_extract("text", r"(?s)<node(?:\s[^>]*)?>(.*)</node>", 1).alias("body"),
    )


def in_listed_order(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes (node_id, father_id) with their ``sequence``, from the lists of the folder form."""
    order = _located(files).where("base = 'subnodes.lst'").select(
        F.when(F.size("ids") > 0, F.element_at("ids", -1).cast("long")).otherwise(F.lit(0)).cast("long").alias("ofather"),
        F.posexplode(F.split(F.trim("text"), r"\s*,\s*")).alias("i", "child"),
    ).select(F.col("child").try_cast("long").alias("oid"), (F.col("i") + 1).cast("long").alias("sequence"), "ofather")
    # a child has one place, so readers of bodies needn't join, and readers of places move no bodies
    order = order.groupBy("oid", "ofather").agg(F.min("sequence").alias("sequence"))
    return nodes.join(order, (F.col("node_id") == F.col("oid")) & (F.col("father_id") == F.col("ofather")), "left").drop("oid", "ofather")


def multifile_nodes(files: DataFrame | dict[str, DataFrame]) -> DataFrame:
    """Nodes of a store kept as nested folders: (path, content) of all its files.

    ``.../<id>/<id>/node.xml`` gives the tree, ``subnodes.lst`` the order of the
    children and the top folder's ``subnodes.lst`` that of the top nodes.
    """
    nodes, lists = (files["node"], files["list"]) if isinstance(files, dict) else (files, files)
    return in_listed_order(multifile_bodies(nodes), lists)


def _id_list(text: Column) -> Column:
    """Ids of a comma list; entries that are no number drop out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("long")), lambda x: x.isNotNull())


def multifile_bookmarks(files: DataFrame) -> DataFrame:
    """Bookmarks of the folder form, from the top ``bookmarks.lst``."""
    lists = files.where(F.regexp_extract("path", r"([^/]*)$", 1) == "bookmarks.lst")
    return lists.select(F.posexplode(_id_list(F.col("content").cast("string"))).alias("i", "node_id")).select("node_id", (F.col("i") + 1).cast("long").alias("sequence"))


def xml_bookmarks(files: DataFrame) -> DataFrame:
    """Bookmarks of single-file stores: path, node_id (the file's own id), sequence."""
    listed = F.regexp_extract("text", r'<bookmarks\s[^>]*list="([^"]*)"', 1)
    return files.select("path", F.posexplode(_id_list(listed)).alias("i", "node_id")).select(
        "path", "node_id", (F.col("i") + 1).cast("long").alias("sequence")
    )


def read_multifile(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder store, of whatever file system: path below ``folder``, content.

    Files that the form doesn't have, and folders that are no node's, are passed over.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    marker = "/" + folder.split("://", 1)[-1].strip("/") + "/"
    below = F.substring_index(F.concat(F.lit("/"), F.regexp_replace("path", r"^[\w.+-]+:/*", "")), marker, -1)
    own = F.col("path").rlike(r"^(?:\d+/)*(?:node\.xml|subnodes\.lst|bookmarks\.lst|[0-9a-f]{64}(?:\.[^/]*)?)$")
    return found.select(below.alias("path"), "content").where(own)


def load_multifile(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of a folder store; its bookmarks: ``multifile_bookmarks(read_multifile(...))``."""
    return multifile_nodes(read_multifile(spark, folder))


def salvage_latest_readable(versions: DataFrame) -> DataFrame:
    """Newest readable version per node; a node without any keeps its header only.

    ``versions``: node_id, version, content (XML text). Adds ``salvaged`` (not
    the newest) and ``header_only`` (read-only shell). A version is readable when
    it parses and its root is closed.
    """
    schema = "_unique_id string, rich_text array<string>, _corrupt string"
    parsed = F.from_xml(F.col("content"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "rowTag": "node"})
    good = parsed["_corrupt"].isNull() & F.col("content").rlike(r"(?s)</node>\s*\z|/>\s*\z")
    read = versions.withColumn("ok", good)
    best = read.groupBy("node_id").agg(
        F.max("version").alias("newest"), F.max(F.when(F.col("ok"), F.col("version"))).alias("version"),
    )
    bodies = versions.select(F.col("node_id").alias("bid"), F.col("version").alias("bv"), "content")
    return best.join(bodies, (F.col("node_id") == F.col("bid")) & (F.coalesce("version", "newest") == F.col("bv"))).select(
        "node_id", "version", (F.col("version") < F.col("newest")).alias("salvaged"), F.col("version").isNull().alias("header_only"),
        F.when(F.col("version").isNull(), F.concat(F.regexp_extract("content", r"(<node[^>]*>)", 1), F.lit("</node>"))).otherwise(F.col("content")).alias("content"),
    )


def note_xml_records(files: DataFrame) -> DataFrame:
    """Note XML files (path, text): name, notebook and body; templates are skipped.

    A missing or empty tag is no notebook; a note without a body is no note.
    """
    text = F.col("text")
    title = decode_xml_entities(F.regexp_extract(text, r"(?s)<title>(.*?)</title>", 1))
    tag = decode_xml_entities(F.regexp_extract(F.regexp_extract(text, r"(?s)<tags>(.*?)</tags>", 1), r"(?s)<tag>(.*?)</tag>", 1))
    raw = F.regexp_extract(text, r"(?s)<note-content\b[^>]*>(.*?)</note-content>", 1)
    body = decode_xml_entities(F.regexp_replace(raw, r"(?s)<[^>]*>", ""))
    prefix = "system:notebook:"
    return files.where(text.rlike(r"<note-content\b")).select(
        "path", F.when(title == "", F.lit("???")).otherwise(title).alias("name"),
        F.when(tag.startswith(prefix) & (F.length(tag) > len(prefix)), F.substring(tag, F.lit(len(prefix) + 1), F.length(tag)))
        .otherwise(F.lit("")).alias("notebook"),
        body.alias("body"),
    ).where(~((F.length("name") > 18) & F.col("name").endswith(" Notebook Template")))


__all__ = [
    "fix_duplicate_ids", "load_multifile", "load_xml_corpus", "multifile_bookmarks", "multifile_nodes", "xml_bookmarks", "note_xml_records", "parse_grid_xml",
    "parse_runs_xml", "run_links", "salvage_latest_readable", "xml_corpus",
]
