"""Nodes with all that they hold as XML: texts, code boxes, grids, images, files, anchors."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape
from ..operators.forest import sibling_rank
from ..operators.shared import holder_id
from ..plans.joins import lookup_join
from ..plans.scan import numbered
from ..sources.store import Store, anchor_collapsed, decode_nodes, image_kind, join_texts, justification
from .export import grid_to_xml

#: Ids that are joined at a time; a list of any length is put together from such parts.
IDS_AT_ONCE = 100_000


def _attr(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), xml_escape(F.coalesce(value.cast("string"), F.lit(""))), F.lit('"'))


def _bit(name: str) -> Column:
    return F.when(F.coalesce(F.col(name), F.lit(False)), F.lit("1")).otherwise(F.lit("0"))


def _element(tag: str, attrs: list[Column], content: Column) -> Column:
    return F.concat(F.lit(f"<{tag}"), *attrs, F.lit(">"), content, F.lit(f"</{tag}>"))


def blob_name(filename: Column | str = "filename") -> Column:
    """What follows the digest in the name of a blob's file: the ending of an embedded file, else that of a picture."""
    name = F.coalesce(F.col(filename) if isinstance(filename, str) else filename, F.lit(""))
    return F.when(name == "", F.lit(".png")).otherwise(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def object_elements(store: Store, folders: bool) -> DataFrame:
    """(node_id, offset, kind, xml) of each object; with ``folders`` blobs are named by their digest instead of written in."""
    place = [_attr("char_offset", F.col("offset")), _attr("justification", justification())]
    code = _element("codebox", [
        *place, _attr("frame_width", F.col("width")), _attr("frame_height", F.col("height")), _attr("width_in_pixels", _bit("is_width_pix")),
        _attr("syntax_highlighting", F.col("syntax")), _attr("highlight_brackets", _bit("do_highl_bra")), _attr("show_line_numbers", _bit("do_show_linenum")),
    ], xml_escape(F.coalesce("txt", F.lit(""))))
    widths = F.array_join(F.transform(F.coalesce("col_widths", F.array().cast("array<int>")), lambda w: w.cast("string")), ",")
    grid = grid_to_xml(F.col("cells"), F.col("offset"), justification(), F.coalesce("col_max", F.lit(0)), widths, F.coalesce("is_light", F.lit(False)))
    named = _attr("sha256sum", F.sha2("png", 256)) if folders else F.lit("")
    blob = F.lit("") if folders else F.coalesce(F.regexp_replace(F.base64("png"), r"\s", ""), F.lit(""))
    state = F.when(anchor_collapsed(), F.lit(' state="coll"')).otherwise(F.lit(""))
    image = (
        F.when(image_kind() == "anchor", _element("encoded_png", [*place, _attr("anchor", F.col("anchor")), state], F.lit("")))
        .when(image_kind() == "latex", _element("encoded_png", [*place, _attr("filename", F.col("filename"))], xml_escape(F.coalesce(F.decode("png", "UTF-8"), F.lit("")))))
        .when(image_kind() == "file", _element("encoded_png", [*place, _attr("filename", F.col("filename")), _attr("time", F.col("time")), F.when(F.col("png").isNull(), F.lit("")).otherwise(named)], blob))
        .otherwise(_element("encoded_png", [*place, _attr("link", F.col("link")), F.when(F.col("png").isNull(), F.lit("")).otherwise(named)], blob))
    )
    out = store.codebox.select("node_id", "offset", F.lit("codebox").alias("kind"), code.alias("xml"))
    out = out.unionByName(store.grid.select("node_id", "offset", F.lit("table").alias("kind"), grid.alias("xml")))
    return out.unionByName(store.image.select("node_id", "offset", image_kind().alias("kind"), image.alias("xml")))


def node_elements(store: Store, paths: DataFrame, folders: bool) -> DataFrame:
    """(node_id, path, head, body) of each tree position: the open tag and what stands in it.

    Texts that are kept as XML go out with their runs; shared positions have no body.
    """
    from ..sources.stored import is_stored_rich

    rows, texts = store.split()
    node = decode_nodes(rows).withColumn("hid", F.col("node_id")).drop("node_id")
    plain = F.when(F.coalesce("txt", F.lit("")) == "", F.lit("")).otherwise(_element("rich_text", [], xml_escape("txt")))
    runs = F.regexp_extract("txt", r"(?s)<node(?:\s[^>]*)?>(.*)</node>", 1)
    text_xml = F.when(is_stored_rich(F.col("txt"), F.col("syntax")), runs).otherwise(plain)
    objects = object_elements(store, folders).groupBy("node_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "kind", "xml"))), lambda o: o["xml"]), "").alias("objects")
    )
    node = node.join(objects, F.col("hid") == F.col("node_id"), "left").drop("node_id")
    pos = lookup_join(paths.select("node_id", "path", "master_id", holder_id().alias("holder")), node, "holder", "hid", "inner")
    attrs = ("name", "tags", "read_only", "exclude_me", "exclude_children", "custom_icon_id", "is_bold", "foreground", "ts_creation", "ts_lastsave")
    head = F.concat(
        F.lit("<node"), *[_attr(a, F.col(c)) for a, c in (("unique_id", "node_id"), ("master_id", "master_id"), ("name", "name"), ("prog_lang", "syntax"), ("tags", "tags"))],
        *[_attr(a, _bit(c)) for a, c in (("readonly", "read_only"), ("nosearch_me", "exclude_me"), ("nosearch_ch", "exclude_children"))],
        _attr("custom_icon_id", F.col("custom_icon_id")), _attr("is_bold", _bit("is_bold")),
        *[_attr(c, F.col(c)) for c in ("foreground", "ts_creation", "ts_lastsave")], F.lit(">"),
    )
    # Texts meet their places last: none is moved by node, and copies of a text stand together.
    shown = F.when(F.coalesce("master_id", F.lit(0)) <= 0, F.col("text_id")).alias("text_id")
    # Tags are made there too, as the columns are shorter than their XML.
    placed = pos.select("node_id", "path", "master_id", *[F.col(c).alias(f"__{c}") for c in attrs], "syntax", "objects", shown, "stored")
    body = F.when(F.col("master_id") > 0, F.lit("")).otherwise(F.concat(text_xml, F.coalesce("objects", F.lit(""))))
    whole = join_texts(placed, texts, "path", "master_id", "objects", *[f"__{c}" for c in attrs]).withColumnsRenamed({f"__{c}": c for c in attrs})
    return whole.select("node_id", "path", "master_id", head.alias("head"), body.alias("body"))


def _id_lists(ranked: DataFrame, key: str) -> DataFrame:
    """(key, content): ids in order of ``rank``, joined by commas; parts are joined first, then the parts."""
    join = lambda value, order, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), sep)
    parts = ranked.withColumns({"part": F.floor(F.col("rank") / IDS_AT_ONCE), "id": F.col("node_id").cast("string")}).groupBy(key, "part").agg(join("id", "rank", ",").alias("ids"))
    return parts.groupBy(key).agg(join("ids", "part", ",").alias("content"))


def multifile_kinds(store: Store, paths: DataFrame) -> dict[str, DataFrame]:
    """The folder form of a store, as rows (path, content) of its files, by kind.

    ``node.xml`` per node in the folder of its path, one ``subnodes.lst`` per father,
    ``bookmarks.lst`` at the top, and each blob once per node folder, named by its digest.
    """
    folder = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "/")
    within = lambda c, name: F.concat(F.when(F.size(c) > 0, F.concat(folder(c), F.lit("/"))).otherwise(F.lit("")), name)
    nodes = node_elements(store, paths, folders=True).select(within(F.col("path"), F.lit("node.xml")).alias("path"), F.concat("head", "body", F.lit("</node>")).cast("binary").alias("content"))
    ranked = sibling_rank(paths.select("node_id", "father_id", "sequence", "path"))
    lists = _id_lists(ranked.withColumn("up", F.slice("path", F.lit(1), F.size("path") - 1)), "up")
    lists = lists.select(within(F.col("up"), F.lit("subnodes.lst")).alias("path"), F.col("content").cast("binary").alias("content"))
    marks = numbered(store.bookmark, [], [F.col("sequence"), F.col("node_id")], "rank")
    marks = _id_lists(marks.withColumn("name", F.lit("bookmarks.lst")), "name").select(F.col("name").alias("path"), F.col("content").cast("binary").alias("content"))
    blobs = store.image.where(F.col("png").isNotNull() & image_kind().isin("png", "file"))
    blobs = blobs.select("node_id", F.concat(F.sha2("png", 256), blob_name()).alias("name"), "png").groupBy("node_id", "name").agg(F.first("png").alias("content"))
    own = paths.where(F.coalesce("master_id", F.lit(0)) <= 0).select(F.col("node_id").alias("owner"), F.col("path").alias("of"))
    blobs = blobs.join(own, F.col("node_id") == F.col("owner")).select(within(F.col("of"), F.col("name")).alias("path"), "content")
    return {"node": nodes, "list": lists, "mark": marks, "blob": blobs}


def export_multifile(store: Store, paths: DataFrame) -> DataFrame:
    """All files of :func:`multifile_kinds`."""
    nodes, *others = multifile_kinds(store, paths).values()
    return reduce(DataFrame.unionByName, others, nodes)


def export_xml(store: Store, ordered: DataFrame) -> DataFrame:
    """The single-file form, one piece per node in document order: pos, node_id, piece.

    Sorted by ``pos`` the pieces make one document; how many nodes close after a piece
    follows from the depth of the next one. Bookmarks stand in the first piece.
    """
    last = ordered.agg(F.max("pos")).head()[0]
    nxt = ordered.select((F.col("pos") - 1).alias("p"), F.col("depth").alias("next_depth"))
    near = ordered.select("node_id", "pos", "depth").join(nxt, F.col("pos") == F.col("p"), "left").withColumn("close", F.col("depth") + 1 - F.coalesce("next_depth", F.lit(0)))
    marks = numbered(store.bookmark, [], [F.col("sequence"), F.col("node_id")], "rank").withColumn("one", F.lit(1))
    listed = _id_lists(marks, "one").select(F.col("content").alias("marks"), F.lit(1).cast("long").alias("first"))
    elements = node_elements(store, ordered, folders=False)
    rows = near.join(elements.select("node_id", "head", "body"), "node_id").join(listed, F.col("pos") == F.col("first"), "left")
    start = F.when(F.col("pos") == 1, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<store>\n<bookmarks list="'), F.coalesce("marks", F.lit("")), F.lit('"/>\n'))).otherwise(F.lit(""))
    end = F.when(F.col("pos") == F.lit(last), F.lit("</store>\n")).otherwise(F.lit(""))
    return rows.select("pos", "node_id", F.concat(start, "head", "body", F.repeat(F.lit("</node>\n"), F.col("close").cast("int")), end).alias("piece"))


def write_files(files: DataFrame, folder: str) -> int:
    """Writes rows (path, content) as the files ``folder/path``; returns how many.

    Each task writes its files under a name of its own and then moves them into place, so a
    task that is run again replaces what it wrote. ``folder`` is a path or URI that all
    executors reach.
    """

    def put(system, place: str, content: bytes | None) -> None:
        above, _, name = place.rpartition("/")
        system.create_dir(above, recursive=True)
        draft = f"{above}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(content or b"")
        system.move(draft, place)

    return _each_file(files.select("path", F.col("content").cast("binary").alias("content")), folder, put)


def remove_files(files: DataFrame, folder: str) -> int:
    """Deletes the files ``folder/path``, those that are there; returns how many rows were given."""

    def drop(system, place: str, _: bytes | None) -> None:
        if system.get_file_info(place).is_file:
            system.delete_file(place)

    return _each_file(files.select("path", F.lit(None).cast("binary").alias("content")), folder, drop)


def _each_file(files: DataFrame, folder: str, do) -> int:
    """``do(file system, path, content)`` for each row, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        local = folder.startswith("file:") or "://" not in folder
        system, root = (fs.LocalFileSystem(), re.sub(r"^file:/+", "/", folder)) if local else fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                do(system, f"{root}/{path}", content)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    return files.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
