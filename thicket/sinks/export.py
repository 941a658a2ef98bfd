"""Writing: stores, text, HTML, indexes, CSV, XML, blobs and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, scan_array
from ..functions.grids import cells_to_html, cells_to_text, header_last
from ..functions.text import base_direction, hier_name, is_sha256, xml_escape
from ..model import HORIZONTAL_RULE, TABLES
from ..operators.aggregates import has_flags
from ..operators.linkgraph import resolve_hrefs
from ..operators.merge import OBJECT_TABLES, export_subtree
from ..operators.search import object_positions
from ..operators.shared import holder_id
from ..plans.joins import lookup_join
from ..sources.store import Store, image_kind, join_texts, named_texts, node_kind, plain_parts

def prepare_store(store: Store) -> Store:
    """As it is written: objects of rich nodes only, has_* flags from the objects."""
    rich = store.node.where(node_kind("syntax") == "rich").select("node_id")
    kept = {n: getattr(store, n).join(rich, "node_id", "left_semi") for n in OBJECT_TABLES}
    slim = store.with_tables(**kept)
    rows, texts = store.split()
    flagged = rows.drop("has_codebox", "has_table", "has_image").join(has_flags(slim), "node_id").select(*rows.columns)
    return slim.with_parts(flagged, texts)


def save_store(store: Store, path: str, root: int | None = None, ordered: DataFrame | None = None, with_children: bool = True) -> None:
    """Write all six tables, or those of one node or subtree, as Parquet.

    ``children`` is clustered by father and the objects by node, so that reads
    by either skip files. Texts go to a table of their own, each once, and nodes name them.
    """
    out = store if root is None else export_subtree(store, ordered, root, with_children)
    rows, texts = plain_parts(out)
    out = prepare_store(out.with_parts(rows, texts))
    named_texts(rows, texts).write.mode("overwrite").parquet(f"{path}/text")
    for name in TABLES:
        df = out.parts[0].drop("stored") if name == "node" else getattr(out, name)
        key = "father_id" if name == "children" else "node_id"
        df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")


def _object_id(table: str) -> Column:
    """A number that splits ties between objects of one kind at one offset."""
    return F.xxhash64(*{"codebox": ("txt", "syntax"), "grid": ("cells",), "image": ("anchor", "filename", "link", "png")}[table])


def _object_pieces(store: Store, render: dict[str, Column], hrefs: DataFrame | None = None) -> DataFrame:
    """Text form of each object at its text position, one list per node.

    The export of a node is one value, so its objects meet in one row anyway. With ``hrefs``
    (link, href) pictures have no text yet: ``picture`` marks them and ``href`` is where they
    link to; only digests of them move.
    """
    rest = [F.lit(False).alias("picture"), F.lit("").alias("href")]
    code = store.codebox.select("node_id", "offset", F.lit("codebox").alias("kind"), _object_id("codebox").alias("obj_id"), render["codebox"].alias("piece"), *rest)
    light = F.when(F.coalesce("is_light", F.lit(False)), F.lit("grid_light")).otherwise(F.lit("grid_heavy"))
    grid = store.grid.select("node_id", "offset", light.alias("kind"), _object_id("grid").alias("obj_id"), render["grid"].alias("piece"), *rest)
    image = store.image.select("node_id", "offset", image_kind().alias("kind"), _object_id("image").alias("obj_id"), render["image"].alias("piece"), F.coalesce("link", F.lit("")).alias("link"))
    if hrefs is None:
        image = image.drop("link").select("*", *rest)
    else:
        image = image.withColumn("picture", F.col("kind").isin("png", "latex"))
        image = lookup_join(image, hrefs.withColumnRenamed("link", "known"), "link", "known", "left", check=False)
        image = image.select("node_id", "offset", "kind", "obj_id", "piece", "picture", F.when(F.col("kind") == "png", F.coalesce("href", F.lit(""))).otherwise(F.lit("")).alias("href"))
    placed = object_positions(code.unionByName(grid).unionByName(image))
    return placed.groupBy(F.col("node_id").alias("oid")).agg(
        F.sort_array(F.collect_list(F.struct("obj_rank", "text_pos", "piece", "picture", "href"))).alias("objs")
    )


_PIECE = "struct<obj_rank:bigint,text_pos:bigint,piece:string,picture:boolean,href:string>"


def _with_pictures(objs: Column, node_id: str) -> Column:
    """The objects of a node with its pictures numbered in order and written as HTML."""

    def step(n: Column, x: Column) -> tuple[Column, Column]:
        now = n + x["picture"].cast("long")
        file = F.concat(F.lit("images/"), F.col(node_id).cast("string"), F.lit("-"), now.cast("string"), F.lit(".png"))
        img = F.concat(F.lit('<img src="'), file, F.lit('" alt="'), file, F.lit('" />'))
        linked = F.when(x["href"] == "", img).otherwise(F.concat(F.lit('<a href="'), xml_escape(x["href"]), F.lit('">'), img, F.lit("</a>")))
        piece = F.when(x["picture"], linked).otherwise(x["piece"])
        return now, F.struct(x["obj_rank"], x["text_pos"], piece, x["picture"], x["href"])

    return F.when(objs.isNotNull(), scan_array(objs, F.lit(0), "bigint", _PIECE, step))


def _embedded_file(node_id: Column) -> Column:
    return F.concat(F.lit("EmbeddedFiles/"), node_id.cast("string"), F.lit("-"), "filename")


def html_files(store: Store) -> DataFrame:
    """The files that the pages of :func:`export_html` show or link to: path, content.

    Pictures are numbered per node in order of their places, LaTeX boxes, which aren't
    rendered, included.
    """
    image = store.image.withColumns({"kind": image_kind(), "obj_id": _object_id("image")})
    shown = image.where(F.col("kind").isin("png", "latex"))
    listed = shown.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("offset", "kind", "obj_id"))).alias("l"))
    numbers = listed.select("node_id", F.posexplode("l").alias("i", "o")).select("node_id", "o.*", "i")
    file = F.concat(F.lit("images/"), F.col("node_id").cast("string"), F.lit("-"), (F.col("i") + 1).cast("string"), F.lit(".png"))
    pictures = shown.where("kind = 'png' AND png IS NOT NULL").join(numbers, ["node_id", "offset", "kind", "obj_id"]).select(file.alias("path"), F.col("png").alias("content"))
    embedded = image.where("kind = 'file'").select(_embedded_file(F.col("node_id")).alias("path"), F.coalesce("png", F.lit(b"")).alias("content"))
    return pictures.unionByName(embedded).groupBy("path").agg(F.first("content").alias("content"))


def _interleave(text: Column, objs: Column, escape: bool = False) -> Column:
    """``text`` (XML-escaped on demand) with the pieces put in at their text positions."""
    def weave(s: Column) -> Column:
        def part(i: Column) -> Column:
            start = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(s["o"], i - 1)["text_pos"])
            end = F.when(i < F.size(s["o"]), F.get(s["o"], i)["text_pos"]).otherwise(F.length(s["t"]).cast("long"))
            piece = F.when(i < F.size(s["o"]), F.get(s["o"], i)["piece"]).otherwise(F.lit(""))
            cut = F.substring(s["t"], (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
            return F.concat(xml_escape(cut) if escape else cut, piece)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(s["o"])), part), "")

    empty = F.array().cast(f"array<{_PIECE}>")
    return let(F.struct(text.alias("t"), F.coalesce(objs, empty).alias("o")), weave)


def _latex_body(blob: Column) -> Column:
    text = blob.cast("string")
    inner = F.regexp_extract(text, r"(?s)\\begin\{document\}.(.*).\\end\{document\}", 1)
    return F.when(inner != "", inner).otherwise(text)


def _text_pieces(store: Store) -> DataFrame:
    """Objects of each node as plain text."""
    rule = F.lit("\n" + HORIZONTAL_RULE + "\n")
    return _object_pieces(store, {
        "codebox": F.concat(rule, F.coalesce("txt", F.lit("")), rule),
        "grid": cells_to_text(F.col("cells")),
        "image": F.when(image_kind() == "latex", F.concat(rule, F.coalesce(_latex_body(F.col("png")), F.lit("")), rule)).otherwise(F.lit("")),
    })


def node_texts(store: Store, *columns: str) -> DataFrame:
    """Plain text of every holder, objects included: node_id, content, and more
    ``columns`` of the node."""
    rows, texts = store.split()
    joined = rows.join(_text_pieces(store), F.col("node_id") == F.col("oid"), "left")
    return join_texts(joined, texts, "objs").select("node_id", _interleave(F.col("txt"), F.col("objs")).alias("content"), *columns)


def export_text(store: Store, ordered: DataFrame, with_name: bool = True) -> DataFrame:
    """One row per tree position: pos, node_id, content.

    Sorted by ``pos`` the contents are the single-file export; written with a
    range sort, its part files follow each other.
    """
    rows, texts = store.split()
    bodies = rows.join(_text_pieces(store), F.col("node_id") == F.col("oid"), "left").select(F.col("node_id").alias("hid"), "name", "objs", "text_id", "stored")
    pos = ordered.select("node_id", "pos", "depth", holder_id().alias("holder"))
    # texts come last: they are not moved to their places
    joined = join_texts(lookup_join(pos, bodies, "holder", "hid", "inner"), texts, "objs", "pos", "depth")
    joined = joined.withColumn("content", _interleave(F.col("txt"), F.col("objs")))
    title = F.concat(F.repeat(F.lit("#"), (F.col("depth") + 1).cast("int")), F.lit(" "), "name", F.lit("\n")) if with_name else F.lit("")
    return joined.select("pos", "node_id", F.concat(title, "content", F.lit("\n\n")).alias("content"))


def export_html(store: Store, ordered: DataFrame, named: DataFrame, single_file: bool = False) -> DataFrame:
    """HTML page per tree position: pos, node_id, file_name, html (the page body).

    Every line is a ``<p>``, right-to-left lines are marked, grids are tables
    with a header row; pictures and embedded files are shown or linked as
    :func:`html_files` names them, pictures that link to the page, file or address they lead
    to. In single-file mode titles carry their level and each
    page starts with an anchor. ``named``: node_id and names from the root.
    """
    links = store.image.where((image_kind() == "png") & (F.coalesce("link", F.lit("")) != "")).select("link").distinct()
    hrefs = resolve_hrefs(links, named, single_file).select("link", "href")
    just = F.coalesce("justification", F.lit(""))
    align = F.when(just == "center", F.lit("margin-left:auto;margin-right:auto")).when(just == "right", F.lit("margin-left:auto")).otherwise(F.lit("display:inline-table"))
    pieces = _object_pieces(store, {
        "codebox": F.concat(F.lit('<div class="codebox">'), F.replace(xml_escape("txt"), F.lit("\n"), F.lit("<br/>")), F.lit("</div>")),
        "grid": cells_to_html(F.col("cells")),
        "image": F.when(image_kind() == "anchor", F.concat(F.lit('<a name="'), xml_escape("anchor"), F.lit('"></a>')))
        .when(image_kind() == "file", F.concat(
            F.lit('<table style="'), align, F.lit('"><tr><td><a href="'), xml_escape(_embedded_file(F.col("node_id"))), F.lit('">Linked file: '), xml_escape("filename"), F.lit(" </a></td></tr></table>"),
        )).otherwise(F.lit("")),
    }, hrefs)
    rows, texts = store.split()
    nodes = rows.join(pieces, F.col("node_id") == F.col("oid"), "left")
    nodes = nodes.select(F.col("node_id").alias("hid"), "name", "syntax", "text_id", "stored", _with_pictures(F.col("objs"), "node_id").alias("objs"))
    # Escaping changes lengths, so the text is cut first and escaped per piece.
    woven = _interleave(F.col("txt"), F.col("objs"), escape=True)

    def paragraphs(s: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            last = i == F.size(s["lines"]) - 1
            rtl = base_direction(F.coalesce(F.get(s["src"], i), F.lit(""))) == "rtl"
            tag = F.when(rtl, F.lit('<p dir="rtl">')).otherwise(F.lit("<p>"))
            return F.when(last & (line == ""), F.lit("")).otherwise(F.concat(tag, line, F.lit("</p>")))

        return F.array_join(F.transform(s["lines"], one), "")

    text_body = let(F.struct(F.split(woven, "\n").alias("lines"), F.split("txt", "\n").alias("src")), paragraphs)
    code_body = F.concat(F.lit("<pre>"), xml_escape("txt"), F.lit("</pre>"))
    files = named.select(
        F.col("node_id").alias("nid"),
        hier_name(F.col("names"), "--", True, node_id=F.col("node_id"), trailer=".html", html=True).alias("file_name"),
    )
    pos = ordered.select("node_id", "pos", "depth", holder_id().alias("holder")).join(files, F.col("node_id") == F.col("nid"))
    # texts come last: they are not moved to their places
    joined = join_texts(lookup_join(pos, nodes, "holder", "hid", "inner"), texts, "objs", "pos", "depth", "file_name")
    joined = joined.withColumn("body", F.when(node_kind("syntax") == "code", code_body).otherwise(text_body))
    if single_file:
        head = F.concat(
            F.lit("<div class='page'><a name=\""), "file_name", F.lit("\"></a><h1 class='title level-"),
            (F.col("depth") + 1).cast("string"), F.lit("'>"), "name", F.lit("</h1><br/>"),
        )
    else:
        head = F.concat(F.lit("<div class='page'><h1 class='title'>"), "name", F.lit("</h1><br/>"))
    return joined.select("pos", "node_id", "file_name", F.concat(head, "body", F.lit("</div>")).alias("html"))


def export_index(ordered: DataFrame, named: DataFrame) -> DataFrame:
    """Nested list index, one piece per node in document order: pos, node_id, piece.

    How many lists close after a node follows from its depth and that of the
    next position, which is one equi-join on the dense order.
    """
    nxt = ordered.select((F.col("pos") - 1).alias("p"), F.col("depth").alias("next_depth"))
    near = ordered.select("node_id", "pos", "depth").join(nxt, F.col("pos") == F.col("p"), "left").withColumn(
        "next_depth", F.coalesce("next_depth", F.lit(0))
    )
    pages = named.select(
        F.col("node_id").alias("nid"), F.element_at("names", -1).alias("name"),
        F.replace(hier_name(F.col("names"), "--", True, node_id=F.col("node_id"), trailer=".html", html=True), F.lit("'"), F.lit("\\'")).alias("href"),
    )
    joined = near.join(pages, F.col("node_id") == F.col("nid"))
    link = F.concat(F.lit("<a href='"), "href", F.lit("'>"), "name", F.lit("</a></li>"))
    leaf = F.concat(F.lit("<li class='leaf'>"), link, F.lit("\n"), F.array_join(F.array_repeat(F.lit("</ul>\n"), F.greatest(F.col("depth") - F.col("next_depth"), F.lit(0)).cast("int")), ""))
    inner = F.concat(F.lit("<li><button onclick='toggleSubTree(this)'>-</button> "), link, F.lit("<ul class='subtree'>\n"))
    return joined.select("pos", "node_id", F.when(F.col("next_depth") > F.col("depth"), inner).otherwise(leaf).alias("piece"))


def grid_to_xml(cells: Column, offset: Column, just: Column, width: Column, col_widths: Column, is_light: Column) -> Column:
    """Grid XML with the header row last."""
    row = lambda r: F.concat(F.lit("<row>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<cell>"), xml_escape(c), F.lit("</cell>"))), ""), F.lit("</row>"))
    light = F.when(is_light, F.lit(' is_light="1"')).otherwise(F.lit(""))
    return F.concat(
        F.lit('<table char_offset="'), offset.cast("string"), F.lit('" justification="'), just, F.lit('" col_min="'), width.cast("string"),
        F.lit('" col_max="'), width.cast("string"), F.lit('" col_widths="'), col_widths, F.lit('"'), light, F.lit(">"),
        F.array_join(F.transform(header_last(cells), row), ""), F.lit("</table>"),
    )


def new_blobs(image: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Contents to write, each once, named by their SHA-256: sha, png.

    Hashes are compared first, so bytes of known contents never move.
    """
    named = image.where("png IS NOT NULL").select(F.sha2("png", 256).alias("sha"), "png")
    if existing is not None:
        named = named.join(existing.select("sha").distinct(), "sha", "left_anti")
    return named.groupBy("sha").agg(F.first("png").alias("png"))


def blob_store(image: DataFrame, path: str) -> int:
    """Append new contents to the blob table at ``path``; returns how many."""
    spark = image.sparkSession
    try:
        existing = spark.read.parquet(path).select("sha")
    except Exception:  # nothing stored yet
        existing = None
    from ..session import materialize

    fresh = materialize(new_blobs(image, existing), "blobs")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def unreferenced_files(files: DataFrame, referenced: DataFrame) -> DataFrame:
    """Files of node folders that nothing refers to.

    ``files``: node_id, file_name. Node data files and content-named blobs stay.
    """
    # Names of a node folder's own data files.
    own = F.col("file_name").isin("node.xml", "subnodes.lst", "bookmarks.lst")
    loose = files.where(~own & ~is_sha256(F.regexp_replace("file_name", r"\.[^.]*$", "")))
    return loose.join(referenced.select("node_id", "file_name").distinct(), ["node_id", "file_name"], "left_anti")


def write_ordered_text(rows: DataFrame, path: str, content: str = "content") -> None:
    """Rows sorted by ``pos`` as text parts whose names follow the order."""
    rows.repartitionByRange("pos").sortWithinPartitions("pos").select(content).write.mode("overwrite").text(path, lineSep="")


__all__ = [
    "blob_store", "export_html", "html_files", "export_index", "export_text", "grid_to_xml", "new_blobs",
    "node_texts", "prepare_store", "save_store", "unreferenced_files", "write_ordered_text",
]
