"""Stored forms of rich texts and grids: XML in the tables, plain values in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grids import header_first
from ..functions.text import is_true, to_int, xml_escape
from ..model import RICH_SYNTAX
from ..sinks.export import grid_to_xml
from .html import decode_xml_entities
from .store import Store, plain_parts, rewritten, text_id
from .xml_store import GRID_SCHEMA, parse_runs_xml

_RUN = r"(?s)<rich_text(?:\s[^>]*)?/>|<rich_text(?:\s[^>]*)?>.*?</rich_text>"
# How a stored rich text begins.
_HEAD, _ROOT = '<?xml version="1.0" encoding="UTF-8"?>\n', "<node>"


def is_stored_xml(txt: Column) -> Column:
    return txt.rlike(r"^\s*(?:<\?xml[^>]*\?>\s*)?<node[\s/>]")


def is_stored_rich(txt: Column, syntax: Column) -> Column:
    """Whether a text is the XML of a rich node, not a text read before."""
    return (syntax == RICH_SYNTAX) & is_stored_xml(txt)


def plain_of_rich(xml: Column) -> Column:
    """The text of all runs of a stored rich text, in order."""
    runs = F.regexp_extract_all(xml, F.lit(_RUN), F.lit(0))
    text = lambda p: decode_xml_entities(F.regexp_extract(p, r"(?s)^<rich_text[^>]*>(.*)</rich_text>\z", 1))
    return F.array_join(F.transform(runs, text), "")


def rich_of_plain(text: Column) -> Column:
    """A text as a stored rich text of one run."""
    run = F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("<rich_text>"), xml_escape(text), F.lit("</rich_text>")))
    return F.concat(F.lit(_HEAD + _ROOT), run, F.lit("</node>"))


def decode_store(store: Store) -> Store:
    """The store with plain texts and cells, whatever form its rows are kept in.

    Texts of rich nodes become the text of their runs; grids without cells get them, with
    the header first and their flags, from their XML. Rows that are plain already stay. Only
    columns that a query uses are decoded. Runs and their links: ``stored_runs``.
    """
    txt = F.when(is_stored_rich(F.col("txt"), F.col("syntax")), plain_of_rich(F.col("txt"))).otherwise(F.col("txt"))
    parsed = store.grid.withColumn("__x", F.when(F.col("cells").isNull(), F.from_xml(F.col("txt"), GRID_SCHEMA, {"ignoreSurroundingSpaces": "false"})))
    rows = header_first(F.transform("__x.row", lambda r: F.transform(r["cell"], lambda c: F.coalesce(c, F.lit("")))))
    widths = F.coalesce(F.col("__x._col_widths"), F.lit(""))
    grid = parsed.withColumns({
        "cells": F.coalesce("cells", rows),
        "is_light": F.coalesce("is_light", is_true("__x._is_light"), F.lit(False)),
        "col_widths": F.coalesce("col_widths", F.when(widths != "", F.transform(F.split(widths, ","), to_int).cast("array<int>")), F.array().cast("array<int>")),
    }).drop("__x")
    out = store.with_tables(grid=grid.where(F.coalesce(F.size("cells"), F.lit(0)) > 0))
    # texts kept apart are decoded as they meet their rows
    return out if store.parts else out.with_tables(node=store.node.withColumn("txt", txt))


def encode_store(store: Store) -> Store:
    """The inverse for plain tables: rich texts as one run, grids as XML without cells."""
    rich = F.col("syntax") == RICH_SYNTAX
    widths = F.array_join(F.transform(F.coalesce("col_widths", F.array().cast("array<int>")), lambda w: w.cast("string")), ",")
    xml = grid_to_xml(F.col("cells"), F.col("offset"), F.coalesce("justification", F.lit("left")), F.coalesce("col_max", F.lit(0)), widths, F.coalesce("is_light", F.lit(False)))
    null = lambda t: F.lit(None).cast(t)
    grid = store.grid.withColumns({"txt": xml, "cells": null("array<array<string>>"), "is_light": null("boolean"), "col_widths": null("array<int>")})
    if store.parts is None:
        return store.with_tables(node=store.node.withColumn("txt", F.when(rich, rich_of_plain(F.coalesce("txt", F.lit("")))).otherwise(F.col("txt"))), grid=grid)
    # a rich node without a text has one without runs
    rows, texts = plain_parts(store)
    none = texts.sparkSession.range(1).select(F.lit("").alias("txt")).select(text_id("txt").alias("text_id"), "txt")
    rows = rows.withColumn("text_id", F.when(rich & F.col("text_id").isNull(), text_id(F.lit(""))).otherwise(F.col("text_id")))
    return store.with_tables(grid=grid).with_parts(*rewritten(rows, texts.unionByName(none), F.lit(True), rich_of_plain(F.col("txt")), rich))


def stored_runs(store: Store) -> DataFrame:
    """The runs of a store that is not decoded: node_id, run_idx, start_offset, text, attrs."""
    kept = store.node.where(is_stored_rich(F.col("txt"), F.col("syntax")))
    return parse_runs_xml(kept, "txt", ["node_id"])
