"""Outline formats: level lists, indented lines, tagged records, NUL records,
and XML outlines that keep titles apart from bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, scan_array, with_marks
from ..operators.forest import sibling_rank
from ..plans.scan import numbered
from ..session import materialize
from .html import decode_xml_entities


#: Rows that are folded at a time, and spans of rows that are combined at a time.
BLOCK, FAN = 512, 256

#: Open rows, from the outermost to the last: the levels rise, as a row closes all of its level and below.
_STACK = "array<struct<level:bigint,id:bigint>>"


def _above(stack: Column, level: Column) -> Column:
    """What a row of that level leaves open."""
    return F.filter(stack, lambda x: x["level"] < level)


def _fold_rows(rows: Column) -> Column:
    """The rows (id, level) of a block, in order, as ``out`` and the ``stack`` they leave.

    Of each row: ``own`` rows of the block open above it, the last of them (``father``), and
    ``cut``: of the rows open before the block those of lower levels are open above it too.
    """
    out = "array<struct<id:bigint,father:bigint,own:int,cut:bigint>>"
    start = F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(out).alias("out"))

    def step(state: Column, row: Column) -> Column:
        def placed(stack: Column) -> Column:
            cut = F.coalesce(F.get(stack, F.lit(0))["level"], row["level"])
            father = F.get(stack, F.size(stack) - 1)["id"]
            made = F.struct(row["id"].alias("id"), father.alias("father"), F.size(stack).alias("own"), cut.alias("cut"))
            opened = F.struct(row["level"].alias("level"), row["id"].alias("id"))
            return F.struct(F.concat(stack, F.array(opened)).alias("stack"), F.concat(state["out"], F.array(made)).alias("out"))

        return let(_above(state["stack"], row["level"]), placed)

    return F.aggregate(rows, start, step)


def _fold_spans(spans: Column) -> Column:
    """Spans (low, stack) of rows, in order, as ``low`` and ``stack`` of them all; ``out`` has those before each span."""
    out = f"array<struct<low:bigint,stack:{_STACK}>>"
    start = F.struct(F.lit(None).cast("bigint").alias("low"), F.array().cast(_STACK).alias("stack"), F.array().cast(out).alias("out"))

    def step(state: Column, span: Column) -> Column:
        before = F.struct(state["low"].alias("low"), state["stack"].alias("stack"))
        left = F.concat(_above(state["stack"], span["low"]), span["stack"])
        return F.struct(F.least(state["low"], span["low"]).alias("low"), left.alias("stack"), F.concat(state["out"], F.array(before)).alias("out"))

    return F.aggregate(spans, start, step)


def _open_before(spans: DataFrame) -> DataFrame:
    """(doc, span, stack): the rows open at the start of each span (doc, span, low, stack), whatever the number of spans.

    Spans are combined FAN by FAN, bottom-up, and what is open is handed down again.
    """
    listed = F.array_sort(F.collect_list(F.struct("span", "low", "stack")))
    folded = spans.groupBy("doc", F.floor(F.col("span") / FAN).alias("upper")).agg(listed.alias("spans"))
    folded = folded.select("doc", "upper", "spans.span", _fold_spans(F.col("spans")).alias("f")).select("doc", "upper", "span", "f.*")
    folded = materialize(folded, "outline-spans")
    inner = folded.select("doc", "upper", F.explode(F.arrays_zip("span", "out")).alias("s")).select("doc", "upper", "s.span", F.col("s.out.low").alias("low"), F.col("s.out.stack").alias("stack"))
    if folded.groupBy("doc").count().where("count > 1").isEmpty():
        return inner.select("doc", "span", "stack")
    outer = _open_before(folded.select("doc", F.col("upper").alias("span"), "low", "stack"))
    outer = outer.select(F.col("doc").alias("__doc"), F.col("span").alias("__upper"), F.col("stack").alias("__outer"))
    joined = inner.join(outer, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("upper") == F.col("__upper")))
    left = F.when(F.col("low").isNull(), F.col("__outer")).otherwise(_above(F.col("__outer"), F.col("low")))
    return joined.select("doc", "span", F.concat(left, "stack").alias("stack"))


def outline_to_tree(rows: DataFrame, doc: str = "doc", pos: str = "pos", level: str = "level") -> DataFrame:
    """Parent links of level lists: adds node_id, father_id, sequence, depth.

    The father of a row on level L is the last earlier row p on level L-1 with no
    row of a level below L-1 between; level 1 hangs from the root (0). Rows
    below level 1 are ignored; a row without a father drops out with all below
    it.

    The rows open above a row form a stack of rising levels, and it hangs from the root if
    that stack holds one row of each level above its own. Blocks of rows are folded by
    themselves, their stacks are combined, and each row takes what was open before its
    block; so a document may hold any share of the rows, and levels may be of any number.
    """
    listed = rows.where(F.col(level) >= 1)
    ids = materialize(numbered(listed, [], [F.col(doc), F.col(pos)], "node_id"), "outline")
    slim = ids.select(F.col(doc).alias("doc"), F.floor(F.col("node_id") / BLOCK).alias("span"), F.col("node_id").alias("id"), F.col(level).cast("bigint").alias("level"))
    blocks = slim.groupBy("doc", "span").agg(F.array_sort(F.collect_list(F.struct("id", "level"))).alias("rows"), F.min("level").alias("low"))
    blocks = materialize(blocks.select("doc", "span", "low", _fold_rows(F.col("rows")).alias("f"), "rows").select("doc", "span", "low", "rows.level", "f.*"), "outline-blocks")
    before = _open_before(blocks.select("doc", "span", "low", "stack")).withColumnsRenamed({"doc": "__doc", "span": "__span", "stack": "before"})
    placed = blocks.drop("stack").join(before, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("span") == F.col("__span")))
    placed = placed.select("before", F.explode(F.arrays_zip("out", "level")).alias("r")).select("r.out.*", F.col("r.level").alias("at"), "before")
    placed = placed.withColumn("before", _above(F.col("before"), F.col("cut")))
    father = F.coalesce("father", F.get("before", F.size("before") - 1)["id"], F.lit(0))
    placed = placed.where(F.col("own") + F.size("before") == F.col("at") - 1).select(F.col("id").alias("node_id"), father.alias("father_id"))
    tree = ids.join(placed, "node_id").select(*ids.columns, "father_id")
    tree = tree.withColumns({"sequence": F.col("node_id"), "depth": (F.col(level) - 1).cast("long")})
    ranked = sibling_rank(materialize(tree, "outline-fathers"), unique_sequences=True)
    return ranked.withColumn("sequence", F.col("rank")).drop("rank")


def indented_lines_to_outline(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Indented lines to (pos, level, name); skipped levels get unnamed rows.

    The level is one plus the leading blanks and tabs; blank lines do not count.
    Fillers follow the highest level seen so far in the text, which never falls.
    """
    row = "struct<level:bigint,name:string>"

    def own(line: Column) -> Column:
        return let(F.regexp_replace(line, r"^[ \t]+", ""), lambda name: F.struct((F.length(line) - F.length(name) + 1).cast("bigint").alias("level"), name.alias("name")))

    def step(high: Column, x: Column) -> tuple[Column, Column]:
        skipped = F.transform(F.sequence(high + 1, x["level"] - 1), lambda k: F.struct(k.cast("bigint").alias("level"), F.lit("").alias("name")))
        fill = F.when(x["level"] - high > 1, skipped).otherwise(F.array().cast(f"array<{row}>"))
        return F.greatest(high, x["level"]), F.concat(fill, F.array(x))

    lines = F.filter(F.transform(F.split(F.replace(F.col(text), F.lit("\r")), "\n"), own), lambda x: x["name"] != "")
    rows = F.flatten(scan_array(lines, F.lit(0), "bigint", f"array<{row}>", step))
    return df.select(*keep, F.posexplode(rows).alias("i", "r")).select(*keep, (F.col("i") + 1).cast("long").alias("pos"), "r.level", "r.name")


def tagged_outline_to_rows(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``<node>`` records to (pos, level, name, contents).

    A record is the tag, the name (its first line and more lines up to one that
    holds digits), that level line, and the contents up to ``<end node>``.
    """
    clean = F.regexp_replace(F.col(text), r"\r(?=\n|\z)", "")
    records = F.split(clean, r"(?m)^<end node>[^\n]*(?:\n|\z)")

    def parsed(lines: Column) -> Column:
        tag = F.array_position(F.transform(lines, lambda x: x.startswith("<node>")), F.lit(True))
        # the level line is the first one with a digit below the name's first line
        level = lambda t: F.array_position(F.transform(lines, lambda x, i: (t > 0) & (i > t) & x.rlike(r"\d")), F.lit(True))
        at = lambda t: F.struct(t.alias("tag"), level(t).alias("level"))
        piece = lambda start, n, sep: F.array_join(F.slice(lines, start.cast("int"), n.cast("int")), sep)
        return let(let(tag, at), lambda p: F.when(
            p["level"] > 0,
            F.struct(
                F.regexp_extract(F.get(lines, (p["level"] - 1).cast("int")), r"(\d+)", 1).try_cast("long").alias("level"),
                piece(p["tag"] + 1, p["level"] - p["tag"] - 1, " ").alias("name"),
                piece(p["level"] + 1, F.size(lines), "\n").alias("contents"),
            ),
        ))

    return (
        df.select(*keep, F.posexplode(records).alias("pos", "rec")).select(*keep, "pos", let(F.split("rec", "\n", -1), parsed).alias("r"))
        .where("r IS NOT NULL").select(*keep, F.col("pos").cast("long").alias("pos"), "r.level", "r.name", "r.contents")
    )


def nul_records_to_outline(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """NUL-separated records to (pos, level, name, contents).

    Two header strings, then pairs: level byte with title, and contents.
    """
    parts = F.split(F.col(text), "\\x00")
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("p") - 4) / 2).cast("int")),
        lambda i: F.struct(F.get(F.col("p"), i * 2 + 2).alias("head"), F.get(F.col("p"), i * 2 + 3).alias("contents")),
    )
    return (
        df.select(*keep, trimmed.alias("p")).where("size(p) >= 4").select(*keep, F.posexplode(pairs).alias("pos", "r"))
        .select(
            *keep, F.col("pos").cast("long").alias("pos"), F.ascii("r.head").cast("long").alias("level"),
            F.substring(F.col("r.head"), F.lit(2), F.length("r.head")).alias("name"), F.col("r.contents").alias("contents"),
        )
    )


def xml_tree_rows(df: DataFrame, text: str, keep: list[str], tag: str) -> DataFrame:
    """Nested ``<tag>`` elements as rows: pos, level, head (the open tag) and
    body (what stands between it and the next such tag, open or close)."""
    shape = rf"<{tag}(?:\s[^>]*)?>|</{tag}>"
    cut = with_marks(F.col(text), 1, lambda t, m: F.split(F.regexp_replace(t, F.lit(f"({shape})"), F.concat(m[0], F.lit("$1"))), m[0]))
    segs = let(cut, lambda s: F.slice(s, F.lit(2), F.size(s)))
    rows = df.select(*keep, F.posexplode(segs).alias("seg_no", "seg"))
    head = F.regexp_extract("seg", f"^({shape})", 1)
    closing, empty = head.startswith("</"), head.endswith("/>")
    step = F.when(closing, -1).when(empty, 0).otherwise(1)
    before = Window.partitionBy(*keep).orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(step).over(before), F.lit(0))
    return (
        rows.withColumn("level", (depth + 1).cast("long")).where(~closing)
        .select(*keep, F.col("seg_no").cast("long").alias("pos"), "level", head.alias("head"),
                F.substring("seg", F.length(head) + 1, F.length("seg")).alias("body"))
    )


def xml_attr(head: Column | str, name: str) -> Column:
    """Value of an attribute of an open tag; '' when absent."""
    c = F.col(head) if isinstance(head, str) else head
    return decode_xml_entities(F.regexp_extract(c, rf"\s{name}\s*=\s*\"([^\"]*)\"", 1))


def xml_attrs(head: Column, names: list[str]) -> Column:
    """Several attributes of an open tag as a struct, read in one pass; '' when absent.

    Select its fields from a column of its own, so that it runs once per row.
    """
    pair = r'\s([\w:.-]+)\s*=\s*"([^"]*)"'
    bound = F.struct(
        F.regexp_extract_all(head, F.lit(pair), F.lit(1)).alias("keys"),
        F.transform(F.regexp_extract_all(head, F.lit(pair), F.lit(2)), decode_xml_entities).alias("vals"),
    )

    def pick(s: Column, name: str) -> Column:
        return F.coalesce(F.get(s["vals"], F.array_position(s["keys"], name).cast("int") - 1), F.lit("")).alias(name)

    return let(bound, lambda s: F.struct(*[pick(s, n) for n in names]))


def vnode_tnode_join(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Outline XML with titles in ``<v t=key><vh>`` and bodies in ``<t tx=key>``:
    pos, level, key, name, contents."""
    heads = xml_tree_rows(df, text, keep, "v").select(
        *keep, "pos", "level", xml_attr("head", "t").alias("key"),
        decode_xml_entities(F.regexp_extract("body", r"(?s)<vh>(.*?)</vh>", 1)).alias("name"),
    )
    bodies = df.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(r'(?s)<t\s+tx="[^"]*"[^>]*>.*?</t>'), F.lit(0))).alias("t"))
    bodies = bodies.select(
        *keep, F.regexp_extract("t", r'<t\s+tx="([^"]*)"', 1).alias("key"),
        decode_xml_entities(F.regexp_extract("t", r"(?s)^<t[^>]*>(.*)</t>\z", 1)).alias("contents"),
    ).dropDuplicates([*keep, "key"])
    return heads.join(bodies, [*keep, "key"], "left").withColumn("contents", F.coalesce("contents", F.lit("")))
