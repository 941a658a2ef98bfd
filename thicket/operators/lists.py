"""Lists, to-dos and tables of contents written in plain text.

A text is one row to begin with, so its lines are folded within the row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, scan_array, with_marks
from ..model import LIST_BULLETS, LIST_NUMBER_ENDS, TOC_BULLETS, TODO_MARKS
from ..plans.joins import dealt, lookup_join
from ..plans.scan import Running, running

INDENT = 3


#: A line's own grammar, and then the item it belongs to.
_LINE = (
    "struct<line_no:bigint,line:string,line_offset:bigint,own_kind:string,own_level:bigint,own_num:bigint,own_aux:bigint,"
    "kind:string,level:bigint,num_seq:bigint,aux:bigint,startoffs:bigint,count_nl:bigint>"
)
_ITEM = "struct<line_no:bigint,level:bigint,kind:string,num:bigint,aux:bigint,startoffs:bigint>"


def _own(line: Column, line_no: Column) -> Column:
    """Own grammar of one line: indent level, kind, number and bullet index."""
    is_mark = lambda marks, rest: (F.substring(rest, 1, 1) != "") & (F.instr(F.lit(marks), F.substring(rest, 1, 1)) > 0) & (F.substring(rest, 2, 1) == " ")

    def of_rest(s: Column) -> Column:
        rest, number = s["rest"], s["number"]
        kind = F.when(is_mark(LIST_BULLETS, rest), F.lit("bullet")).when(is_mark(TODO_MARKS, rest), F.lit("todo")).when(number != "", F.lit("number")).otherwise(F.lit("none"))
        end = F.substring(rest, F.length(number) + 1, F.lit(1))
        return let(kind, lambda k: F.struct(
            line_no.cast("bigint").alias("line_no"), line.alias("line"), s["level"].alias("own_level"), k.alias("own_kind"),
            F.when(k == "number", number.try_cast("long")).otherwise(F.lit(-1)).cast("long").alias("own_num"),
            F.when(k == "bullet", F.instr(F.lit(LIST_BULLETS), F.substring(rest, 1, 1)) - 1).when(k == "number", F.instr(F.lit(LIST_NUMBER_ENDS), end) - 1).otherwise(F.lit(-1)).cast("long").alias("own_aux"),
        ))

    def of_level(level: Column) -> Column:
        rest = F.substring(line, (level * INDENT + 1).cast("int"), F.length(line))
        return let(rest, lambda r: let(F.struct(r.alias("rest"), level.alias("level"), F.regexp_extract(r, r"^([1-9]\d*)[.)\->] ", 1).alias("number")), of_rest))

    return let(F.floor(F.length(F.regexp_extract(line, r"^((?:   )*+)", 1)) / INDENT).cast("long"), of_level)


def _lines(text: Column) -> Column:
    """The lines of a text with the item that each belongs to, folded within the row."""
    no_item = F.lit(None).cast(_ITEM)
    state_type = f"struct<offset:bigint,item:{_ITEM},broken:boolean>"
    start = F.struct(F.lit(0).cast("long").alias("offset"), no_item.alias("item"), F.lit(True).alias("broken"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        new = x["own_kind"] != "none"
        own = F.struct(x["line_no"].alias("line_no"), x["own_level"].alias("level"), x["own_kind"].alias("kind"), x["own_num"].alias("num"), x["own_aux"].alias("aux"), state["offset"].alias("startoffs"))
        item = F.when(new, own).otherwise(state["item"])
        broken = ~new & (state["broken"] | F.coalesce(x["own_level"] != state["item"]["level"] + 1, F.lit(True)))
        of = lambda c: F.when(~broken, item[c])
        out = F.struct(
            x["line_no"], x["line"], state["offset"], x["own_kind"], x["own_level"], x["own_num"], x["own_aux"],
            F.when(~broken, item["kind"]).otherwise(F.lit("none")), of("level"), of("num"), of("aux"), of("startoffs"), F.when(~broken, x["line_no"] - item["line_no"]),
        )
        return F.struct(state["offset"] + F.length(x["line"]) + 1, item, broken), out

    return scan_array(F.transform(F.split(text, "\n"), _own), start, state_type, _LINE, step)


def list_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Every line with the list item it belongs to.

    A line that is no item itself continues the item above when it is indented
    one level deeper and no other line lies between. ``kind`` is ``none`` for
    lines outside lists; ``count_nl`` counts lines since the item's first.
    """
    return df.select(*keep, F.explode(_lines(F.col(text))).alias("l")).select(*keep, "l.*")


def list_items(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per list item, its continuation lines joined in."""

    def items(lines: Column) -> Column:
        last = lambda x, i: F.coalesce(F.get(lines, i + 1)["startoffs"] != x["startoffs"], F.lit(True))
        ends = F.filter(lines, lambda x, i: (x["kind"] != "none") & last(x, i))

        def one(x: Column) -> Column:
            own = F.slice(lines, (x["line_no"] - x["count_nl"] + 1).cast("int"), (x["count_nl"] + 1).cast("int"))
            item_text = F.array_join(F.transform(own, lambda y: y["line"]), "\n")
            return F.struct(x["startoffs"].alias("startoffs"), x["kind"].alias("kind"), x["level"].alias("level"), x["num_seq"].alias("num_seq"), x["aux"].alias("aux"), (x["count_nl"] + 1).alias("n_lines"), item_text.alias("item_text"))

        return F.transform(ends, one)

    return df.select(*keep, F.explode(let(_lines(F.col(text)), items)).alias("l")).select(*keep, "l.*")


def renumber_lists(df: DataFrame, text: str, keep: list[str], from_line: int = -1, start: int = 1, level: int = 0) -> DataFrame:
    """Numbers on ``level`` made consecutive after line ``from_line``.

    Stops at the first line outside lists or the first item on the level that is
    no number; deeper and shallower items are passed over.
    """

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        after = x["line_no"] > from_line
        stopped = state["stopped"] | (after & ((x["kind"] == "none") | ((x["level"] == level) & (x["kind"] != "number"))))
        hit = after & ~stopped & (x["own_kind"] == "number") & (x["own_level"] == level)
        new = F.concat(F.repeat(F.lit(" "), F.lit(INDENT * level)), state["next"].cast("string"), F.regexp_replace(F.ltrim(x["line"]), r"^\d+", ""))
        return F.struct(stopped, state["next"] + hit.cast("long")), F.when(hit, new).otherwise(x["line"])

    begin = F.struct(F.lit(False), F.lit(start).cast("long"))
    out = scan_array(_lines(F.col(text)), begin, "struct<stopped:boolean,next:bigint>", "string", step)
    return dealt(df.where(F.col(text).isNotNull()).select(*keep, text), read=True).select(*keep, F.array_join(out, "\n").alias("text"))


def indent_lists(df: DataFrame, text: str, keep: list[str], increase: bool = True, indent: str = "\t") -> DataFrame:
    """All lines one level deeper or back, as by Tab and Shift+Tab on a selection.

    Items move by three spaces and take the bullet or number style of the
    nearest item above on the new level, else the next style in the cycle;
    other lines get or lose ``indent``. Above a line the levels still open form a stack,
    which a line outside lists empties; so any depth works, within the row.
    """
    step_by = 1 if increase else -1
    entry = "struct<level:bigint,kind:string,aux:bigint,num:bigint>"
    pick = lambda chars, i: F.substring(F.lit(chars), i + 1, F.lit(1))

    def moved(x: Column, target: Column, above: Column) -> Column:
        found = F.coalesce(above["level"] == target, F.lit(False))
        cycled = lambda size: F.pmod(target + x["own_aux"] - x["own_level"] % size, F.lit(size)).cast("int")
        bullet = F.when(found & (above["kind"] == "bullet"), above["aux"].cast("int")).otherwise(cycled(len(LIST_BULLETS)))
        same_number = found & (above["kind"] == "number")
        number = F.when(same_number, above["num"] + 1).otherwise(F.lit(1))
        end = F.when(same_number, above["aux"].cast("int")).otherwise(cycled(len(LIST_NUMBER_ENDS)))
        body = F.substring(x["line"], (x["own_level"] * INDENT + 1).cast("int"), F.length(x["line"]))
        styled = (
            F.when(x["own_kind"] == "bullet", F.concat(pick(LIST_BULLETS, bullet), F.substring(body, F.lit(2), F.length(body))))
            .when(x["own_kind"] == "number", F.concat(number.cast("string"), pick(LIST_NUMBER_ENDS, end), F.regexp_replace(body, r"^\d+[.)\->]", "")))
            .otherwise(body)
        )
        return F.concat(F.repeat(F.lit(" " * INDENT), target.cast("int")), styled)

    def step(stack: Column, x: Column) -> tuple[Column, Column]:
        target = x["own_level"] + step_by
        below = F.filter(stack, lambda e: e["level"] <= target)
        above = F.get(below, F.size(below) - 1)
        outside = x["kind"] == "none"
        moves = ~outside & (F.lit(increase) | (x["level"] > 0))
        plain = (
            F.concat(F.lit(indent), x["line"]) if increase
            else F.when(x["line"].startswith(indent), F.substring(x["line"], F.lit(len(indent) + 1), F.length(x["line"]))).otherwise(x["line"])
        )
        own = F.array(F.struct(x["level"].alias("level"), x["kind"].alias("kind"), x["aux"].alias("aux"), x["num_seq"].alias("num")))
        left = F.when(outside, F.array().cast(f"array<{entry}>")).otherwise(F.concat(F.filter(stack, lambda e: e["level"] < x["level"]), own))
        return left, F.when(moves, moved(x, target, above)).when(outside, plain).otherwise(x["line"])

    out = scan_array(_lines(F.col(text)), F.array().cast(f"array<{entry}>"), f"array<{entry}>", "string", step)
    return dealt(df.where(F.col(text).isNotNull()).select(*keep, text), read=True).select(*keep, F.array_join(out, "\n").alias("text"))


def rotate_todo(c: Column) -> Column:
    """Every to-do mark at a list start to its next state: open, done, dropped."""

    def turn(out: Column, m: list[Column]) -> Column:
        for mark, stand_in in zip(TODO_MARKS, m):
            out = F.regexp_replace(out, F.lit(rf"(?m)^((?:   )*+){mark} "), F.concat(F.lit("$1"), stand_in, F.lit(" ")))
        return F.call_function("translate", out, F.concat(*m), F.lit(TODO_MARKS[1:] + TODO_MARKS[0]))

    return with_marks(c, 3, turn)


def todo_status(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """To-do items per state; counted inside the row, then combined."""
    marks = F.regexp_extract_all(F.col(text), F.lit(f"(?m)^(?:   )*+([{TODO_MARKS}]) "), F.lit(1))
    named = F.create_map(*[x for m, n in zip(TODO_MARKS, ("open", "done", "dropped")) for x in (F.lit(m), F.lit(n))])
    return (
        df.select(*keep, F.explode(marks).alias("mark")).select(*keep, named[F.col("mark")].alias("status"))
        .groupBy(*keep, "status").agg(F.count(F.lit(1)).cast("long").alias("n"))
    )


def legacy_todo(c: Column) -> Column:
    """``[ ]`` and ``[X]`` at line starts become to-do marks."""
    done = F.regexp_replace(c, r"(?m)^\[X\]", TODO_MARKS[1])
    return F.regexp_replace(done, r"(?m)^\[ \]", TODO_MARKS[0])


def toc(headings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Table of contents rows of nodes and their headings.

    ``headings``: node_id, offset, scale (``h1``..``h6`` or a digit; others such
    as ``small`` do not count), text. ``nodes``: node_id, name, depth. Anchors
    are numbered per level within the node; one node may hold most headings, so
    the numbering runs over buckets.
    """
    level = F.regexp_extract("scale", r"^h?([1-6])$", 1).try_cast("long")
    heads = headings.withColumn("level", level).where("level IS NOT NULL")
    heads = running(heads, ["node_id", "level"], [F.col("offset")], {"n": Running("count", F.lit(1))},
                    bucket=F.floor(F.col("offset") / 1_000_000))
    anchor = F.concat(F.lit("h"), F.col("level").cast("string"), F.lit("-"), F.col("n").cast("string"))
    depths = nodes.select(F.col("node_id").alias("nid"), "depth")
    located = lookup_join(heads, depths, "node_id", "nid", "inner")
    bullet = F.substring(F.lit(TOC_BULLETS), F.least(F.col("level") + 2, F.lit(len(TOC_BULLETS))).cast("int"), F.lit(1))
    rows = located.select(
        "node_id", F.col("offset").cast("long").alias("offset"), F.col("level").cast("long").alias("level"),
        F.concat(F.lit("node "), F.col("node_id").cast("string"), F.lit(" "), anchor).alias("link"), "text",
        (F.col("depth") + F.col("level")).cast("long").alias("indent"), bullet.alias("bullet"),
    )
    tops = nodes.select(
        "node_id", F.lit(-1).cast("long").alias("offset"), F.lit(0).cast("long").alias("level"),
        F.concat(F.lit("node "), F.col("node_id").cast("string")).alias("link"), F.col("name").alias("text"),
        F.col("depth").cast("long").alias("indent"), F.lit(TOC_BULLETS[0]).alias("bullet"),
    )
    line = F.concat(F.lit("\n"), F.array_join(F.array_repeat(F.lit("\t"), F.col("indent").cast("int")), ""), "bullet", F.lit(" "), "text")
    return tops.unionByName(rows).withColumn("line", line)


def style_runs(pieces: DataFrame, attrs: str = "attrs") -> DataFrame:
    """Neighbouring pieces with equal attributes merged: node_id, run_idx,
    start_offset, text, attrs. ``pieces``: node_id, idx, text and attributes."""
    doc = Window.partitionBy("node_id").orderBy("idx")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    key = F.col(attrs)
    marked = pieces.withColumns(
        {
            "new": F.when(F.lag(attrs).over(doc).eqNullSafe(key) & (F.row_number().over(doc) > 1), 0).otherwise(1),
            "at": F.coalesce(F.sum(F.length("text")).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
        }
    ).withColumn("run_idx", F.sum("new").over(upto))
    return marked.groupBy("node_id", "run_idx").agg(
        F.min("at").alias("start_offset"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), "").alias("text"),
        F.first(attrs).alias(attrs),
    )
