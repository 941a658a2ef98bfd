"""Blocks out of Markdown and wiki text, line by line with windows per text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def markdown_blocks(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Blocks of Markdown: line_no, kind, level, lang, content.

    Kinds: heading (levels above 3 count as 3; ``==`` and ``----`` below a line
    make it level 1 and 2), code (a fence, its first line the language), item,
    row (table), paragraph. Table dividers are dropped.
    """
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    doc = Window.partitionBy(*keep).orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    before = F.coalesce(F.sum(F.col("fence").cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("fence", fence).withColumn("opened", before)
    lines = lines.withColumns(
        {
            "in_code": F.col("opened") % 2 == 1,
            "below": F.lead("line").over(doc),
            "block": F.when((F.col("opened") % 2 == 1) | F.col("fence"), F.floor(F.col("opened") / 2)),
        }
    )
    code = (
        lines.where(F.col("block").isNotNull()).groupBy(*keep, "block").agg(
            F.min("line_no").alias("line_no"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("fence"), F.struct("line_no", "line")))), lambda s: s["line"]), "\n").alias("content"),
            F.regexp_extract(F.min_by("line", "line_no"), r"^\s*(?:```|~~~)\s*(\S*)", 1).alias("lang"),
        )
        .select(*keep, "line_no", F.lit("code").alias("kind"), F.lit(0).alias("level"), "lang", "content")
    )
    plain = lines.where(F.col("block").isNull())
    hashes = F.length(F.regexp_extract("line", r"^(#{1,6}) ", 1))
    setext = F.when(F.col("below").rlike("^=="), 1).when(F.col("below").rlike("^----"), 2).otherwise(0)
    under = F.col("line").rlike("^(==|----)")
    level = F.when(hashes > 0, F.least(hashes, F.lit(3))).when((setext > 0) & (F.col("line") != ""), setext).otherwise(0)
    kind = (
        F.when(level > 0, "heading").when(F.col("line").rlike(r"^\s*[*-] "), "item")
        .when(F.col("line").rlike(r"^\s*\|"), "row").otherwise("paragraph")
    )
    content = (
        F.when(hashes > 0, F.regexp_replace("line", r"^#{1,6} ", ""))
        .when(kind == "item", F.regexp_replace("line", r"^\s*[*-] ", "")).otherwise(F.col("line"))
    )
    divider = F.col("line").rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|[\s:|-]*$")
    rest = plain.where(~under & ~divider & (F.trim("line") != "")).select(
        *keep, "line_no", kind.alias("kind"), level.alias("level"), F.lit("").alias("lang"), content.alias("content")
    )
    return code.unionByName(rest).withColumns({"line_no": F.col("line_no").cast("long"), "level": F.col("level").cast("long")})


def markdown_cells(content):
    """Cells of a table row."""
    inner = F.regexp_replace(F.regexp_replace(content, r"^\s*\|", ""), r"\|\s*$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def markdown_spans(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Inline marks: kind (bold_italic, bold, italic, strike, mono, link, image,
    autolink), content and target."""
    shape = (
        r"!\[[^\]]*\]\([^)\s]*\)|\[[^\]^][^\]]*\]\([^)\s]*\)|<[a-z]+:[^>\s]+>|`[^`\n]+`|\*\*\*[^*\n]+\*\*\*|"
        r"\*\*[^*\n]+\*\*|__[^_\n]+__|~~[^~\n]+~~|\*[^*\n]+\*|\b_[^_\n]+_\b"
    )
    spans = df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(0))).alias("span_no", "s"))
    s = F.col("s")
    kind = (
        F.when(s.startswith("!["), "image").when(s.startswith("["), "link").when(s.startswith("<"), "autolink")
        .when(s.startswith("`"), "mono").when(s.startswith("***"), "bold_italic")
        .when(s.startswith("**") | s.startswith("__"), "bold").when(s.startswith("~~"), "strike").otherwise("italic")
    )
    target = F.when(kind.isin("image", "link"), F.regexp_extract(s, r"\]\(([^)]*)\)$", 1)).when(
        kind == "autolink", F.regexp_replace(s, "[<>]", "")).otherwise("")
    content = F.when(kind.isin("image", "link"), F.regexp_extract(s, r"^!?\[([^\]]*)\]", 1)).otherwise(
        F.regexp_replace(s, r"^[*_~`<]+|[*_~`>]+$", ""))
    return spans.select(*keep, F.col("span_no").cast("long").alias("span_no"), kind.alias("kind"), content.alias("content"), target.alias("target"))


def wiki_blocks(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Wiki text after its ``Creation-Date:`` header: line_no, kind, level, content.

    ``==`` headings: level 5 less the extra ``=``, 3 at most; with more than
    five extra the line is plain. To-dos ``[ ] [*] [x] [>]`` come as open, done
    and dropped; bullets count tabs; ``[[name]]`` links stay in the content.
    """
    lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    upto = Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("line").contains("Creation-Date:")).over(upto), F.lit(False))
    body = lines.withColumn("seen", seen).where("seen")
    line = F.col("line")
    extra = F.length(F.regexp_extract(line, r"^==(=*)", 1))
    heading = line.rlike("^==") & (extra <= 5)
    todo = F.regexp_extract(line, r"^\s*\[([ *x>])\]", 1)
    tabs = F.length(F.regexp_extract(line, r"^(\t*)", 1))
    bullet = line.rlike(r"^\t*\* ")
    kind = (
        F.when(heading, "heading").when(todo == " ", "todo_open").when(todo == "*", "todo_done")
        .when(todo.isin("x", ">"), "todo_dropped").when(bullet, "item").otherwise("paragraph")
    )
    level = F.when(heading, F.least(5 - extra, F.lit(3))).when(bullet, tabs).otherwise(F.lit(0))
    title = F.trim(F.replace(F.replace(F.regexp_replace(line, "^==", ""), F.lit("= "), F.lit("")), F.lit("="), F.lit("")))
    content = (
        F.when(heading, title).when(todo != "", F.regexp_replace(line, r"^\s*\[[ *x>]\] ?", ""))
        .when(bullet, F.regexp_replace(line, r"^\t*\* ", "")).otherwise(line)
    )
    return body.where(F.trim(line) != "").select(
        *keep, F.col("line_no").cast("long").alias("line_no"), kind.alias("kind"), level.cast("long").alias("level"), content.alias("content")
    )


def wiki_links(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``[[name]]`` links, to be resolved by name."""
    return df.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\]]*)\]\]"), F.lit(1))).alias("target_name"))
