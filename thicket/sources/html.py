"""Blocks, links and tables out of HTML, as expressions inside the row.

A page is cut at block tags in one pass; nothing is shuffled and no page is
parsed in Python.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import with_marks
from ..functions.text import unicode_trim, _col

#: A rowspan above this counts as this, as the HTML standard says.
MOST_ROWS = 65534
#: Tags that begin or end a block.
BLOCK_TAGS = (
    "title|h[1-6]|p|li|ul|ol|dl|dt|dd|div|article|section|nav|header|footer|main|aside|body|html|head|"
    "table|thead|tbody|tr|td|th|pre|blockquote|form|br|hr"
)
# Named entities and what they become.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&middot;": "·",
    "&copy;": "©", "&reg;": "®", "&trade;": "™", "&euro;": "€", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&laquo;": "«", "&raquo;": "»", "&bull;": "•",
    "&agrave;": "à", "&aacute;": "á", "&acirc;": "â", "&atilde;": "ã", "&auml;": "ä", "&aring;": "å", "&aelig;": "æ",
    "&ccedil;": "ç", "&egrave;": "è", "&eacute;": "é", "&ecirc;": "ê", "&euml;": "ë", "&igrave;": "ì", "&iacute;": "í",
    "&icirc;": "î", "&iuml;": "ï", "&ntilde;": "ñ", "&ograve;": "ò", "&oacute;": "ó", "&ocirc;": "ô", "&otilde;": "õ",
    "&ouml;": "ö", "&oslash;": "ø", "&ugrave;": "ù", "&uacute;": "ú", "&ucirc;": "û", "&uuml;": "ü", "&szlig;": "ß",
}


#: All named characters of HTML 4, with the choices above.
_NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {k[1:-1]: v for k, v in ENTITIES.items() if k[1] != "#"}
_XML_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decode_entities(c: Column | str) -> Column:
    """Named and numeric entities to characters, in one pass."""
    return _decode(_col(c), _NAMED)


def decode_xml_entities(c: Column | str) -> Column:
    """The entities XML itself defines, and numeric ones."""
    return _decode(_col(c), _XML_NAMED)


def _decode(text: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def piece(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.regexp_extract(part, r"^#0*(\d{1,7});", 1)
        hexa = F.regexp_extract(part, r"^#[xX]0*([0-9a-fA-F]{1,6});", 1)
        code = F.when(digits != "", digits.cast("long")).when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(name != "", F.try_element_at(table, name)).when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        rest = F.substring(part, F.instr(part, ";") + 1, F.length(part))
        return F.when(i == 0, part).when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))

    # Most pieces hold no entity at all.
    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&"), piece), "")).otherwise(text)


def plain_text(c: Column) -> Column:
    """Text of an HTML piece: tags dropped, entities decoded, blanks folded."""
    return unicode_trim(F.regexp_replace(decode_entities(F.regexp_replace(c, r"(?s)<[^>]*>", "")), r"[\s\x{A0}]+", " "))


def _body(html: Column) -> Column:
    """Without comments, scripts and styles; a fragment is wrapped as a page."""
    lean = F.regexp_replace(
        html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", ""
    )
    page = lean.rlike(r"(?i)<(html|body)\b")
    return F.when(page, lean).otherwise(F.concat(F.lit("<html><body>"), lean, F.lit("</body></html>")))


def html_blocks(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Title, headings, list items, cells and paragraphs of each page, in order.

    Adds block_no, kind (title | heading | item | cell | paragraph), level (of
    headings, else 0) and text. Text outside any of these tags is a paragraph.
    """
    tags = F.lit(rf"(?i)(</?(?:{BLOCK_TAGS})(?:[\s/][^>]*)?>)")
    segments = with_marks(_body(F.col(html)), 1, lambda t, m: F.split(F.regexp_replace(t, tags, F.concat(m[0], F.lit("$1"))), m[0]))

    def block(seg: Column) -> Column:
        tag = F.lower(F.regexp_extract(seg, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))
        return F.struct(tag.alias("tag"), plain_text(seg).alias("text"))

    blocks = F.filter(F.transform(segments, block), lambda b: b["text"] != "")
    tag = F.col("b.tag")
    kind = (
        F.when(tag == "title", "title").when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "item")
        .when(tag.isin("td", "th"), "cell").otherwise("paragraph")
    )
    return df.select(*keep, F.posexplode(blocks).alias("block_no", "b")).select(
        *keep, F.col("block_no").cast("long").alias("block_no"), kind.alias("kind"),
        F.when(kind == "heading", F.substring(tag, 2, 1).try_cast("long")).otherwise(F.lit(0)).cast("long").alias("level"),
        F.col("b.text").alias("text"),
    )


def html_links(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Links of each page in order: link_no, href, text."""
    anchors = F.regexp_extract_all(_body(F.col(html)), F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0))
    href = F.regexp_extract(F.col("a"), r"(?is)^<a\s[^>]*?href\s*=\s*[\"']([^\"']*)", 1)
    return df.select(*keep, F.posexplode(anchors).alias("link_no", "a")).select(
        *keep, F.col("link_no").cast("long").alias("link_no"), decode_entities(href).alias("href"), plain_text(F.col("a")).alias("text")
    )


def html_tables(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Tables as cell matrices: table_no, cells, kind (grid | codebox).

    A rowspan of n adds n-1 empty cells after the cell; a rowspan of 0 fills the
    row; short rows are padded to the widest; a single cell is a code box.
    """
    row_re, cell_re = r"(?is)<tr\b.*?(?=<tr\b|</table|\z)", r"(?is)<t[dh]\b.*?(?=<t[dh]\b|</t[dh]>|</tr|\z)"
    table_list = F.regexp_extract_all(_body(F.col(html)), F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))

    def cell(c: Column) -> Column:
        span = F.regexp_extract(c, r"(?i)^<t[dh]\b[^>]*rowspan\s*=\s*[\"']?(\d+)", 1)
        text = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
        text = unicode_trim(decode_entities(F.regexp_replace(text, r"(?s)<[^>]*>", "")))
        return F.struct(F.when(span == "", F.lit(1)).otherwise(F.least(F.coalesce(span.try_cast("int"), F.lit(MOST_ROWS)), F.lit(MOST_ROWS))).alias("span"), text.alias("text"))

    # A first row may lack its <tr>.
    head_fixed = F.regexp_replace(F.col("t"), r"(?is)^(<table\b[^>]*>\s*)(<t[dh]\b)", "$1<tr>$2")
    rows = F.transform(
        F.regexp_extract_all(head_fixed, F.lit(row_re), F.lit(0)),
        lambda r: F.transform(F.regexp_extract_all(r, F.lit(cell_re), F.lit(0)), cell),
    )
    rows = F.filter(rows, lambda r: F.size(r) > 0)
    spread = F.transform(
        F.col("rows"),
        lambda r: F.flatten(F.transform(r, lambda c: F.concat(
            F.array(F.struct(c["text"].alias("text"), (c["span"] == 0).alias("fill"))),
            F.array_repeat(F.struct(F.lit("").alias("text"), F.lit(False).alias("fill")), F.greatest(c["span"] - 1, F.lit(0))),
        ))),
    )
    width = F.array_max(F.transform(F.col("wide"), lambda r: F.size(r)))

    def padded(r: Column) -> Column:
        gap = F.array_repeat(F.lit(""), F.col("width") - F.size(r))
        texts = F.transform(r, lambda c: c["text"])
        at = F.array_position(F.transform(r, lambda c: c["fill"]), F.lit(True)).cast("int")
        filled = F.concat(F.slice(texts, F.lit(1), at), gap, F.slice(texts, at + 1, F.size(r)))
        return F.when(at > 0, filled).otherwise(F.concat(texts, gap))

    out = (
        df.select(*keep, F.posexplode(table_list).alias("table_no", "t"))
        .select(*keep, F.col("table_no").cast("long").alias("table_no"), rows.alias("rows")).where("size(rows) > 0")
        .withColumn("wide", spread).withColumn("width", width).withColumn("cells", F.transform("wide", padded))
    )
    single = (F.size("cells") == 1) & (F.col("width") == 1)
    return out.select(*keep, "table_no", "cells", F.when(single, F.lit("codebox")).otherwise(F.lit("grid")).alias("kind"))


def split_journal(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Dated notes of a journal export: entry_no, name (of the first h1), html.

    Text before the first date marker is the export's own header and dropped.
    """
    # Fixed value: the marker between two days.
    marker = r'<p>[\S\s]<span id="(?:[12]\d{3}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))"></span>[\S\s]</p>'
    parts = F.split(F.col(html), marker)
    entries = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    title = F.regexp_extract(F.col("entry"), r"<h1>([\S\s]*?)</h1>", 1)
    return df.select(*keep, F.posexplode(entries).alias("entry_no", "entry")).select(
        *keep, F.col("entry_no").cast("long").alias("entry_no"),
        F.when(F.col("entry").contains("<h1>") & F.col("entry").rlike(r"<h1>([\S\s]*?)</h1>"), title).otherwise(F.lit("?")).alias("name"),
        F.col("entry").alias("html"),
    )
