"""Import formats, on pages, conversations, parts, orders and documents."""

from pyspark.sql import functions as F

from ..functions import grids as G
from ..sources import files as FI
from ..sources import html as HT
from ..sources import markup as MK
from ..sources import outline as OU
from ..sources import xml_store as XS
from .base import query, store, tables

T = "<[^>]*>"


def plain_sql(c):
    out = f"regexp_replace({c}, '(?s)<[^>]*>', '', 'g')"
    for ent, ch in HT.ENTITIES.items():
        lit = "chr(39)" if ch == "'" else f"'{ch}'"
        out = f"replace({out}, '{ent}', {lit})"
    return f"trim(regexp_replace(replace({out}, '&amp;', '&'), '[\\s\\x{{A0}}]+', ' ', 'g'))"


LEAN = "regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<!--.*?-->', '', 'g')"


@query(
    "html_blocks",
    f"""WITH s AS (SELECT page_id, string_split(regexp_replace({LEAN}, '(?i)(</?(?:{HT.BLOCK_TAGS})(?:[\\s/][^>]*)?>)', chr(64976) || '\\1', 'g'), chr(64976)) AS segs FROM pages),
       b AS (SELECT page_id, unnest(segs) AS seg, unnest(range(len(segs))) AS i FROM s),
       t AS (SELECT page_id, i, lower(regexp_extract(seg, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, {plain_sql('seg')} AS text FROM b)
       SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS block_no,
              CASE WHEN tag = 'title' THEN 'title' WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' WHEN tag = 'li' THEN 'item'
                   WHEN tag IN ('td', 'th') THEN 'cell' ELSE 'paragraph' END AS kind,
              CAST(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN CAST(substr(tag, 2, 1) AS BIGINT) ELSE 0 END AS BIGINT) AS level, text
       FROM t WHERE text <> ''""",
)
def _(spark, sf):
    return HT.html_blocks(tables(spark, sf)["pages"], "html", ["page_id"])


@query(
    "html_links",
    f"""WITH a AS (SELECT page_id, unnest(l) AS a, unnest(range(len(l))) AS link_no FROM (SELECT page_id, regexp_extract_all({LEAN}, '(?is)<a\\s[^>]*>.*?</a>') AS l FROM pages))
        SELECT page_id, link_no, replace(regexp_extract(a, '(?is)^<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)', 1), '&amp;', '&') AS href, {plain_sql('a')} AS text FROM a""",
)
def _(spark, sf):
    return HT.html_links(tables(spark, sf)["pages"], "html", ["page_id"])


# Pages hold no tables, so one per page is put around its links and title.
def _table_page():
    return F.concat(
        F.lit("<body><table><tr><th rowspan='2'>url</th><th>id</th></tr><tr><td>"), F.col("url"), F.lit("</td><td>"), F.col("page_id").cast("string"),
        F.lit("</td><td>x<br>y</td></tr><tr><td>one</td></tr></table> text <table><tr><td>"), F.col("url"), F.lit("</td></tr></table>"), F.col("html"),
    )


@query(
    "html_tables",
    f"""SELECT page_id, CAST(0 AS BIGINT) AS table_no, 'grid' AS kind, 'url||id' || chr(10) || {plain_sql('url')} || '|' || page_id || '|x' || chr(10) || 'y' || chr(10) || 'one||' AS cells FROM pages
        UNION ALL SELECT page_id, 1, 'codebox', {plain_sql('url')} FROM pages""",
)
def _(spark, sf):
    pages = tables(spark, sf)["pages"].select("page_id", _table_page().alias("h"))
    out = HT.html_tables(pages, "h", ["page_id"])
    return out.select("page_id", "table_no", "kind", F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "\n").alias("cells"))


@query(
    "split_journal",
    """SELECT page_id, CAST(i AS BIGINT) AS entry_no, CASE WHEN i = 0 THEN url WHEN i = 1 AND regexp_matches(html, '<h1>[\\S\\s]*?</h1>') THEN regexp_extract(html, '<h1>([\\S\\s]*?)</h1>', 1) ELSE '?' END AS name,
              md5(CASE i WHEN 0 THEN '<h1>' || url || '</h1>a' WHEN 1 THEN html ELSE 'no title' END) AS digest
       FROM pages, (SELECT unnest(range(3)) AS i)""",
)
def _(spark, sf):
    mark = lambda d: F.lit(f'<p>\n<span id="{d}"></span>\n</p>')
    text = F.concat(F.lit("head"), mark("2024-01-31"), F.lit("<h1>"), "url", F.lit("</h1>a"), mark("2024-02-01"), "html", mark("2024-12-09"), F.lit("no title"))
    return HT.split_journal(tables(spark, sf)["pages"].select("page_id", text.alias("h")), "h", ["page_id"]).select("page_id", "entry_no", "name", F.md5("html").alias("digest"))


# --- outlines ------------------------------------------------------------------

# Fathers by the rule itself, tested pair by pair; documents here are short.
TREE_SQL = """, a AS (SELECT r.*, CASE WHEN level = 1 THEN -1 ELSE (
    SELECT max(p.pos) FROM rows_ AS p WHERE p.doc = r.doc AND p.pos < r.pos AND p.level = r.level - 1
      AND NOT EXISTS (SELECT 1 FROM rows_ AS b WHERE b.doc = r.doc AND b.pos > p.pos AND b.pos < r.pos AND b.level < r.level - 1)) END AS fpos FROM rows_ AS r),
  f AS (SELECT * FROM a WHERE fpos IS NOT NULL),
  reach AS (SELECT doc, pos, level, name, fpos, 0 AS depth FROM f WHERE fpos = -1
            UNION ALL SELECT f.doc, f.pos, f.level, f.name, f.fpos, r.depth + 1 FROM f JOIN reach AS r ON r.doc = f.doc AND r.pos = f.fpos)
  SELECT doc, pos, name, CASE WHEN fpos = -1 THEN NULL ELSE fpos END AS father_pos, CAST(depth AS BIGINT) AS depth FROM reach"""


def _tree(rows):
    tree = OU.outline_to_tree(rows)
    up = tree.select(F.col("node_id").alias("fid"), F.col("pos").alias("father_pos"))
    return tree.join(up, F.col("father_id") == F.col("fid"), "left").select("doc", "pos", "name", "father_pos", "depth")


@query(
    "outline_to_tree",
    """WITH RECURSIVE rows_ AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
         CAST(l_partkey % 4 AS BIGINT) AS level, CAST(l_partkey AS VARCHAR) AS name FROM lineitem), rows1 AS (SELECT * FROM rows_ WHERE level >= 1)"""
    + TREE_SQL.replace("rows_", "rows1"),
)
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = tables(spark, sf)["lineitem"].select(
        F.col("l_orderkey").alias("doc"), F.row_number().over(w).cast("long").alias("pos"), (F.col("l_partkey") % 4).alias("level"),
        F.col("l_partkey").cast("string").alias("name"),
    )
    return _tree(rows)


@query(
    "conversation_outline",
    """WITH RECURSIVE rows_ AS (SELECT conv_id AS doc, turn + 1 AS pos, CAST(CASE WHEN turn = 0 THEN 1 WHEN role = 'user' THEN 2 ELSE 3 END AS BIGINT) AS level,
         string_split(text, chr(10))[1] AS name FROM conversations)""" + TREE_SQL,
)
def _(spark, sf):
    rows = tables(spark, sf)["conversations"].select(
        F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("pos"),
        F.when(F.col("turn") == 0, 1).when(F.col("role") == "user", 2).otherwise(3).cast("long").alias("level"),
        F.substring_index("text", "\n", 1).alias("name"),
    )
    return _tree(rows)


INDENT_SQL = """, l AS (SELECT p_partkey, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT p_partkey, string_split(replace(t, chr(13), ''), chr(10)) AS ls FROM texts)),
  m AS (SELECT p_partkey, i, ltrim(line, ' ' || chr(9)) AS name, length(line) - length(ltrim(line, ' ' || chr(9))) + 1 AS level FROM l WHERE ltrim(line, ' ' || chr(9)) <> ''),
  h AS (SELECT *, COALESCE(max(level) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS high FROM m),
  x AS (SELECT p_partkey, i, k.k, CASE WHEN k.k = level THEN name ELSE '' END AS name FROM h, LATERAL (SELECT unnest(CASE WHEN level - high > 1 THEN range(high + 1, level + 1) ELSE [level] END) AS k) AS k)
  SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i, k) AS pos, CAST(k AS BIGINT) AS level, name FROM x"""


@query(
    "indented_lines",
    """WITH texts AS (SELECT p_partkey, p_name || chr(13) || chr(10) || repeat(' ', CAST(p_size % 5 AS INT)) || p_brand || chr(10) || chr(10) || chr(9) || p_type || chr(10) || repeat(' ', CAST(p_size % 7 AS INT)) || 'end' AS t FROM part)"""
    + INDENT_SQL,
)
def _(spark, sf):
    sp = lambda n: F.expr(f"repeat(' ', p_size % {n})")
    t = F.concat("p_name", F.lit("\r\n"), sp(5), "p_brand", F.lit("\n\n\t"), "p_type", F.lit("\n"), sp(7), F.lit("end"))
    return OU.indented_lines_to_outline(tables(spark, sf)["part"].select("p_partkey", t.alias("t")), "t", ["p_partkey"])


@query(
    "tagged_outline",
    """SELECT o_orderkey, CAST(0 AS BIGINT) AS pos, CAST(o_orderkey % 5 AS BIGINT) AS level, 'Order ' || o_orderkey || ' second line' AS name, o_orderpriority || chr(10) || 'more' || chr(10) AS contents FROM orders
       UNION ALL SELECT o_orderkey, 1, 3, o_orderstatus, '<node> ' || o_custkey || chr(10) FROM orders""",
)
def _(spark, sf):
    key = F.col("o_orderkey").cast("string")
    t = F.concat(
        F.lit("<Treepad version>\n<node>\nOrder "), key, F.lit("\nsecond line\n"), (F.col("o_orderkey") % 5).cast("string"), F.lit("\r\n"),
        "o_orderpriority", F.lit("\nmore\n<end node> 5P9i0s8y19Z\njunk\n<node>\n"), "o_orderstatus", F.lit("\n3\n<node> "), F.col("o_custkey").cast("string"), F.lit("\n<end node>\n"),
    )
    return OU.tagged_outline_to_rows(tables(spark, sf)["orders"].select("o_orderkey", t.alias("t")), "t", ["o_orderkey"])


@query(
    "nul_records",
    """SELECT o_orderkey, CAST(0 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS level, 'Order ' || o_orderkey AS name, o_orderstatus AS contents FROM orders
       UNION ALL SELECT o_orderkey, 1, 2, o_orderpriority, '' FROM orders UNION ALL SELECT o_orderkey, 2, 1, 'last', 'x' || o_custkey FROM orders""",
)
def _(spark, sf):
    z = F.lit("\x00")
    t = F.concat(
        F.lit("MeMpAd."), z, F.lit("1"), z, F.lit("\x01Order "), F.col("o_orderkey").cast("string"), z, "o_orderstatus", z, F.lit("\x02"), "o_orderpriority", z, z,
        F.lit("\x01last"), z, F.lit("x"), F.col("o_custkey").cast("string"), z,
    )
    return OU.nul_records_to_outline(tables(spark, sf)["orders"].select("o_orderkey", t.alias("t")), "t", ["o_orderkey"])


@query(
    "vnode_tnode",
    """SELECT page_id, 'k1' AS key, CAST(1 AS BIGINT) AS level, url AS name, html AS contents FROM pages UNION ALL SELECT page_id, 'k2', 2, 'child', '' FROM pages
       UNION ALL SELECT page_id, 'k3', 1, 'last & least', CAST(page_id AS VARCHAR) FROM pages""".replace("html AS contents", "md5(html) AS contents").replace("'child', ''", "'child', md5('')").replace("CAST(page_id AS VARCHAR) FROM", "md5(CAST(page_id AS VARCHAR)) FROM"),
)
def _(spark, sf):
    from ..functions.text import xml_escape

    t = F.concat(
        F.lit('<leo_file><vnodes><v t="k1"><vh>'), xml_escape("url"), F.lit('</vh><v t="k2"><vh>child</vh></v></v><v t="k3"><vh>last &amp; least</vh></v></vnodes><tnodes><t tx="k1">'),
        xml_escape("html"), F.lit('</t><t tx="k3">'), F.col("page_id").cast("string"), F.lit("</t></tnodes></leo_file>"),
    )
    out = OU.vnode_tnode_join(tables(spark, sf)["pages"].select("page_id", t.alias("t")), "t", ["page_id"])
    return out.select("page_id", "key", "level", "name", F.md5("contents").alias("contents"))


# --- files -----------------------------------------------------------------------


@query(
    "csv_to_grid",
    """SELECT p_partkey, p_name || '|' || p_brand || ',"' || chr(10) || '|' || p_size || chr(10) || p_type || '|back\\slash|' || chr(10) || 'a|b|c' AS cells FROM part""",
)
def _(spark, sf):
    t = F.concat(
        F.lit('"'), "p_name", F.lit('","'), "p_brand", F.lit(',\\"\n",'), F.col("p_size").cast("string"), F.lit("\n"), "p_type",
        F.lit(',back\\\\slash\n"a","b",c,dropped\nno line end'),
    )
    g = FI.csv_to_grid(tables(spark, sf)["part"].select("p_partkey", t.alias("t")), "t", ["p_partkey"])
    return g.select("p_partkey", F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "\n").alias("cells"))


@query("csv_round_trip", "SELECT node_id, array_to_string(list_transform(cells, lambda r: array_to_string(r, '|')), chr(10)) AS cells FROM grid", "grid")
def _(spark, sf):
    csv = store(spark, sf).grid.select("node_id", G.cells_to_csv(F.col("cells")).alias("t"))
    g = FI.csv_to_grid(csv, "t", ["node_id"])
    return g.select("node_id", F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "\n").alias("cells"))


@query(
    "ingest_text",
    """SELECT 'doc' || doc_id AS name, e AS charset, md5(text) AS txt FROM documents, (SELECT unnest(['utf8', 'utf8bom', 'utf16be', 'utf16le', 'utf32be', 'utf32le']) AS e)""",
)
def _(spark, sf):
    docs = tables(spark, sf)["documents"]
    be32 = F.hex(F.encode("text", "UTF-32"))
    le32 = F.unhex(F.concat(F.lit("FFFE0000"), F.regexp_replace(be32, "(..)(..)(..)(..)", "$4$3$2$1")))
    enc = lambda bom, cs: F.concat(F.unhex(F.lit(bom)), F.encode("text", cs))
    forms = {"utf8": F.encode("text", "UTF-8"), "utf8bom": enc("EFBBBF", "UTF-8"), "utf16be": enc("FEFF", "UTF-16BE"), "utf16le": enc("FFFE", "UTF-16LE"),
             "utf32be": enc("0000FEFF", "UTF-32"), "utf32le": le32}
    files = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("charset"), c.alias("content")) for n, c in forms.items()])).alias("f")).select(
        F.concat(F.lit("/in/"), "f.charset", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "f.content"
    )
    return FI.text_nodes(files).select("name", F.split("path", "/")[2].alias("charset"), F.md5("txt").alias("txt"))


@query(
    "dir_to_tree",
    """WITH n AS (
         SELECT 'R' || n_regionkey AS place, '' AS father, 'R' || n_regionkey AS name, false AS has_content FROM nation GROUP BY n_regionkey
         UNION ALL SELECT 'R' || n_regionkey || '/' || n_name, 'R' || n_regionkey, n_name, true FROM nation
         UNION ALL SELECT 'R' || n_regionkey || '/' || n_name || '/S' || s_suppkey, 'R' || n_regionkey || '/' || n_name, 'S' || s_suppkey, true FROM nation JOIN supplier ON s_nationkey = n_nationkey)
       SELECT place, father, name, has_content FROM n""",
)
def _(spark, sf):
    t = tables(spark, sf)
    sup = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    region = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    s = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    leafs = sup.select(F.concat(region, F.lit("/"), "n_name", F.lit("/"), s, F.lit("/"), s, F.lit(".txt")).alias("path"))
    beside = t["nation"].select(F.concat(region, F.lit("/"), "n_name", F.lit(".txt")).alias("path"))
    tree = FI.dir_to_tree(leafs.unionByName(beside))
    place = F.when(F.col("father_place") == "", F.col("name")).otherwise(F.concat("father_place", F.lit("/"), "name"))
    return tree.select(place.alias("place"), F.col("father_place").alias("father"), "name", "has_content")


# --- markup ------------------------------------------------------------------------


@query(
    "markdown_blocks",
    """SELECT p_partkey, unnest([0, 1, 3, 5, 8, 9, 11]) AS line_no, unnest(['heading', 'heading', 'heading', 'code', 'item', 'row', 'row']) AS kind,
              unnest([1, 3, 1, 0, 0, 0, 0]) AS level, unnest(['', '', '', 'sql', '', '', '']) AS lang,
              unnest([p_name, p_brand, p_type, 'select ' || p_size, p_name, '| a | b |', '| ' || p_size || ' | x |']) AS content FROM part""",
)
def _(spark, sf):
    size = F.col("p_size").cast("string")
    t = F.concat(
        F.lit("# "), "p_name", F.lit("\n##### "), "p_brand", F.lit("\n\n"), "p_type", F.lit("\n====\n```sql\nselect "), size,
        F.lit("\n```\n- "), "p_name", F.lit("\n| a | b |\n| - | - |\n| "), size, F.lit(" | x |\n"),
    )
    out = MK.markdown_blocks(tables(spark, sf)["part"].select("p_partkey", t.alias("t")), "t", ["p_partkey"])
    return out


@query(
    "markdown_spans",
    """SELECT p_partkey, CAST(unnest(range(8)) AS BIGINT) AS span_no, unnest(['bold', 'italic', 'strike', 'mono', 'link', 'image', 'autolink', 'bold_italic']) AS kind,
              unnest([p_name, p_brand, p_type, 'x', p_name, p_brand, 'http://a.b/' || p_partkey, p_type]) AS content,
              unnest(['', '', '', '', 'http://c.d/' || p_size, 'i.png', 'http://a.b/' || p_partkey, '']) AS target FROM part""",
)
def _(spark, sf):
    t = F.concat(
        F.lit("so **"), "p_name", F.lit("** and *"), "p_brand", F.lit("* or ~~"), "p_type", F.lit("~~ `x` ["), "p_name", F.lit("](http://c.d/"),
        F.col("p_size").cast("string"), F.lit(") ![") , "p_brand", F.lit("](i.png) <http://a.b/"), F.col("p_partkey").cast("string"), F.lit("> ***"), "p_type", F.lit("***"),
    )
    return MK.markdown_spans(tables(spark, sf)["part"].select("p_partkey", t.alias("t")), "t", ["p_partkey"])


@query(
    "wiki_blocks",
    """SELECT p_partkey, unnest([3, 4, 5, 6, 7, 8, 9]) AS line_no, unnest(['heading', 'heading', 'todo_open', 'todo_done', 'todo_dropped', 'item', 'paragraph']) AS kind,
              unnest([3, 1, 0, 0, 0, 2, 0]) AS level, unnest([p_name, p_brand, p_type, p_type, p_type, p_name, 'see [[' || p_name || ']]']) AS content FROM part""",
)
def _(spark, sf):
    t = F.concat(
        F.lit("Content-Type: text\nWiki-Format: x\nCreation-Date: 2024\n== "), "p_name", F.lit(" ==\n====== "), "p_brand", F.lit(" ======\n[ ] "), "p_type",
        F.lit("\n[*] "), "p_type", F.lit("\n[x] "), "p_type", F.lit("\n\t\t* "), "p_name", F.lit("\nsee [["), "p_name", F.lit("]]\n"),
    )
    return MK.wiki_blocks(tables(spark, sf)["part"].select("p_partkey", t.alias("t")), "t", ["p_partkey"])


# --- XML stores ----------------------------------------------------------------------


@query(
    "note_xml",
    """SELECT page_id, url AS name, CASE WHEN page_id % 2 = 0 THEN 'Book ' || page_id ELSE '' END AS notebook, md5(html) AS body FROM pages""",
)
def _(spark, sf):
    from ..functions.text import xml_escape

    i = F.col("page_id").cast("string")
    tag = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<tag>system:notebook:Book "), i, F.lit("</tag>"))).otherwise(F.lit("<tag></tag>"))
    t = F.concat(F.lit("<note><title>"), xml_escape("url"), F.lit("</title><tags>"), tag, F.lit('</tags><text><note-content version="0.1">'), xml_escape("html"), F.lit("</note-content></text></note>"))
    out = XS.note_xml_records(tables(spark, sf)["pages"].select(i.alias("path"), t.alias("text")))
    return out.select(F.col("path").cast("long").alias("page_id"), "name", "notebook", F.md5("body").alias("body"))


@query(
    "parse_runs_xml",
    """SELECT doc_id AS node_id, CAST(0 AS BIGINT) AS run_idx, CAST(0 AS BIGINT) AS start_offset, md5(text) AS text, '' AS attrs FROM documents WHERE text <> ''
       UNION ALL SELECT doc_id, 1, length(text), md5(lang || ' & ' || source), 'link=node ' || doc_id || ' h1-1;weight=heavy' FROM documents""",
)
def _(spark, sf):
    from ..functions.text import xml_escape

    i = F.col("doc_id").cast("string")
    x = F.concat(
        F.lit("<node><rich_text>"), xml_escape("text"), F.lit('</rich_text><rich_text weight="heavy"></rich_text><rich_text weight="heavy" unknown="1" link="node '), i,
        F.lit(' h1-1">'), "lang", F.lit(" &amp; "), xml_escape("source"), F.lit("</rich_text></node>"),
    )
    runs = XS.parse_runs_xml(tables(spark, sf)["documents"].select(F.col("doc_id").alias("node_id"), x.alias("x")), "x", ["node_id"])
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return runs.select("node_id", "run_idx", "start_offset", F.md5("text").alias("text"), pairs.alias("attrs"))


@query(
    "xml_corpus",
    """, r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
       SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(1 AS BIGINT) AS fixed_id, 'Customer ' || o_custkey AS name, CAST(0 AS BIGINT) AS depth, true AS read_only, CAST(count(*) AS BIGINT) AS ts FROM r GROUP BY o_custkey
       UNION ALL SELECT CAST(o_custkey AS VARCHAR), o_orderkey + 2, 'Order ' || o_orderkey, 1, false, 77 FROM r
       UNION ALL SELECT CAST(o_custkey AS VARCHAR), m + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'again', 2, false, 0
         FROM (SELECT *, max(o_orderkey + 2) OVER (PARTITION BY o_custkey) AS m FROM r)""".replace(", r AS", "WITH r AS", 1),
)
def _(spark, sf):
    # A file per customer; an order holds a child that repeats the order's id.
    o = tables(spark, sf)["orders"]
    i = (F.col("o_orderkey") + 2).cast("string")
    one = F.concat(
        F.lit('<node unique_id="'), i, F.lit('" name="Order '), F.col("o_orderkey").cast("string"), F.lit('" ts_creation="77"><rich_text>x</rich_text><node unique_id="'), i,
        F.lit('" name="again"/></node>'),
    )
    files = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", one.alias("x")))).alias("l"))
    text = F.concat(
        F.lit('<?xml version="1.0"?><store><node unique_id="1" readonly="true" name="Customer '), F.col("o_custkey").cast("string"), F.lit('" ts_creation="'),
        F.size("l").cast("string"), F.lit('">'), F.array_join(F.transform("l", lambda s: s["x"]), ""), F.lit("</node></store>"),
    )
    out = XS.xml_corpus(files.select(F.col("o_custkey").cast("string").alias("path"), text.alias("text")))
    return out.select("path", "fixed_id", "name", "depth", "read_only", F.col("ts_creation").alias("ts"))


@query(
    "salvage",
    """SELECT node_id, CASE node_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 END AS version, node_id % 3 = 1 AS salvaged, node_id % 3 = 2 AS header_only,
              CASE node_id % 3 WHEN 0 THEN '<node name="a"><rich_text>v3</rich_text></node>' WHEN 1 THEN '<node name="a"><rich_text>v2</rich_text></node>' ELSE '<node name="a"></node>' END AS content
       FROM node_props""".replace("THEN 3 WHEN 1 THEN 2 END", "THEN CAST(3 AS BIGINT) WHEN 1 THEN CAST(2 AS BIGINT) END"),
    "node_props",
)
def _(spark, sf):
    def doc(v):
        good = F.when(F.lit(v) == 3, F.col("node_id") % 3 == 0).when(F.lit(v) == 2, F.col("node_id") % 3 < 2).otherwise(F.lit(False))
        head = f'<node name="a"><rich_text>v{v}'
        return F.struct(F.lit(v).cast("long").alias("version"), F.when(good, F.lit(head + "</rich_text></node>")).otherwise(F.lit(head + "</rich")).alias("content"))

    versions = store(spark, sf).node.select("node_id", F.explode(F.array(doc(1), doc(2), doc(3))).alias("v")).select("node_id", "v.*")
    return XS.salvage_latest_readable(versions).withColumn("salvaged", F.coalesce("salvaged", F.lit(False)))
