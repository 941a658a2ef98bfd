"""Scalar functions over names, texts, pages and parts."""

from pyspark.sql import functions as F

from ..functions import grids as G
from ..functions import links as L
from ..functions import text as S
from .base import derived, paths, query, store, tables
from ..operators.forest import names_on_path
from ..operators.shared import resolve_shared

SRC, DST = S.ACCENTS_SRC, S.ACCENTS_DST


@query("fold_accents", f"SELECT doc_id, md5(translate(text, '{SRC}', '{DST}')) AS folded FROM documents")
def _(spark, sf):
    return tables(spark, sf)["documents"].select("doc_id", F.md5(S.fold_accents("text")).alias("folded"))


NATURAL = (
    "array_to_string(list_transform(regexp_extract_all({c}, '(\\d+|\\D+)'), lambda x: CASE WHEN regexp_matches(x, '^\\d') "
    "THEN chr(1) || lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0') ELSE x END), '')"
)


@query("natural_key", "SELECT node_id, " + NATURAL.format(c="name") + " AS key FROM node_props", "node_props")
def _(spark, sf):
    return derived(spark, sf, "node_props")["node_props"].select("node_id", S.natural_key("name").alias("key"))


XML_SQL = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '\"', '&quot;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;')"


@query("xml_escape", f"SELECT page_id, md5({XML_SQL.format(c='html')}) AS escaped FROM pages")
def _(spark, sf):
    return tables(spark, sf)["pages"].select("page_id", F.md5(S.xml_escape("html")).alias("escaped"))


@query(
    "sanitize_xml",
    "SELECT doc_id, md5(regexp_replace(replace(text, 'e', chr(7) || 'e' || chr(65535)), "
    "'[^\\x{9}\\x{A}\\x{D}\\x{20}-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]', '', 'g')) AS clean FROM documents",
)
def _(spark, sf):
    dirty = F.replace("text", F.lit("e"), F.lit("\x07e\uffff"))
    return tables(spark, sf)["documents"].select("doc_id", F.md5(S.sanitize_xml(dirty)).alias("clean"))


@query(
    "swap_case",
    "SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '(?s).'), "
    "lambda x: CASE WHEN x = 'ß' THEN 'SS' WHEN x = upper(x) THEN lower(x) ELSE upper(x) END), '')) AS swapped, "
    "md5(lower(text)) AS lowered FROM documents",
)
def _(spark, sf):
    return tables(spark, sf)["documents"].select(
        "doc_id", F.md5(S.swap_case("text")).alias("swapped"), F.md5(F.lower("text")).alias("lowered")
    )


@query("word_count", "SELECT doc_id, CAST(length(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS BIGINT) AS n_words FROM documents")
def _(spark, sf):
    return tables(spark, sf)["documents"].select("doc_id", S.word_count("text").alias("n_words"))


@query(
    "line_at",
    """WITH d AS (SELECT doc_id, text, substr(text, 1, CAST(n_chars // 2 AS INT)) AS head,
                         substr(text, CAST(n_chars // 2 AS INT) + 1) AS tail FROM documents),
       l AS (SELECT doc_id, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS BIGINT) AS line_num,
                    CASE WHEN head = '' THEN '' ELSE string_split(head, chr(10))[-1] || string_split(tail, chr(10))[1] END AS line,
                    string_split(ltrim(text, chr(10)), chr(10))[1] AS first FROM d)
       SELECT doc_id, line_num, CASE WHEN length(line) <= 100 THEN line ELSE substr(line, 1, 100) || '...' END AS line,
              CASE WHEN length(first) <= 100 THEN first ELSE substr(first, 1, 100) || '...' END AS first_line FROM l""",
)
def _(spark, sf):
    at = F.floor(F.col("n_chars") / 2).cast("int")
    return tables(spark, sf)["documents"].select(
        "doc_id", S.line_number("text", at).alias("line_num"), S.line_at("text", at).alias("line"),
        S.first_line("text").alias("first_line"),
    )


# Control characters in a web link are dropped; file paths come back from base64.
PARSE_SQL = """
  SELECT node_id, "offset" AS object_offset, link, p[1] AS type,
         CAST(CASE WHEN p[1] = 'node' THEN CAST(p[2] AS BIGINT) ELSE -1 END AS BIGINT) AS target_id,
         CASE WHEN p[1] = 'webs' THEN regexp_replace(p[2], '[\\x00-\\x1f]', '', 'g') ELSE '' END AS webs,
         CASE WHEN p[1] = 'file' THEN decode(from_base64(p[2])) ELSE '' END AS file,
         CASE WHEN p[1] = 'node' AND len(p) >= 3 THEN array_to_string(p[3:], ' ') ELSE '' END AS anch
  FROM (SELECT node_id, "offset", link, string_split(link, ' ') AS p FROM image WHERE link <> '')"""


@query("parse_link", PARSE_SQL, "image")
def _(spark, sf):
    links = derived(spark, sf, "image")["image"].where("link <> ''").withColumn("l", L.parse_link("link"))
    return links.select(
        "node_id", F.col("offset").alias("object_offset"), "link", "l.type", F.col("l.node_id").alias("target_id"),
        "l.webs", "l.file", "l.anch",
    )


@query("format_link", 'SELECT node_id, "offset" AS object_offset, link AS property FROM image WHERE link <> \'\'', "image")
def _(spark, sf):
    links = derived(spark, sf, "image")["image"].where("link <> ''").withColumn("l", L.parse_link("link"))
    return links.select("node_id", F.col("offset").alias("object_offset"), L.format_link(F.col("l")).alias("property"))


HREF_SQL = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages"


def _hrefs(spark, sf):
    return tables(spark, sf)["pages"].select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")
    )


@query(
    "href_to_link",
    f"""SELECT page_id, href, CASE WHEN regexp_matches(href, '^(mailto:|\\p{{L}}*://)') THEN 'webs ' || href
               ELSE 'webs http://' || href END AS link
        FROM (SELECT page_id, href FROM ({HREF_SQL}) UNION ALL SELECT page_id, url FROM pages)""",
)
def _(spark, sf):
    both = _hrefs(spark, sf).unionByName(tables(spark, sf)["pages"].select("page_id", F.col("url").alias("href")))
    return both.select("page_id", "href", L.href_to_link("href").alias("link"))


@query(
    "is_url",
    f"""SELECT href, regexp_matches(href, '^(mailto:|\\p{{L}}*://)') AS is_url, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT href FROM ({HREF_SQL}) UNION ALL SELECT url FROM pages) GROUP BY ALL""",
)
def _(spark, sf):
    both = _hrefs(spark, sf).select("href").union(tables(spark, sf)["pages"].select("url"))
    return both.groupBy("href").agg(F.count(F.lit(1)).alias("n")).select("href", S.is_url("href").alias("is_url"), "n")


CAMEL = "replace(p_name, ' ', upper(substr(split_part(p_name, ' ', 2), 1, 1)))"


@query(
    "is_camel_case",
    f"""SELECT p_partkey, w AS word, regexp_matches(w, '^[\\p{{L}}\\p{{N}}]+$') AND regexp_matches(w, '\\p{{Ll}}.*\\p{{Lu}}.*\\p{{Ll}}') AS camel
        FROM (SELECT p_partkey, {CAMEL} AS w FROM part UNION ALL SELECT p_partkey, p_name FROM part
              UNION ALL SELECT p_partkey, p_brand FROM part)""",
)
def _(spark, sf):
    part = tables(spark, sf)["part"]
    camel = F.expr(CAMEL)
    words = part.select("p_partkey", F.explode(F.array(camel, "p_name", "p_brand")).alias("word"))
    return words.select("p_partkey", "word", S.is_camel_case("word").alias("camel"))


@query(
    "header_anchor_level",
    """SELECT name, CAST(CASE WHEN lvl BETWEEN 1 AND 6 THEN lvl ELSE 0 END AS BIGINT) AS level FROM (
         SELECT name, COALESCE(TRY_CAST(regexp_extract(name, 'h(\\d+)-\\d+', 1) AS BIGINT), 0) AS lvl FROM (
           SELECT 'h' || p_size || '-' || p_partkey AS name FROM part UNION ALL SELECT anchor FROM image WHERE anchor <> ''))""",
    "image",
)
def _(spark, sf):
    d = derived(spark, sf, "part", "image")
    names = d["part"].select(F.concat_ws("", F.lit("h"), "p_size", F.lit("-"), "p_partkey").alias("name")).union(
        d["image"].where("anchor <> ''").select("anchor")
    )
    return names.select("name", S.header_anchor_level("name").alias("level"))


@query(
    "safe_file_name",
    "SELECT page_id, replace(trim(translate(url || ' *? a:b<c>|\"', '/\\*?:<>|\"' || chr(10) || chr(13), '--')), ' ', '_') AS file_name FROM pages",
)
def _(spark, sf):
    raw = F.concat("url", F.lit(' *? a:b<c>|"'))
    return tables(spark, sf)["pages"].select("page_id", S.safe_file_name(raw).alias("file_name"))


NAMES_SQL = """names AS (
  SELECT p.node_id, list(r.name ORDER BY s.i) AS names
  FROM paths AS p, LATERAL (SELECT unnest(p.path) AS id, unnest(range(len(p.path))) AS i) AS s
  JOIN resolved AS r ON r.node_id = s.id GROUP BY p.node_id)"""


def named_paths(spark, sf):
    names = resolve_shared(store(spark, sf), "name").select("node_id", "name")
    return names_on_path(paths(spark, sf), names)


@query(
    "hier_name",
    f""", {NAMES_SQL} SELECT node_id, array_to_string(names, '  /  ') AS shown, array_to_string(list_reverse(names), '--') AS leaf_first,
           right(replace(array_to_string(names, '--') || '_' || node_id || '.txt', ' ', '_'), 142) AS file_name,
           replace(right(replace(array_to_string(names, '--') || '.html', ' ', '_'), 142), '#', '~') AS html_name FROM names""",
    "paths resolved",
)
def _(spark, sf):
    names = F.col("names")
    return named_paths(spark, sf).select(
        "node_id", S.hier_name(names, "  /  ", False).alias("shown"),
        S.hier_name(names, "--", False, root_to_leaf=False).alias("leaf_first"),
        S.hier_name(names, "--", True, node_id=F.col("node_id"), trailer=".txt").alias("file_name"),
        S.hier_name(names, "--", True, trailer=".html", html=True).alias("html_name"),
    )


@query(
    "split_compress",
    """SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), '|') AS parts,
              CAST(len(string_split(url, '/')) AS BIGINT) AS n_all FROM pages""",
)
def _(spark, sf):
    return tables(spark, sf)["pages"].select(
        "page_id", F.array_join(S.split_compress("url", "/"), "|").alias("parts"),
        F.size(S.split_compress("url", "/", False)).cast("long").alias("n_all"),
    )


@query(
    "join_split_numbers",
    """SELECT o_orderkey, o_orderkey || ',' || o_custkey || ',0x1f' AS joined,
              CAST(o_orderkey + o_custkey + 31 AS BIGINT) AS total FROM orders""",
)
def _(spark, sf):
    joined = F.concat(S.join_numbers(F.array("o_orderkey", "o_custkey"), ","), F.lit(",0x1f"))
    total = F.aggregate(S.split_ints("joined", ","), F.lit(0).cast("long"), lambda a, b: a + b)
    return tables(spark, sf)["orders"].select("o_orderkey", joined.alias("joined")).withColumn("total", total)


@query(
    "highlight_words",
    "SELECT page_id, md5(replace(replace(" + XML_SQL.format(
        c="regexp_replace(html, '(the|de|p)', chr(64976) || '\\1' || chr(64977), 'gi')"
    ) + ", chr(64976), '<b>'), chr(64977), '</b>')) AS marked FROM pages",
)
def _(spark, sf):
    return tables(spark, sf)["pages"].select("page_id", F.md5(S.highlight_words("html", ["the", "de", "p"])).alias("marked"))


@query(
    "contains_words",
    "SELECT doc_id, contains(text, 'the') AND contains(text, 'and') AS has_all, contains(text, 'der') OR contains(text, 'que') AS has_any FROM documents",
)
def _(spark, sf):
    return tables(spark, sf)["documents"].select(
        "doc_id", S.contains_words("text", ["the", "and"]).alias("has_all"),
        S.contains_words("text", ["der", "que"], False).alias("has_any"),
    )


@query(
    "base_direction",
    f"""SELECT direction, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT CASE WHEN strong = '' THEN 'neutral' WHEN regexp_matches(strong, '[{S.RTL_CLASS}]') THEN 'rtl' ELSE 'ltr' END AS direction
         FROM (SELECT regexp_extract(line, '(\\p{{L}})', 1) AS strong FROM (
           SELECT unnest(string_split(text, chr(10))) AS line FROM documents
           UNION ALL SELECT '12 ' || chr(1488) || ' ' || p_name FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part)))
        GROUP BY direction""",
)
def _(spark, sf):
    t = tables(spark, sf)
    lines = (
        t["documents"].select(F.explode(F.split("text", "\n")).alias("line"))
        .union(t["part"].select(F.concat(F.lit("12 א "), "p_name"))).union(t["part"].select(F.col("p_size").cast("string")))
    )
    return lines.groupBy(S.base_direction("line").alias("direction")).agg(F.count(F.lit(1)).alias("n"))


BLANKS_SQL = "replace(text, '. ', '.  ' || chr(9) || chr(10)) || '  '"


@query(
    "strip_trailing_blanks",
    f"""SELECT doc_id, md5(regexp_replace(t, '[ \\t]+(\\n|\\z)', '\\1', 'g')) AS clean,
               CAST(len(regexp_extract_all(t, '[ \\t]+(\\n|\\z)')) AS BIGINT) AS n_lines
        FROM (SELECT doc_id, {BLANKS_SQL} AS t FROM documents)""",
)
def _(spark, sf):
    t = F.concat(F.replace("text", F.lit(". "), F.lit(".  \t\n")), F.lit("  "))
    return tables(spark, sf)["documents"].select("doc_id", t.alias("t")).select(
        "doc_id", F.md5(S.strip_trailing_blanks("t")).alias("clean"), S.count_trailing_blanks("t").alias("n_lines")
    )


@query(
    "tabs_to_spaces",
    """SELECT doc_id, md5(replace(t, chr(9), '    ')) AS clean, CAST(length(t) - length(replace(t, chr(9), '')) AS BIGINT) AS n_tabs
       FROM (SELECT doc_id, replace(text, ' ', chr(9)) AS t FROM documents)""",
)
def _(spark, sf):
    t = F.replace("text", F.lit(" "), F.lit("\t"))
    return tables(spark, sf)["documents"].select("doc_id", t.alias("t")).select(
        "doc_id", F.md5(S.tabs_to_spaces("t")).alias("clean"), S.count_tabs("t").alias("n_tabs")
    )


@query("format_ts", "SELECT node_id, strftime(make_timestamp(ts_lastsave * 1000000), '%Y/%m/%d - %H:%M') AS saved FROM node_props", "node_props")
def _(spark, sf):
    return derived(spark, sf, "node_props")["node_props"].select("node_id", S.format_ts("ts_lastsave", zone="UTC").alias("saved"))


@query(
    "cell_index",
    """SELECT p_partkey, CAST(7 * (p_partkey // 7) + p_partkey % 7 AS BIGINT) AS idx, CAST(p_partkey // 7 AS BIGINT) AS cell_row,
              CAST(p_partkey % 7 AS BIGINT) AS cell_col FROM part""",
)
def _(spark, sf):
    at = tables(spark, sf)["part"].withColumn("at", G.cell_row_col(F.col("p_partkey"), F.lit(7)))
    return at.select(
        "p_partkey", G.cell_index(F.col("at.row"), F.col("at.col"), F.lit(7)).alias("idx"),
        F.col("at.row").alias("cell_row"), F.col("at.col").alias("cell_col"),
    )


@query(
    "is_sha256",
    "SELECT doc_id, h, regexp_matches(h, '^[0-9a-f]{64}$') AS ok FROM (SELECT doc_id, sha256(text) AS h FROM documents UNION ALL SELECT doc_id, md5(text) FROM documents)",
)
def _(spark, sf):
    d = tables(spark, sf)["documents"]
    return d.select("doc_id", F.explode(F.array(F.sha2("text", 256), F.md5("text"))).alias("h")).select(
        "doc_id", "h", S.is_sha256("h").alias("ok")
    )


@query(
    "classify_uri",
    f"""SELECT uri, CASE WHEN starts_with(uri, 'https://') OR starts_with(uri, 'http://') THEN 'web'
                         WHEN starts_with(uri, '/') OR starts_with(uri, 'C:\\\\') THEN 'local' ELSE 'unknown' END AS kind, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT href AS uri FROM ({HREF_SQL}) UNION ALL SELECT url FROM pages UNION ALL SELECT 'C:\\\\' || p_name FROM part) GROUP BY ALL""",
)
def _(spark, sf):
    t = tables(spark, sf)
    uris = _hrefs(spark, sf).select(F.col("href").alias("uri")).union(t["pages"].select("url")).union(
        t["part"].select(F.concat(F.lit("C:\\\\"), "p_name"))
    )
    return uris.groupBy("uri").agg(F.count(F.lit(1)).alias("n")).select("uri", S.classify_uri("uri").alias("kind"), "n")


@query(
    "store_type",
    """SELECT path, CASE WHEN ext IN ('ctd', 'ctz') THEN 'xml' WHEN ext IN ('ctb', 'ctx') THEN 'sqlite' ELSE 'none' END AS kind,
              CASE WHEN ext IN ('ctd', 'ctb') THEN false WHEN ext IN ('ctz', 'ctx') THEN true END AS encrypted,
              CASE WHEN ext = 'txt' THEN path ELSE left(path, -4) END || '.ctz' AS fixed
       FROM (SELECT path, split_part(path, '.', -1) AS ext FROM (
         SELECT 'dir/' || p_partkey || '.' || CASE p_partkey % 5 WHEN 0 THEN 'ctd' WHEN 1 THEN 'ctz' WHEN 2 THEN 'ctb' WHEN 3 THEN 'ctx' ELSE 'txt' END AS path FROM part))""",
)
def _(spark, sf):
    ext = F.get(F.array(*[F.lit(x) for x in ("ctd", "ctz", "ctb", "ctx", "txt")]), (F.col("p_partkey") % 5).cast("int"))
    p = tables(spark, sf)["part"].select(F.concat(F.lit("dir/"), "p_partkey", F.lit("."), ext).alias("path"))
    return p.select(
        "path", S.store_type("path").alias("kind"), S.store_encrypted("path").alias("encrypted"),
        S.fix_extension("path", "xml", True).alias("fixed"),
    )


@query(
    "string_basics",
    """SELECT p_partkey, trim(chr(9) || p_name || '  ', ' ' || chr(9)) AS trimmed, replace(p_name, 'e', 'EE') AS replaced,
              starts_with(p_name, 'b') OR starts_with(p_name, 's') AS starts, ends_with(p_name, 'g') AS ends,
              CAST(instr(p_name, 'ring') - 1 AS BIGINT) AS at, repeat(p_name, CAST(p_size % 3 AS INT)) AS repeated FROM part""",
)
def _(spark, sf):
    return tables(spark, sf)["part"].select(
        "p_partkey", S.unicode_trim(F.concat(F.lit("\t"), "p_name", F.lit("  "))).alias("trimmed"),
        F.replace("p_name", F.lit("e"), F.lit("EE")).alias("replaced"),
        S.starts_with_any("p_name", ["b", "s"]).alias("starts"), F.col("p_name").endswith("g").alias("ends"),
        S.index_of("p_name", "ring").alias("at"), F.expr("repeat(p_name, p_size % 3)").alias("repeated"),
    )


def _text(cells):
    return F.array_join(F.transform(cells, lambda r: F.array_join(r, "|")), "\n")


LT = "array_to_string(list_transform({c}, lambda r: array_to_string(r, '|')), chr(10))"


@query(
    "grid_edits",
    "SELECT node_id, " + ", ".join(
        LT.format(c=c) + f" AS {n}"
        for n, c in {
            "row_added": "[cells[1], ['a','b','',''], cells[2], cells[3], cells[4]]",
            "row_deleted": "[cells[1], cells[3], cells[4]]",
            "row_up": "[cells[1], cells[3], cells[2], cells[4]]",
            "col_added": "list_transform(cells, lambda r: [r[1], '', r[2], r[3], r[4]])",
            "col_deleted": "list_transform(cells, lambda r: [r[1], r[2], r[4]])",
            "col_left": "list_transform(cells, lambda r: [r[1], r[3], r[2], r[4]])",
            "pasted_row": "[cells[1], cells[1], cells[2], cells[3], cells[4]]",
            "pasted_col": "list_transform(cells, lambda r: [r[1], r[1], r[2], r[3], r[4]])",
        }.items()
    ) + " FROM grid",
    "grid",
)
def _(spark, sf):
    c = F.col("cells")
    return store(spark, sf).grid.select(
        "node_id", _text(G.row_add(c, 0, F.array(F.lit("a"), F.lit("b")))).alias("row_added"),
        _text(G.row_delete(c, 1)).alias("row_deleted"), _text(G.row_move(c, 2, True)).alias("row_up"),
        _text(G.column_add(c, 0)).alias("col_added"), _text(G.column_delete(c, 2)).alias("col_deleted"),
        _text(G.column_move(c, 2, True)).alias("col_left"), _text(G.paste_row(c, 0, c)).alias("pasted_row"),
        _text(G.paste_column(c, 0, c)).alias("pasted_col"),
    )


@query(
    "sort_grid",
    "SELECT node_id, (SELECT string_agg(array_to_string(r, '|'), chr(10) ORDER BY list_transform(r, lambda v: "
    + NATURAL.format(c="v") + ")) FROM (SELECT unnest(cells[2:]) AS r)) AS body, array_to_string(cells[1], '|') AS header FROM grid",
    "grid",
)
def _(spark, sf):
    g = store(spark, sf).grid.withColumn("s", G.sort_rows(F.col("cells")))
    return g.select(
        "node_id", _text(F.slice("s", F.lit(2), F.size("s"))).alias("body"), F.array_join(F.get("s", F.lit(0)), "|").alias("header")
    )
