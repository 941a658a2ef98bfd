"""Search, replace, quick open, URLs, mentions and word audits."""

import uuid

from pyspark.sql import functions as F

from ..functions.text import ACCENTS_DST, ACCENTS_SRC
from ..operators import search as X
from ..operators.shared import resolve_shared
from ..session import shared_dir
from ..sinks.export import save_store
from ..sources.store import decode_nodes, load_store
from ..sources.stored import encode_store
from .base import object_index, paths, query, store, tables
from .scalars import NAMES_SQL, XML_SQL
from .trees import ordered

WORD = X.SearchOptions("avec", match_case=True)


def clip_sql(c):
    return f"CASE WHEN length({c}) <= 100 THEN {c} ELSE substr({c}, 1, 100) || '...' END"


def spans_sql(name, source, key, text, word):
    """Matches of a literal: {key}, i, match_start, match_end, line_num, line_content."""
    n = len(word)
    return f"""{name} AS (
      SELECT {key}, i, match_start, match_start + {n} AS match_end, line_num,
             CASE WHEN match_start + {n} = 0 THEN '' ELSE {clip_sql('lines[line_num]')} END AS line_content
      FROM (SELECT {key}, i, lines,
              CAST(sum(length(part)) OVER w + (i - 1) * {n} AS BIGINT) AS match_start,
              CAST(sum(length(part) - length(replace(part, chr(10), ''))) OVER w + 1 AS BIGINT) AS line_num
            FROM (SELECT {key}, string_split(t, chr(10)) AS lines, unnest(p[1:len(p) - 1]) AS part, unnest(range(1, len(p))) AS i
                  FROM (SELECT {key}, {text} AS t, string_split({text}, '{word}') AS p FROM {source}) WHERE len(p) > 1)
            WINDOW w AS (PARTITION BY {key} ORDER BY i)))"""


OBJECTS_SQL = """objects AS (
  SELECT node_id, "offset", kind, "offset" - row_number() OVER (PARTITION BY node_id ORDER BY "offset", kind) + 1 AS text_pos FROM (
    SELECT node_id, "offset", 'codebox' AS kind FROM codebox
    UNION ALL SELECT node_id, "offset", CASE WHEN is_light THEN 'grid_light' ELSE 'grid_heavy' END FROM grid
    UNION ALL SELECT node_id, "offset", CASE WHEN anchor <> '' THEN 'anchor' WHEN filename = '__ct_special.tex' THEN 'latex'
                                             WHEN filename <> '' THEN 'file' ELSE 'png' END FROM image))"""

SHIFT_SQL = """shifted AS (
  SELECT s.*, (SELECT count(*) FROM objects AS o WHERE o.node_id = s.node_id AND o.text_pos <= s.match_start) AS nb FROM spans AS s)"""

WS = "[^\\p{L}\\p{N}_]+"


@query(
    "compile_pattern",
    f"""WITH d AS (SELECT doc_id, text, lower(translate(text, '{ACCENTS_SRC}', '{ACCENTS_DST}')) AS folded,
                          ' ' || regexp_replace(lower(text), '{WS}', '  ', 'g') || ' ' AS padded,
                          string_split(lower(text), chr(10)) AS lines FROM documents)
        SELECT option, CAST(count(*) AS BIGINT) AS n_docs FROM (
          SELECT 'literal' AS option FROM d WHERE contains(lower(text), 'nicht')
          UNION ALL SELECT 'match_case' FROM d WHERE contains(text, 'Der')
          UNION ALL SELECT 'whole_word' FROM d WHERE contains(padded, ' de ')
          UNION ALL SELECT 'start_word' FROM d WHERE contains(padded, ' unt')
          UNION ALL SELECT 'accents' FROM d WHERE contains(folded, 'ete')
          UNION ALL SELECT 'all_words' FROM d WHERE len(list_filter(lines, lambda x: contains(x, 'the') AND contains(x, 'with'))) > 0
          UNION ALL SELECT 'any_word' FROM d WHERE len(list_filter(lines, lambda x: contains(x, 'avec') OR contains(x, 'nicht'))) > 0
          UNION ALL SELECT 'regex' FROM d WHERE regexp_matches(lower(text), 'q[a-z]+e,'))
        GROUP BY option""",
)
def _(spark, sf):
    O = X.SearchOptions
    options = {
        "literal": O("NICHT"), "match_case": O("Der", match_case=True), "whole_word": O("de", whole_word=True),
        "start_word": O("unt", start_word=True), "accents": O("été", accent_insensitive=True),
        "all_words": O("with the", multiple_words=1), "any_word": O("nicht avec", multiple_words=2),
        "regex": O("q[a-z]+e,", reg_exp=True),
    }
    docs = tables(spark, sf)["documents"]
    # One scan answers all options.
    flags = F.array(*[F.when(X.hit(F.col("text"), o), F.lit(n)) for n, o in options.items()])
    return (
        docs.select(F.explode(flags).alias("option")).where("option IS NOT NULL")
        .groupBy("option").agg(F.count(F.lit(1)).alias("n_docs"))
    )


@query(
    "time_filter",
    "SELECT node_id, ts_creation, ts_lastsave FROM node_props WHERE ts_creation >= 820454400 AND ts_creation <= 915148800 AND ts_lastsave <= 915100000",
    "node_props",
)
def _(spark, sf):
    opts = X.SearchOptions("", created_after=820454400, created_before=915148800, modified_before=915100000)
    return X.time_filter(store(spark, sf).node.select("node_id", "ts_creation", "ts_lastsave"), opts)


OPEN_SQL = """open_pos AS (
  SELECT r.node_id, r.holder_id, r.name, r.tags, r.syntax FROM resolved AS r
  WHERE (r.level & 1) = 0 AND r.node_id NOT IN (
    SELECT c.descendant_id FROM closure AS c JOIN resolved AS u ON u.node_id = c.ancestor_id
    WHERE ((u.level >> 1) & 1) = 1 AND c.descendant_id <> c.ancestor_id))"""


def _positions(spark, sf):
    return decode_nodes(resolve_shared(store(spark, sf), "name", "tags", "syntax", "level", "is_ro", "is_richtxt"))


@query("searchable_nodes", f", {OPEN_SQL} SELECT node_id, holder_id FROM open_pos", "resolved closure")
def _(spark, sf):
    return X.searchable_nodes(_positions(spark, sf), paths(spark, sf)).select("node_id", "holder_id")


@query("any_excluded", "SELECT bool_or(level <> 0) AS any_excluded FROM resolved", "resolved")
def _(spark, sf):
    return X.any_excluded(_positions(spark, sf))


@query(
    "search_scope",
    """SELECT 'subtree' AS scope, CAST(count(*) AS BIGINT) AS n, CAST(sum(node_id) AS BIGINT) AS id_sum FROM preorder WHERE list_contains(path, 103)
       UNION ALL SELECT 'onward', count(*), CAST(sum(node_id) AS BIGINT) FROM preorder WHERE pos >= (SELECT pos FROM preorder WHERE node_id = 103)
       UNION ALL SELECT 'backward', count(*), CAST(sum(node_id) AS BIGINT) FROM preorder WHERE pos <= (SELECT pos FROM preorder WHERE node_id = 103)""",
    "preorder",
)
def _(spark, sf):
    o = ordered(spark, sf)
    out = None
    for name, args in {"subtree": (False, True), "onward": (True, True), "backward": (True, False)}.items():
        part = X.search_scope(o, 103, *args).agg(F.count(F.lit(1)).alias("n"), F.sum("node_id").alias("id_sum")).withColumn("scope", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


FIND_TEXT_SQL = f""", {spans_sql('spans', 'node', 'node_id', 'txt', 'avec')}, {OBJECTS_SQL}, {SHIFT_SQL}
       SELECT node_id, match_start, match_end, match_start + nb AS buffer_start, match_end + nb AS buffer_end, line_num, line_content FROM shifted"""


@query("find_text", FIND_TEXT_SQL, "node codebox grid image")
def _(spark, sf):
    return X.find_text(store(spark, sf), WORD, index=object_index(spark, sf)).drop("match_idx")


def _stored(spark, sf):
    """The derived store, written as a real one with XML texts and grids, and read back."""
    path = f"{shared_dir(spark)}/thicket-stored-{uuid.uuid4().hex}"
    save_store(encode_store(store(spark, sf)), path)
    return load_store(spark, path)


@query("find_text_stored", FIND_TEXT_SQL, "node codebox grid image")
def _(spark, sf):
    return X.find_text(_stored(spark, sf), WORD).drop("match_idx")


@query(
    "find_text_folded",
    f"""SELECT doc_id, CAST((length(p) - length(replace(p, ' etre ', ''))) // 6 AS BIGINT) AS n_matches FROM (
         SELECT doc_id, ' ' || regexp_replace(lower(translate(text, '{ACCENTS_SRC}', '{ACCENTS_DST}')), '{WS}', '  ', 'g') || ' ' AS p FROM documents)
        WHERE contains(p, ' etre ')""",
)
def _(spark, sf):
    opts = X.SearchOptions("être", accent_insensitive=True, whole_word=True)
    found = X.text_matches(tables(spark, sf)["documents"], "text", opts, ["doc_id"])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matches"))


@query(
    "find_name_tags",
    """SELECT node_id, name, tags FROM resolved WHERE contains(lower(CASE WHEN tags = '' THEN name ELSE name || ' ' || tags END), 'urgent')
       OR contains(name, '99')""",
    "resolved",
)
def _(spark, sf):
    return X.find_name_tags(_positions(spark, sf), X.SearchOptions("urgent|99", reg_exp=True)).select("node_id", "name", "tags")


@query(
    "find_codebox",
    f""", {spans_sql('spans', 'codebox', 'node_id, "offset"', 'txt', 'the')}
       SELECT node_id, "offset" AS object_offset, match_start, match_end, line_num, line_content FROM spans""",
    "codebox",
)
def _(spark, sf):
    return X.find_codebox(store(spark, sf), X.SearchOptions("the", match_case=True)).drop("match_idx").withColumnRenamed("offset", "object_offset")


CELLS_SQL = """cells AS (SELECT node_id, "offset", is_light, 4 * (r - 1) + c - 1 AS cell_idx, cells[r][c] AS cell
  FROM grid, (SELECT unnest(range(1, 5)) AS r), (SELECT unnest(range(1, 5)) AS c))"""


FIND_GRID_SQL = f""", {CELLS_SQL}, {spans_sql('spans', 'cells', 'node_id, "offset", cell_idx', 'cell', 'r')}
       SELECT node_id, "offset" AS object_offset, cell_idx, match_start, match_end FROM spans"""


@query("find_grid", FIND_GRID_SQL, "grid")
def _(spark, sf):
    found = X.find_grid(store(spark, sf), X.SearchOptions("r", match_case=True))
    return found.select("node_id", F.col("offset").alias("object_offset"), "cell_idx", "match_start", "match_end")


@query("find_grid_stored", FIND_GRID_SQL, "grid")
def _(spark, sf):
    found = X.find_grid(_stored(spark, sf), X.SearchOptions("r", match_case=True))
    return found.select("node_id", F.col("offset").alias("object_offset"), "cell_idx", "match_start", "match_end")


@query(
    "find_object_names",
    """SELECT node_id, "offset" AS object_offset, CASE WHEN anchor <> '' THEN 'anchor' ELSE 'file' END AS kind,
              CASE WHEN anchor <> '' THEN anchor ELSE filename END AS object_name
       FROM image WHERE contains(anchor, '1') OR (anchor = '' AND filename <> '__ct_special.tex' AND contains(filename, '1'))""",
    "image",
)
def _(spark, sf):
    return X.find_object_names(store(spark, sf), X.SearchOptions("1")).withColumnRenamed("offset", "object_offset")


TARGETS_SQL = """targets AS (
  SELECT node_id, "offset", CASE p[1] WHEN 'webs' THEN p[2] WHEN 'node' THEN array_to_string(p[3:], ' ') WHEN 'file' THEN decode(from_base64(p[2])) END AS target
  FROM (SELECT node_id, "offset", string_split(link, ' ') AS p FROM image WHERE link <> ''))"""


@query(
    "find_link_targets",
    f""", {TARGETS_SQL}, {spans_sql('spans', 'targets', 'node_id, "offset"', 'target', 'e')}
       SELECT node_id, "offset" AS object_offset, match_start, match_end, line_content FROM spans""",
    "image",
)
def _(spark, sf):
    found = X.find_link_targets(X.link_objects(store(spark, sf)), X.SearchOptions("e", match_case=True))
    return found.select("node_id", F.col("offset").alias("object_offset"), "match_start", "match_end", "line_content")


NEEDLE = "der"
ALL = X.SearchOptions("avec", match_case=True)

ALL_SQL = f""", {OPEN_SQL}, {NAMES_SQL}, {OBJECTS_SQL},
  {spans_sql('spans', 'node', 'node_id', 'txt', 'avec')}, {SHIFT_SQL},
  {spans_sql('cspans', 'codebox', 'node_id, "offset"', 'txt', 'avec')},
  {CELLS_SQL}, {spans_sql('gspans', 'cells', 'node_id, "offset", is_light, cell_idx', 'cell', 'avec')},
  {TARGETS_SQL}, {spans_sql('lspans', 'targets', 'node_id, "offset"', 'target', 'avec')},
  objs AS (
    SELECT node_id, "offset", 'codebox' AS object_kind, 0 AS cell_idx, match_start AS inner_start, match_end AS inner_end, line_content FROM cspans
    UNION ALL SELECT node_id, "offset", CASE WHEN is_light THEN 'grid_light' ELSE 'grid_heavy' END, cell_idx, match_start, match_end, line_content FROM gspans
    UNION ALL SELECT node_id, "offset", CASE WHEN anchor <> '' THEN 'anchor' ELSE 'file' END, 0, 0, 0, CASE WHEN anchor <> '' THEN anchor ELSE filename END FROM image
      WHERE contains(anchor, 'avec') OR (anchor = '' AND filename <> '__ct_special.tex' AND contains(filename, 'avec'))
    UNION ALL SELECT node_id, "offset", 'png', 0, match_start, match_end, line_content FROM lspans),
  rows_ AS (
    SELECT node_id AS h, match_start + nb AS start_offset, match_end + nb AS end_offset, line_num, line_content, 'text' AS object_kind,
           0 AS cell_idx, 0 AS inner_start, 0 AS inner_end, 0 AS is_name FROM shifted
    UNION ALL
    SELECT o.node_id, o."offset", o."offset" + 1,
           (SELECT length(substr(n.txt, 1, CAST(x.tp AS INT))) - length(replace(substr(n.txt, 1, CAST(x.tp AS INT)), chr(10), '')) + 1 FROM node AS n WHERE n.node_id = o.node_id),
           line_content, object_kind, cell_idx, inner_start, inner_end, 0
    FROM objs AS o JOIN (SELECT node_id, "offset", min(text_pos) AS tp FROM objects GROUP BY ALL) AS x
      ON x.node_id = o.node_id AND x."offset" = o."offset"),
  located AS (
    SELECT p.node_id, p.name, p.tags, r.* EXCLUDE (h) FROM rows_ AS r JOIN open_pos AS p ON p.holder_id = r.h
    UNION ALL
    SELECT p.node_id, p.name, p.tags, 0, 0, 0, {clip_sql("string_split(ltrim(n.txt, chr(10)), chr(10))[1]")}, 'text', 0, 0, 0, 1
    FROM open_pos AS p JOIN node AS n ON n.node_id = p.holder_id
    WHERE contains(CASE WHEN p.tags = '' THEN p.name ELSE p.name || ' ' || p.tags END, 'avec')),
  matches AS (
    SELECT CAST(o.pos AS BIGINT) AS pos, l.is_name = 1 AS is_name, l.node_id,
           CASE WHEN l.tags = '' THEN l.name ELSE l.name || chr(10) || ' [Tags: ' || l.tags || ']' END AS node_name,
           {XML_SQL.format(c="array_to_string(s.names, '  /  ')")} AS hier_name,
           CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset, CAST(line_num AS BIGINT) AS line_num,
           line_content, object_kind, CAST(cell_idx AS BIGINT) AS cell_idx, CAST(inner_start AS BIGINT) AS inner_start, CAST(inner_end AS BIGINT) AS inner_end
    FROM located AS l JOIN names AS s ON s.node_id = l.node_id JOIN preorder AS o ON o.node_id = l.node_id)"""
ALL_NEEDS = "resolved closure node codebox grid image preorder"


def searched(spark, sf, word):
    return X.all_matches(store(spark, sf), paths(spark, sf), ordered(spark, sf), X.SearchOptions(word, match_case=True), index=object_index(spark, sf))


@query("all_matches", ALL_SQL + " SELECT * FROM matches", ALL_NEEDS)
def _(spark, sf):
    out = searched(spark, sf, "avec").drop("kind_rank")
    return out.withColumn("is_name", F.col("is_name") == 1)


@query("all_matches_objects", (ALL_SQL + " SELECT * FROM matches").replace("'avec'", "'1-1'").replace("* 4 AS", "* 3 AS").replace("+ 4 ", "+ 3 ").replace("(i - 1) * 4", "(i - 1) * 3"), ALL_NEEDS)
def _(spark, sf):
    return searched(spark, sf, "1-1").drop("kind_rank").withColumn("is_name", F.col("is_name") == 1)


MATCH_ORDER_SQL = "pos, is_name, start_offset, CASE WHEN object_kind = 'text' THEN 1 ELSE 0 END, object_kind, cell_idx, inner_start, line_content"


@query(
    "first_match",
    ALL_SQL + """, o AS (SELECT *, row_number() OVER (ORDER BY {o}) AS rn FROM matches WHERE pos > 500)
      SELECT 'next' AS direction, node_id, start_offset FROM o WHERE rn = 1
      UNION ALL SELECT 'previous', node_id, start_offset FROM (SELECT *, row_number() OVER (ORDER BY {o}) AS rn FROM matches WHERE pos < 500)
      QUALIFY rn = max(rn) OVER ()""".format(o=MATCH_ORDER_SQL),
    ALL_NEEDS,
)
def _(spark, sf):
    m = searched(spark, sf, "avec")
    nxt = X.first_match(m.where("pos > 500")).select(F.lit("next").alias("direction"), "node_id", "start_offset")
    prev = X.first_match(m.where("pos < 500"), forward=False).select(F.lit("previous").alias("direction"), "node_id", "start_offset")
    return nxt.unionByName(prev)


@query(
    "result_pages",
    ALL_SQL + f""" SELECT node_id, start_offset, object_kind, row_num, CAST((row_num - 1) // 500 AS BIGINT) AS page FROM (
        SELECT *, row_number() OVER (ORDER BY {MATCH_ORDER_SQL}) AS row_num FROM matches)""",
    ALL_NEEDS,
)
def _(spark, sf):
    return X.paged(searched(spark, sf, "avec")).select("node_id", "start_offset", "object_kind", "row_num", "page")


@query(
    "one_page",
    ALL_SQL + f""" SELECT node_id, start_offset, object_kind, row_num FROM (
        SELECT *, row_number() OVER (ORDER BY {MATCH_ORDER_SQL}) AS row_num FROM matches) WHERE row_num BETWEEN 101 AND 200""",
    ALL_NEEDS,
)
def _(spark, sf):
    return X.page(X.match_pages(searched(spark, sf, "avec"), size=100), 1).select("node_id", "start_offset", "object_kind", F.col("row_num").cast("long").alias("row_num"))


@query(
    "page_labels",
    """SELECT CAST(p AS BIGINT) AS page, (p * 500 + 1) || '..' || least((p + 1) * 500, n) AS label
       FROM (SELECT n, unnest(range(CAST(ceil(n / 500.0) AS BIGINT))) AS p FROM (SELECT count(*) AS n FROM children))""",
    "children",
)
def _(spark, sf):
    return X.page_labels(store(spark, sf).children.agg(F.count(F.lit(1)).alias("n")))


@query("match_summary", ALL_SQL + " SELECT node_id, CAST(count(*) AS BIGINT) AS n_matches FROM matches GROUP BY node_id", ALL_NEEDS)
def _(spark, sf):
    return X.match_summary(searched(spark, sf, "avec"))


@query(
    "replace_text",
    "SELECT node_id, md5(replace(txt, 'avec', 'A$1\\B')) AS txt FROM node WHERE contains(txt, 'avec') AND (is_ro & 1) = 0",
    "node",
)
def _(spark, sf):
    return X.replace_text(store(spark, sf).node, ALL, "A$1\\B").select("node_id", F.md5("txt").alias("txt"))


@query(
    "replace_text_regex",
    "SELECT node_id, md5(regexp_replace(txt, '(que)([a-z])', '\\2-\\1', 'g')) AS txt FROM node WHERE regexp_matches(txt, 'que[a-z]') AND (is_ro & 1) = 0",
    "node",
)
def _(spark, sf):
    opts = X.SearchOptions("(que)([a-z])", reg_exp=True, match_case=True)
    return X.replace_text(store(spark, sf).node, opts, "\\2-\\1").select("node_id", F.md5("txt").alias("txt"))


@query(
    "replace_in_objects",
    """SELECT node_id, 'codebox' AS kind, replace(txt, 'the', 'THE') AS content FROM codebox WHERE contains(txt, 'the') AND node_id IN (SELECT node_id FROM node_props WHERE (is_ro & 1) = 0)
       UNION ALL SELECT node_id, 'grid', array_to_string(list_transform(cells, lambda r: array_to_string(list_transform(r, lambda c: replace(c, 'the', 'THE')), '|')), chr(10))
         FROM grid WHERE contains(array_to_string(list_transform(cells, lambda r: array_to_string(r, '|')), '|'), 'the') AND node_id IN (SELECT node_id FROM node_props WHERE (is_ro & 1) = 0)
       UNION ALL SELECT node_id, 'image', replace(link, 'the', 'THE') FROM image WHERE starts_with(link, 'webs ') AND contains(link, 'the') AND node_id IN (SELECT node_id FROM node_props WHERE (is_ro & 1) = 0)""",
    "codebox grid image",
)
def _(spark, sf):
    out = X.replace_in_objects(store(spark, sf), X.SearchOptions("the", match_case=True, replace_in_link_targets=True), "THE")
    cells = F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "\n")
    return (
        out["codebox"].select("node_id", F.lit("codebox").alias("kind"), F.col("txt").alias("content"))
        .unionByName(out["grid"].select("node_id", F.lit("grid").alias("kind"), cells.alias("content")))
        .unionByName(out["image"].select("node_id", F.lit("image").alias("kind"), F.col("link").alias("content")))
    )


@query(
    "replace_names",
    "SELECT node_id, regexp_replace(name, '(order)', '<\\1>', 'gi') AS name FROM node_props WHERE contains(lower(name || ' ' || tags), 'order') AND (is_ro & 1) = 0",
    "node_props",
)
def _(spark, sf):
    opts = X.SearchOptions("order")
    return X.replace_names(store(spark, sf).node.select("node_id", "name", "tags", "is_ro"), opts, "<\\0>").select("node_id", "name")


@query(
    "rank_nodes",
    f""", {NAMES_SQL}, n AS (SELECT s.node_id, lower(s.names[-1]) AS nm, s.names[-1] AS name, lower(array_to_string(s.names, ' / ')) AS hier, o.pos
                             FROM names AS s JOIN preorder AS o ON o.node_id = s.node_id)
       SELECT * FROM (SELECT node_id, name, CAST(CASE WHEN starts_with(nm, 'order 12') THEN 0 WHEN contains(nm, 'order 12') THEN 1
             WHEN contains(nm, 'order') AND contains(nm, '12') THEN 2 WHEN contains(nm, 'order') OR contains(nm, '12') THEN 3
             WHEN contains(hier, 'order') AND contains(hier, '12') THEN 4 WHEN contains(hier, 'order') OR contains(hier, '12') THEN 5 END AS BIGINT) AS score,
             CAST(pos AS BIGINT) AS pos FROM n) WHERE score IS NOT NULL""",
    "resolved preorder",
)
def _(spark, sf):
    names = resolve_shared(store(spark, sf), "name").select("node_id", "name")
    return X.rank_nodes(paths(spark, sf), names, ordered(spark, sf), "Order 12")


@query(
    "find_urls",
    """SELECT page_id, k, u AS url, CAST(s AS BIGINT) AS url_start, CAST(s + length(u) AS BIGINT) AS url_end FROM (
         SELECT page_id, unnest(['paren', 'square', 'www', 'plain']) AS k,
                unnest([url, url, 'www.x.org/' || page_id, url]) AS u,
                unnest([5, 5 + length(url) + 7, 5 + 2 * length(url) + 13, 5 + 2 * length(url) + 13 + length('www.x.org/' || page_id) + 1]) AS s FROM pages)""",
)
def _(spark, sf):
    text = F.concat(
        F.lit("see ("), "url", F.lit(") and ["), "url", F.lit("] or <www.x.org/"), F.col("page_id").cast("string"), F.lit(">"), "url", F.lit(" and more text")
    )
    found = X.find_urls(tables(spark, sf)["pages"].select("page_id", text.alias("t")), "t", ["page_id"])
    from pyspark.sql import Window

    k = F.get(F.array(*[F.lit(x) for x in ("paren", "square", "www", "plain")]), F.row_number().over(Window.partitionBy("page_id").orderBy("url_start")) - 1)
    return found.select("page_id", k.alias("k"), "url", "url_start", "url_end")


@query(
    "find_node_mentions",
    f""", first_ AS (SELECT name, arg_min(r.node_id, pos) AS target_id FROM resolved AS r JOIN preorder AS o ON o.node_id = r.node_id GROUP BY name)
       SELECT l.l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber, m.mention, f.target_id FROM lineitem AS l,
         LATERAL (SELECT 'Order ' || l.l_partkey AS mention UNION ALL SELECT 'Customer#' || lpad(CAST(l.l_suppkey AS VARCHAR), 9, '0')) AS m
       JOIN first_ AS f ON f.name = m.mention""",
    "resolved preorder",
)
def _(spark, sf):
    s = store(spark, sf)
    text = F.concat(
        F.lit("see [[Order "), F.col("l_partkey").cast("string"), F.lit("]] and [[Customer#"),
        F.lpad(F.col("l_suppkey").cast("string"), 9, "0"), F.lit("]] or [[nobody]] and NoNode1"),
    )
    lines = tables(spark, sf)["lineitem"].select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), text.alias("t"))
    names = resolve_shared(s, "name").select("node_id", "name")
    return X.find_node_mentions(lines, "t", ["l_orderkey", "l_linenumber"], names, ordered(spark, sf)).drop("form")


@query(
    "unknown_words",
    """WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents),
            known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM benchmark)
       SELECT lang, word, CAST(count(*) AS BIGINT) AS n FROM w WHERE word NOT IN (SELECT word FROM known) GROUP BY lang, word""",
)
def _(spark, sf):
    t = tables(spark, sf)
    known = t["benchmark"].select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("word"))
    return X.unknown_words(t["documents"], "text", known, ["lang"])


@query(
    "objects_before",
    f""", {OBJECTS_SQL}, points AS (SELECT node_id, 50 AS at FROM node_props UNION ALL SELECT node_id, 70 FROM node_props)
       SELECT p.node_id, CAST(p.at AS BIGINT) AS at, (SELECT count(*) FROM objects AS o WHERE o.node_id = p.node_id AND o.text_pos <= p.at) AS n_before FROM points AS p""",
    "codebox grid image",
)
def _(spark, sf):
    s = store(spark, sf)
    points = s.node.select("node_id", F.explode(F.array(F.lit(50).cast("long"), F.lit(70).cast("long"))).alias("at"))
    return X.objects_before(points, object_index(spark, sf), "at")


@query("objects_between", f', {OBJECTS_SQL} SELECT node_id, "offset" AS object_offset, kind FROM objects WHERE "offset" BETWEEN 20 AND 80', "codebox grid image")
def _(spark, sf):
    return X.objects_between(X.all_objects(store(spark, sf)), 20, 80).select("node_id", F.col("offset").alias("object_offset"), "kind")


@query(
    "objects_in_order",
    f""", {OBJECTS_SQL} SELECT node_id, "offset" AS object_offset, kind, row_number() OVER (PARTITION BY node_id ORDER BY "offset", kind) AS rank,
          "offset" - row_number() OVER (PARTITION BY node_id ORDER BY "offset", kind) + 1 AS text_pos FROM objects""",
    "codebox grid image",
)
def _(spark, sf):
    return object_index(spark, sf).place.select(
        "node_id", F.col("offset").alias("object_offset"), "kind", F.col("obj_rank").alias("rank"), "text_pos"
    )
