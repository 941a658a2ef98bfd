"""Lists, to-dos, tables of contents, style runs, histories."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import lists as LI
from ..sources.html import html_blocks
from .base import derived, query, tables

# Orders as list texts: numbered lines, nested bullets, to-dos and plain lines.
KIND = "l_linenumber % 4"
LINE_SPARK = """CASE WHEN l_linenumber % 4 = 0 THEN concat('   • ', p_name) WHEN l_linenumber % 4 = 1 THEN concat(l_linenumber + 2, ') ', p_name)
 WHEN l_linenumber % 4 = 2 THEN concat('   ', p_name) ELSE concat(CASE WHEN l_quantity > 30 THEN '☐ ' WHEN l_quantity > 15 THEN '☑ ' ELSE '☒ ' END, p_name) END"""
LIST_SQL = """lines AS (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS line_no,
         """ + LINE_SPARK + """ AS line FROM lineitem JOIN part ON p_partkey = l_partkey),
texts AS (SELECT id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY id)"""


def list_texts(spark, sf):
    t = tables(spark, sf)
    j = t["lineitem"].join(t["part"], F.col("p_partkey") == F.col("l_partkey"))
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.expr(LINE_SPARK).alias("line"))
    return j.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda s: s["line"]), "\n").alias("t")
    )


ITEMS_SQL = LIST_SQL + """, own AS (
  SELECT id, line_no, line, CASE WHEN starts_with(line, '   •') THEN 'bullet' WHEN regexp_matches(line, '^[1-9]') THEN 'number'
           WHEN regexp_matches(line, '^[☐☑☒]') THEN 'todo' ELSE 'none' END AS own_kind, CASE WHEN starts_with(line, '   ') THEN 1 ELSE 0 END AS own_level,
         CAST(COALESCE(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM lines),
items AS (
  SELECT *, max(CASE WHEN own_kind <> 'none' THEN line_no END) OVER (PARTITION BY id ORDER BY line_no) AS item_no FROM own),
attr AS (
  SELECT i.*, p.own_kind AS pk, p.own_level AS pl, p.off AS po, p.line AS pline,
         sum(CASE WHEN i.own_kind = 'none' AND (p.line_no IS NULL OR i.own_level <> p.own_level + 1) THEN 1 ELSE 0 END)
           OVER (PARTITION BY i.id, i.item_no ORDER BY i.line_no) AS breaks
  FROM items AS i LEFT JOIN own AS p ON p.id = i.id AND p.line_no = i.item_no)"""


@query(
    "list_lines",
    "WITH " + ITEMS_SQL + """ SELECT id, line_no, off AS line_offset, CASE WHEN breaks = 0 THEN pk ELSE 'none' END AS kind,
       CAST(CASE WHEN breaks = 0 THEN pl END AS BIGINT) AS level,
       CASE WHEN breaks = 0 THEN CASE WHEN pk = 'number' THEN CAST(regexp_extract(pline, '^(\\d+)', 1) AS BIGINT) ELSE -1 END END AS num_seq,
       CASE WHEN breaks = 0 THEN po END AS startoffs, CASE WHEN breaks = 0 THEN line_no - item_no END AS count_nl FROM attr""",
)
def _(spark, sf):
    return LI.list_lines(list_texts(spark, sf), "t", ["id"]).select(
        "id", "line_no", "line_offset", "kind", "level", "num_seq", "startoffs", "count_nl"
    )


@query(
    "list_items",
    "WITH " + ITEMS_SQL + """ SELECT id, po AS startoffs, pk AS kind, CAST(pl AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n_lines,
       string_agg(line, chr(10) ORDER BY line_no) AS item_text FROM attr WHERE breaks = 0 GROUP BY id, po, pk, pl""",
)
def _(spark, sf):
    return LI.list_items(list_texts(spark, sf), "t", ["id"]).select("id", "startoffs", "kind", "level", "n_lines", "item_text")


# Stops at the first to-do (an item on level 0 that is no number) or loose line.
@query(
    "renumber_lists",
    "WITH " + ITEMS_SQL + """, s AS (SELECT *, max(CASE WHEN breaks > 0 OR (pl = 0 AND pk <> 'number') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS stopped FROM attr),
       n AS (SELECT *, sum(CASE WHEN stopped = 0 AND own_kind = 'number' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS k FROM s)
       SELECT id, string_agg(CASE WHEN stopped = 0 AND own_kind = 'number' THEN k || regexp_replace(line, '^\\d+', '') ELSE line END, chr(10) ORDER BY line_no) AS text
       FROM n GROUP BY id""",
)
def _(spark, sf):
    return LI.renumber_lists(list_texts(spark, sf), "t", ["id"])


# Texts here hold one bullet, todos and one kind of number end, on levels 0 and 1.
@query(
    "indent_lists",
    "WITH " + ITEMS_SQL + """, l AS (
         SELECT *, breaks > 0 AS outside, pl AS level, CASE WHEN own_kind = 'number' THEN CAST(regexp_extract(line, '^(\\d+)', 1) AS BIGINT) END AS num FROM attr),
       near AS (
         SELECT l.*, (SELECT max(o.line_no) FROM l AS o WHERE o.id = l.id AND o.line_no < l.line_no AND (o.outside OR o.level <= l.own_level + 1)) AS at FROM l),
       got AS (SELECT n.*, a.pk AS above, NOT a.outside AND a.level = n.own_level + 1 AS found FROM near AS n LEFT JOIN l AS a ON a.id = n.id AND a.line_no = n.at),
       styled AS (
         SELECT id, line_no, CASE WHEN outside THEN chr(9) || line
           WHEN own_kind = 'bullet' THEN '      ' || CASE WHEN found AND above = 'bullet' THEN '•' ELSE substr('•◇▪-→⇒', CAST((own_level + 1 + 0 - own_level % 6) % 6 AS INT) + 1, 1) END || substr(line, 5)
           WHEN own_kind = 'number' THEN '   ' || '1' || substr('.)->', CAST((1 + 1 - 0) % 4 AS INT) + 1, 1) || regexp_replace(line, '^\\d+\\)', '')
           ELSE '   ' || line END AS new FROM got)
       SELECT id, string_agg(new, chr(10) ORDER BY line_no) AS text FROM styled GROUP BY id""",
)
def _(spark, sf):
    return LI.indent_lists(list_texts(spark, sf), "t", ["id"], True)


@query(
    "todo_status",
    "WITH " + LIST_SQL + """ SELECT CASE substr(line, 1, 1) WHEN '☐' THEN 'open' WHEN '☑' THEN 'done' ELSE 'dropped' END AS status,
       CAST(count(*) AS BIGINT) AS n FROM lines WHERE regexp_matches(line, '^[☐☑☒] ') GROUP BY ALL""",
)
def _(spark, sf):
    return LI.todo_status(list_texts(spark, sf), "t", [])


@query("rotate_todo", "WITH " + LIST_SQL + " SELECT id, translate(t, '☐☑☒', '☑☒☐') AS t FROM texts")
def _(spark, sf):
    return list_texts(spark, sf).select("id", LI.rotate_todo(F.col("t")).alias("t"))


@query("legacy_todo", "WITH " + LIST_SQL + " SELECT id, t FROM (SELECT id, translate(t, '☒', '☑') AS t FROM texts)")
def _(spark, sf):
    old = F.replace(F.replace(F.replace("t", F.lit("☐"), F.lit("[ ]")), F.lit("☑"), F.lit("[X]")), F.lit("☒"), F.lit("[X]"))
    return list_texts(spark, sf).select("id", LI.legacy_todo(old).alias("t"))


HEADS_SQL = """heads AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS k, CAST(substr(m, 3, 1) AS BIGINT) AS level,
         {plain} AS text
  FROM (SELECT page_id, unnest(h) AS m, unnest(range(len(h))) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>') AS h FROM pages)))"""
PLAIN = "{e}"


def entity_sql(c):
    out = f"regexp_replace({c}, '(?s)<[^>]*>', '', 'g')"
    for ent, ch in [("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")]:
        out = f"replace({out}, '{ent}', {ch})"
    return f"trim(regexp_replace({out}, '[\\s\\x{{A0}}]+', ' ', 'g'))"


@query(
    "toc",
    "WITH " + HEADS_SQL.replace("{plain}", entity_sql("m")) + """,
       n AS (SELECT *, row_number() OVER (PARTITION BY page_id, level ORDER BY k) AS n FROM heads)
       SELECT page_id AS node_id, k AS "offset", level, 'node ' || page_id || ' h' || level || '-' || n AS link, text, level + 1 AS indent,
              CASE WHEN level = 1 THEN '◇' ELSE '▪' END AS bullet,
              chr(10) || repeat(chr(9), CAST(level + 1 AS INT)) || CASE WHEN level = 1 THEN '◇' ELSE '▪' END || ' ' || text AS line FROM n
       UNION ALL SELECT page_id, -1, 0, 'node ' || page_id, url, 1, '▸', chr(10) || chr(9) || '▸ ' || url FROM pages""",
)
def _(spark, sf):
    pages = tables(spark, sf)["pages"]
    heads = html_blocks(pages, "html", ["page_id"]).where("kind = 'heading'").select(
        F.col("page_id").alias("node_id"), F.col("level").cast("string").alias("scale"), "text",
        (F.row_number().over(Window.partitionBy("page_id").orderBy("block_no")) - 1).cast("long").alias("offset"),
    )
    nodes = pages.select(F.col("page_id").alias("node_id"), F.col("url").alias("name"), F.lit(1).alias("depth"))
    return LI.toc(heads, nodes)


@query(
    "style_runs",
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents),
       a AS (SELECT *, CASE WHEN length(w) > 6 THEN 'weight=heavy' ELSE '' END AS attrs FROM w),
       c AS (SELECT *, CASE WHEN attrs IS DISTINCT FROM lag(attrs) OVER (PARTITION BY doc_id ORDER BY i) OR i = 0 THEN 1 ELSE 0 END AS new,
                    CAST(COALESCE(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off_ FROM a),
       r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS run_idx FROM c)
       SELECT doc_id AS node_id, run_idx, min(off_) AS start_offset, string_agg(w, '' ORDER BY i) AS text, any_value(attrs) AS attrs FROM r GROUP BY doc_id, run_idx""",
)
def _(spark, sf):
    words = tables(spark, sf)["documents"].select(F.col("doc_id").alias("node_id"), F.posexplode(F.split("text", " ")).alias("idx", "text"))
    return LI.style_runs(words.withColumn("attrs", F.when(F.length("text") > 6, F.lit("weight=heavy")).otherwise(F.lit(""))))


HIST_SQL = """, c AS (SELECT *, lag(snapshot) OVER (PARTITION BY node_id ORDER BY ts, event_id) AS prev FROM edit_log),
  hist AS (SELECT node_id, event_id, snapshot, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) - 1 AS age
           FROM c WHERE prev IS DISTINCT FROM snapshot QUALIFY age < 10)"""


def _hist(spark, sf):
    return H.history(derived(spark, sf, "edit_log")["edit_log"].select("node_id", "ts", "event_id", "snapshot"))


@query("history", HIST_SQL + " SELECT node_id, event_id, snapshot, age FROM hist", "edit_log")
def _(spark, sf):
    return _hist(spark, sf).select("node_id", "event_id", "snapshot", "age")


@query(
    "undo_redo",
    HIST_SQL + """ SELECT node_id, 'undo3' AS op, event_id, snapshot FROM hist WHERE age = 3 UNION ALL SELECT node_id, 'redo1', event_id, snapshot FROM hist WHERE age = 2
       UNION ALL SELECT node_id, 'pushed', event_id, snapshot FROM (
         SELECT node_id, event_id, snapshot FROM (SELECT *, age + 1 - 3 AS a2 FROM hist WHERE age >= 3) WHERE a2 < 10
         UNION ALL SELECT node_id, -1, 'new' FROM hist WHERE age = 0)""",
    "edit_log",
)
def _(spark, sf):
    from ..session import materialize

    h = materialize(_hist(spark, sf), "history")
    new = h.where("age = 0").select("node_id", F.expr("ts + interval 1 day").alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("new").alias("snapshot"))
    cols = ["node_id", "event_id", "snapshot"]
    return (
        H.undo_at(h, 3).select(*cols, F.lit("undo3").alias("op"))
        .unionByName(H.redo_at(h, 3, 1).select(*cols, F.lit("redo1").alias("op")))
        .unionByName(H.push_after_undo(h, 3, new).select(*cols, F.lit("pushed").alias("op")))
    )


@query("visited", "SELECT node_id, max(ts) AS last_ts, arg_max(event_id, (ts, event_id)) AS last_event FROM edit_log WHERE kind = 'visit' GROUP BY node_id", "edit_log")
def _(spark, sf):
    return H.visited(derived(spark, sf, "edit_log")["edit_log"].where("kind = 'visit'"))


@query(
    "recent",
    "SELECT node_id, arg_max(event_id, (ts, event_id)) AS last_event FROM edit_log WHERE kind = 'visit' GROUP BY node_id ORDER BY max((ts, event_id)) DESC LIMIT 10",
    "edit_log",
)
def _(spark, sf):
    return H.recent(derived(spark, sf, "edit_log")["edit_log"].where("kind = 'visit'"), "node_id", 10)


@query(
    "rotate_backups",
    """SELECT node_id, event_id, 'store-' || node_id || '.ctb' || repeat('~', CAST(rn AS INT)) AS backup_name FROM (
         SELECT node_id, event_id, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) AS rn FROM edit_log WHERE kind = 'buff') WHERE rn <= 3""",
    "edit_log",
)
def _(spark, sf):
    log = derived(spark, sf, "edit_log")["edit_log"].where("kind = 'buff'")
    versions = log.select("node_id", "event_id", "ts", F.concat(F.lit("store-"), F.col("node_id").cast("string"), F.lit(".ctb")).alias("path"), F.col("event_id").alias("version"))
    return H.rotate_backups(versions).select("node_id", "event_id", "backup_name")
