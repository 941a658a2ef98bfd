"""The tree: loading, sharing, closure, order, moves, summaries."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import forest as T
from ..operators import merge as M
from ..operators import shared as SH
from ..sources import store as ST
from .base import derived, paths, query, store, tables
from .scalars import NATURAL


@query(
    "load_store",
    """SELECT 'node' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(node_id) AS BIGINT) AS id_sum, md5(string_agg(md5(name || txt || tags) , '' ORDER BY node_id)) AS digest FROM node
       UNION ALL SELECT 'children', count(*), sum(node_id), md5(string_agg(father_id || ':' || sequence || ':' || master_id, '' ORDER BY node_id)) FROM children
       UNION ALL SELECT 'codebox', count(*), sum(node_id), NULL FROM codebox UNION ALL SELECT 'grid', count(*), sum(node_id), NULL FROM grid
       UNION ALL SELECT 'image', count(*), sum(node_id), NULL FROM image UNION ALL SELECT 'bookmark', count(*), sum(node_id), NULL FROM bookmark"""
    .replace("md5(string_agg(md5(name || txt || tags) , '' ORDER BY node_id))", "CAST(sum(length(name) + length(txt) + length(tags)) AS VARCHAR)")
    .replace("md5(string_agg(father_id || ':' || sequence || ':' || master_id, '' ORDER BY node_id))", "CAST(sum(father_id + sequence + master_id) AS VARCHAR)"),
    "node children codebox grid image bookmark",
)
def _(spark, sf):
    s = store(spark, sf)
    total = {
        "node": F.sum(F.length("name") + F.length("txt") + F.length("tags")).cast("long").cast("string"),
        "children": F.sum(F.col("father_id") + F.col("sequence") + F.col("master_id")).cast("string"),
    }
    out = None
    for name, df in s.tables().items():
        row = df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum("node_id").alias("id_sum"),
            total.get(name, F.lit(None).cast("string")).alias("digest"),
        ).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "decode_nodes",
    """SELECT node_id, (is_ro & 1) = 1 AS read_only, is_ro >> 1 AS custom_icon_id, (is_richtxt & 1) = 1 AS is_rich,
              ((is_richtxt >> 1) & 1) = 1 AS is_bold,
              CASE WHEN ((is_richtxt >> 2) & 1) = 1 THEN '#' || lower(lpad(to_hex((is_richtxt >> 3) & 16777215), 6, '0')) ELSE '' END AS foreground,
              (level & 1) = 1 AS exclude_me, ((level >> 1) & 1) = 1 AS exclude_children,
              CASE syntax WHEN 'custom-colors' THEN 'rich' WHEN 'plain-text' THEN 'plain' ELSE 'code' END AS kind FROM node_props""",
    "node_props",
)
def _(spark, sf):
    return ST.decode_nodes(store(spark, sf).node).select(
        "node_id", "read_only", "custom_icon_id", "is_rich", "is_bold", "foreground", "exclude_me", "exclude_children", "kind"
    )


@query(
    "align_schema",
    """SELECT node_id, name, '' AS tags, CAST(NULL AS BIGINT) AS ts_creation, CAST(NULL AS BIGINT) AS ts_lastsave FROM node_props""",
    "node_props",
)
def _(spark, sf):
    old = store(spark, sf).node.select("node_id", "name", F.lit(None).cast("string").alias("tags"))
    aligned = ST.align_schema(old, "node_id long, name string, tags string, ts_creation long, ts_lastsave long")
    return ST.null_to_empty(aligned)


@query("null_to_empty", "SELECT c_custkey, COALESCE(CASE WHEN c_acctbal < 0 THEN c_mktsegment END, '') AS tags FROM customer")
def _(spark, sf):
    df = tables(spark, sf)["customer"].select("c_custkey", F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).alias("tags"))
    return ST.null_to_empty(df, "tags")


@query("resolve_shared", "SELECT node_id, holder_id, name, syntax, tags, ts_creation FROM resolved", "resolved")
def _(spark, sf):
    return SH.resolve_shared(store(spark, sf), "name", "syntax", "tags", "ts_creation").select(
        "node_id", "holder_id", "name", "syntax", "tags", "ts_creation"
    )


@query(
    "shared_groups",
    """SELECT master_id, CAST(count(DISTINCT node_id) AS BIGINT) AS n_members, min(node_id) AS first_member, max(node_id) AS last_member
       FROM children WHERE master_id > 0 GROUP BY master_id""",
    "children",
)
def _(spark, sf):
    return SH.shared_groups(store(spark, sf).children)


@query(
    "closure",
    """SELECT s.a AS ancestor_id, node_id AS descendant_id, CAST(len(path) - 1 - s.i AS BIGINT) AS distance
       FROM paths, LATERAL (SELECT unnest(path) AS a, unnest(range(len(path))) AS i) AS s""",
    "paths",
)
def _(spark, sf):
    return T.closure(paths(spark, sf))


@query("root_paths", "SELECT node_id, CAST(depth AS BIGINT) AS depth, array_to_string(path, '/') AS path FROM paths", "paths")
def _(spark, sf):
    return paths(spark, sf).select("node_id", "depth", T.path_text(F.col("path")).alias("path"))


@query(
    "preorder",
    """SELECT node_id, CAST(pos AS BIGINT) AS pos, lag(node_id) OVER w AS prev_sibling, lead(node_id) OVER w AS next_sibling
       FROM preorder WINDOW w AS (PARTITION BY father_id ORDER BY sequence, node_id)""",
    "preorder",
)
def _(spark, sf):
    return T.preorder(paths(spark, sf), siblings=True).select("node_id", "pos", "prev_sibling", "next_sibling")


def ordered(spark, sf):
    """Document order of the derived store."""
    from .base import _key
    from ..session import materialize

    key = _key(spark, sf)
    if key not in _ORDERED:
        _ORDERED[key] = materialize(T.preorder(paths(spark, sf)).select("node_id", "path", "depth", "father_id", "sequence", "master_id", "pos"), "ordered")
    return _ORDERED[key]


_ORDERED = {}


@query(
    "fix_sequences",
    """SELECT node_id, r AS sequence, r <> seq AS changed FROM (
         SELECT node_id, seq, row_number() OVER (PARTITION BY father_id ORDER BY seq, node_id) AS r
         FROM (SELECT node_id, father_id, sequence * 3 AS seq FROM children))""",
    "children",
)
def _(spark, sf):
    gaps = store(spark, sf).children.withColumn("sequence", F.col("sequence") * 3)
    return T.fix_sequences(gaps).select("node_id", "sequence", "changed")


_SORT = """SELECT node_id, r AS sequence, r <> seq AS changed FROM (
    SELECT node_id, sequence AS seq, row_number() OVER (PARTITION BY father_id ORDER BY {key} {dir}, sequence, node_id) AS r
    FROM resolved {where})"""


@query("sort_forest", _SORT.format(key=NATURAL.format(c="lower(name)"), dir="DESC", where=""), "resolved")
def _(spark, sf):
    named = SH.resolve_shared(store(spark, sf), "name").select("node_id", "father_id", "sequence", "name")
    return T.sort_forest(named, ascending=False).select("node_id", "sequence", "changed")


@query("sort_siblings", _SORT.format(key=NATURAL.format(c="lower(name)"), dir="ASC", where="WHERE father_id = 101"), "resolved")
def _(spark, sf):
    named = SH.resolve_shared(store(spark, sf), "name").select("node_id", "father_id", "sequence", "name")
    return T.sort_siblings(named, 101).select("node_id", "sequence", "changed")


@query("subtree_counts", "SELECT ancestor_id AS node_id, CAST(count(*) AS BIGINT) AS n_nodes FROM closure GROUP BY ancestor_id", "closure")
def _(spark, sf):
    return T.subtree_counts(paths(spark, sf))


# Every customer moved under some other customer, nation or region.
@query(
    "move_is_valid",
    """SELECT m.src, m.dst, NOT list_contains(p.path, m.src) AS valid
       FROM (SELECT node_id AS src, father_id AS dst FROM children WHERE father_id > 0
             UNION ALL SELECT father_id, node_id FROM children WHERE father_id > 0
             UNION ALL SELECT node_id, 101 FROM children) AS m JOIN paths AS p ON p.node_id = m.dst""",
    "paths",
)
def _(spark, sf):
    c = store(spark, sf).children
    inner = c.where("father_id > 0")
    moves = (
        inner.select(F.col("node_id").alias("src"), F.col("father_id").alias("dst"))
        .union(inner.select("father_id", "node_id")).union(c.select("node_id", F.lit(101).cast("long")))
    )
    return T.move_is_valid(moves, paths(spark, sf)).select("src", "dst", "valid")


@query(
    "move_subtree",
    """SELECT node_id, father_id, row_number() OVER (PARTITION BY father_id ORDER BY seq, tie, node_id) AS sequence FROM (
         SELECT node_id, CASE WHEN node_id = 101 THEN 2 ELSE father_id END AS father_id,
                CASE WHEN node_id = 101 THEN (SELECT sequence FROM children WHERE node_id = 102 AND father_id = 2) ELSE sequence END AS seq,
                CASE WHEN node_id = 101 THEN 1 WHEN node_id = 102 THEN 0 ELSE 2 END AS tie FROM children)""",
    "children",
)
def _(spark, sf):
    return T.move_subtree(store(spark, sf).children, 101, 2, after=102).select("node_id", "father_id", "sequence")


@query(
    "move_step",
    """SELECT node_id, father_id, row_number() OVER (PARTITION BY father_id ORDER BY seq, tie, node_id) AS sequence FROM (
         SELECT node_id, CASE WHEN node_id = 2 THEN 1 ELSE father_id END AS father_id,
                CASE WHEN node_id = 2 THEN 1000000000 ELSE sequence END AS seq, 0 AS tie FROM children)""",
    "children",
)
def _(spark, sf):
    return T.move_step(store(spark, sf).children, 2, "indent").select("node_id", "father_id", "sequence")


@query(
    "write_order",
    "SELECT DISTINCT e.node_id, CAST(p.depth AS BIGINT) AS depth FROM edit_log AS e JOIN paths AS p ON p.node_id = e.node_id",
    "edit_log paths",
)
def _(spark, sf):
    log = derived(spark, sf, "edit_log")["edit_log"]
    return T.write_order(log.select("node_id").distinct(), paths(spark, sf))


@query(
    "summary",
    """SELECT * FROM (SELECT count(*) FILTER (syntax = 'custom-colors') AS nodes_rich, count(*) FILTER (syntax = 'plain-text') AS nodes_plain,
              count(*) FILTER (syntax = 'sql') AS nodes_code,
              count(DISTINCT master_id) FILTER (master_id > 0) AS shared_groups,
              count(*) FILTER (master_id > 0) + count(DISTINCT master_id) FILTER (master_id > 0) AS shared_total FROM resolved),
       (SELECT count(*) FILTER (anchor = '' AND filename = '') AS images, count(*) FILTER (anchor = '' AND filename = '__ct_special.tex') AS latexes,
              count(*) FILTER (anchor = '' AND filename NOT IN ('', '__ct_special.tex')) AS files, count(*) FILTER (anchor <> '') AS anchors FROM image),
       (SELECT count(*) FILTER (NOT is_light) AS heavy_grids, count(*) FILTER (is_light) AS light_grids FROM grid),
       (SELECT count(*) AS codeboxes FROM codebox)""",
    "resolved image grid codebox",
)
def _(spark, sf):
    return A.summary(store(spark, sf))


@query("used_tags", "SELECT DISTINCT trim(t) AS tag FROM (SELECT unnest(string_split(tags, ' ')) AS t FROM node_props) WHERE trim(t) <> ''", "node_props")
def _(spark, sf):
    return A.used_tags(store(spark, sf).node)


@query(
    "tag_counts",
    """SELECT t AS tag, CAST(count(DISTINCT node_id) AS BIGINT) AS n_nodes FROM (SELECT node_id, unnest(string_split(tags, ' ')) AS t FROM node_props)
       WHERE t <> '' GROUP BY t""",
    "node_props",
)
def _(spark, sf):
    return A.tag_counts(store(spark, sf).node)


@query(
    "has_flags",
    """SELECT node_id, node_id IN (SELECT node_id FROM codebox) AS has_codebox, node_id IN (SELECT node_id FROM grid) AS has_table,
              node_id IN (SELECT node_id FROM image) AS has_image FROM node_props""",
    "codebox grid image",
)
def _(spark, sf):
    return A.has_flags(store(spark, sf))


WORDS_SQL = "CAST(length(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+')) AS BIGINT)"


@query(
    "words_by_subtree",
    f"""SELECT c.ancestor_id AS node_id, CAST(sum(w.n) AS BIGINT) AS n_words
        FROM closure AS c JOIN resolved AS r ON r.node_id = c.descendant_id
        JOIN (SELECT node_id, {WORDS_SQL.format(c='txt')} AS n FROM node) AS w ON w.node_id = r.holder_id GROUP BY c.ancestor_id""",
    "closure resolved node",
)
def _(spark, sf):
    return A.words_by_subtree(store(spark, sf), paths(spark, sf))


@query(
    "words_by_language",
    f"SELECT lang, CAST(sum({WORDS_SQL.format(c='text')}) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n_docs FROM documents GROUP BY lang",
)
def _(spark, sf):
    from ..functions.text import word_count

    return tables(spark, sf)["documents"].groupBy("lang").agg(
        F.sum(word_count("text")).alias("n_words"), F.count(F.lit(1)).alias("n_docs")
    )


@query("clear_exclusions", "SELECT node_id, CAST(0 AS BIGINT) AS level FROM node_props WHERE level <> 0", "node_props")
def _(spark, sf):
    return M.clear_exclusions(store(spark, sf).node).select("node_id", "level")


@query("next_id", "SELECT greatest((SELECT max(node_id) FROM children), (SELECT max(node_id) FROM edit_log)) + 1 AS next_id", "children edit_log")
def _(spark, sf):
    return M.next_id(store(spark, sf).children, derived(spark, sf, "edit_log")["edit_log"])


@query(
    "bookmarks_view",
    """SELECT row_number() OVER (ORDER BY b.sequence) AS rank, b.node_id, r.name FROM bookmark AS b JOIN resolved AS r ON r.node_id = b.node_id""",
    "bookmark resolved",
)
def _(spark, sf):
    return A.bookmarks_view(store(spark, sf))


@query(
    "bookmarks_edit",
    """WITH gone AS (SELECT node_id FROM edit_log WHERE kind = 'remove'),
            added AS (SELECT DISTINCT node_id FROM edit_log WHERE kind = 'new' AND node_id NOT IN (SELECT node_id FROM bookmark))
       SELECT node_id, sequence FROM (
         SELECT node_id, sequence FROM bookmark
         UNION ALL SELECT node_id, (SELECT max(sequence) FROM bookmark) + row_number() OVER (ORDER BY node_id) FROM added)
       WHERE node_id NOT IN (SELECT node_id FROM gone)""".replace("WITH gone", ", gone", 1),
    "bookmark edit_log",
)
def _(spark, sf):
    log = derived(spark, sf, "edit_log")["edit_log"]
    grown = A.bookmarks_add(store(spark, sf).bookmark, log.where("kind = 'new'"))
    return A.bookmarks_remove(grown, log.where("kind = 'remove'").select("node_id").distinct())
