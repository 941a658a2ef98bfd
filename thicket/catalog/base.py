"""The derived document store, in Spark and as SQL text, and the query registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import root_paths
from ..operators.object_index import ObjectIndex, build_index
from ..plans.joins import sized
from ..session import materialize, shared_dir
from ..sources.store import Store, load_store, text_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a query; ``ctes`` names the derived tables its SQL uses."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(ctes.split(), sql)
        return fn

    return wrap


# Each text runs on both engines; [[...]] marks the few words that differ.
_DIALECT = {
    "spark": {"bytes": "BINARY", "days": "datediff(CAST({c} AS DATE), DATE '1970-01-01')", "offset": "offset", "each4": "explode(array(0, 1, 2, 3))", "count": "{n_{c}}"},
    "duckdb": {"bytes": "BLOB", "days": "datediff('day', DATE '1970-01-01', CAST({c} AS DATE))", "offset": '"offset"', "each4": "unnest([0, 1, 2, 3])", "count": "(SELECT count(*) FROM {c})"},
}

_DERIVED = {
    "children": """
        SELECT node_id, father_id,
               row_number() OVER (PARTITION BY father_id ORDER BY node_id) AS sequence, master_id
        FROM (
          SELECT CAST(1 + r_regionkey AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS father_id, CAST(0 AS BIGINT) AS master_id FROM {region}
          UNION ALL SELECT CAST(101 + n_nationkey AS BIGINT), CAST(1 + n_regionkey AS BIGINT), CAST(0 AS BIGINT) FROM {nation}
          UNION ALL SELECT CAST(1001 + c_custkey AS BIGINT), CAST(101 + c_nationkey AS BIGINT),
                    CAST(CASE WHEN c_custkey % 10 = 3 THEN 1001 + c_custkey - 3 ELSE 0 END AS BIGINT) FROM {customer}
          UNION ALL SELECT CAST(1000000000001 + o_orderkey AS BIGINT), CAST(1001 + o_custkey AS BIGINT), CAST(0 AS BIGINT) FROM {orders}
        ) AS ids""",
    "node_props": """
        SELECT CAST(node_id AS BIGINT) AS node_id, name,
               CASE WHEN node_id % 3 = 0 THEN 'custom-colors' WHEN node_id % 3 = 1 THEN 'plain-text' ELSE 'sql' END AS syntax,
               tags,
               CAST((node_id % 7) * 2 + (CASE WHEN node_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS is_ro,
               CAST((CASE WHEN node_id % 5 = 0 THEN (node_id % 16777216) * 8 + 4 ELSE 0 END)
                    + (CASE WHEN node_id % 4 = 0 THEN 2 ELSE 0 END) + (CASE WHEN node_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS is_richtxt,
               CAST((CASE WHEN node_id % 17 = 0 THEN 2 ELSE 0 END) + (CASE WHEN node_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS level,
               CAST(ts AS BIGINT) AS ts_creation, CAST(ts + node_id % 1000000 AS BIGINT) AS ts_lastsave
        FROM (
          SELECT 1 + r_regionkey AS node_id, r_name AS name, '' AS tags, 800000000 AS ts FROM {region}
          UNION ALL SELECT 101 + n_nationkey, n_name, '', 800000000 FROM {nation}
          UNION ALL SELECT 1001 + c_custkey, c_name, lower(c_mktsegment), 800000000 FROM {customer} WHERE c_custkey % 10 <> 3
          UNION ALL SELECT 1000000000001 + o_orderkey, 'Order ' || CAST(o_orderkey AS VARCHAR(20)),
                           o_orderstatus || ' ' || o_orderpriority, [[days:o_orderdate]] * 86400 FROM {orders}
        ) AS rows_""",
    "node": """
        SELECT p.*, d.text AS txt FROM {node_props} AS p
        JOIN {documents} AS d ON d.doc_id = p.node_id % ([[count:documents]])""",
    "codebox": """
        SELECT p.node_id, p.node_id % 50 AS [[offset]], '' AS justification, b.text AS txt, 'sql' AS syntax
        FROM {node_props} AS p
        JOIN {benchmark} AS b ON b.item_id = p.node_id % ([[count:benchmark]])
        WHERE p.node_id BETWEEN 1001 AND 1000000000000 AND p.syntax = 'custom-colors'""",
    "grid_cells": """
        SELECT k.node_id, 60 + k.node_id % 50 AS [[offset]], k.node_id % 2 = 0 AS is_light, k.k,
               CASE WHEN k.k = 0 THEN 'key' ELSE CAST(t.p_partkey AS VARCHAR(20)) END AS c0,
               CASE WHEN k.k = 0 THEN 'name' ELSE t.p_name END AS c1,
               CASE WHEN k.k = 0 THEN 'brand' ELSE t.p_brand END AS c2,
               CASE WHEN k.k = 0 THEN 'size' ELSE CAST(t.p_size AS VARCHAR(20)) END AS c3
        FROM (SELECT node_id, [[each4]] AS k FROM {node_props}
              WHERE node_id BETWEEN 1001 AND 1000000000000 AND syntax = 'custom-colors') AS k
        JOIN {part} AS t ON t.p_partkey = (k.node_id * 3 + k.k * 7) % ([[count:part]])""",
    "image": """
        SELECT p.node_id, 5 + p.node_id % 40 AS [[offset]], '' AS justification,
               CASE WHEN p.node_id % 8 = 0 THEN 'h1-1' WHEN p.node_id % 8 = 1 THEN 'h2-1' WHEN p.node_id % 8 = 2 THEN 'note' ELSE '' END AS anchor,
               CASE WHEN p.node_id % 8 <= 2 THEN NULL ELSE CAST('png' || CAST(p.node_id % 97 AS VARCHAR(20)) AS [[bytes]]) END AS png,
               CASE WHEN p.node_id % 8 = 3 THEN '__ct_special.tex' WHEN p.node_id % 8 = 4 THEN 'file_' || CAST(p.node_id % 31 AS VARCHAR(20)) || '.txt' ELSE '' END AS filename,
               CASE WHEN p.node_id % 8 = 5 THEN 'webs ' || g.url
                    WHEN p.node_id % 8 = 6 THEN 'node ' || CAST(1001 + (p.node_id * 7) % ([[count:customer]] * 2) AS VARCHAR(20)) || ' h1-1'
                    WHEN p.node_id % 8 = 7 THEN 'file ' || base64(CAST('/data/' || p.tags AS [[bytes]]))
                    ELSE '' END AS link,
               p.ts_lastsave AS time
        FROM {node_props} AS p
        JOIN {pages} AS g ON g.page_id = p.node_id % ([[count:pages]])
        WHERE p.node_id >= 1001 AND p.syntax = 'custom-colors'""",
    "bookmark": """
        SELECT CAST(1001 + c_custkey AS BIGINT) AS node_id, row_number() OVER (ORDER BY c_custkey) AS sequence
        FROM {customer} WHERE c_acctbal < 0""",
    "edit_log": """
        SELECT event_id, ts, CAST(1001 + user_id AS BIGINT) AS node_id,
               CASE event_type WHEN 'signup' THEN 'new' WHEN 'click' THEN 'prop' WHEN 'view' THEN 'visit'
                               WHEN 'purchase' THEN 'buff' ELSE 'remove' END AS kind,
               CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR(20)) AS snapshot
        FROM {events}""",
}

# SQL-only derived tables, for the oracles.
_SQL_ONLY = {
    "grid": """
        SELECT node_id, "offset", is_light,
               list([c0, c1, c2, c3] ORDER BY k) AS cells FROM grid_cells GROUP BY node_id, "offset", is_light""",
    "paths": """
        SELECT node_id, father_id, sequence, master_id, 0 AS depth, [node_id] AS path,
               [struct_pack(s := sequence, n := node_id)] AS sort_path FROM children WHERE father_id = 0
        UNION ALL
        SELECT c.node_id, c.father_id, c.sequence, c.master_id, p.depth + 1, list_append(p.path, c.node_id),
               list_append(p.sort_path, struct_pack(s := c.sequence, n := c.node_id))
        FROM children AS c JOIN paths AS p ON c.father_id = p.node_id""",
    "preorder": "SELECT *, row_number() OVER (ORDER BY sort_path) AS pos FROM paths",
    "closure": "SELECT unnest(path) AS ancestor_id, node_id AS descendant_id, depth, path FROM paths",
    "resolved": """
        SELECT c.node_id, c.father_id, c.sequence, c.master_id, n.name, n.syntax, n.tags, n.is_ro, n.is_richtxt, n.level,
               n.ts_creation, n.ts_lastsave, n.node_id AS holder_id
        FROM children AS c JOIN node_props AS n
          ON n.node_id = CASE WHEN c.master_id > 0 THEN c.master_id ELSE c.node_id END""",
}
_NEEDS = {
    "node": ["node_props"], "codebox": ["node_props"], "grid_cells": ["node_props"], "grid": ["grid_cells"],
    "image": ["node_props"], "paths": ["children"], "preorder": ["paths"], "closure": ["paths"],
    "resolved": ["children", "node_props"],
}


def _text(name: str, dialect: str) -> str:
    out = _DERIVED[name]
    words = _DIALECT[dialect]
    while "[[" in out:
        head, rest = out.split("[[", 1)
        token, tail = rest.split("]]", 1)
        key, _, arg = token.partition(":")
        out = head + words[key].replace("{c}", arg) + tail
    return out


def with_ctes(names: list[str], body: str) -> str:
    """``body`` preceded by the derived tables it needs, as one SQL statement."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return body
    idents = {t: t for t in [*BASE_TABLES, *_DERIVED]}
    parts = []
    for name in order:
        text = _SQL_ONLY[name] if name in _SQL_ONLY else _text(name, "duckdb").format(**idents)
        parts.append(f"{name} AS ({text})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def id_sum():
    """The sum of ``node_id``, exact; null where it is no long, which the SQL can't cast either."""
    return F.sum(F.col("node_id").cast("decimal(38,0)")).try_cast("long")


class Tables(dict):
    """The given tables; each is opened when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __missing__(self, name: str) -> DataFrame:
        if name not in BASE_TABLES:
            raise KeyError(name)
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def derived(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Derived tables as DataFrames, straight from the given tables."""
    made = tables(spark, sf_dir)

    def get(name: str) -> DataFrame:
        if name not in made and name not in BASE_TABLES:
            for need in _NEEDS.get(name, []):
                get(need)
            sql = _text(name, "spark").replace("VARCHAR(20)", "STRING")
            for base in BASE_TABLES:
                if "{n_" + base + "}" in sql:  # a count, answered from file footers
                    sql = sql.replace("{n_" + base + "}", str(made[base].count()))
            used = {k: made[k] for k in [*BASE_TABLES, *_DERIVED] if "{" + k + "}" in sql}
            made[name] = spark.sql(sql, **used)
        return made[name]

    return {name: get(name) for name in names}


_STORES: dict[tuple[str, str], Store] = {}
_PATHS: dict[tuple[str, str], DataFrame] = {}
_INDEXES: dict[tuple[str, str], ObjectIndex] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The derived store, written once per session to the shared folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = _key(spark, sf_dir)
    if key not in _STORES:
        path = f"{shared_dir(spark)}/thicket-store-{uuid.uuid4().hex}"
        d = derived(spark, sf_dir, "children", "node_props", "codebox", "grid_cells", "image", "bookmark")
        d["children"].write.parquet(f"{path}/children")
        # Many nodes show one document: each text is written once, and nodes name it.
        docs = tables(spark, sf_dir)["documents"].withColumn("text_id", text_id("text"))
        docs.where("text IS NOT NULL").select("text_id", F.col("text").alias("txt")).write.parquet(f"{path}/text")
        named = sized(docs.select("doc_id", "text_id"), "doc-ids")
        node = d["node_props"].join(named, F.col("doc_id") == F.col("node_id") % F.lit(docs.count()))
        node.drop("doc_id").write.parquet(f"{path}/node")
        d["codebox"].write.parquet(f"{path}/codebox")
        # At most four rows per grid, so the list is small by construction.
        cells = d["grid_cells"].groupBy("node_id", "offset", "is_light").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("k", F.array("c0", "c1", "c2", "c3").alias("row")))),
                lambda s: s["row"],
            ).alias("cells")
        )
        cells.write.parquet(f"{path}/grid")
        d["image"].write.parquet(f"{path}/image")
        d["bookmark"].write.parquet(f"{path}/bookmark")
        _STORES[key] = load_store(spark, path)
    return _STORES[key]


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root paths of the derived store: the tree index, built once per store version."""
    key = _key(spark, sf_dir)
    if key not in _PATHS:
        _PATHS[key] = materialize(root_paths(store(spark, sf_dir).children), "paths")
    return _PATHS[key]


def object_index(spark: SparkSession, sf_dir: str) -> ObjectIndex:
    """Places of the derived store's objects, built once per store version."""
    key = _key(spark, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(store(spark, sf_dir))
    return _INDEXES[key]
