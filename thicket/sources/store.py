"""Reading a document store: six tables, one scan each, columns pruned by use."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import _col
from ..model import DDL, LATEX_FILENAME, PLAIN_SYNTAX, RICH_SYNTAX, TABLES
from ..plans.joins import BROADCAST_ROWS, sized
from ..session import materialize


@dataclass(frozen=True)
class Store:
    """The six tables of a document store as DataFrames.

    ``parts`` may hold the node table with its texts apart: rows with a ``text_id``, and texts
    (text_id, txt). Operators join and copy rows, and texts meet them last, so none is moved by node.
    """

    node: DataFrame
    children: DataFrame
    codebox: DataFrame
    grid: DataFrame
    image: DataFrame
    bookmark: DataFrame
    parts: tuple[DataFrame, DataFrame] | None = None

    def with_tables(self, **tables: DataFrame) -> "Store":
        return replace(self, **({"parts": None} if "node" in tables else {}), **tables)

    def with_parts(self, rows: DataFrame, texts: DataFrame) -> "Store":
        return replace(self, node=join_texts(rows, texts), parts=(rows, texts))

    def nodes(self, ids: DataFrame) -> DataFrame:
        """The node table of the ``ids`` (node_id) alone; texts kept apart meet only their rows."""
        if self.parts is None:
            return self.node.join(ids, "node_id", "left_semi")
        return join_texts(self.parts[0].join(ids, "node_id", "left_semi"), self.parts[1])

    def split_of(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of the ``ids`` (node_id), and texts; ids that are no broadcast meet the rows without texts."""
        if self.parts is None and ids.count() <= BROADCAST_ROWS:
            return split_texts(self.node.join(F.broadcast(ids), "node_id", "left_semi"))
        rows, texts = self.split()
        return rows.join(ids, "node_id", "left_semi"), texts

    def split(self) -> tuple[DataFrame, DataFrame]:
        """The node table as rows and texts; written, if the store doesn't hold it so."""
        return self.parts or split_texts(self.node)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def schema_of(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


#: Node rows without their texts. ``stored``: the text is decoded, if it is the XML of a rich text.
ROW_DDL = ", ".join(c for c in DDL["node"].split(", ") if not c.startswith("txt ")) + ", text_id binary, stored boolean"
TEXT_DDL = "text_id binary, txt string"


def text_id(txt: Column | str) -> Column:
    """The name of a text: half of the SHA-256 of its contents, null for no text."""
    return F.unhex(F.substring(F.sha2(_col(txt), 256), 1, 32))


def split_texts(node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows with a ``text_id``, and each text once; both written.

    Texts are compared where they lie before any moves, so copies in one task move once.
    """
    named = node.withColumn("text_id", text_id("txt"))
    texts = materialize(named.where("txt IS NOT NULL").select("text_id", "txt").distinct(), "texts")
    rows = materialize(align_schema(named.drop("txt").withColumn("stored", F.lit(False)), ROW_DDL), "rows")
    return rows, texts


def rewritten(rows: DataFrame, texts: DataFrame, rule: Column, new: Column, which: Column) -> tuple[DataFrame, DataFrame]:
    """Rows and texts after the texts that ``rule`` picks became ``new`` (both of ``txt``) in the rows that ``which`` picks.

    A text is rewritten once, however many rows name it; rows get its new name and carry no text.
    """
    wanted = sized(rows.where(which).select("text_id").distinct(), "text-ids")
    picked = texts.join(wanted, "text_id", "left_semi").where(rule).select(F.col("text_id").alias("__old"), new.alias("txt"))
    made = materialize(picked.withColumn("text_id", text_id("txt")), "texts")
    names = sized(made.select("__old", F.col("text_id").alias("__new")).distinct(), "text-names")
    if names.isEmpty():
        return rows, texts
    named = rows.join(names, (F.col("text_id") == F.col("__old")) & which, "left")
    return named.withColumn("text_id", F.coalesce("__new", "text_id")).drop("__old", "__new"), texts.unionByName(made.select("text_id", "txt"))


def plain_parts(store: Store) -> tuple[DataFrame, DataFrame]:
    """The node table as rows and texts of which none is left to decode."""
    from .stored import is_stored_xml, plain_of_rich

    if store.parts is None:
        return split_texts(store.node)
    rows, texts = rewritten(*store.parts, is_stored_xml(F.col("txt")), plain_of_rich(F.col("txt")), F.col("stored"))
    return rows.withColumn("stored", F.lit(False)), texts


def named_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts that rows name, each once."""
    named = texts.join(sized(rows.select("text_id").distinct(), "text-ids"), "text_id", "left_semi")
    return named.groupBy("text_id").agg(F.first("txt").alias("txt"))


def join_texts(rows: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """The node table of rows and texts, with ``more`` columns of the rows; columns of the table that the rows lack are left out.

    A text has one row on the right, so queries that read no text don't join, and filters
    by node apply to the rows before.
    """
    from .stored import is_stored_xml, plain_of_rich

    one = texts.groupBy("text_id").agg(F.first("txt").alias("txt"))
    txt = F.when(F.col("stored") & is_stored_xml(F.col("txt")), plain_of_rich(F.col("txt"))).otherwise(F.col("txt")).alias("txt")
    columns = [c for c in schema_of("node").names if c == "txt" or c in rows.columns]
    return rows.join(one, "text_id", "left").select(*[txt if c == "txt" else F.col(c) for c in columns], *more)


def align_schema(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Add columns an older store lacks as NULL and cast the rest, in schema order."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def null_to_empty(df: DataFrame, *columns: str) -> DataFrame:
    """NULL text reads as the empty string (all string columns by default)."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in names})


def load_store(spark: SparkSession, path: str, fmt: str = "parquet", decode: bool = True) -> Store:
    """Read the six tables under ``path``; columns missing in old stores become NULL.

    Rich texts and grids kept as XML become plain texts and cells, unless ``decode`` is off.
    Nodes that have a ``text_id`` instead of a text find it in a further table, ``text``.
    Nothing but the columns a query uses is read, so queries on the tree alone
    never touch the text. Order is data (``sequence``), not row order.
    """
    tables = {}
    for name in TABLES:
        df = spark.read.format(fmt).load(f"{path}/{name}")
        if name == "node" and "txt" not in df.columns:
            rows = align_schema(df.withColumn("stored", F.lit(decode) & (F.col("syntax") == RICH_SYNTAX)), ROW_DDL)
            tables["parts"] = (rows, align_schema(spark.read.format(fmt).load(f"{path}/text"), TEXT_DDL))
            tables[name] = join_texts(*tables["parts"])
        else:
            tables[name] = align_schema(df, schema_of(name))
    return _decoded(Store(**tables)) if decode else Store(**tables)


def _decoded(store: Store) -> Store:
    from .stored import decode_store

    return decode_store(store)


def load_store_jdbc(spark: SparkSession, url: str, decode: bool = True, **options: str) -> Store:
    """Read the six tables through JDBC; the driver jar is the caller's.

    ``partitionColumn`` and its bounds may be given to read in parallel; all
    tables have ``node_id``.
    """
    tables = {}
    for name in TABLES:
        df = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
        tables[name] = align_schema(df, schema_of(name))
    return _decoded(Store(**tables)) if decode else Store(**tables)


def _bits(c: Column, shift: int, mask: int) -> Column:
    return F.shiftright(c, shift).bitwiseAND(F.lit(mask).cast("long"))


def decode_nodes(node: DataFrame) -> DataFrame:
    """Unpack the bit fields of ``is_ro``, ``is_richtxt`` and ``level``."""
    ro, rich, level = (F.coalesce(F.col(c), F.lit(0)) for c in ("is_ro", "is_richtxt", "level"))
    colour = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(_bits(rich, 3, 0xFFFFFF)), 6, "0")))
    return node.withColumns(
        {
            "read_only": _bits(ro, 0, 1) == 1,
            "custom_icon_id": F.shiftright(ro, 1),
            "is_rich": _bits(rich, 0, 1) == 1,
            "is_bold": _bits(rich, 1, 1) == 1,
            "foreground": F.when(_bits(rich, 2, 1) == 1, colour).otherwise(F.lit("")),
            "exclude_me": _bits(level, 0, 1) == 1,
            "exclude_children": _bits(level, 1, 1) == 1,
            "kind": node_kind("syntax"),
        }
    )


def encode_node_bits(node: DataFrame) -> DataFrame:
    """Inverse of :func:`decode_nodes`: the packed columns from the plain ones."""
    rgb = F.when(F.col("foreground") == "", F.lit(0)).otherwise(
        F.conv(F.substring("foreground", 2, 6), 16, 10).cast("long")
    )
    bit = lambda c: F.col(c).cast("long")
    return node.withColumns(
        {
            "is_ro": F.shiftleft(F.col("custom_icon_id"), 1).bitwiseOR(bit("read_only")),
            "is_richtxt": F.shiftleft(rgb, 3)
            .bitwiseOR(F.shiftleft((F.col("foreground") != "").cast("long"), 2))
            .bitwiseOR(F.shiftleft(bit("is_bold"), 1))
            .bitwiseOR(bit("is_rich")),
            "level": F.shiftleft(bit("exclude_children"), 1).bitwiseOR(bit("exclude_me")),
        }
    ).drop("read_only", "custom_icon_id", "is_rich", "is_bold", "foreground", "exclude_me",
           "exclude_children", "kind")


def node_kind(syntax: Column | str) -> Column:
    c = _col(syntax)
    return (
        F.when(c == RICH_SYNTAX, F.lit("rich")).when(c == PLAIN_SYNTAX, F.lit("plain")).otherwise(F.lit("code"))
    )


def image_kind() -> Column:
    """``anchor``, ``latex``, ``file`` or ``png``: what an image row holds."""
    anchor, filename = (F.coalesce(F.col(c), F.lit("")) for c in ("anchor", "filename"))
    return (
        F.when(anchor != "", F.lit("anchor"))
        .when(filename == LATEX_FILENAME, F.lit("latex"))
        .when(filename != "", F.lit("file"))
        .otherwise(F.lit("png"))
    )


def justification() -> Column:
    c = F.coalesce(F.col("justification"), F.lit(""))
    return F.when(c == "", F.lit("left")).otherwise(c)


def anchor_collapsed() -> Column:
    """Header anchors keep their fold state in the link column."""
    from ..functions.text import header_anchor_level

    return (header_anchor_level(F.coalesce(F.col("anchor"), F.lit(""))) > 0) & (
        F.coalesce(F.col("link"), F.lit("")) == "state:coll"
    )
