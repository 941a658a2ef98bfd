"""Plain files: CSV grids, text in any encoding, directory trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grids import csv_to_cells, pad_cells
from ..plans.joins import dealt
from ..plans.scan import numbered


def csv_to_grid(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """CSV texts as grids: cells padded or cut to the width of their first row."""
    texts = dealt(df.select(*keep, F.col(text).alias("__csv")))
    # exploded, so that the filter can't move before the tasks that the rows are dealt to and read each text again
    return texts.select(*keep, F.explode(F.array(pad_cells(csv_to_cells(F.col("__csv"))))).alias("cells")).where("size(cells) > 0")


def read_csv_grids(spark: SparkSession, pattern: str) -> DataFrame:
    """One grid per CSV file."""
    files = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return csv_to_grid(files, "text", ["path"])


def decode_text(content: Column, fallback: str = "ISO-8859-1") -> Column:
    """Bytes to text by byte order mark, else UTF-8 when valid, else ``fallback``.

    The mark itself is dropped. UTF-32 is tested before UTF-16, whose mark it
    begins with.
    """
    head = F.hex(F.substring(content, 1, 4))
    after = lambda n: F.substring(content, F.lit(n + 1), F.octet_length(content))
    utf8 = lambda c: F.is_valid_utf8(c.cast("string"))
    return (
        F.when(head.startswith("EFBBBF"), F.make_valid_utf8(after(3).cast("string")))
        .when(head.isin("0000FEFF", "FFFE0000"), F.decode(content, "UTF-32"))  # the mark gives the byte order
        .when(head.startswith("FEFF"), F.decode(after(2), "UTF-16BE"))
        .when(head.startswith("FFFE"), F.decode(after(2), "UTF-16LE"))
        .when(utf8(content), content.cast("string"))
        .otherwise(F.decode(content, fallback))
    )


def text_nodes(files: DataFrame) -> DataFrame:
    """(path, content) files as nodes named by file stem."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return files.select("path", stem.alias("name"), decode_text(F.col("content")).alias("txt"), F.lit("plain-text").alias("syntax"))


def ingest_text(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """All text files below ``folder`` as nodes."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    )
    return text_nodes(files.select("path", "content"))


def dir_to_tree(files: DataFrame, strip_extension: bool = True) -> DataFrame:
    """A listing of file paths as a forest: node_id, father_id, name, path, has_content.

    Only folders above a file appear, so empty ones drop out. A leaf file and a
    folder of the same name beside it become one node, as do a folder and a leaf
    file of its own name inside it. ``files``: path (``a/b/c.txt``).
    """
    stem = F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", "") if strip_extension else F.col("path")
    leaf = files.select(F.col("path").alias("file"), stem.alias("key")).dropDuplicates(["file"])
    split = lambda c: F.split(c, "/")
    # Every proper prefix of a path is a folder.
    folders = (
        leaf.select(F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(split(F.col("key"))) - 1, F.lit(1))),
            lambda n: F.when(n < F.size(split(F.col("key"))), F.array_join(F.slice(split(F.col("key")), F.lit(1), n), "/")),
        )).alias("dir")).where("dir IS NOT NULL").distinct()
    )
    parent = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit(""))
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    # Case 1: a file beside a folder of its name takes the folder's place. The
    # first of several files of one stem does; the others stay leaves.
    first = leaf.groupBy("key").agg(F.min("file").alias("file"))
    merged = folders.join(first, F.col("dir") == F.col("key"), "left").select("dir", F.col("file").alias("taken"))
    # Case 2: a folder still without content takes in a leaf file of its own name.
    own = first.where(name(F.col("key")) == name(parent(F.col("key")))).select(parent(F.col("key")).alias("odir"), F.col("file").alias("own_file"))
    own = own.join(folders.select(F.col("dir").alias("fd")), F.col("own_file").isNotNull() & (F.concat_ws("/", "odir", name(F.col("odir"))) == F.col("fd")), "left_anti")
    merged = merged.join(own, F.col("dir") == F.col("odir"), "left").withColumn("content", F.coalesce("taken", "own_file"))
    used = merged.where("content IS NOT NULL").select(F.col("content").alias("file"))
    rest = leaf.join(used, "file", "left_anti")
    nodes = merged.select(
        F.col("dir").alias("place"), parent(F.col("dir")).alias("father_place"), name(F.col("dir")).alias("name"),
        F.col("content").alias("file"), F.lit("dir").alias("kind"),
    ).unionByName(rest.select(
        F.col("file").alias("place"), parent(F.col("key")).alias("father_place"), name(F.col("key")).alias("name"), "file",
        F.lit("file").alias("kind"),
    ))
    ids = numbered(nodes, [], [F.col("father_place"), F.col("name"), F.col("kind"), F.col("place")], "node_id")
    up = ids.where("kind = 'dir'").select(F.col("place").alias("fp"), F.col("node_id").alias("father_node"))
    return ids.join(up, F.col("father_place") == F.col("fp"), "left").select(
        "node_id", F.coalesce("father_node", F.lit(0)).cast("long").alias("father_id"), "name", "file",
        F.col("file").isNotNull().alias("has_content"), "father_place",
    )
