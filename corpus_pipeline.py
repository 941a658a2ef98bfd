"""A corpus made ready for training: each stage takes documents and returns those it keeps."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import jaccard, packing, quality_rules, substring
from thicket.llm import toxicity as tox
from thicket.session import Scratch, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before = Scratch()


def stage(f: Stage) -> Stage:
    """A stage that drops what the stage before it wrote on its way, as that one's result has been written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _before
        _before.drop()
        _before = Scratch()
        with _before:
            return f(spark, docs, sf_dir)

    return run_stage


def placed_rows(docs: DataFrame) -> DataFrame:
    """The rows with the file that each comes from and its place there; rows of no file are written first."""
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place")]
    try:
        return docs.select("*", *place)
    except AnalysisException:  # not read from files
        return materialize(docs, "rows").select("*", *place)


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return tox.toxicity(docs, labels).where("score < 0.5").select("row.*")


@stage
def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the limits of their language and source."""
    return quality_rules.quality_rules(docs).where("kept").select("row.*")


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: of those with an id the one with the smallest.

    Rows are told apart by where they stand in their files, so equal rows, and rows that share
    an id or have none, are judged one by one. Null, empty and blank texts stay.
    """
    rows = placed_rows(docs)
    stays = jaccard.near_duplicates(rows, keep=["__file", "__place"]).where("stays").select("row.*")
    return rows.join(stays, ["__file", "__place"], "left_semi").select(*docs.columns)


@stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document also holds are cut out."""
    return substring.without_repeats(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words in sequences of the permitted lengths, a row per piece with its place in its bin."""
    return packing.sequences(docs, packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", apply_quality_rules),
    ("n-gram jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: No SQL: the first stage trains a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES:
        docs = materialize(apply(spark, docs, sf_dir), "stage")
    return docs
