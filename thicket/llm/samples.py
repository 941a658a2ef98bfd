"""Bounded samples of labelled documents, and the split that keeps some labels back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sample holds no more rows than this, each no longer than this many code points.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """Labelled documents to learn from: doc_id, ``columns`` and ``label``.

    Takes rows with a label whose remainder isn't 0, at most ``rows`` of them, the first by a
    hash of their id, leaving out longer ones than ``chars``; so its size has a fixed bound.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (remainder("doc_id") != 0))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    texts = docs.select("doc_id", *columns).where(F.length("text") <= chars)
    return texts.join(F.broadcast(known), "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS):
    """``labelled_rows`` in order of doc_id, as pandas."""
    return labelled_rows(docs, labels, label, columns, rows, chars).orderBy("doc_id").toPandas()
