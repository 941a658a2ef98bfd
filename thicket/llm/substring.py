"""Removal of word windows that an earlier document also holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import chunks as C
from thicket.llm.words import U, Words, join_words, steps

WINDOW = 13


def _windows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """(first row, words, window hashes, first word of each) of each part of a chunk."""
    for row, _, data, offsets in steps(batch["text"]):
        words = Words(data, offsets)
        yield row, words, *words.windows(width)


def _first_holders(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's distinct window hashes, ascending, and for each the smallest id that holds it."""
    ids = np.asarray(batch["id"])
    hashes, holders = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)]
    for row, words, h, at in _windows(batch, width):
        hashes.append(h)
        holders.append(ids[words.doc[at] + row])
    h, first = np.unique(np.concatenate(hashes), return_index=True)  # the first: rows are sorted by id
    return h, np.concatenate(holders)[first]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Cuts words covered by a window that also starts in a document with a smaller id.

    Words are runs outside ``[\\x20\\x09-\\x0D]``, taken as they are. All windows of
    ``window`` words are hashed (Rabin-Karp); for each hash Spark counts down to the smallest
    id that holds it, and in each document overlapping repeated windows merge into maximal
    intervals. Windows are judged on the input.

    Returns per row: the id, ``n_words``, ``n_removed``, ``spans`` (removed intervals as
    [first word, end word) pairs, ascending, disjoint) and ``kept`` (the words left, joined
    by one space). Null and empty texts have no words; texts shorter than the window lose
    nothing; rows that share an id are one document and don't erase each other; a null id
    comes after all others, as one document. The columns ``keep`` are carried in a struct
    ``row``, and with them the whole ``text``; others are not carried.
    """

    def count(texts: pa.Array) -> int:
        return sum(len(Words(data, offsets).starts) for _, _, data, offsets in steps(texts))

    def ask(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        h, holder = _first_holders(batch, window)
        order = np.argsort(holder, kind="stable")  # equal ids side by side pack well
        return {"hash": h[order], "id": holder[order]}

    def earliest(sent: dict[str, np.ndarray], _chunk: np.ndarray) -> np.ndarray:
        """0: no smaller id than the chunk's own first holder; 1: there is one."""
        order = np.argsort(sent["hash"], kind="stable")
        h, ids = sent["hash"][order], sent["id"][order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        least = np.repeat(np.minimum.reduceat(ids, new), np.diff(np.append(new, len(h))))
        out = np.empty(len(h), dtype=np.uint8)
        out[order] = least < ids
        return out

    def cut(batch: pa.RecordBatch, _key: int, lookup) -> Iterator[pa.RecordBatch]:
        known, holder = _first_holders(batch, window)
        order = np.argsort(holder, kind="stable")
        earlier = np.empty(len(known), dtype=bool)
        earlier[order] = lookup(known[order]).astype(bool)
        ids = np.asarray(batch["id"])
        for row, words, h, at in _windows(batch, window):
            place = np.searchsorted(known, h)
            repeated = earlier[place] | (holder[place] < ids[words.doc[at] + row])
            cover = np.zeros(len(words.starts) + 1, dtype=np.int32)
            np.add.at(cover, at[repeated], 1)
            np.add.at(cover, at[repeated] + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            out = _rows(ids[row : row + len(words.offsets) - 1], words, gone)
            for name in ("row", "text") if keep else ():
                out = out.append_column(name, batch[name].slice(row, len(out)))
            yield out

    chunks = C.chunk_documents(docs, id_col, text_col, count, keep)
    n = C.buckets_for(chunks)
    schema = "id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    if keep:
        schema += f", row {docs.select(F.struct(*[docs[c] for c in keep]).alias('r')).schema['r'].dataType.simpleString()}, text string"
    out = C.answered(chunks, [C.answer(C.ask(chunks, n, ask), earliest)], n, cut, schema)
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """The documents with ``repeated_spans`` cut out and their lengths set anew.

    A text that loses words is its other words with one space between; others stay as they
    are. A text may become empty; its row stays. All columns are returned.
    """
    others = [c for c in docs.columns if c != text_col]
    out = repeated_spans(docs, id_col, text_col, window, others)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("text"))
    made = {text_col: text, chars_col: F.when(cut, F.length("kept").cast("long")).otherwise(F.col("row")[chars_col])}
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def _rows(ids: np.ndarray, words: Words, gone: np.ndarray) -> pa.RecordBatch:
    """Result rows of a part of a chunk, given which words go."""
    n_docs = len(ids)
    n_words = np.diff(words.bounds)
    total = np.concatenate([[0], np.cumsum(gone)])
    n_removed = total[words.bounds[1:]] - total[words.bounds[:-1]]
    # maximal runs of removed words within a document
    new = np.zeros(len(gone) + 1, dtype=bool)
    new[words.bounds] = True
    first = np.flatnonzero(gone & (new[:-1] | ~np.concatenate([[False], gone[:-1]])))
    last = np.flatnonzero(gone & (new[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    of = words.doc[first]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(of, np.arange(n_docs + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(first - words.bounds[of], pa.int64()), pa.array(last - words.bounds[of], pa.int64())], ["start", "end"]),
    )
    text, by_doc = join_words(words, ~gone)
    kept = pa.LargeStringArray.from_buffers(n_docs, pa.py_buffer(by_doc), pa.py_buffer(text)).cast(pa.string())
    id_array = pa.array(ids, pa.int64(), mask=ids == C.NO_ID)
    return pa.RecordBatch.from_arrays([id_array, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), spans, kept], names=["id", "n_words", "n_removed", "spans", "kept"])
