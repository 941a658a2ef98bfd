"""Corpus statistics of hashes asked for and answered in blocks.

Documents are packed into chunks of a few MB. Each chunk sends its distinct hashes, as one
binary per bucket of the hash space; a bucket sums up what all chunks have sent and answers
each chunk in the order it asked. A hash costs its own eight bytes in the shuffle instead of
a row, and a hash that stands in a third of all documents costs one entry per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.session import materialize

#: Text bytes in a chunk, and sent hashes in a bucket; both bound a task's memory.
CHUNK_BYTES = 4 << 20
BUCKET_HASHES = 1_000_000
#: Rows in a chunk at most, so that chunk and place give a row a key of its own.
CHUNK_ROWS = 1 << 20
#: Chunks that one partition may number, and partitions: 64 GB and 16 PB of documents. Numbers stay below CHUNK_NUMBERS.
CHUNKS_PER_PART, PARTS = 1 << 14, 1 << 27
CHUNK_NUMBERS = CHUNKS_PER_PART * PARTS
REPLY_SCHEMA = "chunk long, bucket long, reply binary"
CHUNK_SCHEMA = "chunk long, n_bytes long, n_hashes long, docs binary"
NO_ID = np.iinfo(np.int64).max


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand rows to Python in batches of 8 MB, as two tasks share an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def chunk_number(part: int, number: int) -> int:
    """A number for a partition's chunk; twice as many, and a row number of CHUNK_ROWS beside each, fit 64 bits."""
    if number >= CHUNKS_PER_PART or part >= PARTS:
        raise ValueError("too many chunks in a partition, or partitions: repartition the documents")
    return part * CHUNKS_PER_PART + number


def pack(table: pa.RecordBatch) -> bytes:
    """A record batch as compressed Arrow bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(table)
    return out.getvalue().to_pybytes()


def unpack(data) -> pa.RecordBatch:
    """The inverse of ``pack``."""
    with pa.ipc.open_stream(pa.py_buffer(data)) as reader:
        return reader.read_next_batch()


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, count: Callable[[pa.Array], int], keep: list[str] | None = None) -> DataFrame:
    """Documents in chunks of about CHUNK_BYTES, written to the shared folder.

    A chunk is a compressed batch (id, text), sorted by id; a longer text is a chunk of its
    own. A null id sorts last, as the largest; a null text is empty. The columns ``keep``, if
    any, go along as a struct ``row``. ``count`` estimates the hashes of a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held, size, rows = [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal number, held, size, rows
            table = pa.Table.from_batches(held).combine_chunks().sort_by("id").to_batches()[0]
            row = [[chunk_number(part, number)], [size], [count(table["text"])], [pack(table)]]
            number, held, size, rows = number + 1, [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int64()), pa.array(row[3], pa.binary())], names=["chunk", "n_bytes", "n_hashes", "docs"])

        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID)
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
            row = 0
            while row < len(ids):
                end = min(int(np.searchsorted(ends, ends[row] + CHUNK_BYTES - size, side="right")) - 1, row + CHUNK_ROWS - rows)
                if end <= row:
                    if held:
                        yield close()
                        continue
                    end = row + 1
                part_of = pa.RecordBatch.from_arrays([x.slice(row, end - row) for x in (ids, texts, *batch.columns[2:])], names=["id", "text", "row"][: batch.num_columns])
                # a slice that keeps the whole batch alive would hold all of it
                held.append(unpack(pack(part_of)) if end < len(ids) else part_of)
                size, rows = size + int(ends[end] - ends[row]), rows + end - row
                row = end
                if size >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                    yield close()
        if held:
            yield close()

    small_batches(docs.sparkSession)
    row = [F.struct(*[docs[c] for c in keep]).alias("row")] if keep else []
    return materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *row).mapInArrow(run, CHUNK_SCHEMA), "chunks")


def buckets_for(chunks: DataFrame) -> int:
    """Buckets of about BUCKET_HASHES hashes, and no fewer than shuffle partitions."""
    total = chunks.agg(F.sum("n_hashes")).head()[0] or 0
    return max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_HASHES))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a hash, from its upper bits."""
    return ((hashes >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)


def ask_order(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that groups hashes by bucket, otherwise as they are, and the bounds of each bucket."""
    bucket = bucket_of(hashes, n)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


Ask = Callable[[pa.RecordBatch], dict[str, np.ndarray]]


def ask(chunks: DataFrame, n: int, of_chunk: Ask) -> DataFrame:
    """(bucket, chunk, asked): what each chunk sends to each bucket.

    ``of_chunk`` gives arrays of equal length; the one named ``deal``, which isn't sent, or else
    ``hash`` deals them out. Their order must be the same whenever the chunk is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch["chunk"].to_pylist(), batch["docs"], strict=True):
                sent = of_chunk(unpack(docs.as_buffer()))
                order, bounds = ask_order(sent.pop("deal") if "deal" in sent else sent["hash"], n)
                full = np.flatnonzero(np.diff(bounds))
                sent = {k: v[order] for k, v in sent.items()}
                rows = [pack(pa.RecordBatch.from_arrays([pa.array(v[bounds[b] : bounds[b + 1]]) for v in sent.values()], names=list(sent))) for b in full]
                pa.default_memory_pool().release_unused()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(np.full(len(full), chunk), pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "chunk", "asked"])

    return chunks.select("chunk", "docs").mapInArrow(run, "bucket long, chunk long, asked binary")


def answer(asked: DataFrame, of_bucket: Callable[[dict[str, np.ndarray], np.ndarray], np.ndarray]) -> DataFrame:
    """(chunk, answers): for each chunk its answers by bucket.

    ``of_bucket`` gets the arrays of all chunks end to end, and the place of the chunk of
    each entry, and gives one value for each entry. A bucket holds a bounded part of the hash
    space, so its group is bounded.
    """

    def run(table):
        sent, sizes = joined(table)
        return replies_to(table, of_bucket(sent, np.repeat(np.arange(len(sizes)), sizes)), sizes)

    return by_chunk(asked.groupBy("bucket").applyInArrow(run, REPLY_SCHEMA))


def joined(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """What a bucket's chunks have sent, end to end, and the length of each chunk's part."""
    parts = [unpack(x.as_buffer()) for x in table["asked"]]
    return {k: np.concatenate([np.asarray(p[k]) for p in parts]) for k in parts[0].schema.names}, np.array([len(p) for p in parts])


def replies_to(table: pa.Table, values: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """A reply to each chunk of a bucket, cut from the values of all."""
    pa.default_memory_pool().release_unused()
    replies = [pack(pa.RecordBatch.from_arrays([pa.array(v)], names=["v"])) for v in np.split(values, np.cumsum(sizes)[:-1])]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "reply": pa.array(replies, pa.binary())})


def by_chunk(replies: DataFrame) -> DataFrame:
    """(chunk, answers): the replies that each chunk gets."""
    return replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias("answers"))


def answered(chunks: DataFrame, answers: list[DataFrame], n: int, of_chunk: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows that ``of_chunk`` makes of a chunk and its answers.

    It gets the batch, the key of its first row (those of the next rows follow) and for each
    of ``answers`` a function that takes the hashes as they were dealt out before and returns
    the answer to each.
    """
    kinds = len(answers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                pa.default_memory_pool().release_unused()
                lookups = [partial(_looked_up, batch[f"answers{k}"][row].values, n) for k in range(kinds)]
                yield from of_chunk(unpack(batch["docs"][row].as_buffer()), batch["chunk"][row].as_py() * CHUNK_ROWS, *lookups)

    out = chunks.select("chunk", "docs")
    for k, given in enumerate(answers):
        out = out.join(given.withColumnRenamed("answers", f"answers{k}"), "chunk", "left")
    return out.mapInArrow(run, schema)


def _looked_up(replies: pa.StructArray | None, n: int, hashes: np.ndarray) -> np.ndarray:
    """The replies of all buckets to a chunk, put in the order of its hashes."""
    order, _ = ask_order(hashes, n)
    by_bucket = {} if replies is None else dict(zip(replies.field("bucket").to_pylist(), replies.field("reply"), strict=True))
    values = [np.asarray(unpack(by_bucket[b].as_buffer())["v"].to_numpy(zero_copy_only=False)) for b in sorted(by_bucket)]
    out = np.concatenate(values) if values else np.zeros(0)
    back = np.empty(len(hashes), dtype=out.dtype)
    back[order] = out
    return back
