"""Documents packed into sequences of several permitted lengths."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.plans.joins import lookup_join
from thicket.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs beside its tokens, in tokens.
OVERHEAD = 32
#: Pieces packed together; bounds a task, and the share of half-filled last bins.
SHARD_PIECES = 20_000


class Shelf:
    """Lengths with a count each; the smallest at least, and the largest at most, some length in constant time."""

    def __init__(self, most: int):
        self.count = [0] * (most + 1)
        self.mask = 0

    def add(self, length: int, n: int = 1) -> None:
        self.count[length] += n
        self.mask |= 1 << length

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            self.mask &= ~(1 << length)

    def at_least(self, length: int) -> int:
        rest = self.mask >> length
        return length + (rest & -rest).bit_length() - 1 if rest else -1

    def at_most(self, length: int) -> int:
        return (self.mask & ((1 << (length + 1)) - 1)).bit_length() - 1


def _fill(left: Shelf, room: int, largest: int) -> int:
    """Tokens that the largest remaining lengths which fit would put into a room, one after another."""
    used, length = 0, min(room, largest)
    while (length := left.at_most(min(room, length))) > 0:
        times = min(left.count[length], room // length)
        used, room = used + times * length, room - times * length
        length -= 1
    return used


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin of each length, its place in the bin, and the capacity of each bin.

    Lengths come in descending order (ties as given). Each goes into the open bin with the
    least room that holds it, of equals the one that has had this room for longest. If there is none, a bin opens, of the
    capacity that would cost least per token once the largest remaining lengths that fit had
    filled it: (capacity + overhead) / tokens, the smaller of equals. At the end each bin
    shrinks to the least capacity that holds its contents.
    """
    most = max(capacities)
    order = np.argsort(-lengths, kind="stable")
    left, open_room = Shelf(most), Shelf(most)
    for length, n in zip(*np.unique(lengths, return_counts=True), strict=True):
        left.add(int(length), int(n))
    by_room: dict[int, list[int]] = {}
    bins, places, sizes, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [], []
    for item in order:
        length = int(lengths[item])
        left.take(length)
        room = open_room.at_least(length)
        if room < 0:
            room = min((c for c in sorted(capacities) if c >= length), key=lambda c: (c + overhead) / (length + _fill(left, c - length, length)))
            number = len(sizes)
            sizes.append(room)
            used.append(0)
        else:
            own = by_room[room]
            number = own.pop(0)
            open_room.take(room)
        bins[item], places[item] = number, used[number]
        used[number] += length
        if room > length:
            by_room.setdefault(room - length, []).append(number)
            open_room.add(room - length)
    ends = np.array(used, dtype=np.int64)
    sorted_sizes = np.array(sorted(capacities), dtype=np.int64)
    return bins, places, sorted_sizes[np.searchsorted(sorted_sizes, ends)]


def text_key(text: Column) -> Column:
    """SHA-256 of a text; null and empty texts share one."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def pieces_of(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, row_key, text_key, piece, start, n_tokens): each text's words in pieces of at most ``most``; one empty piece of a text without words."""
    n = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD), F.lit(0)))
    own = ["id", "row_key", "text_key"]
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row_key"), text_key(F.col(text_col)).alias("text_key"), n.cast("long").alias("n"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(most).cast("long"))
    out = out.select(*own, "n", F.posexplode(starts).alias("piece", "start"))
    return out.select(*own, "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(most)).alias("n_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Best-fit packing of whole documents into sequences of the permitted lengths.

    A document longer than the largest capacity is cut into pieces of that length and a rest;
    no word is lost. Each row gets a written key of its own; pieces are dealt by a hash of
    that key and their start into shards of about ``shard_pieces``, however many rows share
    an id, each packed by ``best_fit`` in order of id, row and piece, so the waste is that of
    a few bins per shard.

    Returns a row per piece: the id, ``row_key``, ``text_key`` (of the whole text), ``piece``
    (0, 1, ...), ``start`` (first word), ``n_tokens``, ``bin_id``, ``capacity`` (of the bin,
    after shrinking) and ``offset`` (the piece's first token in the bin). Null, empty and
    blank texts have one piece of no tokens and no bin. Rows with a null or a shared id are
    packed one by one; ``row_key`` tells their pieces apart.
    """
    most = max(capacities)
    pieces = materialize(pieces_of(docs, id_col, text_col, most), "pieces")
    shards = max(1, math.ceil(pieces.where("n_tokens > 0").count() / shard_pieces))
    dealt = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("row_key", "start"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:  # not by pandas, which makes ids beside a null one floats
        table = table.sort_by([("id", "ascending"), ("row_key", "ascending"), ("piece", "ascending")])
        bins, places, sizes = best_fit(table["n_tokens"].to_numpy(), capacities, overhead)
        first = table["shard"][0].as_py() << 32
        out = table.select(["id", "row_key", "text_key", "piece", "start", "n_tokens"])
        for name, values in (("bin_id", first + bins), ("capacity", sizes[bins]), ("offset", places)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    schema = "id long, row_key long, text_key binary, piece int, start long, n_tokens long"
    packed = dealt.groupBy("shard").applyInArrow(run, schema + ", bin_id long, capacity long, offset long")
    null = F.lit(None).cast("long")
    empty = pieces.where("n_tokens = 0").select("*", null.alias("bin_id"), null.alias("capacity"), null.alias("offset"))
    return packed.union(empty).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed pieces with their words, one space between. Pieces without words are left out.

    Pieces meet their text by its digest, as equal texts have equal words: ids may be null or
    shared, and each piece meets one text. Texts of very many pieces are spread.
    """
    own = docs.select(text_key(F.col(text_col)).alias("own_key"), F.col(text_col).cast("string").alias("own_text")).dropDuplicates(["own_key"])
    slim = materialize(packed.where("bin_id IS NOT NULL"), "packed")
    met = lookup_join(slim, own, "text_key", "own_key", "inner", hot_rows=SHARD_PIECES)
    words = F.regexp_extract_all("own_text", F.lit(WORD), F.lit(0))
    text = F.array_join(F.slice(words, F.col("start").cast("int") + 1, F.col("n_tokens").cast("int")), " ")
    return met.select("bin_id", "capacity", "offset", id_col, "row_key", "piece", "start", "n_tokens", text.alias("text"))
