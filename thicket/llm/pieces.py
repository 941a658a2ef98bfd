"""Encoding and decoding with a SentencePiece vocabulary, giant texts in parallel."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.chunks import small_batches
from thicket.session import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Texts of more code points are encoded in chunks of this many.
GIANT, CHUNK = 65_536, 8_192
#: Segments whose encoding a task remembers.
REMEMBERED = 400_000
NEVER = -np.inf
#: Texts that are not words behind single blanks.
_UNEVEN = f"{BLANK}|  |^ | $|^$"
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]*")


class Vocabulary:
    """Pieces with scores, and a lattice over them: the best path has the highest sum of scores.

    A code point without a piece of its own may be passed at the least score less 10, and is
    written as byte pieces. Of equal paths into a place the one with the longest last piece
    wins. Scores are summed in 64 bits.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kind = type(proto).SentencePiece
        normal = [p.score for p in proto.pieces if p.type == kind.NORMAL]
        self.score, self.id, self.byte, self.written = {}, {}, {}, []
        for number, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                self.byte[int(p.piece[3:5], 16)] = number
                self.written.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (kind.NORMAL, kind.USER_DEFINED):
                own = p.type == kind.USER_DEFINED
                self.score[p.piece] = len(p.piece.encode()) * max(normal) - 0.1 if own else float(p.score)
                self.id[p.piece] = number
                self.written.append(p.piece.replace(BLANK, " ").encode())
            else:
                self.written.append(b"")
        #: Scores of pieces, and NaN for what only begins a piece.
        self.begun = {p[:k]: np.nan for p in self.score for k in range(1, len(p))} | self.score
        self.unknown = min(normal) - 10
        self.longest = max(map(len, self.score))
        #: Whether a path must cut before each run of blanks.
        self.cuts = all(BLANK not in p.lstrip(BLANK) for p in self.score)
        self.all_written = pa.array(self.written, pa.binary())
        self.known: dict[str, bytes] = {}
        self.sums: dict[str, float] = {}

    def forward(self, text: str, end: int, entry: dict[int, float]) -> tuple[list[float], list[int]]:
        """Best sums into each place, and the start of the last piece (-1: an entry), over pieces that start before ``end``."""
        most = len(text)
        best, back = [NEVER] * (most + 1), [-1] * (most + 1)
        for place, value in entry.items():
            best[place] = value
        begun, longest = self.begun, self.longest
        for start in range(end):
            here = best[start]
            if here == NEVER:
                continue
            single = False
            for stop in range(start + 1, min(start + longest, most) + 1):
                s = begun.get(text[start:stop])
                if s is None:
                    break
                if s == s:
                    single = single or stop == start + 1
                    if here + s > best[stop]:
                        best[stop], back[stop] = here + s, start
            if not single and start < most and here + self.unknown > best[start + 1]:
                best[start + 1], back[start + 1] = here + self.unknown, start
        return best, back

    def ids_of(self, text: str, back: list[int], at: int) -> list[int]:
        """Ids of the path into ``at``, back to its entry."""
        out = []
        while back[at] >= 0:
            piece = text[back[at] : at]
            number = self.id.get(piece)
            out += [number] if number is not None else [self.byte[b] for b in reversed(piece.encode())]
            at = back[at]
        return out[::-1]

    def segment(self, text: str) -> bytes:
        """Ids of a text between two cuts, as they are written; remembered with its sum."""
        ids = self.known.get(text)
        if ids is None:
            best, back = self.forward(text, len(text), {0: 0.0})
            if len(self.known) >= REMEMBERED:
                self.known.clear()
                self.sums.clear()
            ids = self.known[text] = _ids(self.ids_of(text, back, len(text)))
            self.sums[text] = best[-1]
        return ids

    def parts(self, text: str) -> list[str]:
        """A marked text between its cuts."""
        return _SEGMENT.findall(text)[:-1] if self.cuts else [text]

    def encoded(self, text: str) -> bytes:
        """Ids of a text, as they are written; blanks are marked and one is put before it."""
        if not text:
            return b""
        get, segment = self.known.get, self.segment
        return b"".join([get(p) or segment(p) for p in self.parts(BLANK + text.replace(" ", BLANK))])

    def encoded_all(self, texts: pa.Array) -> pa.Array:
        """Ids of each text, as they are written. Where single blanks part words, each distinct word is looked up once."""
        uneven = np.asarray(pc.match_substring_regex(texts, _UNEVEN)) | (not self.cuts)
        rest = pa.array([self.encoded(t) for t in texts.filter(pa.array(uneven)).to_pylist()], pa.binary())
        if uneven.all():
            return rest
        words = pc.split_pattern(texts.filter(pa.array(~uneven)), " ")
        distinct = words.flatten().dictionary_encode()
        get, segment = self.known.get, self.segment
        ids = pa.array([get(w) or segment(w) for w in pc.binary_join_element_wise(BLANK, distinct.dictionary, "").to_pylist()], pa.binary())
        bounds = np.asarray(words.offsets)
        out = _cut(ids.take(distinct.indices), bounds - bounds[0])
        order = np.empty(len(texts), dtype=np.int64)
        order[np.flatnonzero(~uneven)], order[uneven] = np.arange(len(out)), len(out) + np.arange(len(rest))
        return pa.concat_arrays([out, rest]).take(pa.array(order)) if len(rest) else out

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return np.frombuffer(self.encoded(text), "<i4").tolist()

    def sum_of(self, text: str) -> float:
        """The best sum of a text between two cuts."""
        if text not in self.sums:
            self.segment(text)
        return self.sums[text]

    def cut_of(self, text: str, size: int) -> tuple[int, int] | None:
        """The first and last forced cut of a chunk behind all entries, if there is one."""
        if not self.cuts:
            return None
        first = next((p for p in range(self.longest, size) if text[p] == BLANK != text[p - 1]), None)
        if first is None:
            return None
        return first, next(p for p in range(size - 1, first - 1, -1) if text[p] == BLANK != text[p - 1])

    def decode(self, ids) -> str:
        """The text of ids; the blank put before it goes."""
        return b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")

    def decoded_all(self, tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of ids and the text of each row of written ids."""
        tokens = tokens.cast(pa.binary()).fill_null(b"")
        bounds = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1] // 4 if len(tokens) else np.zeros(1, np.int32)
        data = tokens.buffers()[2]
        ids = np.frombuffer(data, "<i4", count=int(bounds[-1]))[bounds[0] :] if data and bounds[-1] else np.zeros(0, np.int32)
        texts = _cut(self.all_written.take(pa.array(ids)), bounds - bounds[0])
        try:
            out = pc.if_else(pc.starts_with(texts, " "), pc.binary_slice(texts, 1), texts).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            out = pa.array([t.decode("utf-8", "replace").removeprefix(" ") for t in texts.to_pylist()], pa.string())
        return np.diff(bounds), out

    def transfer(self, text: str, size: int) -> np.ndarray:
        """The max-plus matrix of a chunk of ``size`` code points, given with those behind it that a piece may reach.

        Entry [i, j]: the best sum of pieces from i code points into the chunk to j beyond its
        end, all starting inside it. Where cuts are forced, paths from all entries meet at the
        first and part behind the last, and what lies between is remembered by segment.
        """
        n = self.longest
        out = np.full((n, n), NEVER)
        cut = self.cut_of(text, size)
        if cut is None:
            for i in range(n):
                if i >= size:
                    out[i, i - size] = 0.0  # a piece reaches over the whole chunk
                    continue
                row = self.forward(text, size, {i: 0.0})[0][size : size + n]
                out[i, : len(row)] = row
            return out
        first, last = cut
        row = self.forward(text[last:], size - last, {0: 0.0})[0][size - last : size - last + n]
        middle = sum(map(self.sum_of, self.parts(text[first:last]))) if last > first else 0.0
        for i in range(n):
            out[i, : len(row)] = self.forward(text[:first], first, {i: 0.0})[0][first] + middle + np.array(row)
        return out

    def sources(self, text: str, size: int, entry: dict[int, float]) -> list[int]:
        """For each exit of a chunk the entry that its best path comes from."""
        cut = self.cut_of(text, size)
        end = size if cut is None else cut[0]
        known = text if cut is None else text[:end]
        best, back = self.forward(known, end, entry)
        out = []
        for k in range(self.longest):
            at = size + k if cut is None else end
            while at <= len(known) and back[at] >= 0:
                at = back[at]
            out.append(at if at <= len(known) and best[at] > NEVER else 0)
        return out

    def traced(self, text: str, size: int, entry: dict[int, float], leave: int) -> bytes:
        """Ids of a chunk's pieces, given its entries and the exit that is taken."""
        if size + leave > len(text):
            return b""
        cut = self.cut_of(text, size)
        if cut is None:
            _, back = self.forward(text, size, entry)
            return _ids(self.ids_of(text, back, size + leave))
        first, last = cut
        _, back = self.forward(text[:first], first, entry)
        head = _ids(self.ids_of(text[:first], back, first))
        middle = b"".join(map(self.segment, self.parts(text[first:last]))) if last > first else b""
        _, back = self.forward(text[last:], size - last, {0: 0.0})
        return head + middle + _ids(self.ids_of(text[last:], back, size - last + leave))


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacks of matrices, with max for sums and sums for products."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def prefix_products(m: np.ndarray) -> np.ndarray:
    """All prefix products of a stack of matrices by doubling; the product is associative."""
    m, step = m.copy(), 1
    while step < len(m):
        m[step:] = max_plus(m[:-step], m[step:])
        step *= 2
    return m


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """A vocabulary, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _cut(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """A row of the binaries between two bounds each, joined."""
    places = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(places[bounds])), values.buffers()[2] or pa.py_buffer(b"")])


def _ids(values) -> bytes:
    return np.asarray(values, dtype="<i4").tobytes()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """The id and ``tokens`` (32-bit little-endian ids, as binary) of each whole text.

    The ids are those of the best path over the vocabulary's pieces and scores. Texts of more
    than ``giant`` code points are cut into chunks wherever they fall. Each chunk gives a
    transfer matrix between the states at its ends, a state being how far a piece reaches
    over; prefix products by a parallel scan give the best sums at each boundary; from these
    each chunk finds the entry behind each exit, and with the exit known traces its own path
    back. The result is that of one pass over the text.

    Null and empty texts have no tokens; rows that share an id are rows of their own; a null
    id is kept. Other columns are not carried. ``model`` must be readable by all tasks.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for row in range(0, len(batch), 4096):
                part = batch.slice(row, 4096)
                yield pa.RecordBatch.from_arrays([part["id"], v.encoded_all(part["text"])], names=["id", "tokens"])

    plain = rows.where(F.length("text") <= giant).mapInArrow(small, "id long, tokens binary")
    return plain.union(_encode_giants(rows.where(F.length("text") > giant), model, chunk)).withColumnRenamed("id", id_col)


def _encode_giants(rows: DataFrame, model: str, chunk: int) -> DataFrame:
    reach = vocabulary(model).longest
    marked = rows.select(F.monotonically_increasing_id().alias("key"), "id", F.concat(F.lit(BLANK), F.translate("text", " ", BLANK)).alias("text"))
    starts = F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))).alias("c", "start")
    cut = marked.select("key", "id", "text", F.length("text").alias("n"), starts)
    parts = cut.select("key", "id", "c", F.least(F.lit(chunk), F.col("n") - F.col("start")).alias("size"), F.expr(f"substring(text, start + 1, {chunk + reach})").alias("text"))
    parts = materialize(parts, "giant-chunks")
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = parts.repartition(many, "key", "c")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            made = [v.transfer(t, s).tobytes() for t, s in zip(batch["text"].to_pylist(), batch["size"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["c"], pa.array(made, pa.binary())], names=["key", "c", "m"])

    def scan(table):
        table = table.sort_by("c").combine_chunks()
        m = np.stack([np.frombuffer(x.as_buffer(), np.float64).reshape(reach, reach) for x in table["m"]])
        ends = prefix_products(m)[:, 0]  # the text starts at a cut
        entries = [np.where(np.arange(reach) == 0, 0.0, NEVER), *ends[:-1]]
        return pa.table({"key": table["key"], "c": table["c"], "entry": pa.array([e.tobytes() for e in entries], pa.binary())})

    entries = spread.select("key", "c", "size", "text").mapInArrow(matrices, "key long, c int, m binary").groupBy("key").applyInArrow(scan, "key long, c int, entry binary")
    entered = materialize(parts.join(entries, ["key", "c"]), "giant-entries")

    def entered_by(entry: bytes) -> dict[int, float]:
        given = np.frombuffer(entry, np.float64)
        return {k: float(given[k]) for k in range(reach) if given[k] > NEVER}

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each exit of a chunk the entry its path comes from."""
        v = vocabulary(model)
        for batch in batches:
            rows = zip(batch["text"].to_pylist(), batch["size"].to_pylist(), batch["entry"].to_pylist(), strict=True)
            found = [_ids(v.sources(t, s, {k: x for k, x in entered_by(e).items() if k <= len(t)})) for t, s, e in rows]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["c"], pa.array(found, pa.binary())], names=["key", "c", "sources"])

    def exits(table):
        """The exit of each chunk, from the last one, which ends where the text does."""
        table = table.sort_by("c").combine_chunks()
        maps = [np.frombuffer(x.as_buffer(), "<i4") for x in table["sources"]]
        out, state = [0] * len(maps), 0
        for c in range(len(maps) - 1, -1, -1):
            out[c] = state
            state = int(maps[c][state])
        return pa.table({"key": table["key"], "c": table["c"], "exit": pa.array(out, pa.int32())})

    again = entered.repartition(many, "key", "c")
    exit_states = again.select("key", "c", "size", "text", "entry").mapInArrow(sources, "key long, c int, sources binary").groupBy("key").applyInArrow(exits, "key long, c int, exit int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            rows = zip(batch["text"].to_pylist(), batch["size"].to_pylist(), batch["entry"].to_pylist(), batch["exit"].to_pylist(), strict=True)
            made = [v.traced(t, s, {k: y for k, y in entered_by(e).items() if k <= len(t)}, x) for t, s, e, x in rows]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["id"], batch["c"], pa.array(made, pa.binary())], names=["key", "id", "c", "tokens"])

    traced = entered.join(exit_states, ["key", "c"]).select("key", "id", "c", "size", "text", "entry", "exit").mapInArrow(trace, "key long, id long, c int, tokens binary")
    joined = traced.groupBy("key").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("c", "tokens"))).alias("p"))
    return joined.select("id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["tokens"])).alias("tokens"))


def decode(rows: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", model: str = MODEL) -> DataFrame:
    """The id, ``n_tokens`` and ``text`` of each row's tokens. A null has none and an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for row in range(0, len(batch), 512):
                part = batch.slice(row, 512)
                n, texts = v.decoded_all(part["tokens"])
                yield pa.RecordBatch.from_arrays([part["id"], part["tokens"], pa.array(n, pa.int64()), texts], names=["id", "tokens", "n_tokens", "text"])

    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(tokens_col).alias("tokens")).mapInArrow(run, "id long, tokens binary, n_tokens long, text string")
    return out.withColumnRenamed("id", id_col)
