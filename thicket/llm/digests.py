"""Fingerprints of documents from statistically improbable byte windows."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.chunks import NO_ID, small_batches
from thicket.llm.words import BYTE_BASE, U, mix, polynomial, random_words, steps

#: Bytes of a window, and windows that compete with each other.
WIDTH, RIVALS = 64, 64
#: A window is selected if it is the rarest of so many of the RIVALS groups it is in.
LEAST_WINS = 8
#: Windows of less entropy (in thousandths of the greatest) are never selected.
LEAST_CLASS = 100
#: Bits of a Bloom filter, features it takes before the next one is chained on, and bits set by a feature.
BITS, FILTER_FEATURES, PROBES = 2048, 160, 5
#: Shorter texts take all their windows of SHORT bytes instead.
SHORT_TEXT, SHORT = WIDTH + RIVALS - 1, 8
#: Bytes at once, so that the scratch arrays stay in a core's cache.
BLOCK = 1 << 18

_TERM = np.zeros(WIDTH + 2, dtype=np.int64)
_TERM[1:] = np.round(np.arange(1, WIDTH + 2) * np.log2(np.arange(1, WIDTH + 2)) * 65536).astype(np.int64)
_STEP = np.diff(_TERM)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """For each window of WIDTH bytes its entropy in thousandths of 6 bits, in exact integers.

    The count of a byte in the window that it enters or leaves comes from comparing the text
    with itself at each shift; entropy then changes by a table entry per step.
    """
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, dtype=np.int64)
    behind, ahead = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for d in range(1, WIDTH):
        same = (data[d:] == data[:-d]).view(np.uint8)
        behind[d:] += same
        ahead[:-d] += same
    # sum of c*log c of the first window; then a byte leaves and another enters
    first = _TERM[np.bincount(data[:WIDTH], minlength=256)].sum()
    change = _STEP[behind[WIDTH:]] - _STEP[ahead[: n - WIDTH]]
    total = first + np.concatenate([[0], np.cumsum(change)])
    return ((6 * WIDTH * 65536 - total) * 1000) // (6 * WIDTH * 65536)


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about BLOCK bytes, one text at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        yield row, end
        row = end


def _inside(offsets: np.ndarray, span: int, n: int) -> np.ndarray:
    """Which of n starts have ``span`` bytes before the end of their text."""
    left = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n)
    return left >= span


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many windows of the texts fall into each entropy class."""
    counts = np.zeros(1001, dtype=np.int64)
    for row, end in _blocks(data, offsets):
        classes = entropy_classes(data[offsets[row] : offsets[end]])
        own = offsets[row : end + 1] - offsets[row]
        counts += np.bincount(classes[_inside(own, WIDTH, len(classes))], minlength=1001)
    return counts


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy class, the rarest first; classes of little entropy come after all."""
    ranks = np.empty(1001, dtype=np.int64)
    ranks[np.lexsort((np.arange(1001), counts))] = np.arange(1001)
    ranks[:LEAST_CLASS] = 1023
    return ranks


def _features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the selected features of some texts, by place."""
    n = len(data)
    docs, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U)]
    doc_at = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    sizes = np.diff(offsets)
    table = random_words(256, 3)
    with np.errstate(over="ignore"):
        classes = entropy_classes(data)
        positions = len(classes)
        fits = _inside(offsets, WIDTH, positions)
        rank = np.where(fits, ranks[classes], 1023)
        groups = positions - RIVALS + 1
        if groups > 0:
            # the leftmost rarest of each group of neighbouring windows of one text wins
            key = (rank << 20 | np.arange(positions)).astype(np.int64)
            width = 1
            while width < RIVALS:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            whole = _inside(offsets, WIDTH + RIVALS - 1, n)[:groups]
            best = key[whole]
            wins = np.bincount(best[best < 1023 << 20] & ((1 << 20) - 1), minlength=positions)
            at = np.flatnonzero(wins >= LEAST_WINS)
            docs.append(doc_at[at])
            hashes.append(mix(polynomial(table[data], at, at + WIDTH, BYTE_BASE)))
        small = np.flatnonzero((sizes > 0) & (sizes < SHORT_TEXT))
        if len(small):
            starts = np.maximum(sizes[small] - SHORT + 1, 1)
            own = np.repeat(small, starts)
            at = np.repeat(offsets[small] - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
            docs.append(own)
            hashes.append(mix(polynomial(table[data], at, np.minimum(at + SHORT, offsets[own + 1]), BYTE_BASE) + U(1)))
        # a long text without a rare window, such as one repeated byte, stands for itself
        bare = np.flatnonzero((sizes >= SHORT_TEXT) & (np.bincount(np.concatenate(docs), minlength=len(sizes)) == 0))
        docs.append(bare)
        hashes.append(mix(polynomial(table[data], offsets[bare], offsets[bare + 1], BYTE_BASE) + U(2)) if len(bare) else np.zeros(0, dtype=U))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


class Digest:
    """Chained Bloom filters: bits set of each filter, and the features put in."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        self.bits = np.zeros((-(-self.n // FILTER_FEATURES), BITS), dtype=np.float32)
        at = np.arange(self.n) // FILTER_FEATURES
        for k in range(PROBES):
            self.bits[at, (hashes >> U(11 * k) & U(BITS - 1)).astype(np.int64)] = 1
        self.ones = self.bits.sum(axis=1)

    def text(self) -> str:
        """Number of features, then the filters."""
        return f"{self.n}:" + base64.b64encode(np.packbits(self.bits.astype(bool), axis=None).tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Digest:
        n, _, body = text.partition(":")
        out = cls(np.zeros(0, dtype=U))
        out.n = int(n)
        out.bits = np.unpackbits(np.frombuffer(base64.b64decode(body), np.uint8)).reshape(-1, BITS).astype(np.float32)
        out.ones = out.bits.sum(axis=1)
        return out


def likeness(a: Digest, b: Digest) -> float:
    """From 0 to 1: each filter of the smaller digest against its best match in the other.

    The overlap of two filters is their common bits beyond those expected by chance, over the
    most there could be. Two empty digests are alike, an empty and another one aren't.
    """
    if not a.n or not b.n:
        return float(a.n == b.n)
    if (len(b.bits), b.n) < (len(a.bits), a.n):
        a, b = b, a
    common = a.bits @ b.bits.T
    chance = np.outer(a.ones, b.ones) / BITS
    most = np.minimum(a.ones[:, None], b.ones[None, :])
    best = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(axis=1)
    share = np.minimum(FILTER_FEATURES, a.n - FILTER_FEATURES * np.arange(len(best)))
    return float((best * share).sum() / share.sum())


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """The digest of each text."""
    out = []
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    for row, end in _blocks(data, offsets):
        own = offsets[row : end + 1] - offsets[row]
        part = data[offsets[row] : offsets[end]]
        if len(part) < 1 << 20:
            doc, h = _features(part, own, ranks)
            bounds = np.searchsorted(doc, np.arange(end - row + 1))
            out += [Digest(h[bounds[i] : bounds[i + 1]]) for i in range(end - row)]
        else:
            out.append(Digest(_long_features(part, ranks)))
    return out


def _long_features(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Features of a text too long for one block: overlapping blocks, each giving the windows that start in its own part."""
    found, reach, part = [], WIDTH + 2 * RIVALS, 1 << 19
    table = random_words(256, 3)
    for start in range(0, len(data), part):
        lo, hi = max(start - RIVALS, 0), min(start + part + reach, len(data))
        rank = ranks[entropy_classes(data[lo:hi])]
        key = (rank << 20 | np.arange(len(rank))).astype(np.int64)
        width = 1
        while width < RIVALS:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        wins = np.bincount(key[key < 1023 << 20] & ((1 << 20) - 1), minlength=len(rank))
        at = np.flatnonzero(wins >= LEAST_WINS)
        at = at[(at + lo >= start) & (at + lo < start + part)]
        with np.errstate(over="ignore"):
            found.append(mix(polynomial(table[data[lo:hi]], at, at + WIDTH, BYTE_BASE)))
    out = np.concatenate(found)
    if not len(out):
        digest = hashlib.sha256(data.tobytes()).digest()
        out = np.frombuffer(digest[:8], dtype=U)
    return out


def corpus_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rarity ranks from the entropy classes of all windows of all texts; 1001 counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1001, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in steps(batch.column(0)):
                counts += class_counts(data, offsets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], names=["class", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select(docs[text_col].cast("string")).mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1001, dtype=np.int64)
    for row in rows:
        counts[row["class"]] = row["n"]
    return rarity_ranks(counts)


def fingerprints(docs: DataFrame, ranks: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, all by default) and ``fingerprint`` of each text; a null is empty."""
    keep = docs.columns if keep is None else keep
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in steps(batch.column(1)):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(end - row)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array([d.text() for d in digests(texts, ranks)])], names=["row", "fingerprint"])

    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fingerprint string")


#: Text bytes of a range of ids.
RANGE_BYTES = 8 << 20


def edited_neighbours(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts, of their edited texts, and how alike they are.

    A text's edit has its last floor(n/2) code points replaced by the first as many, or all,
    of the next text in order of id; after the last comes the first. Rows of one id stand in
    order of text; a null id comes last; a null text is empty. Ranges of ids are dealt out,
    each with the first text of the range behind it, and read in order, so every text is
    moved once.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    least, total = rows.agg(F.min("id"), F.sum(F.octet_length("text"))).head()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(4 * parts, (total or 0) // RANGE_BYTES)
    # ids that stand in the data, so each is the first of its range
    cuts = rows.select("id").agg(F.percentile_approx("id", [k / n for k in range(1, n)], 4 * n)).head()[0] if least is not None else []
    bounds = np.unique(np.array([least, *(cuts or [])], dtype=np.int64)) if least is not None else np.zeros(1, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch["id"])
            bucket = np.searchsorted(bounds, ids, side="right") - 1
            first = np.flatnonzero(bounds[bucket] == ids)
            for part, to, peek in ((batch, bucket, False), (batch.take(pa.array(first)), (bucket[first] - 1) % len(bounds), True)):
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.full(len(to), peek)), part["id"], part["text"]], names=["bucket", "peek", "id", "text"])

    dealt = rows.mapInArrow(deal, "bucket long, peek boolean, id long, text string").repartition(parts, "bucket").sortWithinPartitions("bucket", "peek", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, over = [], 0, None

        def emit(pairs):
            own = [t for _, t, _ in pairs]
            edits = [_edited(t, after) for _, t, after in pairs]
            encoded = [t.encode("utf-8", "surrogatepass") for t in own]
            edited = [t.encode("utf-8", "surrogatepass") for t in edits]
            chained = all(pairs[i][2] is pairs[i + 1][1] for i in range(len(pairs) - 1))
            following = [pairs[-1][2]] if chained else [after for _, _, after in pairs]
            made = digests(encoded + edited + [t.encode("utf-8", "surrogatepass") for t in following], ranks)
            k = len(pairs)
            mine, changed = made[:k], made[k : 2 * k]
            behind = mine[1:] + made[2 * k :] if chained else made[2 * k :]
            ids = np.array([i for i, _, _ in pairs], dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=ids == NO_ID), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
                    pa.array([d.text() for d in mine]), pa.array([d.text() for d in changed]),
                    pa.array([likeness(x, y) for x, y in zip(mine, changed, strict=True)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(mine, behind, strict=True)], pa.float64()),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        last = None  # (bucket, id, text) still without a next text
        for batch in batches:
            for bucket, peek, i, text in zip(batch["bucket"].to_pylist(), batch["peek"].to_pylist(), batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if last is not None:
                    held.append((last[0], last[1], text))
                    size += len(last[1])
                    last = None
                elif peek and over == bucket:
                    continue
                if not peek:
                    last = (i, text)
                over = bucket
                if size > 1 << 20:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    out = dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]
