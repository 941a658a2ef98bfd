"""Quality by a factorisation machine, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.chunks import small_batches
from thicket.llm.samples import SAMPLE_ROWS, labelled_sample
from thicket.llm.words import U, Words, steps

RANK = 8
WORD_ROWS = 1 << 16
#: Each statistic falls into one of this many classes, a feature each.
CLASSES = 16
STATISTICS = ("words", "word_length", "symbols", "capitals", "digits", "stops", "line_words", "dup_lines", "distinct_words", "stated_chars")
ROWS = WORD_ROWS + CLASSES * len(STATISTICS)
EPOCHS = 6
#: Share of a document's weight that its words have; the statistics have the rest.
WORD_WEIGHT = 0.5


class Features:
    """Sparse features of some texts: (text, feature row, value), sorted by text, each pair once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, stated: np.ndarray):
        n = len(offsets) - 1
        words = Words(data, offsets)
        n_words = np.diff(words.bounds)
        key = words.doc.astype(np.int64) * WORD_ROWS + (words.hashes() % U(WORD_ROWS)).astype(np.int64)
        distinct, times = np.unique(key, return_counts=True)
        doc, row = distinct // WORD_ROWS, distinct % WORD_ROWS
        value = np.sqrt(times)
        norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=n))
        value = WORD_WEIGHT * value / np.maximum(norm[doc], 1e-9)

        per_doc = lambda marks: self._sums(marks, offsets)
        size = np.maximum(n_words, 1)
        letters = np.maximum(per_doc((data & 0xC0) != 0x80) - per_doc(data == 0x20), 1)
        symbols = per_doc(np.isin(data, np.frombuffer(b"#*$%&|<>{}[]\\^~=_@", np.uint8)))
        capitals, digits = per_doc((data >= 65) & (data <= 90)), per_doc((data >= 48) & (data <= 57))
        stops = per_doc(np.isin(data, np.frombuffer(b".!?", np.uint8)))
        lines, dup = self._lines(data, offsets)
        log = lambda x: np.log2(1 + np.asarray(x, dtype=np.float64))
        scaled = [
            log(n_words), np.minimum(letters / size, 30) / 2, log(1000 * symbols / letters) * 1.5, log(1000 * capitals / letters) * 1.5, log(1000 * digits / letters) * 1.5,
            log(1000 * stops / size) * 1.5, log(n_words / np.maximum(lines, 1)) * 1.5, log(1000 * dup / np.maximum(lines, 1)) * 1.5, 15 * np.bincount(doc, minlength=n) / size, log(stated) * 0.9,
        ]
        classes = np.clip(np.floor(np.stack(scaled, axis=1)), 0, CLASSES - 1).astype(np.int64) + np.arange(len(STATISTICS)) * CLASSES + WORD_ROWS
        share = np.sqrt(1 - WORD_WEIGHT**2) / np.sqrt(len(STATISTICS))
        doc = np.concatenate([doc, np.repeat(np.arange(n), len(STATISTICS))])
        order = np.argsort(doc, kind="stable")
        self.n, self.doc = n, doc[order]
        self.row = np.concatenate([row, classes.ravel()])[order]
        self.value = np.concatenate([value, np.full(classes.size, share)])[order].astype(np.float32)
        self.bounds = np.searchsorted(self.doc, np.arange(n + 1))

    @staticmethod
    def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    @staticmethod
    def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word of each text, and how many of them repeat an earlier one."""
        lines = Words(data, offsets, between=np.arange(256) == 0x0A)
        ink = np.concatenate([[0], np.cumsum(~np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)))])
        full = ink[lines.ends] > ink[lines.starts]
        doc, h = lines.doc[full], lines.hashes()[full]
        n = len(offsets) - 1
        order = np.lexsort((h, doc))
        d, h = doc[order], h[order]
        again = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
        return np.bincount(doc, minlength=n), np.bincount(d[1:][again], minlength=n)


class Machine:
    """y = b + sum w x + 1/2 sum over factors of ((sum v x)^2 - sum v^2 x^2), in time linear in the features."""

    def __init__(self, seed: int = 9):
        self.b = 0.0
        self.w = np.zeros(ROWS, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (ROWS, RANK)).astype(np.float32)
        self.prior = 0.0

    def logits(self, doc: np.ndarray, row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The logit of each text, and its factor sums. All texts have features, sorted by text."""
        first = np.searchsorted(doc, np.arange(n))
        vx = self.v[row] * value[:, None]
        sums = np.add.reduceat(vx, first)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), first)
        return self.b + np.add.reduceat(self.w[row] * value, first) + 0.5 * (np.einsum("ij,ij->i", sums, sums) - squares), sums


def train(x: Features, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, seed: int = 4) -> Machine:
    """A machine for labels 0 and 1 by Adagrad on the log loss."""
    fm, rng = Machine(), np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    fm.prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return fm
    fm.b = float(np.log(fm.prior / (1 - fm.prior)))
    sw, sv = np.full(ROWS, 1e-6, np.float32), np.full((ROWS, RANK), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            sizes = x.bounds[own + 1] - x.bounds[own]
            place = np.repeat(x.bounds[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            doc, row, value = np.repeat(np.arange(len(own)), sizes), x.row[place], x.value[place]
            z, sums = fm.logits(doc, row, value, len(own))
            d = ((1 / (1 + np.exp(-z)) - y[own]) / len(own)).astype(np.float32)
            fm.b -= rate * float(d.sum())
            gw = d[doc] * value
            gv = gw[:, None] * (sums[doc] - fm.v[row] * value[:, None])
            by_row = np.argsort(row, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], row[by_row][1:] != row[by_row][:-1]]))
            rows = row[by_row][new]
            gw, gv = np.add.reduceat(gw[by_row], new), np.add.reduceat(gv[by_row], new) + 1e-5 * fm.v[rows]
            sw[rows] += gw * gw
            sv[rows] += gv * gv
            fm.w[rows] -= rate * gw / np.sqrt(sw[rows])
            fm.v[rows] -= rate * gv / np.sqrt(sv[rows])
    return fm


def score(docs: DataFrame, fm: Machine, text_col: str = "text", chars_col: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """Scores each whole text from 0 to 1.

    Features are hashed words, classes of structure statistics and the document's stated
    length. Returns per row ``row`` (a struct of the columns ``keep``, all by default, so that
    no name clashes) and ``score``. A null text is empty, a null length is 0; an empty text is
    scored by its statistics alone.
    """
    model = docs.sparkSession.sparkContext.broadcast(fm)
    keep = docs.columns if keep is None else keep
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = model.value
        for batch in batches:
            stated = np.maximum(np.asarray(batch.column(2).fill_null(0)), 0)
            for row, end, data, offsets in steps(batch.column(1)):
                x = Features(data, offsets, stated[row:end])
                z = fm.logits(x.doc, x.row, x.value, x.n)[0].astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["row", "score"])

    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].cast("string").alias("text"), docs[chars_col].cast("long").alias("stated"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``score`` by a machine trained on a bounded sample of the labels (see ``samples``)."""
    sample = labelled_sample(docs, labels, "quality", ["text", "n_chars"], rows)
    encoded = [t.encode("utf-8", "replace") for t in sample["text"].fillna("")]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
    stated = np.maximum(sample["n_chars"].fillna(0).to_numpy(dtype=np.int64), 0)
    x = Features(np.frombuffer(b"".join(encoded), np.uint8), offsets, stated)
    return score(docs, train(x, sample["label"].to_numpy()), keep=keep)
