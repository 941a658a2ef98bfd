"""Toxicity by a bidirectional gated recurrent network with attention, trained in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.chunks import small_batches
from thicket.llm.samples import SAMPLE_ROWS, labelled_rows
from thicket.llm.words import LOWER, NO_LETTER, U, Words, mix, steps

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, ATTEND = 12, 12, 8
#: Rows of the word and character tables; both are hashed.
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 14
EPOCHS = 8
#: Training texts that must hold a word for it to get a row of its own, and the share of words
#: that a training step hides; both keep the network from learning texts by their rare words.
LEAST_TEXTS, HIDDEN_WORDS = 4, 0.1
#: Standard deviations from which a word counts as a cue at the start.
LEAST_CUE = 2.5
#: From the third epoch on, a text labelled 1 whose best window is below this logit may have a
#: wrong label. It is learned from all the same, at no less than this share of its weight, so
#: that the network doesn't learn such texts by heart.
DOUBT, DOUBTED_WEIGHT = -0.5, 0.25


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Inputs:
    """The distinct words of some texts as rows of the two tables, and the word at each place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, lower=True, between=NO_LETTER)
        distinct, first, self.word_at = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.bounds = words.bounds
        self.word_row = (distinct % U(WORD_ROWS)).astype(np.int64)
        starts, ends = words.starts[first], words.ends[first]
        lengths = ends - starts
        self.char_bounds = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(starts - self.char_bounds[:-1], lengths) + np.arange(self.char_bounds[-1])
        # each byte with its neighbours inside the word
        lowered = LOWER.astype(np.uint8)[data]
        before = np.where(at > np.repeat(starts, lengths), lowered[np.maximum(at - 1, 0)], 0) if len(at) else at
        after = np.where(at + 1 < np.repeat(ends, lengths), lowered[np.minimum(at + 1, len(data) - 1)], 0) if len(at) else at
        code = before.astype(U) << U(16) | lowered[at].astype(U) << U(8) | after.astype(U)
        with np.errstate(over="ignore"):
            self.char_row = (mix(code + U(11)) % U(CHAR_ROWS)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Overlapping windows: first word and length of each, and the first window of each text with a word."""
        n = np.diff(self.bounds)
        count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
        doc = np.repeat(np.arange(len(n)), count)
        first = np.cumsum(count) - count
        start = np.minimum((np.arange(len(doc)) - first[doc]) * STRIDE, np.maximum(n[doc] - WINDOW, 0))
        return self.bounds[:-1][doc] + start, np.minimum(n[doc], WINDOW), doc


class Network:
    """Word and character tables, a recurrent layer in each direction, attention and a logit."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2] if len(shape) > 1 else 1), shape).astype(np.float32)
        self.p = {
            "words": draw(WORD_ROWS, EMBED) * np.float32(20), "chars": draw(CHAR_ROWS, EMBED) * np.float32(20),
            "wx": draw(2 * EMBED, 6 * HIDDEN), "bx": np.zeros(6 * HIDDEN, np.float32), "uf": draw(HIDDEN, 3 * HIDDEN), "ub": draw(HIDDEN, 3 * HIDDEN),
            "wa": draw(2 * HIDDEN, ATTEND), "va": draw(ATTEND, 1)[:, 0], "wo": draw(2 * HIDDEN, 1)[:, 0], "bo": np.zeros(1, np.float32),
        }
        self.prior = 0.0
        #: Rows of the word table that enough training texts hold; row 0 stands for all others.
        self.known = np.ones(WORD_ROWS, dtype=bool)

    def rows_of(self, x: Inputs) -> np.ndarray:
        return np.where(self.known[x.word_row], x.word_row, 0)

    def project(self, x: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """Gate inputs of each distinct word, and its embedding: its own row beside the mean of its characters'."""
        p = self.p
        if not len(x.word_row):
            return np.zeros((0, 6 * HIDDEN), np.float32), np.zeros((0, 2 * EMBED), np.float32)
        chars = np.add.reduceat(p["chars"][x.char_row], x.char_bounds[:-1]) / np.diff(x.char_bounds)[:, None].astype(np.float32)
        e = np.concatenate([p["words"][self.rows_of(x)], chars.astype(np.float32)], axis=1)
        return e @ p["wx"] + p["bx"], e

    def _direction(self, gates: np.ndarray, u: np.ndarray, mask: np.ndarray, order, keep: list | None) -> np.ndarray:
        """One direction over (step, window) gate inputs; returns states in place of their steps."""
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((gates.shape[0], gates.shape[1], HIDDEN), np.float32)
        full = bool(mask.all())
        for t in order:
            g, r = gates[t], h @ u
            zr = _sigmoid(g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(g[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
            nh = h + z * (new - h)
            if not full:
                nh = np.where(mask[t][:, None], nh, h)
            if keep is not None:
                keep.append((t, h, z, reset, new, r[:, 2 * HIDDEN :]))
            h = out[t] = nh
        return out

    def logits(self, projected: np.ndarray, word_at: np.ndarray, start: np.ndarray, length: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        p, n = self.p, len(start)
        steps_ = np.arange(WINDOW)[:, None]
        mask = steps_ < length[None, :]
        at = word_at[np.minimum(start[None, :] + steps_, max(len(word_at) - 1, 0))]
        gates = projected[at]
        kf, kb = ([], []) if tape is not None else (None, None)
        f = self._direction(gates[:, :, : 3 * HIDDEN], p["uf"], mask, range(WINDOW), kf)
        b = self._direction(gates[:, :, 3 * HIDDEN :], p["ub"], mask, range(WINDOW - 1, -1, -1), kb)
        h = np.concatenate([f, b], axis=2)
        a = np.tanh((h.reshape(-1, 2 * HIDDEN) @ p["wa"]).reshape(WINDOW, n, ATTEND))
        s = np.where(mask, a @ p["va"], np.float32(-1e9))
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, h)
        if tape is not None:
            tape.update(at=at, mask=mask, h=h, a=a, w=w, pooled=pooled, kf=kf, kb=kb)
        return pooled @ p["wo"] + p["bo"][0]

    def gradients(self, x: Inputs, e: np.ndarray, tape: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients by back propagation through time; tables as (rows, values)."""
        p, g = self.p, {}
        h, a, w, mask = tape["h"], tape["a"], tape["w"], tape["mask"]
        g["wo"], g["bo"] = tape["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["wo"][None, :]
        dw = np.einsum("tnh,nh->tn", h, d_pooled)
        ds = w * (dw - (w * dw).sum(axis=0))
        da = ds[:, :, None] * p["va"] * (1 - a * a)
        g["va"] = np.einsum("tn,tna->a", ds, a)
        g["wa"] = h.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, ATTEND)
        dh = w[:, :, None] * d_pooled[None] + (da.reshape(-1, ATTEND) @ p["wa"].T).reshape(h.shape)
        d_gates = np.zeros((WINDOW, len(d_logit), 6 * HIDDEN), np.float32)
        for kept, u, part, at in ((tape["kf"], "uf", 0, 0), (tape["kb"], "ub", HIDDEN, 3 * HIDDEN)):
            carry = np.zeros((len(d_logit), HIDDEN), np.float32)
            gu = np.zeros_like(p[u])
            for t, before, z, reset, new, rn in reversed(kept):
                d = carry + dh[t, :, part : part + HIDDEN]
                m = mask[t][:, None]
                dn = d * z * (1 - new * new) * m
                dz = d * (new - before) * z * (1 - z) * m
                dr = dn * rn * reset * (1 - reset)
                d_in = np.concatenate([dz, dr, dn], axis=1)
                d_rec = np.concatenate([dz, dr, dn * reset], axis=1)
                d_gates[t, :, at : at + 3 * HIDDEN] = d_in
                gu += before.T @ d_rec
                carry = np.where(m, d * (1 - z), d) + d_rec @ p[u].T
            g[u] = gu
        d_proj = np.zeros((len(x.word_row), 6 * HIDDEN), np.float32)
        np.add.at(d_proj, tape["at"].ravel(), d_gates.reshape(-1, 6 * HIDDEN) * mask.reshape(-1, 1))
        used = np.flatnonzero(np.bincount(tape["at"].ravel(), minlength=len(x.word_row)))
        d_proj, e = d_proj[used], e[used]
        g["wx"], g["bx"] = e.T @ d_proj, d_proj.sum(axis=0)
        de = d_proj @ p["wx"].T
        lengths = np.diff(x.char_bounds)[used]
        at = np.repeat(x.char_bounds[:-1][used] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        g["words"] = (self.rows_of(x)[used], de[:, :EMBED])
        g["chars"] = (x.char_row[at], np.repeat(de[:, EMBED:] / lengths[:, None], lengths, axis=0))
        return g


def _rows_summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    rows, values = rows[order], values[order]
    new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[new], np.add.reduceat(values, new)


class Adagrad:
    """Steps scaled by the root of summed squares; rows of a table that aren't used stay."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.05):
        self.params, self.rate = params, rate
        self.sums = {k: np.full(v.shape, 1e-8, np.float32) for k, v in params.items()}

    def step(self, gradients: dict) -> None:
        for k, g in gradients.items():
            p, s = self.params[k], self.sums[k]
            if isinstance(g, tuple):
                if len(g[0]):
                    rows, g = _rows_summed(*g)
                    s[rows] += g * g
                    p[rows] -= self.rate * g / np.sqrt(s[rows])
            else:
                s += g * g
                p -= self.rate * g / np.sqrt(s)


def label_weights(best: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """What each text weighs, by the logit of its best window: 1, or DOUBTED_WEIGHT for doubted ones."""
    return np.where((labels > 0) & (best < DOUBT), np.float32(DOUBTED_WEIGHT), np.float32(1))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """A network for labels of whole texts, of which only some window may show the cause.

    In the first epoch a text stands for the window with the word that departs most from the
    usual share of labels, later for the one that scores highest, beside one drawn window of
    each text labelled 0. Every text is learned from in every epoch; texts labelled
    1 that show nothing yet are doubted and weigh less (``label_weights``).
    """
    net, rng = Network(), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    net.prior = float(labels.mean()) if len(labels) else 0.0
    encoded = [t.encode("utf-8", "replace") for t in texts]
    x = Inputs(np.frombuffer(b"".join(encoded), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64))
    start, length, doc = x.windows()
    if not len(doc) or labels.min() == labels.max():
        return net
    holder = np.searchsorted(x.bounds, np.arange(len(x.word_at)), side="right") - 1
    held = np.unique(x.word_row[x.word_at] * len(texts) + holder)
    times = np.bincount(held // len(texts), minlength=WORD_ROWS)
    net.known = times >= LEAST_TEXTS
    net.known[0] = False
    # one column of the word table starts from how far a word's texts depart from the share of label 1
    toxic = np.bincount(held // len(texts), weights=labels[held % len(texts)], minlength=WORD_ROWS)
    z = (toxic - times * net.prior) / np.sqrt(times * net.prior * (1 - net.prior) + 0.25)
    cue = np.where(net.known & (np.abs(z) > LEAST_CUE), np.clip(z / LEAST_CUE, -3, 3), 0).astype(np.float32)
    net.p["words"][:, 0] = cue
    hints = np.zeros(len(start), np.float32)
    place = start[:, None] + np.minimum(np.arange(WINDOW)[None, :], length[:, None] - 1)
    for at in range(0, len(start), 2048):
        hints[at : at + 2048] = cue[x.word_row[x.word_at[place[at : at + 2048]]]].max(axis=1)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    count = np.diff(np.append(first, len(doc)))
    y = labels[doc]
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    weight = np.sqrt(weight)
    trust = np.ones(len(texts), np.float32)
    ada = Adagrad(net.p)
    for epoch in range(epochs):
        drawn = first + rng.integers(0, count)
        if epoch == 0:
            chosen = np.unique(np.concatenate([np.lexsort((-hints, doc))[first], drawn[labels[doc[first]] == 0]]))
        else:
            z = np.concatenate([_block_scores(net, x, start[i : i + 2048], length[i : i + 2048]) for i in range(0, len(start), 2048)])
            order = np.lexsort((-z, doc))
            best, own = order[first], labels[doc[first]]
            if epoch > 1:
                trust[doc[first]] = label_weights(z[best], own)
            chosen = np.unique(np.concatenate([best, drawn[own == 0]]))
        rng.shuffle(chosen)
        for at in range(0, len(chosen), 128):
            own = chosen[at : at + 128]
            part = _part(x, start[own], length[own])
            part.word_row[rng.random(len(part.word_row)) < HIDDEN_WORDS] = 0
            projected, e = net.project(part)
            tape: dict = {}
            z = net.logits(projected, part.word_at, np.arange(len(own)) * WINDOW, length[own], tape)
            d = ((_sigmoid(z) - y[own]) * weight[doc[own]] * trust[doc[own]] / len(own)).astype(np.float32)
            ada.step(net.gradients(part, e, tape, d))
        ada.rate *= 0.9
    return net


def _part(x: Inputs, start: np.ndarray, length: np.ndarray) -> Inputs:
    """The words of some windows only, laid out window after window."""
    out = Inputs.__new__(Inputs)
    at = np.minimum(start[:, None] + np.minimum(np.arange(WINDOW)[None, :], length[:, None] - 1), len(x.word_at) - 1)
    used, out.word_at = np.unique(x.word_at[at].ravel(), return_inverse=True)
    out.word_row = x.word_row[used]
    lengths = np.diff(x.char_bounds)[used]
    out.char_bounds = np.concatenate([[0], np.cumsum(lengths)])
    out.char_row = x.char_row[np.repeat(x.char_bounds[:-1][used] - out.char_bounds[:-1], lengths) + np.arange(lengths.sum())]
    return out


def _block_scores(net: Network, x: Inputs, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logits of some windows, with the gate inputs of their own words only."""
    part = _part(x, start, length)
    return net.logits(net.project(part)[0], part.word_at, np.arange(len(start)) * WINDOW, length)


def scores_of(net: Network, x: Inputs, start: np.ndarray, length: np.ndarray, block: int = 2048) -> np.ndarray:
    """Logits of all windows, block by block."""
    projected, _ = net.project(x)
    return np.concatenate([np.zeros(0, np.float32), *[net.logits(projected, x.word_at, start[i : i + block], length[i : i + block]) for i in range(0, len(start), block)]])


def score(docs: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Scores each text from 0 to 1 by its most toxic window.

    All windows of WINDOW words that start STRIDE words apart, and the last one, are scored;
    shorter texts are one window. Returns per row ``row`` (a struct of the columns ``keep``,
    all by default, so that no name clashes), ``score`` and ``n_windows``. A text without a
    word, null included, gets the share of label 1 in the training sample.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)
    keep = docs.columns if keep is None else keep
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for row, end, data, offsets in steps(batch.column(1)):
                x = Inputs(data, offsets)
                start, length, doc = x.windows()
                z = np.full(end - row, -np.inf)
                np.maximum.at(z, doc, scores_of(net, x, start, length).astype(np.float64))
                s = np.where(np.isfinite(z), 1 / (1 + np.exp(-np.clip(z, -500, 500))), net.prior)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(s), pa.array(np.bincount(doc, minlength=end - row), pa.int64())], names=["row", "score", "n_windows"])

    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, n_windows long")


def trained(sample: DataFrame) -> Network:
    """``train`` on a bounded sample (doc_id, text, label), in one task; the driver gets the weights alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held).sort_by("doc_id") if held else pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})
        net = train(table["text"].fill_null("").to_pylist(), table["label"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    nets = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "net binary").head()
    return pickle.loads(nets[0]) if nets else train([], np.zeros(0, np.float32))


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``score`` by a network trained on a bounded sample of the labels (see ``samples``)."""
    return score(docs, trained(labelled_rows(docs, labels, "toxic", ["text"], rows)), keep=keep)
