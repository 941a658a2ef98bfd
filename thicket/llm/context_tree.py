"""A byte language model by context-tree weighting, and documents scored with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm import chunks as C
from thicket.llm.words import LOWER, U, Words, mix, one_blank, steps
from thicket.session import materialize

#: Bytes of context. Distinct grams whose contexts share their last TOP bytes meet in one bucket,
#: once their counts are summed up; shorter contexts have at most 65,535 nodes in all, which are
#: summed up by Spark.
DEPTH, TOP = 5, 2
NEWLINE = 0x0A
_LOWER = LOWER.astype(np.uint8)
_SMALL = 4096
_HALF = np.concatenate([[0.5 * np.log(np.pi)], 0.5 * np.log(np.pi) + np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])


def _log_gamma(n: np.ndarray, shift: float, table: np.ndarray) -> np.ndarray:
    """log gamma of n + shift: a table for small counts, Stirling's series above."""
    x = np.maximum(n, _SMALL) + shift
    large = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL - 1)], large)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov block probability of n0 zeros and n1 ones, as a logarithm."""
    return _log_gamma(n0, 0.5, _HALF) + _log_gamma(n1, 0.5, _HALF) - _log_gamma(n0 + n1, 1.0, _WHOLE) - np.log(np.pi)


def grams(text: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Each byte with the ``depth`` bytes before it in its text, as one number; line feeds stand before a text."""
    g = np.zeros(len(text), dtype=U)
    for k in range(depth, -1, -1):
        g <<= U(8)
        if k:
            g[k:] |= text[:-k]
        else:
            g |= text
    starts, sizes = offsets[:-1], np.diff(offsets)
    for r in range(depth):  # the bytes whose context reaches over the start
        at = starts[sizes > r] + r
        value = np.zeros(len(at), dtype=U)
        for k in range(depth, -1, -1):
            value = value << U(8) | (text[at - k].astype(U) if k <= r else U(NEWLINE))
        g[at] = value
    return g


def deal_of(g: np.ndarray) -> np.ndarray:
    """A hash of the last TOP bytes of the context."""
    with np.errstate(over="ignore"):
        return mix((g >> U(8) & U((1 << 8 * TOP) - 1)) + U(1))


def spread_of(g: np.ndarray) -> np.ndarray:
    """A hash of whole grams."""
    with np.errstate(over="ignore"):
        return mix(g + U(1))


class Tree:
    """Nodes of depths ``top`` to ``depth``: contexts with the bits of the next byte that are known.

    For depth d and j known bits a node's key is its d context bytes and those bits; it holds
    the counts of the next bit, the logarithm of its weighted probability and the weight of
    its own estimate against that of its children.
    """

    def __init__(self, g: np.ndarray, n: np.ndarray, depth: int = DEPTH, top: int = TOP):
        self.depth, self.top, self.nodes = depth, top, {}
        for d in range(depth, top - 1, -1):
            g, n = _summed(g & U((1 << 8 * (d + 1)) - 1), n)
            for j in range(8):
                keys, group = np.unique(g >> U(8 - j), return_inverse=True)
                one = (g >> U(7 - j) & U(1)).astype(bool)
                n1 = np.bincount(group, weights=n * one, minlength=len(keys)).astype(np.int64)
                n0 = np.bincount(group, weights=n * ~one, minlength=len(keys)).astype(np.int64)
                own = log_kt(n0, n1)
                if d == depth:
                    log_w, weight = own, np.ones(len(keys))
                else:
                    below, _, _, child_w, _ = self.nodes[d + 1, j]
                    parent = np.searchsorted(keys, below & U((1 << 8 * d + j) - 1))
                    log_w, weight = weighted(own, np.bincount(parent, weights=child_w, minlength=len(keys)))
                self.nodes[d, j] = (keys, n0, n1, log_w, weight)

    def top_sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For nodes one level above the tree's: key (context byte, then 1 and the known bits), counts, and the summed logarithms of their children."""
        out = []
        for j in range(8):
            keys, n0, n1, log_w, _ = self.nodes[self.top, j]
            bits = keys & U((1 << j) - 1)
            parent = (keys >> U(j) & U((1 << 8 * (self.top - 1)) - 1)) << U(8) | bits | U(1 << j)
            out.append((parent, n0, n1, log_w))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(4))

    def probability(self, g: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The probability of bit j of the byte after each context, and whether the top context is known."""
        bit = (g >> U(7 - j) & U(1)).astype(bool)
        p, seen = np.full(len(g), 0.5), np.zeros(len(g), dtype=bool)
        for d in range(self.depth, self.top - 1, -1):
            keys, n0, n1, _, weight = self.nodes[d, j]
            p, seen = _mixed(keys, n0, n1, weight, (g & U((1 << 8 * (d + 1)) - 1)) >> U(8 - j), bit, p, seen)
        return p, seen


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of half of each, added, and the share of the first."""
    both = np.logaddexp(own, children)
    return both - np.log(2), np.exp(own - both)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, group = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(group, weights=n, minlength=len(distinct)).astype(np.int64)


def _mixed(keys, n0, n1, weight, key, bit, p, seen) -> tuple[np.ndarray, np.ndarray]:
    """One level up: a known node mixes its estimate with that of a known child; an unknown one leaves all to its parent."""
    if not len(keys):
        return p, seen
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    known = keys[at] == key
    q = (np.where(bit, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1.0)
    w = weight[at]
    return np.where(known, np.where(seen, w * q + (1 - w) * p, q), p), seen | known


class Top:
    """The nodes of contexts shorter than TOP bytes."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray):
        order = np.argsort(key)
        key, n0, n1, children = key[order], n0[order], n1[order], children[order]
        log_w, weight = weighted(log_kt(n0, n1), children)
        root, group = np.unique(key & U(255), return_inverse=True)
        sums = [np.bincount(group, weights=x, minlength=len(root)) for x in (n0, n1, log_w)]
        r0, r1 = sums[0].astype(np.int64), sums[1].astype(np.int64)
        self.levels = [(key, n0, n1, weight), (root, r0, r1, weighted(log_kt(r0, r1), sums[2])[1])]

    def mix(self, g: np.ndarray, j: int, p: np.ndarray, seen: np.ndarray) -> np.ndarray:
        bit = (g >> U(7 - j) & U(1)).astype(bool)
        bits = (g & U(255)) >> U(8 - j) | U(1 << j)
        for (keys, n0, n1, weight), context in zip(self.levels, ((g >> U(8) & U(255)) << U(8), U(0)), strict=True):
            p, seen = _mixed(keys, n0, n1, weight, context | bits, bit, p, seen)
        return p


def log_probabilities(tree: Tree, top: Top, g: np.ndarray) -> np.ndarray:
    """The natural logarithm of the probability of each gram's byte after its context."""
    total = np.zeros(len(g))
    for j in range(8):
        total += np.log(top.mix(g, j, *tree.probability(g, j)))
    return total


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """(first row, words, bytes, offsets) of each part: lower-cased words, one space between, a line feed at the end."""
    for row, _, data, offsets in steps(batch["text"]):
        words, text, at = one_blank(data, offsets, NEWLINE, lower=True)
        yield row, words, _LOWER[text], at


def gram_sums(asked: DataFrame, n: int, held_out: int) -> DataFrame:
    """(context, bucket, counts): each distinct gram once, with how often training chunks hold it.

    ``asked`` has the grams of all chunks dealt by ``spread_of``, so a bucket gets its even
    share of them; chunks from ``held_out`` on count for nothing. A bucket's grams are dealt
    out again, by ``deal_of``.
    """

    def run(table: pa.Table) -> pa.Table:
        sent, sizes = C.joined(table)
        learning = np.repeat(table["chunk"].to_numpy() < held_out, sizes)
        g, total = _summed(sent["gram"], sent["n"] * learning)
        order, bounds = C.ask_order(deal_of(g), n)
        g, total, full = g[order], total[order], np.flatnonzero(np.diff(bounds))
        counts = [C.pack(pa.RecordBatch.from_arrays([pa.array(x[bounds[b] : bounds[b + 1]]) for x in (g, total)], names=["gram", "n"])) for b in full]
        pa.default_memory_pool().release_unused()
        return pa.table({"context": pa.array(full, pa.int64()), "bucket": pa.array(np.full(len(full), table["bucket"][0].as_py()), pa.int64()), "counts": pa.array(counts, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "context long, bucket long, counts binary")


def _grown(table: pa.Table, depth: int) -> tuple[list[pa.RecordBatch], Tree]:
    """The sums that a group of contexts got, and the tree of those seen in training."""
    parts = [C.unpack(x.as_buffer()) for x in table["counts"]]
    g, total = (np.concatenate([np.asarray(p[c]) for p in parts]) for c in ("gram", "n"))
    return parts, Tree(g[total > 0], total[total > 0], depth)


def ctw_scores(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Scores all texts with a model of those for which ``learns`` (over ``id``) holds.

    A text is its lower-cased (A-Z) words with one space between and an end mark. Its bytes
    are predicted bit by bit; each bit's estimates in the contexts of 0 to ``depth`` bytes
    before it are mixed with the weights that context-tree weighting gives them on all
    training texts. Contexts never seen in training leave the estimate to shorter ones.

    Returns per row the id, ``n_tokens`` (words and one end), ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (log10 under add-half unigram counts of
    tokens), ``score`` (log10 of the text under the model), ``n_bytes`` and ``bits_per_byte``
    (code length). Null and empty texts are a lone end. Without training texts the model
    gives each bit one half. Repeated rows count as often as they stand. Chunks of documents
    send their grams to buckets of a hash of the whole gram, which sum them up; only these
    distinct sums are grouped by context, for the trees and for prices, and the buckets answer
    the chunks. So no group by context holds an entry per chunk.
    """

    def count(texts: pa.Array) -> int:
        return sum(len(data) for _, _, data, _ in steps(texts)) // 8

    prepared = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the sign of a second column can't be lost in a chunk, so training rows form chunks of their own
    chunks = [C.chunk_documents(prepared.where(cond), "id", "text", count) for cond in (F.coalesce(learns, F.lit(False)), ~F.coalesce(learns, F.lit(False)))]
    stride = C.CHUNK_NUMBERS
    chunks = chunks[0].union(chunks[1].withColumn("chunk", F.col("chunk") + stride))
    learning = F.col("chunk") < stride
    n = C.buckets_for(chunks)

    def distinct_grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.unique(grams(text, at, depth), return_counts=True) for _, _, text, at in _texts(batch)]
        return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def ask_counted(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        g, times = distinct_grams(batch)
        return {"deal": spread_of(g), "gram": g, "n": times}

    def ask_prices(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        g, _ = distinct_grams(batch)
        return {"deal": spread_of(g), "gram": g}

    def ask_words(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        h, times = np.unique(np.concatenate([Words(data, offsets, lower=True).hashes() for _, _, data, offsets in steps(batch["text"])]), return_counts=True)
        return {"hash": h, "n": times}

    def top_sums(table):
        key, n0, n1, children = _grown(table, depth)[1].top_sums()
        keys, group = np.unique(key, return_inverse=True)
        sums = [np.bincount(group, weights=x, minlength=len(keys)) for x in (n0, n1, children)]
        return pa.table([pa.array(keys.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), pa.array(sums[2].astype(np.float64))], ["k", "n0", "n1", "w"])

    model = materialize(gram_sums(C.ask(chunks, n, ask_counted), n, stride), "contexts")
    tops = model.groupBy("context").applyInArrow(top_sums, "k long, n0 long, n1 long, w double")
    sums = tops.groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("w")).toPandas()  # at most 65,280 rows
    top = docs.sparkSession.sparkContext.broadcast(Top(sums["k"].to_numpy(np.int64).astype(U), sums["n0"].to_numpy(np.int64), sums["n1"].to_numpy(np.int64), sums["w"].to_numpy(np.float64)))

    def price(table):
        parts, tree = _grown(table, depth)
        priced = []
        for p in parts:
            g = np.asarray(p["gram"])
            priced.append(C.pack(pa.RecordBatch.from_arrays([pa.array(g), pa.array(log_probabilities(tree, top.value, g).astype(np.float32))], names=["gram", "price"])))
        return pa.table({"bucket": table["bucket"], "priced": pa.array(priced, pa.binary())})

    def reply(asked, priced):
        sent, sizes = C.joined(asked)
        parts = [C.unpack(x.as_buffer()) for x in priced["priced"]]
        g, value = (np.concatenate([np.asarray(p[c]) for p in parts]) for c in ("gram", "price"))
        order = np.argsort(g)
        return C.replies_to(asked, value[order][np.searchsorted(g[order], sent["gram"])], sizes)

    priced = model.groupBy("context").applyInArrow(price, "bucket long, priced binary")
    prices = C.by_chunk(C.ask(chunks, n, ask_prices).groupBy("bucket").cogroup(priced.groupBy("bucket")).applyInArrow(reply, C.REPLY_SCHEMA))

    # the base: how often training texts hold each word; held-out chunks ask with a count of 0
    def ask_counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        sent = ask_words(batch)
        return sent | {"n": sent["n"] * 0}

    def word_counts(table):
        sent, sizes = C.joined(table)
        _, place = np.unique(sent["hash"], return_inverse=True)
        total = np.bincount(place, weights=sent["n"]).astype(np.int64)
        out = C.replies_to(table, total[place], sizes)
        return out.append_column("known", pa.array(np.full(len(sizes), np.count_nonzero(total)), pa.int64())).append_column("tokens", pa.array(np.full(len(sizes), total.sum()), pa.int64()))

    asked = C.ask(chunks.where(learning), n, ask_words).union(C.ask(chunks.where(~learning), n, ask_counts))
    replies = materialize(asked.groupBy("bucket").applyInArrow(word_counts, C.REPLY_SCHEMA + ", known long, tokens long"), "counts")
    per_bucket = replies.groupBy("bucket").agg(F.first("known").alias("known"), F.first("tokens").alias("tokens"))
    known, tokens = per_bucket.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).head()
    ends = prepared.where(learns).count()
    vocabulary, tokens = known + (ends > 0), tokens + ends
    least = tokens + 0.5 * (vocabulary + 1)

    def scored(batch: pa.RecordBatch, _key: int, price_of, count_of) -> Iterator[pa.RecordBatch]:
        parts = [(row, words, at, *np.unique(grams(text, at, depth), return_inverse=True)) for row, words, text, at in _texts(batch)]
        g = np.unique(np.concatenate([p[3] for p in parts]))
        log_p = price_of(spread_of(g)).astype(np.float64)
        hashed = [np.unique(p[1].hashes(), return_inverse=True) for p in parts]
        h = np.unique(np.concatenate([p[0] for p in hashed]))
        counts = count_of(h).astype(np.int64)
        ids = np.asarray(batch["id"])
        for (row, words, at, own_g, place), (own_h, word) in zip(parts, hashed, strict=True):
            own = ids[row : row + len(at) - 1]
            bits = np.add.reduceat(log_p[np.searchsorted(g, own_g)][place], at[:-1])
            c = counts[np.searchsorted(h, own_h)][word] if len(word) else np.zeros(0, np.int64)
            n_words = np.diff(words.bounds)
            base = np.bincount(words.doc, weights=np.log10((c + 0.5) / least), minlength=len(own)) + np.log10((ends + 0.5) / least)
            seen = np.bincount(words.doc[c > 0], minlength=len(own)) + (ends > 0)
            n_bytes = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64(), mask=own == C.NO_ID), pa.array(n_words + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(np.full(len(own), tokens), pa.int64()), pa.array(base), pa.array(bits / np.log(10)), pa.array(n_bytes, pa.int64()), pa.array(-bits / np.log(2) / n_bytes)],
                names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
            )

    schema = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return C.answered(chunks, [prices, C.by_chunk(replies)], n, scored, schema).withColumnRenamed("id", id_col)
