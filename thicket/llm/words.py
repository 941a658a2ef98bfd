"""Words, windows and their hashes over whole Arrow batches, without a loop over words.

A word is a run of code points outside ``[\\x20\\x09-\\x0D]``; all separators are ASCII, so
the work is done on UTF-8 bytes. Hashes are polynomials modulo 2**64 over random byte
values, mixed at the end. Words meet in 64 bits, so among n different windows about
n**2 / 2**65 pairs are wrongly taken for equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once; bounds the scratch arrays of a task to some 50 MB.
STEP = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers drawn by splitmix64."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base and of its inverse modulo 2**64, n of each."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        n = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, U(b), dtype=U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U))
        known = _POWERS[base] = (made[0], made[1])
    return known[0][:n], known[1][:n]


def polynomial(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of values[start:end] for each span, whatever its place."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up[: len(values)], dtype=U, out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


#: Bytes between words; and, for words of a classifier, all ASCII but letters and digits.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE_BASE, WORD_BASE = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D


class Words:
    """The words of some documents: byte spans, document of each, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, seed: int = 1, between: np.ndarray = SPACE):
        self.data, self.offsets, self.lower, self.seed = data, offsets, lower, seed
        ink = ~between[data]
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        first[edges] = ink[edges]
        last = ink.copy()
        last[:-1] &= ~ink[1:]
        last[edges - 1] = ink[edges - 1]
        self.ink = ink
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        #: Index of the first word of each document, and one past the last.
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, block by block of the text."""
        table = random_words(256, self.seed)
        if self.lower:
            table = table[LOWER]
        out = np.empty(len(self.starts), dtype=U)
        first = 0
        while first < len(out):
            end = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + STEP)))
            lo = self.starts[first]
            with np.errstate(over="ignore"):
                out[first:end] = mix(polynomial(table[self.data[lo : self.ends[end - 1]]], self.starts[first:end] - lo, self.ends[first:end] - lo, BYTE_BASE))
            first = end
        return out

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of all windows of ``width`` words, and the first word of each."""
        n = len(self.starts)
        if n < width:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])
        with np.errstate(over="ignore"):
            return mix(polynomial(self.hashes(), at, at + width, WORD_BASE)), at


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - (offsets[0] if len(offsets) else 0)


def steps(column: pa.Array, limit: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``limit`` bytes, one row at least."""
    data, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def join_words(words: Words, stay: np.ndarray, tail: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts made of the words that stay, one space between; each ends with ``tail``, if given."""
    n = len(words.offsets) - 1
    starts, doc = words.starts[stay], words.doc[stay]
    lengths = words.ends[stay] - starts
    last = np.concatenate([doc[1:] != doc[:-1], [True]])[: len(doc)]
    size = lengths + (1 if tail is not None else ~last)
    lone = (np.bincount(doc, minlength=n) == 0).astype(np.int64) if tail is not None else np.zeros(n, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=n).astype(np.int64) + lone)])
    to = np.cumsum(size) - size + np.cumsum(lone)[doc]
    text = np.full(offsets[-1], 0x20 if tail is None else tail, dtype=np.uint8)
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[np.repeat(to, lengths) + inside] = words.data[np.repeat(starts, lengths) + inside]
    text[(to + lengths)[~last]] = 0x20
    return text, offsets


def one_blank(data: np.ndarray, offsets: np.ndarray, tail: int, lower: bool = False) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of some texts, and bytes and offsets of the texts with one space between words and ``tail`` at the end.

    As ``join_words`` of all words, without touching each byte more than a few times.
    """
    data, offsets = np.insert(data, offsets[1:], tail), offsets + np.arange(len(offsets))
    words = Words(data, offsets, lower)
    between = np.ones(len(words.ends), dtype=bool)
    between[words.bounds[1:][np.diff(words.bounds) > 0] - 1] = False
    blanks = words.ends[between]
    keep = words.ink.copy()
    keep[blanks] = True
    keep[offsets[1:] - 1] = True
    data[blanks] = 0x20
    return words, data[keep], np.concatenate([[0], np.cumsum(np.add.reduceat(keep.astype(np.int64), offsets[:-1]))])
