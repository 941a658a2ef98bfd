"""Small building blocks over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda would run once per element; bound as a
    lambda variable it runs once, and the optimizer cannot inline it again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(values: Column) -> Column:
    """Running sums of an ``array<bigint>``, in n·sqrt(n) steps and without copies."""

    def with_chunks(s: Column) -> Column:
        chunk_ids = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.size(s["a"]) / s["b"]) - 1)
        total = lambda arr: F.aggregate(arr, F.lit(0).cast("bigint"), lambda x, y: x + y)
        chunk_sums = F.transform(chunk_ids, lambda c: total(F.slice(s["a"], (c * s["b"] + 1).cast("int"), s["b"].cast("int"))))
        carried = let(chunk_sums, lambda t: F.transform(t, lambda _, c: total(F.slice(t, F.lit(1), c))))

        def at(carry: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                c = F.floor(i / s["b"]).cast("int")
                inside = total(F.slice(s["a"], (c * s["b"] + 1).cast("int"), (i - c * s["b"] + 1).cast("int")))
                return F.get(carry, c) + inside

            return F.transform(s["a"], one)

        return let(carried, at)

    empty = F.array().cast("array<bigint>")
    return let(values, lambda v: F.when(F.size(v) == 0, empty).otherwise(let(_in_chunks(v), with_chunks)))


def _in_chunks(values: Column) -> Column:
    """Values as ``a``, and as ``b`` how many of them make a chunk."""
    return F.struct(values.alias("a"), F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).alias("b"))


def scan_array(values: Column, start: Column, state_type: str, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(state, value)`` puts out for each element, in order; it gives the next state and the output.

    The state passes from element to element within the row. Outputs are gathered in chunks,
    so that n of them take n·sqrt(n) copies.
    """
    many = lambda kind: F.array().cast(f"array<{kind}>")

    def bind(s: Column) -> Column:
        def inner(held: Column, value: Column) -> Column:
            def put(r: Column) -> Column:
                return F.struct(r["s"].cast(state_type).alias("s"), F.concat(held["o"], F.array(r["o"].cast(out_type))).alias("o"))

            def run(state: Column) -> Column:
                after, out = step(state, value)
                return F.struct(after.alias("s"), out.alias("o"))

            return let(let(held["s"], run), put)

        def outer(held: Column, chunk: Column) -> Column:
            part = F.slice(s["a"], (chunk * s["b"] + 1).cast("int"), s["b"].cast("int"))
            done = F.aggregate(part, F.struct(held["s"].alias("s"), many(out_type).alias("o")), inner)
            return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(held["o"], F.array(d["o"])).alias("o")))

        chunks = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.size(s["a"]) / s["b"]) - 1)
        return F.flatten(F.aggregate(chunks, F.struct(start.cast(state_type).alias("s"), many(f"array<{out_type}>").alias("o")), outer)["o"])

    return let(values, lambda v: F.when(F.size(v) == 0, many(out_type)).otherwise(let(_in_chunks(v), bind)))


#: Blocks of Unicode non-characters. They may stand in a text, so a free block is chosen for each.
MARKS = ["".join(chr(0xFDD0 + 5 * k + i) for i in range(5)) for k in range(6)]


def with_marks(text: Column, n: int, body: Callable[[Column, list[Column]], Column]) -> Column:
    """``body(text, marks)`` with ``n`` (up to 5) symbols that do not occur in the text.

    A text that holds a symbol of every block raises an error.
    """
    given = F.coalesce(text, F.lit(""))
    free = F.when(~given.rlike("[\ufdd0-\ufdef]"), F.lit(MARKS[0]))
    for block in MARKS:
        free = free.when(~given.rlike(f"[{block}]"), F.lit(block))
    free = free.otherwise(F.raise_error(F.lit("the text holds a symbol of each block of marks")))
    marks = lambda m: [F.substring(m, i + 1, 1) for i in range(n)]
    return let(F.struct(text.alias("t"), free.alias("m")), lambda s: body(s["t"], marks(s["m"])))


def match_parts(text: Column, pattern: str) -> Column:
    """Text cut at the matches of ``pattern``: literal, match, literal, ...

    Matches sit at odd positions; joined, the parts give the text again.
    """

    def parts(t: Column, m: list[Column]) -> Column:
        marked = F.regexp_replace(t, F.lit(pattern), F.concat(m[0], F.lit("$0"), m[1]))
        return F.split(marked, F.concat(F.lit("["), m[0], m[1], F.lit("]")))

    return with_marks(text, 2, parts)
