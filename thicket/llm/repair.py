"""Repair of conversations whose turns break the order of roles, by weighted CYK over spans of rows.

The roles of a whole conversation are to read ``(s?(ua)+)?``. As a grammar in Chomsky normal
form: a nonterminal (i, k) stands for the edited rows that lead from state i to state k of
that pattern, with rules (i, k) -> (i, j)(j, k), and terminal rules for each edit of a row. A
span's cell holds, per nonterminal, its minimum (cost, audit). Every derivation of a span
passes through some state at any place where it is cut, so one cut per span gives the
minimum of all; spans are therefore built bottom-up by length 1, 2, 4, ... and, beyond a
block, sixteen by sixteen. Equal costs never come from audits of which one begins with the
other, as a longer one has insertions more; so the least audit of a span is made of the least
audits of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.plans import scan
from thicket.session import materialize

#: Costs of edits, and of a truncated row that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a conversation in a block, and blocks that are combined at a time.
BLOCK, FAN = 256, 16
#: States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
STATES, START, ENDS = 4, 0, (0, 3)
STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
LEGAL = ("su", "ua", "au")
KINDS = ("blank", "duplicate", "truncated")

Cell = tuple  # STATES * STATES entries, each (cost, audit) or None


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjoining spans."""
    out = []
    for i in range(STATES):
        for k in range(STATES):
            found = [(a[0] + b[0], a[1] + b[1]) for j in range(STATES) if (a := left[i * STATES + j]) and (b := right[j * STATES + k])]
            out.append(min(found, default=None))
    return tuple(out)


def _cell(rules: list[tuple[int, int, int, str]]) -> Cell:
    out = [None] * (STATES * STATES)
    for i, k, cost, letter in rules:
        at = i * STATES + k
        out[at] = min(filter(None, (out[at], (cost, letter))))
    return tuple(out)


def insertions() -> Cell:
    """The empty span: nothing, or rows put in; closed under repetition."""
    one = _cell([(i, i, 0, "") for i in range(STATES)] + [(i, k, INSERT, "I") for r in "ua" for i, k in STEPS[r]])
    while (more := combine(one, one)) != one:
        one = more
    return one


CLOSED = insertions()
#: A row's code: its initial (x for others) and what is wrong with it, as one letter.
INITIALS, FAULTS = "suax", ("", "gone", "truncated")
CODES = {chr(ord("A") + n + len(INITIALS) * f): (i, fault) for n, i in enumerate(INITIALS) for f, fault in enumerate(FAULTS)}


@lru_cache(maxsize=1 << 16)
def span_cell(code: str) -> Cell:
    """The cell of a span, given the codes of its rows."""
    if not code:
        return CLOSED
    if len(code) > 1:
        cut = 1 << (len(code) - 1).bit_length() - 1
        return combine(span_cell(code[:cut]), span_cell(code[cut:]))
    initial, fault = CODES[code]
    rules = [(i, i, DELETE, "D") for i in range(STATES)]
    if fault != "gone":
        more = TRUNCATED if fault else 0
        rules += [(i, k, more, "K") for i, k in STEPS.get(initial, [])]
        rules += [(i, k, REROLE + more, "R") for r in "ua" for i, k in STEPS[r]]
    return combine(combine(CLOSED, _cell(rules)), CLOSED)


CELL = "array<struct<at:int,cost:long,audit:string>>"
SPAN_SCHEMA = f"conv string, block long, first string, last string, illegal long, cell {CELL}"


def _dense(cell: list[dict]) -> Cell:
    out = [None] * (STATES * STATES)
    for e in cell:
        out[e["at"]] = (e["cost"], e["audit"])
    return tuple(out)


def _sparse(cell: Cell) -> list[dict]:
    return [{"at": n, "cost": e[0], "audit": e[1]} for n, e in enumerate(cell) if e]


def _illegal(initials: str) -> int:
    return sum(initials[n : n + 2] not in LEGAL for n in range(len(initials) - 1))


def _of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The span of each block, from its code."""
    for batch in batches:
        out = []
        for conv, block, code in zip(*(batch[c].to_pylist() for c in ("conv", "block", "code")), strict=True):
            initials = "".join(CODES[c][0] for c in code)
            out.append((conv, block, initials[:1], initials[-1:], _illegal(initials), _sparse(span_cell(code))))
        yield _batch(out)


def _of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The span of up to FAN adjoining spans."""
    for batch in batches:
        out = []
        for conv, block, parts in zip(*(batch[c].to_pylist() for c in ("conv", "block", "parts")), strict=True):
            cells = [_dense(p["cell"]) for p in parts]
            while len(cells) > 1:
                cells = [combine(*cells[n : n + 2]) if n + 1 < len(cells) else cells[n] for n in range(0, len(cells), 2)]
            seams = sum(_illegal(a["last"] + b["first"]) for a, b in zip(parts, parts[1:], strict=False))
            out.append((conv, block, parts[0]["first"], parts[-1]["last"], seams + sum(p["illegal"] for p in parts), _sparse(cells[0])))
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    entry = pa.struct([("at", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    kinds = {"conv": pa.string(), "block": pa.int64(), "first": pa.string(), "last": pa.string(), "illegal": pa.int64(), "cell": pa.list_(entry)}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds.values())], names=list(kinds))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the repaired conversations, from the audits: their place among the rows before, and new roles."""
    for batch in batches:
        for conv, audit in zip(batch["conv"].to_pylist(), batch["audit"].to_pylist(), strict=True):
            length = len(audit) - audit.count("D")
            system, place, at = length % 2, 0, 0
            out: tuple[list, list, list, list] = ([], [], [], [])
            for letter in audit:
                place += letter != "I"
                if letter == "D":
                    continue
                role = None if letter == "K" else "user" if (at - system) % 2 == 0 else "assistant"
                for held, value in zip(out, (at, None if letter == "I" else place, letter, role), strict=True):
                    held.append(value)
                at += 1
                if len(out[0]) == 10_000 or at == length:
                    arrays = [pa.array([conv] * len(out[0])), *(pa.array(held, kind) for held, kind in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["conv", "at", "place", "edit", "new_role"])
                    out = ([], [], [], [])


def _conv(conv_col: str) -> Column:
    """The id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("+"), F.col(conv_col).cast("string")), F.lit("-"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Damages one row in four by a checksum of its id and turn; a null role or text is one blank.

    0 drops a row, 1 empties its text, 2 removes its marks ``.!?``, 3 repeats it, 4 makes its
    role user; the checksum is taken modulo 20.
    """
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("kind"),
    ).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations (conv_id, turn, role, text); roles are judged by their first letter.

    Rows stand in order of turn, nulls first, then of role and text; a null role or text is
    one blank. A row's first fault counts: blank (no ink), duplicate (role and text seen
    earlier), truncated (the last ink isn't one of ``.!?``). Edits: Keep 0, Rerole to user or
    assistant 1, Delete 2 (blank and duplicate rows must go), Insert an empty user or
    assistant row 5; a truncated row that stays costs 5 more. The cheapest edits win that
    make the initials ``(s?(ua)+)?``; of equals those whose initials come first in ASCII.

    Returns two frames. Per conversation that has rows: ``conv_id``, ``gaps`` (turns missing
    between the first and the last), ``blank``, ``duplicate``, ``truncated``, ``illegal``
    (neighbours whose initials aren't su, ua or au), ``cost``, ``audit``. And per row of the
    repaired conversations: ``conv_id``, ``at`` (from 0), ``edit`` (K, R or I), ``role``,
    ``text``. A null conv_id is a conversation of its own; an empty table gives no rows;
    equal rows are duplicates of the first; other columns aren't carried.

    A conversation may hold any share of the rows: they are numbered over ranges, and its
    blocks are combined ``fan`` at a time. Only its audit, one row of the result, is whole.
    """
    blank = F.lit(" ")
    rows = rows.select(
        _conv("conv_id").alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    # a number of their own keeps equal rows apart, so that they too spread over ranges
    rows = materialize(rows.withColumn("own", F.monotonically_increasing_id()), "rows")
    rows = scan.numbered(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("own")], "place").drop("own")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    seen = F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)
    rows = materialize(rows.withColumn("last", last).withColumn("seen", seen), "numbered")
    slim = rows.select("conv", "conv_id", "place", "seen", "last", F.substring("role", 1, 1).alias("initial"))
    firsts = slim.groupBy("conv", "seen").agg(F.min("place").alias("first"))
    slim = slim.join(firsts, ["conv", "seen"]).withColumn(
        "fault", F.when(F.col("last") == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    )
    n = F.when(F.col("initial").isin(*INITIALS[:-1]), F.instr(F.lit(INITIALS), F.col("initial")) - 1).otherwise(len(INITIALS) - 1)
    f = F.when(F.col("fault") == "", 0).when(F.col("fault") == "truncated", 2).otherwise(1)
    slim = slim.withColumn("code", F.char(F.lit(ord("A")) + n + f * len(INITIALS)))
    blocks = slim.withColumn("block", F.floor((F.col("place") - 1) / block)).groupBy("conv", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x.code), "").alias("code"),
        F.first("conv_id").alias("conv_id"), *[F.count_if(F.col("fault") == x).alias(x) for x in KINDS],
    )
    blocks = materialize(blocks, "blocks")
    spans = blocks.select("conv", "block", "code").mapInArrow(_of_blocks, SPAN_SCHEMA)
    last_block = blocks.agg(F.max("block")).head()[0]
    while last_block:
        parts = F.array_sort(F.collect_list(F.struct("block", "first", "last", "illegal", "cell"))).alias("parts")
        spans = materialize(spans.groupBy("conv", F.floor(F.col("block") / fan).alias("block")).agg(parts).mapInArrow(_of_parts, SPAN_SCHEMA), "spans")
        last_block //= fan
    ends = F.filter("cell", lambda x: x["at"].isin(*[START * STATES + k for k in ENDS]))
    best = F.array_min(F.transform(ends, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
    whole = spans.select("conv", "illegal", best.alias("best")).select("conv", "illegal", "best.cost", "best.audit")
    summary = materialize(_counts(rows, blocks).join(whole, "conv"), "summary")
    edits = summary.select("conv", "audit").mapInArrow(_edits, "conv string, at long, place long, edit string, new_role string")
    texts = rows.select("conv", "place", "role", "text")
    repaired = edits.join(texts, ["conv", "place"], "left").join(summary.select("conv", "conv_id"), "conv")
    repaired = repaired.select("conv_id", "at", "edit", F.coalesce("new_role", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
    return summary.drop("conv"), repaired


def _counts(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(conv, conv_id, gaps, blank, duplicate, truncated) of each conversation."""
    faults = blocks.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), *[F.sum(x).alias(x) for x in KINDS])
    turns = rows.select("conv", F.col("turn").cast("decimal(20,0)").alias("turn")).distinct().groupBy("conv")
    missing = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return faults.join(turns.agg(F.least(missing, F.lit((1 << 63) - 1)).cast("long").alias("gaps")), "conv")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of each conversation's rows as ``role:text`` lines."""
    lines = F.array_sort(F.collect_list(F.struct("at", F.concat_ws(":", "role", "text").alias("line"))))
    return repaired.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(lines, lambda x: x.line), "\n"), 256).alias("repaired_sha256"))
