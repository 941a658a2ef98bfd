"""Grids as ``array<array<string>>`` columns: CSV, edits, sorting, text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, with_marks
from .text import _col, natural_key, xml_escape

def csv_to_cells(text: Column | str) -> Column:
    r"""Rows of cells from CSV text.

    ``\`` escapes any character; ``"`` only switches string mode; a row ends at
    LF outside strings, so a last row without LF is lost; NUL ends the input.
    Every step is linear in the text and runs without regex recursion.
    """

    def cells(t: Column, m: list[Column]) -> Column:
        quote, comma, lf, backslash = m
        # An escape run is read in pairs from its left end.
        for pattern, put in [(r"\\\\", backslash), (r'\\"', quote), (r"\\,", comma), (r"\\\n", lf), (r"\\", F.lit(""))]:
            t = F.regexp_replace(t, F.lit(pattern), put)
        translate = lambda x, old, new: F.call_function("translate", x, old, new)
        quoted = F.transform(
            F.split(t, '"'),
            lambda part, i: F.when(i % 2 == 1, translate(part, F.lit(",\n"), F.concat(comma, lf))).otherwise(part),
        )
        rows = F.split(F.array_join(quoted, ""), "\n")
        rows = F.slice(rows, F.lit(1), F.size(rows) - 1)
        restore = lambda cell: translate(cell, F.concat(quote, comma, lf, backslash), F.lit('",\n\\'))
        return F.transform(rows, lambda row: F.transform(F.split(row, ","), restore))

    return with_marks(F.substring_index(_col(text), "\x00", 1), 4, cells)


def pad_cells(cells: Column) -> Column:
    """Every row padded or cut to the width of the first."""
    def padded(s: Column) -> Column:
        return F.transform(s["cells"], lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), s["width"])), F.lit(1), s["width"]))

    return let(cells, lambda c: let(F.struct(c.alias("cells"), F.size(F.get(c, F.lit(0))).alias("width")), padded))


def cells_to_csv(cells: Column) -> Column:
    def cell(x: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))

    return F.array_join(
        F.transform(cells, lambda row: F.concat(F.array_join(F.transform(row, cell), ","), F.lit("\n"))), ""
    )


def cells_to_text(cells: Column) -> Column:
    """Plain text form: a line feed, then ``| a | b |`` per row."""
    row = lambda r: F.concat(F.lit("|"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(" "), c, F.lit(" |"))), ""), F.lit("\n"))
    return F.concat(F.lit("\n"), F.array_join(F.transform(cells, row), ""))


def cells_to_html(cells: Column) -> Column:
    """``<table>`` with a header row; empty cells hold one space."""
    def row(r: Column, i: Column) -> Column:
        tag = F.when(i == 0, F.lit("th")).otherwise(F.lit("td"))
        cell = lambda c: F.concat(F.lit("<"), tag, F.lit(">"), F.when(c == "", F.lit(" ")).otherwise(xml_escape(c)), F.lit("</"), tag, F.lit(">"))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))

    return F.concat(F.lit('<table class="table">'), F.array_join(F.transform(cells, row), ""), F.lit("</table>"))


def header_last(cells: Column) -> Column:
    """Header row moved to the end, as stores keep it."""
    n = F.size(cells)
    return F.concat(F.slice(cells, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(cells, 1, 1))


def header_first(cells: Column) -> Column:
    """Last row (the header, as stored) moved to the front."""
    n = F.size(cells)
    return F.concat(F.slice(cells, -1, 1), F.slice(cells, F.lit(1), F.greatest(n - 1, F.lit(0))))


def cell_index(row: Column, col: Column, ncols: Column) -> Column:
    return (ncols * row + col).cast("long")


def cell_row_col(index: Column, ncols: Column) -> Column:
    return F.struct(F.floor(index / ncols).cast("long").alias("row"), (index % ncols).cast("long").alias("col"))


def _put(arr: Column, at: int, item: Column) -> Column:
    """``arr`` with ``item`` inserted before 0-based position ``at``."""
    return F.concat(F.slice(arr, F.lit(1), F.lit(at)), F.array(item), F.slice(arr, F.lit(at + 1), F.greatest(F.size(arr) - at, F.lit(0))))


def row_add(cells: Column, after: int, new: Column | None = None) -> Column:
    """A row after row ``after``; cells the donor lacks are empty."""
    width = F.size(F.get(cells, F.lit(0)))
    blank = F.array_repeat(F.lit(""), width)
    row = blank if new is None else F.slice(F.concat(new, blank), F.lit(1), width)
    return _put(cells, after + 1, row)


def row_delete(cells: Column, at: int) -> Column:
    """Without row ``at``; the last row is never deleted."""
    return F.when(F.size(cells) <= 1, cells).otherwise(F.filter(cells, lambda _, i: i != at))


def _swap(arr: Column, a: int, b: int) -> Column:
    return F.when((F.size(arr) > max(a, b)) & F.lit(min(a, b) >= 0), F.transform(
        arr, lambda x, i: F.when(i == a, F.get(arr, F.lit(max(b, 0)))).when(i == b, F.get(arr, F.lit(max(a, 0)))).otherwise(x)
    )).otherwise(arr)


def row_move(cells: Column, at: int, up: bool) -> Column:
    return _swap(cells, at, at - 1 if up else at + 1)


def column_add(cells: Column, after: int, new: Column | None = None) -> Column:
    donor = F.array().cast("array<string>") if new is None else new
    return F.transform(cells, lambda row, i: _put(row, after + 1, F.coalesce(F.get(donor, i), F.lit(""))))


def column_delete(cells: Column, at: int) -> Column:
    return F.when(F.size(F.get(cells, F.lit(0))) <= 1, cells).otherwise(
        F.transform(cells, lambda row: F.filter(row, lambda _, i: i != at))
    )


def column_move(cells: Column, at: int, left: bool) -> Column:
    return F.transform(cells, lambda row: _swap(row, at, at - 1 if left else at + 1))


def paste_row(cells: Column, after: int, donor: Column) -> Column:
    """The first row of another grid, pasted after row ``after``."""
    return row_add(cells, after, F.get(donor, F.lit(0)))


def paste_column(cells: Column, after: int, donor: Column) -> Column:
    """The first column of another grid, pasted after column ``after``."""
    return column_add(cells, after, F.transform(donor, lambda row: F.get(row, F.lit(0))))


def sort_rows(cells: Column, ascending: bool = True) -> Column:
    """Rows after the header in natural order of all columns; ties keep their order."""
    body = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))
    n = F.size(body)
    keyed = F.transform(
        body,
        lambda row, i: F.struct(
            F.transform(row, natural_key).alias("k"), (i if ascending else n - i).alias("i"), row.alias("r")
        ),
    )
    ordered = F.sort_array(keyed, asc=ascending)
    return F.concat(F.slice(cells, 1, 1), F.transform(ordered, lambda s: s["r"]))
