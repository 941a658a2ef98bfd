"""String functions as Column expressions: no Python runs on the executors."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import with_marks
from ..model import LINE_CONTENT_LIMIT, MAX_FILE_NAME_BYTES, TIMESTAMP_FORMAT


# Accented letters, and below each the letter it folds to. Search results depend on them.
ACCENTS_SRC = (
    "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨ"
    "ĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽžḄḅḌḍḤḥḲḳḶḷṂṃṆṇṚṛṢṣṬ"
    "ṭẈẉẒẓẠạẸẹỊịỌọỤụỴỵđĐħĦıŀĿłŁŉøØŧŦ"
)
ACCENTS_DST = (
    "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhI"
    "iIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZzBbDdHhKkLlMmNnRrSsT"
    "tWwZzAaEeIiOoUuYydDhHilLlLnoOtT"
)

#: A word is a run of letters, digits and underscores.
WORD = r"[\p{L}\p{N}_]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_literal(text: str) -> str:
    """``text`` as a pattern that matches just itself, in any regex dialect used here."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", text, flags=re.ASCII) if text.isascii() else "".join(
        "\\" + ch if ch.isascii() and not ch.isalnum() and not ch.isspace() else ch for ch in text
    )


def replacement_literal(text: str) -> str:
    """``text`` as a replacement without group references."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def symbols(c: Column | str) -> Column:
    """The code points of ``c`` as an array of one-symbol strings."""
    return F.regexp_extract_all(_col(c), F.lit("(?s)."), F.lit(0))


def fold_accents(c: Column | str) -> Column:
    """Accented Latin letters to ASCII, one for one, so offsets stay valid."""
    return F.translate(_col(c), ACCENTS_SRC, ACCENTS_DST)


def natural_key(c: Column | str) -> Column:
    """A string whose order is natural order: digit runs compare as numbers."""

    def part(x: Column) -> Column:
        digits = F.ltrim(x, F.lit("0"))
        return F.when(
            x.rlike(r"^\d"), F.concat(F.lit("\x01"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        ).otherwise(x)

    return F.array_join(F.transform(F.regexp_extract_all(_col(c), F.lit(r"(\d+|\D+)"), F.lit(1)), part), "")


def xml_escape(c: Column | str) -> Column:
    out = _col(c)
    for char, entity in [("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;")]:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def sanitize_xml(c: Column | str) -> Column:
    """Drop characters that XML 1.0 does not allow."""
    return F.regexp_replace(
        _col(c), r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", ""
    )


def swap_case(c: Column | str) -> Column:
    return F.array_join(
        F.transform(symbols(c), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), ""
    )


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(WORD)).cast("long")


def line_number(text: Column | str, offset: Column | int) -> Column:
    """1-based number of the line that holds code point ``offset``."""
    head = F.substring(_col(text), F.lit(1), _as_col(offset))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1).cast("long")


def _as_col(v: Column | int) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def clip(c: Column, limit: int = LINE_CONTENT_LIMIT) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit), F.lit("...")))


def line_at(text: Column | str, offset: Column | int) -> Column:
    """The line holding ``offset``, cut to 100 symbols; empty at offset 0."""
    t, off = _col(text), _as_col(offset)
    head = F.substring_index(F.substring(t, F.lit(1), off), "\n", -1)
    tail = F.substring_index(F.substring(t, off + 1, F.length(t)), "\n", 1)
    return F.when(off == 0, F.lit("")).otherwise(clip(F.concat(head, tail)))


def first_line(text: Column | str) -> Column:
    """First line that is not empty, cut to 100 symbols."""
    return clip(F.substring_index(F.ltrim(_col(text), F.lit("\n")), "\n", 1))


def is_url(c: Column | str) -> Column:
    return _col(c).rlike(r"^(mailto:|\p{L}*://)")


def is_camel_case(c: Column | str) -> Column:
    """All letters or digits, going from lower to upper and to lower case again."""
    return _col(c).rlike(r"^[\p{L}\p{N}]+$") & _col(c).rlike(r"\p{Ll}.*\p{Lu}.*\p{Ll}")


def header_anchor_level(c: Column | str) -> Column:
    # try_cast: a run of digits may be longer than any number type
    level = F.regexp_extract(_col(c), r"h(\d+)-\d+", 1).try_cast("long")
    return F.when(level.between(1, 6), level).otherwise(F.lit(0)).cast("long")


def safe_file_name(c: Column | str) -> Column:
    kept = F.translate(_col(c), '/\\*?:<>|"\n\r', "--")
    return F.replace(unicode_trim(kept), F.lit(" "), F.lit("_"))


def hier_name(
    names: Column,
    sep: str = "--",
    for_filename: bool = True,
    root_to_leaf: bool = True,
    node_id: Column | None = None,
    trailer: str = "",
    html: bool = False,
) -> Column:
    """Trimmed names of a root-to-leaf array joined by ``sep``.

    File names are cleaned and keep their last 142 bytes (whole symbols only).
    """
    trimmed = F.transform(names, unicode_trim)
    out = F.array_join(trimmed if root_to_leaf else F.reverse(trimmed), sep)
    if node_id is not None:
        out = F.concat(out, F.lit("_"), node_id.cast("string"))
    if trailer:
        out = F.concat(out, F.lit(trailer))
    if for_filename:
        out = safe_file_name(out)
        tail = F.make_valid_utf8(F.substring(F.encode(out, "UTF-8"), -MAX_FILE_NAME_BYTES, MAX_FILE_NAME_BYTES).cast("string"))
        out = F.when(F.octet_length(out) <= MAX_FILE_NAME_BYTES, out).otherwise(
            F.regexp_replace(tail, "^\ufffd+", "")
        )
    if html:
        out = F.replace(out, F.lit("#"), F.lit("~"))
    return out


def split_compress(c: Column | str, sep: str, compress: bool = True) -> Column:
    parts = F.split(_col(c), regex_literal(sep))
    return F.filter(parts, lambda x: x != "") if compress else parts


def join_numbers(c: Column | str, sep: str = " ") -> Column:
    return F.array_join(F.transform(_col(c), lambda x: x.cast("string")), sep)


def to_int(c: Column) -> Column:
    """Leading integer of a text: decimal, hexadecimal when it holds ``0x``, else 0."""
    hexa = F.conv(F.regexp_extract(c, r"^\s*[+-]?(?:0[xX])?([0-9a-fA-F]*)", 1), 16, 10).try_cast("long")
    deci = F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.coalesce(F.when(c.contains("0x"), hexa).otherwise(deci), F.lit(0)).cast("long")


def split_ints(c: Column | str, sep: str = ",") -> Column:
    return F.transform(F.split(_col(c), regex_literal(sep)), to_int)


def is_true(c: Column | str) -> Column:
    return (F.lower(_col(c)) == "true") | (_col(c) == "1")


def highlight_words(c: Column | str, words: list[str], tag: str = "b") -> Column:
    """XML-escape the text and wrap each match of a word, any case, in ``tag``.

    Matches are marked before escaping, so that words never match inside an
    entity; the marks are symbols that the text does not hold.
    """
    if not words:
        return xml_escape(c)
    pattern = "(?iu)(" + "|".join(regex_literal(w) for w in words) + ")"

    def wrap(t: Column, m: list[Column]) -> Column:
        marked = F.regexp_replace(t, F.lit(pattern), F.concat(m[0], F.lit("$1"), m[1]))
        return F.replace(F.replace(xml_escape(marked), m[0], F.lit(f"<{tag}>")), m[1], F.lit(f"</{tag}>"))

    return with_marks(_col(c), 2, wrap)


def contains_words(c: Column | str, words: list[str], require_all: bool = True) -> Column:
    tests = [_col(c).contains(w) for w in words]
    if not tests:
        return F.lit(require_all)
    return reduce((lambda a, b: a & b) if require_all else (lambda a, b: a | b), tests)


#: Letters of right-to-left scripts (Hebrew to Arabic Extended, presentation forms).
RTL_CLASS = r"\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}"


def base_direction(c: Column | str) -> Column:
    """``rtl``, ``ltr`` or ``neutral``: the class of the first letter."""
    strong = F.regexp_extract(_col(c), r"(\p{L})", 1)
    return (
        F.when(strong == "", F.lit("neutral"))
        .when(strong.rlike(f"[{RTL_CLASS}]"), F.lit("rtl"))
        .otherwise(F.lit("ltr"))
    )


def strip_trailing_blanks(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[ \t]+(?=\n|\z)", "")


def count_trailing_blanks(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(r"[ \t]+(?=\n|\z)")).cast("long")


def tabs_to_spaces(c: Column | str, width: int = 4) -> Column:
    return F.replace(_col(c), F.lit("\t"), F.lit(" " * width))


def count_tabs(c: Column | str) -> Column:
    return (F.length(_col(c)) - F.length(F.replace(_col(c), F.lit("\t")))).cast("long")


def format_ts(seconds: Column | str, fmt: str = TIMESTAMP_FORMAT, zone: str | None = None) -> Column:
    """Epoch seconds as text in ``zone`` (the session's when not given)."""
    ts = F.timestamp_seconds(_col(seconds))
    if zone:
        ts = F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), zone)
    return F.date_format(ts, fmt)


def is_sha256(c: Column | str) -> Column:
    return _col(c).rlike("^[0-9a-f]{64}$")


def unicode_trim(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+\z", "")


def index_of(c: Column | str, part: str) -> Column:
    """0-based position in code points, -1 when absent."""
    return (F.instr(_col(c), part) - 1).cast("long")


def starts_with_any(c: Column | str, starts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_col(c).startswith(s) for s in starts])


def classify_uri(c: Column | str) -> Column:
    # The prefixes that tell web and local targets.
    return (
        F.when(starts_with_any(c, ["https://", "http://"]), F.lit("web"))
        .when(starts_with_any(c, ["/", "C:\\\\"]), F.lit("local"))
        .otherwise(F.lit("unknown"))
    )


#: File extension by (store type, encrypted).
EXTENSIONS = {("xml", False): ".ctd", ("xml", True): ".ctz", ("sqlite", False): ".ctb", ("sqlite", True): ".ctx"}


def store_type(path: Column | str) -> Column:
    """``xml``, ``sqlite`` or ``none`` by file extension."""
    ext = F.regexp_extract(_col(path), r"[^/\\](\.[^./\\]*)$", 1)
    return (
        F.when(ext.isin(".ctd", ".ctz"), F.lit("xml")).when(ext.isin(".ctb", ".ctx"), F.lit("sqlite"))
        .otherwise(F.lit("none"))
    )


def store_encrypted(path: Column | str) -> Column:
    ext = F.regexp_extract(_col(path), r"[^/\\](\.[^./\\]*)$", 1)
    return F.when(ext.isin(".ctz", ".ctx"), F.lit(True)).when(ext.isin(".ctd", ".ctb"), F.lit(False))


def fix_extension(path: Column | str, kind: str, encrypted: bool) -> Column:
    """Give the path the extension of its type; ``kind='none'`` drops a store extension."""
    ext = EXTENSIONS.get((kind, encrypted), "")
    return F.concat(F.regexp_replace(_col(path), r"\.ct[dzbx]$", ""), F.lit(ext))
