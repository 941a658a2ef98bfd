"""Search and replace over node text, names, tags and embedded objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, match_parts, prefix_sums
from ..functions.links import link_target, parse_link, with_link_target, format_link
from ..functions.text import (
    clip, first_line, fold_accents, regex_literal, replacement_literal, unicode_trim, xml_escape,
)
from ..model import PAGE_SIZE, RICH_SYNTAX
from ..plans.joins import lookup_join, sized
from ..plans.scan import numbered
from ..session import materialize
from ..sources.store import Store, decode_nodes, image_kind, plain_parts, rewritten
from .forest import names_on_path, subtree
from .object_index import ObjectIndex, all_objects, build_index, object_lines, object_positions, objects_before  # noqa: F401


@dataclass(frozen=True)
class SearchOptions:
    """What to look for and where."""

    pattern: str
    reg_exp: bool = False
    match_case: bool = False
    whole_word: bool = False
    start_word: bool = False
    accent_insensitive: bool = False
    multiple_words: int = 0  # 0 off, 1 all words on one line, 2 any word
    in_content: bool = True
    in_name_and_tags: bool = True
    override_exclusions: bool = False
    created_after: int | None = None
    created_before: int | None = None
    modified_after: int | None = None
    modified_before: int | None = None
    replace_in_link_targets: bool = False


def compile_pattern(opts: SearchOptions) -> str:
    """The regular expression of a search, built once on the driver.

    Several words match a whole line. The pattern is tied to the line start: a
    line that fails there fails everywhere, and trying each place would take
    time quadratic in the line.
    """
    text = opts.pattern
    if opts.accent_insensitive:
        from ..functions.text import ACCENTS_DST, ACCENTS_SRC

        text = text.translate(str.maketrans(ACCENTS_SRC, ACCENTS_DST))
    flags = "(?mU)" if opts.match_case else "(?miuU)"
    words = [w for w in text.split(" ") if w] if opts.multiple_words and not opts.reg_exp else []
    if len(words) > 1:
        if opts.multiple_words == 1:
            return flags + "^" + "".join(f"(?=.*{regex_literal(w)})" for w in words) + ".*"
        return flags + "^.*(?:" + "|".join(regex_literal(w) for w in words) + ").*"
    if opts.reg_exp:
        return flags + text
    literal = regex_literal(text)
    if opts.whole_word:
        return flags + r"\b" + literal + r"\b"
    if opts.start_word:
        return flags + r"\b" + literal
    return flags + literal


def _is_plain(opts: SearchOptions) -> bool:
    """A case-sensitive literal: a substring test can stand in for the regex."""
    return opts.match_case and not (opts.reg_exp or opts.multiple_words or opts.whole_word or opts.start_word)


def hit(text: Column, opts: SearchOptions) -> Column:
    """Whether ``text`` matches at all; the cheap test that goes first."""
    subject = fold_accents(text) if opts.accent_insensitive else text
    if _is_plain(opts) and not opts.accent_insensitive:
        return subject.contains(opts.pattern)
    return subject.rlike(compile_pattern(opts))


def time_filter(nodes: DataFrame, opts: SearchOptions) -> DataFrame:
    """Keep nodes whose (holder's) times lie in the given bounds, ends included."""
    for column, low, high in [
        ("ts_creation", opts.created_after, opts.created_before),
        ("ts_lastsave", opts.modified_after, opts.modified_before),
    ]:
        if low is not None:
            nodes = nodes.where(F.col(column) >= low)
        if high is not None:
            nodes = nodes.where(F.col(column) <= high)
    return nodes


def resolve_positions(store: Store, *columns: str) -> DataFrame:
    """Tree positions with their holder's properties (only ``columns``)."""
    from .shared import resolve_shared

    return resolve_shared(store, *columns)


def searchable_nodes(positions: DataFrame, paths: DataFrame, override: bool = False) -> DataFrame:
    """Positions open to search.

    Drops positions flagged exclude-me and everything below positions flagged
    exclude-children. ``positions`` needs node_id, exclude_me, exclude_children.
    """
    if override:
        return positions
    closed = positions.where("exclude_children").select(F.col("node_id").alias("closed_id"))
    above = paths.select("node_id", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("up"))
    blocked = above.join(closed, F.col("up") == F.col("closed_id"), "left_semi").select("node_id").distinct()
    return positions.where(~F.col("exclude_me")).join(blocked, "node_id", "left_anti")


def any_excluded(positions: DataFrame) -> DataFrame:
    """One row: whether the search met any exclusion."""
    return positions.agg(F.coalesce(F.bool_or(F.col("exclude_me") | F.col("exclude_children")), F.lit(False)).alias("any_excluded"))


def search_scope(
    ordered: DataFrame, selected: int | None = None, whole_tree: bool = True, forward: bool = True
) -> DataFrame:
    """Positions to visit: a node with its subtree, the whole forest, or the
    forest from the selected node onward (backward when ``forward`` is off).

    ``ordered`` has node_id, path and pos (document order).
    """
    if selected is None:
        return ordered
    if not whole_tree:
        return subtree(ordered, selected)
    at = ordered.where(F.col("node_id") == selected).agg(F.max("pos")).head()[0]  # one value
    return ordered.where(F.col("pos") >= at if forward else F.col("pos") <= at)


def text_matches(df: DataFrame, text: str, opts: SearchOptions, keep: list[str]) -> DataFrame:
    """Every non-overlapping match in column ``text``.

    Adds match_idx, match_start, match_end (code points), line_num and
    line_content. Works inside the row: nothing is shuffled, and the text itself
    does not travel with its matches. Runs in one pass of the pattern.
    """
    subject = fold_accents(F.col(text)) if opts.accent_insensitive else F.col(text)
    pattern = compile_pattern(opts)

    def spans(s: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            end = F.get(s["ends"], i)
            start = end - F.length(part)
            last_line = F.get(s["line_ends"], i)  # line feeds up to the match end
            line = F.get(s["lines"], last_line.cast("int"))
            feeds_inside = F.length(part) - F.length(F.replace(part, F.lit("\n")))
            return F.struct(
                i.alias("i"), start.alias("match_start"), end.alias("match_end"),
                (last_line - feeds_inside + 1).cast("long").alias("line_num"),
                F.when(end == 0, F.lit("")).otherwise(clip(line)).alias("line_content"),
            )

        return F.filter(F.transform(s["parts"], one), lambda x: (x["i"] % 2 == 1) & (x["match_end"] > x["match_start"]))

    def bind(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p).cast("long"))
        feeds = F.transform(parts, lambda p: (F.length(p) - F.length(F.replace(p, F.lit("\n")))).cast("long"))
        return F.struct(
            parts.alias("parts"), prefix_sums(lengths).alias("ends"),
            prefix_sums(feeds).alias("line_ends"), F.split(F.col(text), "\n").alias("lines"),
        )

    found = let(match_parts(subject, pattern), lambda parts: let(bind(parts), spans))
    return (
        df.where(hit(F.col(text), opts))
        .select(*keep, F.posexplode(found).alias("match_idx", "m"))
        .select(
            *keep, F.col("match_idx").cast("long").alias("match_idx"), "m.match_start", "m.match_end", "m.line_num", "m.line_content"
        )
    )


def objects_between(objects: DataFrame, start: int, end: int) -> DataFrame:
    """Objects whose offset lies in ``start..end``, in order."""
    return objects.where(F.col("offset").between(start, end))


def find_text(store: Store, opts: SearchOptions, holders: DataFrame | None = None, index: ObjectIndex | None = None) -> DataFrame:
    """Matches in body text per data holder, in text and in buffer offsets.

    Texts are searched where they lie. ``holders`` limits the result; it meets
    the matches, so that no text is ever shuffled. Without an ``index`` the objects of the
    nodes that match are ranked for this search.
    """
    found = text_matches(store.node, "txt", opts, ["node_id"])
    if holders is not None:
        found = found.join(holders.select("node_id"), "node_id", "left_semi")
    found = materialize(found, "found")
    if index is None:
        index = build_index(store, sized(found.select("node_id").distinct(), "hit"))
    shifted = objects_before(found, index)
    return shifted.select(
        "node_id", "match_idx", "match_start", "match_end",
        (F.col("match_start") + F.col("n_before")).alias("buffer_start"),
        (F.col("match_end") + F.col("n_before")).alias("buffer_end"), "line_num", "line_content",
    )


def find_name_tags(nodes: DataFrame, opts: SearchOptions) -> DataFrame:
    """One row per node whose ``name`` or ``name tags`` matches."""
    tags = F.coalesce(F.col("tags"), F.lit(""))
    subject = F.when(tags == "", F.col("name")).otherwise(F.concat_ws(" ", "name", tags))
    return nodes.where(hit(subject, opts))


def find_codebox(store: Store, opts: SearchOptions) -> DataFrame:
    """Matches in code boxes: offsets inside the box, the box's offset outside."""
    return text_matches(store.codebox, "txt", opts, ["node_id", "offset"])


def find_grid(store: Store, opts: SearchOptions) -> DataFrame:
    """Matches per grid cell with the cell's index (row-major)."""
    rows = store.grid.select(
        "node_id", "offset", "is_light", F.size(F.get("cells", F.lit(0))).alias("ncols"), F.posexplode("cells").alias("row", "cells_row")
    )
    cells = rows.select(
        "node_id", "offset", "is_light", "ncols", "row", F.posexplode("cells_row").alias("col", "cell")
    ).withColumn("cell_idx", (F.col("ncols") * F.col("row") + F.col("col")).cast("long"))
    return text_matches(cells, "cell", opts, ["node_id", "offset", "is_light", "cell_idx"])


def find_object_names(store: Store, opts: SearchOptions) -> DataFrame:
    """One match per anchor name or embedded file name that matches."""
    kinded = store.image.withColumn("kind", image_kind()).where(F.col("kind").isin("anchor", "file"))
    named = kinded.withColumn("object_name", F.when(F.col("kind") == "anchor", F.col("anchor")).otherwise(F.col("filename")))
    return named.where(hit(F.col("object_name"), opts)).select("node_id", "offset", "kind", "object_name")


def link_objects(store: Store, run_links: DataFrame | None = None) -> DataFrame:
    """Links of images and, when given, of text runs: node_id, offset, source, link."""
    image = (
        store.image.where((image_kind() == "png") & (F.coalesce("link", F.lit("")) != ""))
        .select("node_id", "offset", F.lit("image").alias("source"), "link")
    )
    if run_links is None:
        return image
    return image.unionByName(run_links.select("node_id", "offset", F.lit("text").alias("source"), "link"))


def find_link_targets(links: DataFrame, opts: SearchOptions) -> DataFrame:
    """Matches in the URL, path, folder or anchor of links."""
    parsed = links.withColumn("l", parse_link("link")).where("l.type <> 'none'")
    return text_matches(parsed.withColumn("target", link_target(F.col("l"))), "target", opts, ["node_id", "offset", "source"])


def all_matches(
    store: Store, paths: DataFrame, ordered: DataFrame, opts: SearchOptions, run_links: DataFrame | None = None, index: ObjectIndex | None = None
) -> DataFrame:
    """Every match of a search, one row each, for all tree positions.

    Holders are searched once; shared positions repeat their holder's matches. ``index``
    tells the places of objects; without one those of the nodes that match are ranked here.
    ``ordered`` has node_id and pos. Sorting is left to the caller: the key is
    (pos, is_name, start_offset, kind_rank, cell_idx, inner_start).
    """
    positions = decode_nodes(
        resolve_positions(store, "name", "tags", "syntax", "level", "is_ro", "is_richtxt", "ts_creation", "ts_lastsave")
    )
    open_pos = time_filter(searchable_nodes(positions, paths, opts.override_exclusions), opts)
    open_pos = materialize(open_pos.select("node_id", "holder_id", "name", "tags", "kind"), "open-positions")
    holders = open_pos.select(F.col("holder_id").alias("node_id"), (F.col("kind") == "rich").alias("rich")).distinct()

    none = {"object_kind": F.lit("text"), "cell_idx": F.lit(0).cast("long"), "inner_start": F.lit(0).cast("long"),
            "inner_end": F.lit(0).cast("long"), "is_name": F.lit(0)}
    pieces = []
    if opts.in_content:
        text = find_text(store, opts, holders, index).select(
            F.col("node_id").alias("h"), F.col("buffer_start").alias("start_offset"),
            F.col("buffer_end").alias("end_offset"), "line_num", "line_content",
        ).withColumns(none)
        code = find_codebox(store, opts).select(
            "node_id", "offset", F.lit("codebox").alias("object_kind"), F.lit(0).cast("long").alias("cell_idx"),
            F.col("match_start").alias("inner_start"), F.col("match_end").alias("inner_end"), "line_content",
        )
        grid = find_grid(store, opts).select(
            "node_id", "offset", F.when(F.col("is_light"), F.lit("grid_light")).otherwise(F.lit("grid_heavy")).alias("object_kind"),
            "cell_idx", F.col("match_start").alias("inner_start"), F.col("match_end").alias("inner_end"), "line_content",
        )
        names = find_object_names(store, opts).select(
            "node_id", "offset", F.col("kind").alias("object_kind"), F.lit(0).cast("long").alias("cell_idx"),
            F.lit(0).cast("long").alias("inner_start"), F.lit(0).cast("long").alias("inner_end"),
            clip(F.col("object_name")).alias("line_content"),
        )
        links = find_link_targets(link_objects(store, run_links), opts).select(
            "node_id", "offset", F.when(F.col("source") == "image", F.lit("png")).otherwise(F.lit("link")).alias("object_kind"),
            F.lit(0).cast("long").alias("cell_idx"), F.col("match_start").alias("inner_start"),
            F.col("match_end").alias("inner_end"), "line_content",
        )
        objs = code.unionByName(grid).unionByName(names).unionByName(links)
        objs = materialize(objs.join(holders.where("rich"), "node_id", "left_semi"), "object-matches")
        hits = objs.select("node_id", "offset").distinct()
        lines = object_lines(hits, index or build_index(store, sized(hits.select("node_id").distinct(), "hit")))
        objs = objs.join(lines, ["node_id", "offset"]).select(
            F.col("node_id").alias("h"), F.col("offset").alias("start_offset"), (F.col("offset") + 1).alias("end_offset"),
            "line_num", "line_content", "object_kind", "cell_idx", "inner_start", "inner_end", F.lit(0).alias("is_name"),
        )
        both = text.unionByName(objs)
        pieces.append(lookup_join(both, open_pos.select("node_id", "holder_id"), "h", "holder_id", "inner", check=False).drop("h", "holder_id"))
    if opts.in_name_and_tags:
        named = materialize(find_name_tags(open_pos, opts), "named")
        # only nodes that match give their first line
        heads = store.nodes(sized(named.select(F.col("holder_id").alias("node_id")).distinct(), "named-holders"))
        heads = heads.select(F.col("node_id").alias("h"), first_line("txt").alias("line_content"))
        zero = F.lit(0).cast("long")
        pieces.append(
            lookup_join(named, heads, "holder_id", "h", "left", check=False).select(
                "node_id", zero.alias("start_offset"), zero.alias("end_offset"), zero.alias("line_num"),
                F.coalesce("line_content", F.lit("")).alias("line_content"), F.lit("text").alias("object_kind"),
                zero.alias("cell_idx"), zero.alias("inner_start"), zero.alias("inner_end"), F.lit(1).alias("is_name"),
            )
        )
    rows = pieces[0]
    for piece in pieces[1:]:
        rows = rows.unionByName(piece)
    # The matches are read several times below; searching again would cost more.
    rows = materialize(rows, "matches")
    hit_nodes = rows.select("node_id").distinct()
    crumbs = names_on_path(paths.join(hit_nodes, "node_id", "left_semi"), positions.select("node_id", "name"))
    info = (
        crumbs.select("node_id", xml_escape(F.array_join(F.transform("names", unicode_trim), "  /  ")).alias("hier_name"))
        .join(open_pos.select("node_id", "name", "tags"), "node_id")
        .join(ordered.select("node_id", "pos"), "node_id")
        .withColumnRenamed("node_id", "info_id")
    )
    out = lookup_join(rows, info, "node_id", "info_id", "inner")
    shown = F.when(F.col("is_name") == 1, fold_accents("name")).otherwise(F.col("name")) if opts.accent_insensitive else F.col("name")
    shown_tags = F.when(F.col("is_name") == 1, fold_accents("tags")).otherwise(F.col("tags")) if opts.accent_insensitive else F.col("tags")
    title = F.when(F.coalesce("tags", F.lit("")) == "", shown).otherwise(
        F.concat(shown, F.lit("\n [Tags: "), shown_tags, F.lit("]"))
    )
    kind_rank = F.when(F.col("object_kind") == "text", 1).otherwise(0)
    return out.select(
        "pos", "is_name", "node_id", title.alias("node_name"), "hier_name", "start_offset", "end_offset",
        "line_num", "line_content", "object_kind", kind_rank.alias("kind_rank"), "cell_idx", "inner_start", "inner_end",
    )


MATCH_ORDER = ["pos", "is_name", "start_offset", "kind_rank", "object_kind", "cell_idx", "inner_start", "line_content"]


def first_match(matches: DataFrame, after: tuple[int, int] | None = None, forward: bool = True) -> DataFrame:
    """The next match after (before) a place given as (pos, offset): a top-1."""
    order = [F.col(c).asc() if forward else F.col(c).desc() for c in MATCH_ORDER]
    if after is not None:
        pos, offset = after
        here = (F.col("pos") == pos) & ((F.col("start_offset") >= offset) if forward else (F.col("end_offset") <= offset))
        beyond = F.col("pos") > pos if forward else F.col("pos") < pos
        matches = matches.where(beyond | here)
    return matches.orderBy(*order).limit(1)


def paged(matches: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Add ``row_num`` and ``page`` in match order, ranked over range partitions."""
    ranked = numbered(matches, [], [F.col(c) for c in MATCH_ORDER], "row_num")
    return ranked.withColumn("page", F.floor((F.col("row_num") - 1) / size).cast("long"))


@dataclass(frozen=True)
class MatchPages:
    """Matches in ranges of their order, written, and per range the number of matches before and in it."""

    rows: DataFrame
    ranges: list[tuple[int, int, int]]  # range, matches before it, matches in it
    size: int

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.ranges)


def match_pages(matches: DataFrame, size: int = PAGE_SIZE, ranges: int | None = None) -> MatchPages:
    """Matches made ready for paging: sorted out into ranges and counted, numbered not at all.

    The driver gets one count per range, of which there are as many as shuffle partitions at
    most, if ``ranges`` doesn't say how many.
    """
    rows = matches.repartitionByRange(*([ranges] if ranges else []), *MATCH_ORDER).withColumn("__range", F.spark_partition_id())
    rows = materialize(rows, "pages")
    counts, found, before = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect(), [], 0
    for r in sorted(counts):
        found.append((r["__range"], before, r.n))
        before += r.n
    return MatchPages(rows, found, size)


def page(pages: MatchPages, n: int) -> DataFrame:
    """One page (0-based) with ``row_num``: reads and numbers the ranges that hold it, mostly one."""
    first, last = n * pages.size + 1, (n + 1) * pages.size
    own = [(r, before) for r, before, count in pages.ranges if before < last and before + count >= first]
    rows = pages.rows.where(F.col("__range").isin([r for r, _ in own]) if own else F.lit(False))
    # a range fits a task, as a partition of the sort that made it
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*MATCH_ORDER))
    before = F.lit(0).cast("long")
    for r, b in own:
        before = F.when(F.col("__range") == r, F.lit(b).cast("long")).otherwise(before)
    return rows.withColumn("row_num", number + before).where(F.col("row_num").between(first, last)).drop("__range")


def page_labels(total: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """``a..b`` labels of all pages from a one-row frame with column ``n``; at least one page."""
    n = total.head()[0] or 0  # one number
    pages = total.sparkSession.range(max(1, -(-n // size))).withColumnRenamed("id", "page")
    first, last = F.col("page") * size + 1, F.least((F.col("page") + 1) * size, F.lit(n).cast("long"))
    return pages.select("page", F.concat(first.cast("string"), F.lit(".."), last.cast("string")).alias("label"))


def match_summary(matches: DataFrame) -> DataFrame:
    """Matches per node."""
    return matches.groupBy("node_id").agg(F.count(F.lit(1)).cast("long").alias("n_matches"))


# --- replace ---------------------------------------------------------------


def group_count(pattern: str) -> int:
    """Capturing groups of a pattern of the JVM regex engine."""
    n, i, depth = 0, 0, 0
    while i < len(pattern):
        if pattern.startswith(r"\Q", i):
            end = pattern.find(r"\E", i)
            i = len(pattern) if end < 0 else end + 2
            continue
        if pattern[i] == "\\":
            i += 2
            continue
        if pattern[i] == "[":
            depth += 1
        elif pattern[i] == "]" and depth:
            depth -= 1
        elif pattern[i] == "(" and not depth:
            special = pattern.startswith("(?", i)
            n += not special or (pattern.startswith("(?<", i) and pattern[i + 3 : i + 4] not in ("=", "!"))
        i += 1
    return n


def java_replacement(text: str, groups: int = 9) -> str:
    r"""A replacement with ``\0``..``\9`` group references for the JVM regex engine.

    A reference to a group that the pattern does not have gives nothing.
    """
    out, i = [], 0
    plain = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\"}
    while i < len(text):
        ch = text[i]
        if ch == "\\" and i + 1 < len(text):
            nxt = text[i + 1]
            if nxt.isdigit():
                if int(nxt) <= groups:
                    out.append("$" + nxt)
                if i + 2 < len(text) and text[i + 2].isdigit():
                    out.append("\\" + text[i + 2])
                    i += 1
            else:
                out.append(plain.get(nxt, "\\" + nxt))
            i += 2
            continue
        out.append("\\$" if ch == "$" else ch)
        i += 1
    return "".join(out)


def replaced(text: Column, opts: SearchOptions, replacement: str) -> Column:
    """``text`` with every match replaced.

    A regex replaces inside the matched piece only, so the piece is matched
    again on its own, as the reference does; a literal never expands groups.
    With accent folding the match is found on folded text and the original
    text is replaced at the same code points.
    """
    pattern = compile_pattern(opts)
    new = java_replacement(replacement, group_count(pattern))

    def put(piece: Column) -> Column:
        return F.regexp_replace(piece, pattern, new) if opts.reg_exp else F.lit(replacement)

    if not opts.accent_insensitive:
        if not opts.reg_exp:
            return F.regexp_replace(text, pattern, replacement_literal(replacement))
        return F.array_join(
            F.transform(match_parts(text, pattern), lambda p, i: F.when(i % 2 == 1, put(p)).otherwise(p)), ""
        )

    def rebuild(s: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            piece = F.substring(s["orig"], (F.get(s["ends"], i) - F.length(part) + 1).cast("int"), F.length(part))
            return F.when((i % 2 == 1) & (F.length(part) > 0), put(piece)).otherwise(piece)

        return F.array_join(F.transform(s["parts"], one), "")

    def bind(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p).cast("long"))
        return F.struct(parts.alias("parts"), prefix_sums(lengths).alias("ends"), text.alias("orig"))

    return let(match_parts(fold_accents(text), pattern), lambda parts: let(bind(parts), rebuild))


def replace_text(nodes: DataFrame, opts: SearchOptions, replacement: str) -> DataFrame:
    """Rewritten bodies of the nodes that match; read-only nodes are left alone.

    Only changed rows come back: they are the rows a store must write.
    """
    open_nodes = nodes.where((F.coalesce("is_ro", F.lit(0)).bitwiseAND(F.lit(1).cast("long"))) == 0)
    return open_nodes.where(hit(F.col("txt"), opts)).withColumn("txt", replaced(F.col("txt"), opts, replacement))


def replace_store_text(store: Store, opts: SearchOptions, replacement: str) -> Store:
    """The store after :func:`replace_text`. Texts are searched and rewritten once each, not by node."""
    open_rows = F.coalesce("is_ro", F.lit(0)).bitwiseAND(F.lit(1).cast("long")) == 0
    return store.with_parts(*rewritten(*plain_parts(store), hit(F.col("txt"), opts), replaced(F.col("txt"), opts, replacement), open_rows))


def replace_names(nodes: DataFrame, opts: SearchOptions, replacement: str, legacy_fold_write: bool = True) -> DataFrame:
    """Renamed nodes. A match in the tags selects a node too, but only its name
    is rewritten; group references always expand. With accent folding the folded
    name is written unless ``legacy_fold_write`` is off."""
    open_nodes = nodes.where((F.coalesce("is_ro", F.lit(0)).bitwiseAND(F.lit(1).cast("long"))) == 0)
    base = fold_accents("name") if opts.accent_insensitive and legacy_fold_write else F.col("name")
    if opts.accent_insensitive and not legacy_fold_write:
        new = replaced(F.col("name"), opts, replacement)
    else:
        pattern = compile_pattern(opts)
        new = F.regexp_replace(base, pattern, java_replacement(replacement, group_count(pattern)))
    return find_name_tags(open_nodes, opts).withColumn("name", new)


def _writable(store: Store) -> DataFrame:
    return store.node.where(
        (F.col("is_ro").bitwiseAND(F.lit(1).cast("long")) == 0) & (F.col("syntax") == RICH_SYNTAX)
    ).select("node_id")


def replace_in_objects(
    store: Store, opts: SearchOptions, replacement: str, run_links: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Changed code boxes, grids and, when enabled, links of images (and of text
    runs, given as node_id, offset, link) of writable rich nodes."""
    writable = _writable(store)
    new = lambda c: replaced(c, opts, replacement)
    code = store.codebox.where(hit(F.col("txt"), opts)).withColumn("txt", new(F.col("txt")))
    any_cell = F.exists("cells", lambda row: F.exists(row, lambda c: hit(c, opts)))
    grid = store.grid.where(any_cell).withColumn("cells", F.transform("cells", lambda row: F.transform(row, new)))
    out = {"codebox": code, "grid": grid}
    if opts.replace_in_link_targets:
        target = link_target(F.col("__l"))

        def relinked(df: DataFrame) -> DataFrame:
            parsed = df.withColumn("__l", parse_link("link")).where((F.col("__l.type") != "none") & hit(target, opts))
            return parsed.withColumn("link", format_link(with_link_target(F.col("__l"), new(target)))).drop("__l")

        out["image"] = relinked(store.image.where((image_kind() == "png") & (F.coalesce("link", F.lit("")) != "")))
        if run_links is not None:
            out["run_link"] = relinked(run_links)
    return {name: df.join(writable, "node_id", "left_semi") for name, df in out.items()}


# --- quick open, URLs, mentions, words -------------------------------------


def rank_nodes(paths: DataFrame, names: DataFrame, ordered: DataFrame, query: str) -> DataFrame:
    """Quick-open score per node, best first; nodes without any match are left out.

    0 name starts with the text, 1 name contains it, 2 all words in the name,
    3 any word in the name, 4 all words in the path, 5 any word in the path.
    """
    from ..functions.text import contains_words

    needle = query.lower()
    words = [w for w in needle.split(" ") if w]
    located = names_on_path(paths, names).select(
        "node_id", F.element_at("names", -1).alias("name"),
        F.lower(F.array_join(F.transform("names", unicode_trim), " / ")).alias("hier"),
    )
    name = F.lower("name")
    score = (
        F.when(name.startswith(needle), 0).when(name.contains(needle), 1)
        .when(contains_words(name, words, True), 2).when(contains_words(name, words, False), 3)
        .when(contains_words("hier", words, True), 4).when(contains_words("hier", words, False), 5)
    )
    scored = located.withColumn("score", score.cast("long")).where("score IS NOT NULL")
    return scored.join(ordered.select("node_id", "pos"), "node_id").select("node_id", "name", "score", "pos")


# What starts a web link, and the characters that end it.
URL_STARTS = ["http://", "https://", "www.", "ftp://"]
URL_END_CLASS = " \\n\\r\\t\"<>\\\\^`{}"


def find_urls(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """URLs in plain text with their code-point offsets.

    A URL runs to a character no URL holds, or to the bracket closing the one
    that stands right before it. Starts in the last seven symbols do not count.
    """
    starts = "(?:" + "|".join(regex_literal(s) for s in URL_STARTS) + ")"
    body = f"[^{URL_END_CLASS}]*"
    kinds = [rf"(?<=\()(?={starts})[^{URL_END_CLASS})]*", rf"(?<=\[)(?={starts})[^{URL_END_CLASS}\]]*", f"{starts}{body}"]
    pattern = "(?:" + "|".join(kinds) + ")"

    def spans(s: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            end = F.get(s["ends"], i)
            return F.struct(i.alias("i"), (end - F.length(part)).alias("url_start"), end.alias("url_end"), part.alias("url"))

        return F.filter(
            F.transform(s["parts"], one), lambda x: (x["i"] % 2 == 1) & (x["url_start"] < s["n"] - 7)
        )

    def bind(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p).cast("long"))
        return F.struct(parts.alias("parts"), prefix_sums(lengths).alias("ends"), F.length(text).alias("n"))

    found = let(match_parts(F.col(text), pattern), lambda parts: let(bind(parts), spans))
    return (
        df.where((F.length(text) >= 7) & F.col(text).rlike(starts))
        .select(*keep, F.explode(found).alias("u")).select(*keep, "u.url_start", "u.url_end", "u.url")
    )


def first_by_name(names: DataFrame, ordered: DataFrame) -> DataFrame:
    """First node in document order for every name; combined before the shuffle."""
    placed = names.select("node_id", "name").join(ordered.select("node_id", "pos"), "node_id")
    return placed.groupBy("name").agg(F.min_by("node_id", "pos").alias("target_id"))


def find_node_mentions(df: DataFrame, text: str, keep: list[str], names: DataFrame, ordered: DataFrame) -> DataFrame:
    """``[[name]]`` and CamelCase words that name a node, linked to the first such node."""
    bracketed = F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1))
    words = F.filter(
        F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)),
        lambda w: w.rlike(r"\p{Ll}.*\p{Lu}.*\p{Ll}"),
    )
    mentions = df.select(*keep, F.explode(F.concat(
        F.transform(bracketed, lambda m: F.struct(m.alias("mention"), F.lit("brackets").alias("form"))),
        F.transform(words, lambda m: F.struct(m.alias("mention"), F.lit("camel").alias("form"))),
    )).alias("m")).select(*keep, "m.mention", "m.form")
    return lookup_join(mentions, first_by_name(names, ordered), "mention", "name", "inner").drop("name")


def unknown_words(df: DataFrame, text: str, wordlist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Words absent from a word list, with their counts.

    Tokens are counted first, so the anti join sees each word once.
    """
    from ..functions.text import WORD

    groups = by or []
    words = df.select(*groups, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word"))
    counted = words.groupBy(*groups, "word").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return counted.join(wordlist.select("word").distinct(), "word", "left_anti")
