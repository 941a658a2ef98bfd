"""Quality rules whose limits follow the documents of each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Fences stand this many interquartile ranges beyond the quartiles.
REACH = 6
#: The least interquartile range assumed, so that a metric which is nearly always 0 gets a fence above 0.
LEAST_RANGE = {"symbols": 8, "word_length": 10, "dup_lines": 70, "repeats": 60}
#: Documents that a source needs for limits of its own; below it those of its language hold, then of all.
LEAST_DOCUMENTS = 200
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more in an array of words.

    Windows are compared by a 64-bit hash, sorted with their places; equal neighbours are
    repeats. All of it happens within the row.
    """

    def of(ws: Column) -> Column:
        n = F.size(ws) - 2
        hashed = F.transform(F.slice(ws, 1, n), lambda w, i: F.struct(F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        repeated = _let(F.sort_array(hashed), lambda s: F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return _let(words, lambda ws: F.when(F.size(ws) < 3, 0).otherwise(of(ws)))


def statistics(text: Column) -> list[Column]:
    """The base counts of a text, and its number of lines with a word."""
    text = F.coalesce(text, F.lit(""))
    ink = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda ws: F.struct(F.size(ws).alias("n"), repeat_words(ws).alias("r")))
    line_counts = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return [
        counts.alias("counts"), line_counts.alias("lines"), F.length(ink).cast("long").alias("word_chars"),
        (F.length(ink) - F.length(F.translate(ink, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ]


def with_statistics(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(row, lang, source, statistics, base_failed, metrics); ``row`` holds the given columns."""
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).select(
        "row", F.col("row")[lang_col].cast("string").alias("lang"), F.col("row")[source_col].cast("string").alias("source"), *statistics(F.col("row")[text_col])
    )
    out = out.select(
        "row", "lang", "source", F.col("counts.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.col("lines.dup").cast("long").alias("n_dup_lines"), F.col("counts.r").cast("long").alias("n_repeat_words"), F.col("lines.n").cast("long").alias("n_lines"),
    )
    return out.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols": F.expr("n_symbols * 1000 div greatest(word_chars, 1L)"),
        "word_length": F.expr("word_chars * 100 div greatest(n_words, 1L)"),
        "dup_lines": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1L)"),
        "repeats": F.expr("n_repeat_words * 1000 div greatest(n_words, 1L)"),
    }).drop("n_lines")


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, v, n): a log-linear histogram of each metric of documents that pass the base.

    Values below 128 have a bucket each, larger ones 64 to a power of two, named by its lower
    bound ``v``: quantiles are off by at most 1/64, and histograms merge by adding up.
    """
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in LEAST_RANGE])).alias("x")
    wide = stats.where(~F.col("base_failed")).select("lang", "source", metrics).select("lang", "source", "x.metric", "x.v")
    step = F.pow(F.lit(2.0), F.greatest(F.length(F.bin("v")) - 7, F.lit(0))).cast("long")
    return wide.select("lang", "source", "metric", (F.col("v") - F.col("v") % step).alias("v")).groupBy("lang", "source", "metric", "v").agg(F.count("*").alias("n"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, <metric>_low, <metric>_high) for each language and source.

    The quartiles come from the source's own sketch, or where it holds fewer than
    LEAST_DOCUMENTS documents from those of its language merged, or of all.
    """
    levels = []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = sketch.groupBy(*keys, "metric", "v").agg(F.sum("n").alias("n"))
        group = ", ".join([*keys, "metric"])
        up_to = F.expr(f"sum(n) OVER (PARTITION BY {group} ORDER BY v)")
        total = F.expr(f"sum(n) OVER (PARTITION BY {group})")
        quartiles = merged.withColumns({"up_to": up_to, "total": total}).groupBy(*keys, "metric").agg(
            F.max("total").alias("total"), F.min(F.when(4 * F.col("up_to") >= F.col("total"), F.col("v"))).alias("q1"), F.min(F.when(4 * F.col("up_to") >= 3 * F.col("total"), F.col("v"))).alias("q3")
        )
        levels.append((keys, quartiles.select(*[F.col(k).alias(f"{k}_{level}") for k in keys], F.col("metric").alias(f"metric_{level}"), F.struct("total", "q1", "q3").alias(f"s{level}"))))
    out = levels[0][1].withColumnsRenamed({"lang_0": "lang", "source_0": "source", "metric_0": "metric"})
    for level in (1, 2):
        keys, other = levels[level]
        same = F.col("metric") == F.col(f"metric_{level}")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"{k}_{level}"))
        out = out.join(other, same, "left").drop(f"metric_{level}", *[f"{k}_{level}" for k in keys])
    enough = lambda level: F.col(f"s{level}.total") >= LEAST_DOCUMENTS
    s = F.when(enough(0), F.col("s0")).when(enough(1), F.col("s1")).otherwise(F.col("s2"))
    span = F.greatest(s["q3"] - s["q1"], F.coalesce(*[F.when(F.col("metric") == m, F.lit(v).cast("long")) for m, v in LEAST_RANGE.items()]))
    out = out.select("lang", "source", "metric", (s["q1"] - REACH * span).alias("low"), (s["q3"] + REACH * span).alias("high"))
    pick = lambda m, side: F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}")
    return out.groupBy("lang", "source").agg(*[pick(m, side) for m in LEAST_RANGE for side in ("low", "high")])


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Judges each document against limits that its own language and source set.

    A document fails the base with fewer than 50 words or with over half of its words in
    repeated 3-word windows. Of the others, quantile sketches per language and source give
    the quartiles of four metrics: symbols per 1000 code points of words, hundredths of code
    points per word, repeated lines per 1000 and repeated words per 1000. A document is kept
    if each lies within REACH interquartile ranges of the quartiles.

    Returns per row ``row`` (a struct of the columns ``keep``, all by default, so that no name
    clashes), ``lang``, ``source``, the base counts, ``base_failed``, the metrics and
    ``kept``. Null and empty texts have no words and fail; a null language or source is a
    group like any other; repeated rows are judged alike. Documents are read once: rows and
    counts are written to the shared folder, sketches and verdicts come from there.
    """
    stats = with_statistics(docs, text_col, lang_col, source_col)
    if keep is not None:
        stats = stats.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in keep]))
    stats = materialize(stats, "statistics")
    # a few numbers per language and source; written, so that its true size decides on a broadcast
    bounds = materialize(limits(sketches(stats)), "limits").withColumnsRenamed({"lang": "l", "source": "s"})
    inside = F.lit(True)
    for m in LEAST_RANGE:
        inside &= F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(True))
    judged = stats.join(bounds, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    return judged.select("row", "lang", "source", *STATISTICS, "base_failed", *LEAST_RANGE, (~F.col("base_failed") & inside).alias("kept"))
