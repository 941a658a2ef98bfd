"""Link properties: ``webs URL``, ``file BASE64``, ``fold BASE64``, ``node ID [anchor]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_url, _col


def parse_link(c: Column | str) -> Column:
    """struct<type, node_id, webs, file, fold, anch>; type is ``none`` when not a link."""
    link = _col(c)
    parts = F.split(link, " ")
    kind = F.get(parts, F.lit(0))
    arg = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    decoded = F.try_to_binary(arg, F.lit("base64")).cast("string")
    node_id = F.regexp_extract(arg, r"^([+-]?\d+)", 1).try_cast("long")
    known = kind.isin("webs", "file", "fold") | ((kind == "node") & node_id.isNotNull())
    return F.struct(
        F.when(known, kind).otherwise(F.lit("none")).alias("type"),
        F.coalesce(F.when(kind == "node", node_id), F.lit(-1)).cast("long").alias("node_id"),
        F.when(kind == "webs", F.regexp_replace(arg, r"[\x00-\x1f]", "")).otherwise(F.lit("")).alias("webs"),
        F.when(kind == "file", decoded).otherwise(F.lit("")).alias("file"),
        F.when(kind == "fold", decoded).otherwise(F.lit("")).alias("fold"),
        F.when((kind == "node") & (F.size(parts) >= 3),
               F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(1))), " "))
        .otherwise(F.lit("")).alias("anch"),
    )


def _b64(c: Column) -> Column:
    # base64 output may be folded into lines in some configurations
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")


def format_link(s: Column) -> Column:
    """Inverse of :func:`parse_link`; a URL without a scheme gets ``http://``."""
    url = F.when(is_url(s["webs"]), s["webs"]).otherwise(F.concat(F.lit("http://"), s["webs"]))
    path = F.when(s["type"] == "file", s["file"]).otherwise(s["fold"])
    anchor = F.when(s["anch"] == "", F.lit("")).otherwise(F.concat(F.lit(" "), s["anch"]))
    return (
        F.when((s["type"] == "webs") & (s["webs"] != ""), F.concat(F.lit("webs "), url))
        .when(s["type"].isin("file", "fold") & (path != ""), F.concat(s["type"], F.lit(" "), _b64(path)))
        .when((s["type"] == "node") & (s["node_id"] != -1),
              F.concat(F.lit("node "), s["node_id"].cast("string"), anchor))
        .otherwise(F.lit(""))
    )


def link_target(s: Column) -> Column:
    """The part of a link that search looks at: URL, path, folder or anchor."""
    return (
        F.when(s["type"] == "webs", s["webs"]).when(s["type"] == "file", s["file"])
        .when(s["type"] == "fold", s["fold"]).when(s["type"] == "node", s["anch"]).otherwise(F.lit(""))
    )


def with_link_target(s: Column, target: Column) -> Column:
    """The link with its searched part replaced."""

    def put(kind: str, field: str) -> Column:
        return F.when(s["type"] == kind, target).otherwise(s[field]).alias(field)

    return F.struct(
        s["type"].alias("type"), s["node_id"].alias("node_id"),
        put("webs", "webs"), put("file", "file"), put("fold", "fold"), put("node", "anch"),
    )


def href_to_link(c: Column | str) -> Column:
    """Link property of an href.

    A ``file://`` href has a scheme too, so, as in the reference, it becomes a
    web link; only hrefs without a scheme get ``http://``.
    """
    url = _col(c)
    return F.when(is_url(url), F.concat(F.lit("webs "), url)).otherwise(F.concat(F.lit("webs http://"), url))
