"""WARC archives: written record by record, read back by following the chain of records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.session import materialize, shared_dir

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Smaller payloads are stored again rather than referred to.
LEAST_REVISIT = 100
#: The block of a record begins with this.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for a null. Line breaks in the value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row, uncompressed, in as many files as the table has partitions.

    Of rows with equal payloads of LEAST_REVISIT bytes or more the one with the smallest id
    is a response, those with other ids are revisits of it without a payload; a row without
    an id is a response. A null text is an empty payload.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns(
        {"digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload")}
    )
    again = rows.where((F.col("size") >= LEAST_REVISIT) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # written first: its true size lets the optimizer decide whether to broadcast it
    again = materialize(again.where("first < last").select("digest", "first"), "revisited")
    rows = rows.join(again, "digest", "left").withColumn("refers", F.when((F.col("size") >= LEAST_REVISIT) & (F.col("first") < F.col("id")), F.col("first")))
    revisit = F.col("refers").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "payload"))
    record_id = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", record_id(F.col("id"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")), _line("X-Payload-Length", F.col("size")),
        F.when(revisit, F.concat(_line("WARC-Refers-To", record_id(F.col("refers"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", F.octet_length(block)), F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).text(path)


def _field(header: Column, name: str, value: str) -> Column:
    """A value in a header block, or null."""
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*({value})[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _parsed(value: Column) -> dict[str, Column]:
    """What a piece after the magic says of itself, if it is a record."""
    header = F.substring_index(value, END, 1)
    size = F.octet_length(header) + len(END)
    return {"header": header, "h_len": F.when(size <= F.octet_length(value), size).cast("long"), "c_len": _field(header, "Content-Length", r"\d{1,18}").cast("long")}


def _payload(content: Column, h_len: Column, c_len: Column) -> Column:
    """The payload of a whole record: its block behind the HTTP header."""
    block = F.substring(content, (h_len + 1).cast("int"), c_len.cast("int"))
    http = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)
    return F.substring(block, http + 1, F.greatest(c_len.cast("int") - http, F.lit(0)))


def reachable(candidates: DataFrame) -> DataFrame:
    """The offsets (file, o) that chains of records from the start of their file come by.

    ``candidates`` has (file, block, o, next): each place of the magic and where its record
    would end. Within a block, candidates that follow one another form a run, all of which
    leave it by the same exit; pointer jumping over runs finds those that the start of the
    file reaches, in rounds that grow with the logarithm of their number. A run counts from
    the first offset at which it is entered.
    """
    by_place = "PARTITION BY file, block ORDER BY o"
    runs = candidates.withColumn("starts", F.coalesce(F.expr(f"lag(next) OVER ({by_place})") != F.col("o"), F.lit(True)))
    runs = runs.withColumn("run", F.expr(f"max(CASE WHEN starts THEN o END) OVER ({by_place} ROWS UNBOUNDED PRECEDING)")).drop("starts")
    runs = materialize(runs, "runs")
    exits = runs.groupBy("file", "run").agg(F.max(F.struct("o", "next")).alias("l")).select("file", "run", F.col("l.next").alias("exit"))
    homes = runs.select("file", F.col("o").alias("exit"), F.col("run").alias("to"))
    # exits that leave a block need not be the start of a run
    graph = materialize(exits.join(homes, ["file", "exit"], "left").withColumn("hit", F.col("run") == 0).withColumn("jump", F.col("to")), "graph")
    reached = -1
    while True:
        now = graph.where("hit").count()
        if now == reached:
            break
        reached = now
        targets = graph.where("hit AND jump IS NOT NULL").select("file", F.col("jump").alias("run"), F.lit(True).alias("new")).distinct()
        onward = graph.select("file", F.col("run").alias("jump"), F.col("jump").alias("beyond"))
        graph = graph.join(targets, ["file", "run"], "left").join(onward, ["file", "jump"], "left")
        graph = materialize(graph.select("file", "run", "exit", "to", (F.col("hit") | F.coalesce("new", F.lit(False))).alias("hit"), F.col("beyond").alias("jump")), "graph")
    entries = graph.where("hit AND to IS NOT NULL").select("file", F.col("to").alias("run"), F.col("exit").alias("entry"))
    entries = entries.union(graph.where("hit AND run = 0").select("file", "run", F.lit(0).cast("long"))).groupBy("file", "run").agg(F.min("entry").alias("entry"))
    return runs.join(entries, ["file", "run"]).where("o >= entry").select("file", "o")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed WARC files.

    Files are split at the magic, wherever it stands, by Spark's own text reader, so large
    files are read by many tasks. Each piece tells where its record would end; only records
    that the chain from the start of the file reaches are taken, so a magic inside a payload
    is part of that payload. A file that doesn't start with the magic has no records; a record
    whose header gives no length, or that is cut off, ends the chain of its file.

    Returns ``page_id``, ``record_type``, ``url``, ``payload_bytes`` and ``payload_digest``
    (measured for responses, as stated for revisits), ``refers_to``, ``file`` and ``offset``.
    """
    step = len(MAGIC)
    pieces = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("piece"))
    parsed = pieces.select("file", "block", "piece", F.octet_length("value").cast("long").alias("len"), *[c.alias(k) for k, c in _parsed(F.col("value")).items()], F.col("value").cast("binary").alias("content"))
    whole = F.col("len") == F.col("h_len") + F.col("c_len") + len(END)
    url = F.regexp_extract(F.col("header"), r"(?im)^WARC-Target-URI:[ \t]*([^\r\n]*)", 1)
    payload = _payload(F.col("content"), F.col("h_len"), F.col("c_len"))
    parsed = parsed.select(
        "file", "block", "piece", "len", "h_len", "c_len", _field(F.col("header"), "WARC-Type", "[a-z]+").alias("record_type"), _field(F.col("header"), "WARC-Record-ID", "<urn:x-page:-?[0-9]+>").alias("rid"),
        _field(F.col("header"), "WARC-Refers-To", "<urn:x-page:-?[0-9]+>").alias("ref"), F.when(url != "", url).alias("url"), _field(F.col("header"), "WARC-Payload-Digest", "sha256:[0-9a-f]{64}").alias("stated"),
        _field(F.col("header"), "X-Payload-Length", r"\d{1,18}").cast("long").alias("stated_bytes"), whole.alias("whole"),
        F.when(whole, F.octet_length(payload).cast("long")).alias("bytes"), F.when(whole, F.sha2(payload, 256)).alias("digest"),
    )
    parsed = materialize(parsed, "pieces")

    # offsets: lengths summed within a block, on top of the blocks before
    base = parsed.groupBy("file", "block").agg(F.sum(F.col("len") + step).alias("size")).withColumn("base", F.expr("sum(size) OVER (PARTITION BY file ORDER BY block) - size")).drop("size")
    inside = F.expr(f"sum(len + {step}) OVER (PARTITION BY file, block ORDER BY piece)") - F.col("len") - step
    placed = parsed.join(base, ["file", "block"]).withColumn("o", F.col("base") + inside - step).drop("base")
    placed = materialize(placed.withColumn("next", F.col("o") + step + F.col("h_len") + F.col("c_len") + len(END)), "placed")
    found = materialize(reachable(placed.where("o >= 0").select("file", "block", "o", "next")), "found")
    records = placed.join(found, ["file", "o"])

    # records that hold the magic: their pieces, put together
    split = records.where("NOT coalesce(whole, false) AND next IS NOT NULL").select("file", "o", "next", "h_len", "c_len")
    blocks = placed.groupBy("file", "block").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
    spans = split.join(blocks, "file").where("hi >= o AND lo < next").select("file", "block", "o", "next", "h_len", "c_len")
    parts = placed.select("file", "block", "piece", F.col("o").alias("at")).join(spans, ["file", "block"]).where("at >= o AND at < next").select("file", "block", "piece", "o", "at", "h_len", "c_len")
    parts = materialize(parts, "parts")
    joined = pieces.join(parts, ["file", "block", "piece"]).groupBy("file", "o").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"), F.first("h_len").alias("h_len"), F.first("c_len").alias("c_len"))
    content = F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).cast("binary")
    joined = joined.withColumn("content", content).where(F.octet_length("content") >= F.col("h_len") + F.col("c_len"))
    long_payload = _payload(F.col("content"), F.col("h_len"), F.col("c_len"))
    joined = joined.select("file", "o", F.octet_length(long_payload).cast("long").alias("bytes2"), F.sha2(long_payload, 256).alias("digest2"))

    out = records.join(joined, ["file", "o"], "left").where("coalesce(whole, false) OR digest2 IS NOT NULL")
    number = lambda c: F.regexp_extract(c, "(-?[0-9]+)", 1).cast("long")
    response = F.col("record_type") == "response"
    return out.select(
        number("rid").alias("page_id"), "record_type", "url",
        F.when(response, F.coalesce("bytes", "bytes2")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.coalesce("digest", "digest2")).otherwise(F.substring("stated", 8, 64)).alias("payload_digest"),
        F.when(F.col("ref").isNotNull(), number("ref")).alias("refers_to"), "file", F.col("o").alias("offset"),
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives under the shared one."""
    return f"{shared_dir(spark)}/thicket-warc-{uuid.uuid4().hex}"
