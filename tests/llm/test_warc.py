"""Archives with the magic inside payloads, read in small splits."""

import hashlib

import pytest

from thicket.llm import warc

INNER = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 70\r\n\r\n" + warc.HTTP + "x" * (70 - len(warc.HTTP)) + "\r\n\r\n"
ROWS = [
    (1, "u", "a" * 200), (2, "u", "a" * 200), (3, None, None), (4, "u", INNER * 3 + "tail"), (5, "u", "pre" + INNER), (6, "u\r\nEvil: 1", "WARC/1.0\r\nContent-Length: zz\r\n\r\n"),
    (7, "u", "é" * 30000 + "WARC/1.0\r\n" + "b" * 50000), (8, "x", INNER * 3 + "tail"), (9, "x", "short"), (10, "x", "short"), (None, "x", "a" * 200), (11, "u", ""), (12, "u", INNER), (1, "u", "a" * 200),
]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("files", [1, 3])
def test_read_back(spark, small_splits, files):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(files)
    path = warc.archive_folder(spark)
    warc.write_archives(pages, path)
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    refers = {2: 1, 8: 4}
    assert got == sorted((i is None, i or 0, len((h or "").encode()), digest(h), "revisit" if i in refers else "response", refers.get(i)) for i, _, h in ROWS)


def test_no_pages(spark):
    path = warc.archive_folder(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0
