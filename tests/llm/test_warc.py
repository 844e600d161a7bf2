import base64
import gzip
import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from strataspan.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://b\r\nEvil: 1", ""), (5, "http://c", "é" * 50_000), (None, "http://d", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (6, "http://e", "a\r\n\r\nb")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark, pages):
    warc.register(spark)
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/out"
    warc.with_revisits(pages).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").load(path)
    rows = back.where("record_type <> 'warcinfo'").collect()
    assert len(rows) == pages.count()
    by = {}
    for r in rows:
        by.setdefault(r["record_id"], []).append(r)
        if r["record_type"] == "response":
            body = bytes(r["payload"])
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode() and len(body) == r["payload_bytes"]
    assert [r["record_type"] for r in by["urn:page:2"]] == ["response"] * 2 and by["urn:page:1"][0]["refers_to"] == "urn:page:2"
    assert by[None][0]["record_type"] == "revisit" and by["urn:page:3"][0]["refers_to"] == "urn:page:4"
    assert by["urn:page:4"][0]["target_uri"] == "http://b Evil: 1" and bytes(by["urn:page:6"][0]["payload"]) == b"a\r\n\r\nb"
    only = back.where("record_type = 'revisit'").select("record_id")
    assert only.count() == 3
    assert back.where("record_type = 'response' AND record_id = 'urn:page:5'").collect()[0]["payload_bytes"] == 100_000
    small = spark.read.format("warc").option("splitbytes", 300).load(path)
    assert small.where("record_type <> 'warcinfo'").count() == len(rows)


def test_foreign_archive_without_lengths(spark):
    warc.register(spark)
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/x.warc.gz", "wb") as f:
        for k in range(5):
            f.write(gzip.compress(warc.record({"record_type": "response", "record_id": f"urn:x:{k}", "payload": b"p" * 9000 * k})))
    got = {r["record_id"]: len(r["payload"]) for r in spark.read.format("warc").load(f"file://{folder}").collect()}
    assert got == {f"urn:x:{k}": 9000 * k for k in range(5)}
    assert spark.read.format("warc").load(f"file://{folder}").where("record_id = 'urn:x:3'").count() == 1


def test_empty_table(spark, pages):
    warc.register(spark)
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/none"
    warc.with_revisits(pages.where("page_id > 99")).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 0


def test_appends_are_read_together_and_overwriting_replaces(spark, pages):
    warc.register(spark)
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/out"
    rows = warc.with_revisits(pages)
    ids = lambda: sorted(r["record_id"] or "" for r in spark.read.format("warc").load(path).collect())
    rows.where("record_id = 'urn:page:5'").write.format("warc").mode("append").save(path)
    rows.where("record_id = 'urn:page:6'").write.format("warc").mode("append").save(path)
    assert ids() == ["urn:page:5", "urn:page:6"]
    rows.where("record_id = 'urn:page:4'").write.format("warc").mode("overwrite").save(path)
    assert ids() == ["urn:page:4"]


def test_malformed_records(spark):
    warc.register(spark)
    folder = tempfile.mkdtemp(prefix="spark-")
    good = warc.record({"record_type": "response", "record_id": "urn:x:1", "payload": b"p"})
    bad = [b"no header", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nx", b""]
    with open(f"{folder}/x.warc.gz", "wb") as f:
        for data in (good, *bad, good):
            f.write(gzip.compress(data))
    read = spark.read.format("warc").option("mode", "DROPMALFORMED").load(f"file://{folder}")
    assert [r["record_id"] for r in read.collect()] == ["urn:x:1"] * 2
    with pytest.raises(Exception, match="WARC header|length"):
        spark.read.format("warc").load(f"file://{folder}").collect()


def test_a_payload_of_many_pages_is_split(spark, split_joins):
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.lit("http://a").alias("url"), F.when(F.col("id") % 2 == 0, "x" * 4000).otherwise(F.col("id").cast("string")).alias("html"))
    assert split_joins(lambda: warc.with_revisits(pages.repartition(8)))
