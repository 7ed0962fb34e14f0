import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from midbase.llm import archive

PAGES = [
    (5, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "http://a/3", "été\r\n\r\nWARC/1.1\r\n"), (1, "http://b", None), (3, None, ""),
    (2, "http://a/2", "<p>one</p>"), (None, "http://c", "<p>one</p>"), (None, "http://d", "alone"), (7, "http://l\r\nong", "x" * 200_000),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("payload", "header", "first", "copies", "bytes"):
        df = df.withColumn(c, df.url)
    return df


def test_records_come_back(spark, tmp_path):
    archive.write(frame(spark, PAGES), f"file://{tmp_path}/a")
    records = archive.read(spark, f"file://{tmp_path}/a")
    rows = records.select("*", archive.original(records).alias("record")).collect()
    assert len(rows) == len(PAGES)
    assert sorted((str(r.page_id), bytes(r.payload)) for r in rows) == sorted((str(i), (h or "").encode()) for i, _, h in PAGES)
    for r in rows:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        ((fields, payload),) = list(archive.parse_warc(bytes(r.record)))
        assert payload == bytes(r.payload) and fields["WARC-Type"] == r.record_type
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows)
    assert kinds == [
        ("1", "response", None), ("2", "response", None), ("2", "revisit", 2), ("3", "revisit", 1), ("5", "revisit", 2),
        ("7", "response", None), ("9", "response", None), ("None", "response", None), ("None", "revisit", 2),
    ]
    assert spark.read.parquet(f"file://{tmp_path}/a/payloads").count() == len({h or "" for _, _, h in PAGES})


def test_small_payloads_are_all_responses_and_damage_is_noticed(spark, tmp_path):
    archive.write(frame(spark, PAGES), f"file://{tmp_path}/b", least=11)
    records = archive.read(spark, f"file://{tmp_path}/b")
    assert records.filter("record_type = 'revisit'").count() == 0
    stored = spark.read.parquet(f"file://{tmp_path}/b/payloads")
    stored.selectExpr("payload_key", "cast('other' as binary) payload").write.parquet(f"file://{tmp_path}/c/payloads")
    spark.read.parquet(f"file://{tmp_path}/b/headers").write.parquet(f"file://{tmp_path}/c/headers")
    with pytest.raises(Exception, match="damaged"):
        archive.read(spark, f"file://{tmp_path}/c").collect()


def test_export(spark, tmp_path):
    archive.write(frame(spark, PAGES), f"file://{tmp_path}/d")
    archive.export_warc(archive.read(spark, f"file://{tmp_path}/d"), f"file://{tmp_path}/warc")
    found = [r for p in Path(tmp_path, "warc").glob("*.gz") for r in archive.parse_warc(gzip.decompress(p.read_bytes()))]
    assert len(found) == len(PAGES)
    assert {p for f, p in found if f["WARC-Type"] == "response"} == {(h or "").encode() for _, _, h in PAGES}


def test_empty_table(spark, tmp_path):
    archive.write(frame(spark, []), f"file://{tmp_path}/e")
    assert archive.read(spark, f"file://{tmp_path}/e").count() == 0
