"""Parsers reading files, and the stream append, in a folder of their own."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from knownwhen.operators import calendars as cal
from knownwhen.sources import actions, feeds
from knownwhen.sources.envelope import landed_text


@pytest.fixture(scope="module")
def days(spark):
    return cal.day_table(spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 12, 31))], "first date, last date")).cache()


def test_pages_from_files(spark, days, tmp_path):
    (tmp_path / "p1.json").write_text(
        '{"bars":{"vti":[{"t":"2024-03-01T05:00:00Z","o":1,"h":2,"l":1,"c":1.5,"v":10},{"t":"2024-03-01T05:00:00Z","o":1,"h":2,"l":1,"c":1.5,"v":10},'
        '{"t":"2024-03-02T05:00:00Z","o":1,"h":2,"l":1,"c":1.5,"v":10}]},"next_page_token":null}'
    )
    (tmp_path / "p2.json").write_text('{"quotes":{}}')
    good, bad = feeds.bars_keyed(landed_text(spark, str(tmp_path)), days)
    got = {r["source_locator"]: r for r in good.collect()}
    assert sorted(got) == ["bars/1d/VTI/2024-03-01", "bars/1d/VTI/2024-03-01#repeat1", "bars/1d/VTI/2024-03-02"]
    assert got["bars/1d/VTI/2024-03-01"]["quality_flags"] == ["AVAILABLE_AT_ESTIMATED"]
    assert got["bars/1d/VTI/2024-03-01"]["available_at"] == dt.datetime(2024, 3, 1, 22, 0)
    # A Saturday print is stale and appears with Monday's bar.
    assert "STALE_BAR" in got["bars/1d/VTI/2024-03-02"]["quality_flags"] and got["bars/1d/VTI/2024-03-02"]["available_at"] == dt.datetime(2024, 3, 4, 22, 0)
    assert [r["code"] for r in bad.collect()] == ["SCHEMA_DRIFT"]


def test_curated_csv_reports_every_line(spark, tmp_path):
    f = tmp_path / "curated.csv"
    f.write_text(
        "# a comment\nsource,entity,kind,ex_date,value,pay_date,document\n"
        'issuer:fund,VTI,CASH_DIVIDEND,2010-03-24,0.49,2010-03-29,"Report, p. 14"\n'
        "Reuters,VTI,CASH_DIVIDEND,24/03/2010,-1,,\n"
        "exchange:x,VTI,SPLIT,2011-01-03,2,2011-01-05,notice\n"
        "issuer:fund,vti,CASH_DIVIDEND,2010-03-24,0.01,,again\n"
    )
    rows = actions.read_curated_csv(spark, str(f)).withColumn("line", F.monotonically_increasing_id())
    got = [r["problems"] for r in actions.curated_problems(rows).orderBy("line").collect()]
    assert got == [[], ["BAD_SOURCE", "BAD_EX_DATE", "BAD_VALUE", "NO_DOCUMENT"], ["SPLIT_HAS_PAY_DATE"], ["DUPLICATE"]]


def test_holdings_csv_and_artifacts(spark, tmp_path):
    (tmp_path / "h.csv").write_text("fund,as_of,symbol,weight,fetched_at,raw_content_hash\nXLF,2024-01-05,JPM,0.1,2024-01-06 10:00:00,sha256:1\nXLF,2024-01-05,BAC,0.05,2024-01-06 10:00:00,sha256:1\n")
    row = feeds.holdings(feeds.read_holdings_csv(spark, str(tmp_path / "h.csv"))).first()
    assert row["source_id"] == "etf_holdings.xlf" and row["vintage_at"] == dt.datetime(2024, 1, 6, 10)
    files = spark.read.format("binaryFile").load(str(tmp_path / "h.csv"))
    known = files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("raw_content_hash"))
    lost = spark.createDataFrame([("file:/gone", "sha256:0")], "path string, raw_content_hash string")
    got = {r["status"] for r in feeds.artifact_verify(files, known.union(lost)).collect()}
    assert got == {"OK", "MISSING"}


def test_rotating_verification_covers_everything(spark):
    m = spark.range(200).select(F.col("id").cast("string").alias("path"))
    seen = sum(feeds.verify_window(m, i, 7).count() for i in range(7))
    assert seen == 200
