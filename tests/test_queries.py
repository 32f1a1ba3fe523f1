"""Every registered query against its SQL in DuckDB, or for rows where it has none."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert ok, message
    assert " type " not in message, message


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0


def test_captured_texts_lose_only_blank_ends_and_escapes(spark, tmp_path):
    """Missing, blank and padded texts, carriage returns, other white space, escape codes and a text's own banner."""
    esc = "\x1b"
    texts = [None, "", " \r\n\t", "\n a\r\nb\rc \n", "\xa0a\u2028", "a\x0b", "\x85", f"{esc}[31m a{esc}[0m", f"a{esc}]0;t\x07", f"\x01a{esc}\x01"]
    texts += ["ffmpeg version 6\n  built with gcc\n\nb", "a\r\nFFprobe version 6", f"ff{esc}mpeg version 6\nb", "fffmpegffprobe version 1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    name = "str_strip_ansi"
    ok, message = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path))
    assert ok, message
