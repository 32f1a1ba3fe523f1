"""Sinks: shards with their manifest, rejects, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_shards(df: DataFrame, path: str, rows_per_shard: int) -> None:
    """One folder and one file per shard; a shard holds a bounded number of rows."""
    shards = df.repartition("shard").sortWithinPartitions("shard", "id")
    shards.write.mode("overwrite").option("maxRecordsPerFile", rows_per_shard).partitionBy("shard").json(path)


def write_lines(df: DataFrame, path: str, columns: Sequence[str], sep: str = " ") -> None:
    line = F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected ids with their reason); ``reason`` is null for a good row."""
    marked = df.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def write_with_rejects(df: DataFrame, reason: Column, good_path: str, bad_path: str) -> dict:
    """Write kept and rejected rows and return both counts, taken while writing."""
    kept, rejected = split_rejects(df, reason)
    seen, lost = Observation("kept"), Observation("rejected")
    kept.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(good_path)
    bad = rejected.select("id", "reason").observe(lost, F.count(F.lit(1)).alias("n"))
    bad.write.mode("overwrite").json(bad_path)
    return {"kept": seen.get["n"], "rejected": lost.get["n"]}


def eval_report_lines(cases: DataFrame, summary: DataFrame) -> DataFrame:
    """JSON lines of a report: one summary line and one line per case of every suite."""
    head = summary.select(
        "suite",
        F.lit(0).cast("long").alias("line_no"),
        F.to_json(F.struct("suite", "total", "passed", "failed", "pass_rate")).alias("line"),
    )
    body = cases.select(
        "suite",
        (F.col("case_id") + 1).alias("line_no"),
        F.to_json(F.struct("case_id", "passed")).alias("line"),
    )
    return head.unionByName(body)


def write_ordered_lines(df: DataFrame, path: str, group: str, order: str, line: str = "line") -> None:
    """Text files in one folder per ``group``, lines in order across the part files of a folder."""
    ordered = df.repartitionByRange(group, order).sortWithinPartitions(group, order)
    ordered.select(group, F.col(line).alias("value")).write.mode("overwrite").partitionBy(group).text(path)
