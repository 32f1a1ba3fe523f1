"""Streaming jobs: each takes a streaming DataFrame and gives one, or writes per micro-batch.

Running results are kept in a ``KeyedStore``: each batch is reduced to one row per key and merged into the
buckets it touches, under the batch's number, so a batch repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuewright.functions.sentences import Release
from cuewright.operators.timeline import top_per_group
from cuewright.sources.keyed_store import KeyedStore
from cuewright.streaming.processors import FirstErrors, Replay, RollingRates, Sentences, Utterances

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("done", "failed", "cancelled")
DAY_MS = 86_400_000


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_append(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now into Parquet files."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode)
    query.trigger(availableNow=True).start().awaitTermination()


@dataclass(frozen=True)
class Rollup:
    """A result per key that batches add to.

    ``reduce`` gives one row per key of a batch; ``merged`` says how two rows of a key become one.
    """

    schema: str
    keys: list[str]
    reduce: Callable[[DataFrame], DataFrame]
    merged: Callable[[], list[Column]]

    def store(self, spark: SparkSession, path: str, buckets: int = 16) -> KeyedStore:
        return KeyedStore(spark, path, self.schema, self.keys, buckets)

    def combine(self, stored: DataFrame, changes: DataFrame) -> DataFrame:
        return stored.unionByName(changes.select(*stored.columns)).groupBy(*self.keys).agg(*self.merged())


def maintain(stream: DataFrame, rollup: Rollup, store: KeyedStore, checkpoint: str) -> None:
    """Keep ``store`` up to date with a stream. There is no state but the store."""

    def each(batch: DataFrame, batch_id: int) -> None:
        reduced = f"{store.path}/changes"
        rollup.reduce(batch).write.mode("overwrite").parquet(reduced)
        changes = batch.sparkSession.read.schema(store.schema).parquet(reduced)
        store.merge(changes, rollup.combine, f"batch {batch_id}")

    run_batches(stream, each, checkpoint)


def packed(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of a key that a task reads together as one row: an array for each column, and their latest ``ts``.

    A row later than the delay goes unnoticed where a timely one is packed with it; timely rows never go.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{key} {kinds[key]}", *[f"{c} array<{kinds[c]}>" for c in columns], "ts timestamp"])
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grouped = pa.Table.from_batches([batch]).group_by(key, use_threads=False)
            out = grouped.aggregate([*[(c, "list") for c in columns], ("ts", "max")])
            out = out.select([key, *[f"{c}_list" for c in columns], "ts_max"]).rename_columns(arrow.names)
            yield from out.cast(arrow).to_batches()

    return rows.select(key, *columns, "ts").mapInArrow(pack, schema)


def replay(events: DataFrame, after_seq: int, terminal: tuple[str, ...] = TERMINAL, job_ids: list[int] | None = None, delay: str = "30 seconds") -> DataFrame:
    """Events (job_id, ts, seq, event_id, kind) past a sequence number, then whatever arrives, until the job ends."""
    chosen = events if job_ids is None else events.filter(F.col("job_id").isin(job_ids))
    wanted = chosen.filter((F.col("seq") > after_seq) | F.col("kind").isin(*terminal))
    out = "job_id long, seq long, event_id long, kind string"
    rows = packed(wanted, "job_id", ["seq", "event_id", "kind"]).withWatermark("ts", delay)
    return rows.groupBy("job_id").transformWithState(Replay(after_seq, terminal), out, "Append", "EventTime")


def sentences(tokens: DataFrame, rules: Release, delay: str = "10 minutes") -> DataFrame:
    """Sentences of token streams (session, ts, token_no, token, is_last)."""
    grouped = packed(tokens, "session", ["token_no", "token", "is_last"]).withWatermark("ts", delay).groupBy("session")
    kind = tokens.schema["session"].dataType.simpleString()
    return grouped.transformWithState(
        Sentences(rules), f"session {kind}, sentence_no long, sentence string", "Append", "EventTime"
    )


def utterances(audio: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Utterances of audio streams (session, ts, at_ms, row_no, bytes, kind); rows later than the delay are dropped."""
    out = "session long, start_ms long, last_audio_ms long, closed_ms long, bytes long, partials long"
    rows = packed(audio, "session", ["at_ms", "row_no", "bytes", "kind"]).withWatermark("ts", delay)
    return rows.groupBy("session").transformWithState(Utterances(), out, "Append", "EventTime")


def rolling_rates(samples: DataFrame, window_ms: int, delay: str = "30 seconds") -> DataFrame:
    """Rates of downloads (job_id, at_ms, sample_no, bytes_done, total_bytes); samples later than the delay are dropped."""
    out = "job_id long, at_ms long, sample_no long, bytes_done long, rate double"
    timed = samples.withColumn("ts", F.timestamp_millis("at_ms"))
    rows = packed(timed, "job_id", ["at_ms", "sample_no", "bytes_done", "total_bytes"]).withWatermark("ts", delay)
    return rows.groupBy("job_id").transformWithState(RollingRates(window_ms), out, "Append", "EventTime")


ERROR_ROLLUP = Rollup(
    "fingerprint string, count long, first_seen timestamp, last_seen timestamp",
    ["fingerprint"],
    lambda errors: errors.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")
    ),
    lambda: [F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")],
)

JOB_STATUS = Rollup(
    "job_id long, latest struct<created_at: timestamp, event_id: bigint, status: string>",
    ["job_id"],
    lambda changes: changes.groupBy("job_id").agg(F.max(F.struct("created_at", "event_id", "status")).alias("latest")),
    lambda: [F.max("latest").alias("latest")],
)


def job_status(stored: DataFrame) -> DataFrame:
    return stored.select("job_id", "latest.status", F.col("latest.created_at").alias("updated_at"))


def sweep_orphans(jobs: DataFrame) -> DataFrame:
    """Jobs a restart left pending or running have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("pending", "running"), "failed").otherwise(F.col("status")))


def _audio(column: str) -> Column:
    return F.when(F.col("kind") == "audio", F.col(column))


TOKEN_TIMES = Rollup(
    "session long, begin_ms long, first_ms long, end_ms long, audio_ms long",
    ["session"],
    lambda events: events.groupBy("session").agg(
        F.min("ts_ms").alias("begin_ms"), F.min(_audio("ts_ms")).alias("first_ms"), F.max("ts_ms").alias("end_ms"),
        F.coalesce(F.sum(_audio("audio_ms")), F.lit(0)).alias("audio_ms"),
    ),
    lambda: [F.min("begin_ms").alias("begin_ms"), F.min("first_ms").alias("first_ms"), F.max("end_ms").alias("end_ms"), F.sum("audio_ms").alias("audio_ms")],
)


def token_rates(stored: DataFrame) -> DataFrame:
    """Per session: time to the first audio, total time and real-time factor."""
    elapsed = F.col("end_ms") - F.col("begin_ms")
    return stored.select(
        "session",
        (F.col("first_ms") - F.col("begin_ms")).alias("first_audio_ms"),
        elapsed.alias("elapsed_ms"),
        "audio_ms",
        F.round(elapsed / F.nullif(F.col("audio_ms"), F.lit(0)), 4).alias("rtf"),
    )


def first_errors(errors: DataFrame, cap: int, keep_ms: int = DAY_MS, delay: str = "10 minutes") -> DataFrame:
    """First error per (session, fingerprint), at most ``cap`` fingerprints a session until it falls silent for ``keep_ms``.

    Each task first reduces its rows to the first of each fingerprint, so a session with most of the rows
    sends few of them. Errors later than the delay are dropped.
    """

    def few(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.sort_values(["created_at", "event_id"]).drop_duplicates(["session", "fingerprint"])

    kinds = {f.name: f.dataType.simpleString() for f in errors.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("session", "fingerprint", "created_at", "event_id"))
    reduced = errors.select("session", "fingerprint", "created_at", "event_id").mapInPandas(few, schema)
    return reduced.withWatermark("created_at", delay).groupBy("session").transformWithStateInPandas(FirstErrors(cap, keep_ms), schema, "Append", "EventTime")


def capped_log(path: str, cap: int) -> Callable[[DataFrame, int], None]:
    """Writer of a log that keeps the newest ``cap`` events per job.

    A batch adds at most ``cap`` rows per job; ``read_capped_log`` applies the cap over all
    batches, so no batch rewrites what is stored.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        newest = top_per_group(batch, ["job_id"], [F.desc("seq")], cap).drop("rank")
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each


def read_capped_log(spark: SparkSession, path: str, cap: int) -> DataFrame:
    return top_per_group(spark.read.parquet(path).drop("batch"), ["job_id"], [F.desc("seq")], cap).drop("rank")


def compact_capped_log(spark: SparkSession, path: str, target: str, cap: int) -> None:
    """Fold all batches of a capped log into a new one."""
    read_capped_log(spark, path, cap).write.mode("overwrite").parquet(f"{target}/batch=0")
