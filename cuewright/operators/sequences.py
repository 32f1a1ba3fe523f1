"""Operators over rows in order: fills, runs, gaps, cues, rates, retention and eviction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators.ordered import (
    following,
    largest_group,
    last_known,
    max_before,
    next_known,
    previous,
    row_number,
    running_max,
    running_sum,
    scan,
    sum_before,
)
from cuewright.operators.timeline import FitSettings, near_other_speaker

EVENT_CAP = 500
BORROW_MAX_MS = 3000
RATE_WINDOW_MS = 8000
CHUNK_EPS_MS = 1
DEFAULT_CPS = 13.0


def newest_events(events: DataFrame, cap: int = EVENT_CAP) -> DataFrame:
    """Newest ``cap`` events of every job, by sequence number."""
    last = events.groupBy("job_id").agg(F.max("seq").alias("_last"))
    return events.join(last, "job_id").filter(F.col("seq") > F.col("_last") - cap).drop("_last")


def fill_labels(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Missing labels take the one before them, leading ones the one after; adds ``filled``."""
    looked = scan(df, keys, order, [last_known("_back", F.col(label)), next_known("_ahead", F.col(label))])
    return looked.withColumn("filled", F.coalesce("_back", "_ahead")).drop("_back", "_ahead")


def label_runs(words: DataFrame, keys: Sequence[str], order: str, label: str) -> DataFrame:
    """Consecutive words of one label inside a key as one row with span and text.

    Keys are whole segments, so a run is never longer than one segment.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    numbered = words.withColumn("_change", change).withColumn("run_no", F.sum("_change").over(w))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("word").alias("w"))))
    return numbered.groupBy(*keys, "run_no").agg(
        F.first(label).alias("label"),
        F.min("word_start").alias("run_start"),
        F.max("word_end").alias("run_end"),
        F.array_join(F.transform(pieces, lambda p: p.w), " ").alias("run_text"),
    )


def duration_status(segs: DataFrame, totals: DataFrame, cps: Column | float = DEFAULT_CPS, settings: FitSettings = FitSettings()) -> DataFrame:
    """Whether the speech expected for a text fits its slot plus the silence it may borrow."""
    ahead = scan(segs, ["job_id"], ["seg_no"], [following("_next", F.col("start_ms"))]).join(totals, "job_id")
    rate = F.lit(cps) if isinstance(cps, float) else cps
    gap = F.greatest(F.greatest(F.col("_next") - F.col("end_ms"), F.lit(0)) - settings.guard_ms, F.lit(0))
    tail = F.when(F.col("total_ms") > 0, F.greatest(F.col("total_ms") - F.col("end_ms"), F.lit(0))).otherwise(0)
    borrow = F.least(F.when(F.col("_next").isNotNull(), gap).otherwise(tail), F.lit(BORROW_MAX_MS))
    rows = ahead.withColumn("available_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) + borrow)
    rows = rows.withColumn("est_ms", F.length(F.trim("text")) * 1000.0 / rate)
    cap = settings.audio_cap * settings.video_cap if settings.retime else 1.8
    need = F.col("est_ms") / F.col("available_ms")
    status = (
        F.when(F.col("est_ms") <= 0, "fits")
        .when(F.col("available_ms") <= 0, "impossible")
        .when(need <= settings.audio_only_rate + 1e-9, "fits")
        .when(need <= cap + 1e-9, "tight")
        .otherwise("impossible")
    )
    overrun = F.greatest(F.col("est_ms") - F.col("available_ms"), F.lit(0.0))
    return rows.select(
        "job_id",
        "seg_no",
        status.alias("status"),
        F.bround(F.col("est_ms") / 1000, 3).alias("est_dur_s"),
        (F.col("available_ms") / 1000).alias("available_s"),
        F.bround(overrun / 1000, 3).alias("est_overrun_s"),
    )


def retime_chunks(plan: DataFrame, batch: int) -> DataFrame:
    """Plan and the gaps around it as gapless chunks, numbered and batched per job.

    Pre-roll, gaps over a millisecond and the tail play at ratio 1.
    """
    seen = scan(plan, ["job_id"], ["seg_no"], [max_before("_cursor", F.col("effective_ms"))])
    cursor = F.greatest(F.coalesce("_cursor", F.lit(0)), F.lit(0))

    def piece(a: Column, b: Column, ratio: Column) -> Column:
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), ratio.cast("double").alias("r"))

    gap = F.when(F.col("start_ms") > cursor + CHUNK_EPS_MS, piece(cursor, F.col("start_ms"), F.lit(1.0)))
    own = F.when(
        F.col("effective_ms") > F.col("start_ms"), piece(F.col("start_ms"), F.col("effective_ms"), F.col("stretch_ratio"))
    )
    body = seen.select("job_id", F.explode(F.array_compact(F.array(gap, own))).alias("c"))
    ends = plan.groupBy("job_id").agg(F.max("effective_ms").alias("_end"), F.max("total_ms").alias("_total"))
    tail = ends.filter(F.col("_total") > F.col("_end") + CHUNK_EPS_MS).select(
        "job_id", piece(F.col("_end"), F.col("_total"), F.lit(1.0)).alias("c")
    )
    chunks = body.unionByName(tail).select(
        "job_id", F.col("c.a").alias("chunk_start"), F.col("c.b").alias("chunk_end"), F.col("c.r").alias("ratio")
    )
    numbered = scan(chunks, ["job_id"], ["chunk_start", "chunk_end"], [row_number("chunk_no")])
    return numbered.withColumn("batch_no", F.floor((F.col("chunk_no") - 1) / batch))


def deoverlap(cues: DataFrame) -> DataFrame:
    """Cues by start, each starting no earlier than the end kept so far; empty ones dropped."""
    seen = scan(cues, ["job_id"], ["start_ms", "cue_no"], [max_before("_end", F.col("end_ms"))])
    moved = seen.withColumn("start_ms", F.greatest("start_ms", F.coalesce("_end", F.lit(0)), F.lit(0)))
    return moved.filter(F.col("end_ms") > F.col("start_ms")).drop("_end")


def monotone(cues: DataFrame) -> DataFrame:
    """Cues in number order whose starts never precede an earlier end."""
    ends = F.greatest("start_ms", "end_ms", F.lit(0))
    seen = scan(cues, ["job_id"], ["cue_no"], [max_before("_before", ends), running_max("_upto", ends)])
    start = F.greatest("start_ms", F.coalesce("_before", F.lit(0)), F.lit(0))
    return seen.select("job_id", "cue_no", start.alias("start_ms"), F.col("_upto").alias("end_ms"))


def rolling_rate(samples: DataFrame, window_ms: int = RATE_WINDOW_MS) -> DataFrame:
    """Bytes per second over the trailing window of each download, with the time left.

    ``samples`` has job_id, at_ms, sample_no, bytes_done, total_bytes. A frame reaches at
    most one window back, so rows are copied to their own and the next time bin and each
    (job, bin) is a separate group: a busy download spreads over many tasks.
    """
    home = F.floor(F.col("at_ms") / window_ms)
    copies = samples.withColumn("_home", home).withColumn("_bin", F.explode(F.array(home, home + 1)))
    w = Window.partitionBy("job_id", "_bin").orderBy("at_ms").rangeBetween(-window_ms, 0)
    first = F.min(F.struct("at_ms", "sample_no", "bytes_done")).over(w)
    last = F.max(F.struct("at_ms", "sample_no", "bytes_done")).over(w)
    rated = copies.withColumn("_f", first).withColumn("_l", last).filter(F.col("_bin") == F.col("_home"))
    dt = F.col("_l.at_ms") - F.col("_f.at_ms")
    rate = F.when(dt > 0, (F.col("_l.bytes_done") - F.col("_f.bytes_done")) * 1000.0 / dt).otherwise(F.lit(0.0))
    left = F.col("total_bytes") - F.col("bytes_done")
    eta = F.when((F.col("rate") > 0) & (left > 0), left / F.col("rate"))
    return rated.withColumn("rate", rate).withColumn("eta_s", eta).select(*samples.columns, "rate", "eta_s")


def history_window(takes: DataFrame, files: DataFrame, newest: int = 50) -> DataFrame:
    """Newest takes and every starred one, without those whose audio is gone."""
    top = takes.orderBy(F.desc("created_at"), F.desc("id")).limit(newest).select("id").withColumn("_new", F.lit(True))
    shown = takes.join(F.broadcast(top), "id", "left").filter(F.col("_new") | (F.col("starred") == 1)).drop("_new")
    present = files.select("audio_path").distinct().withColumn("_there", F.lit(True))
    return shown.join(present, "audio_path", "left").filter(
        F.col("_there") | (F.coalesce("audio_path", F.lit("")) == "")
    ).drop("_there")


def retention_victims(takes: DataFrame, cap: int = 200) -> DataFrame:
    """Oldest unstarred takes, as many as the history is over its cap; cap 0 keeps all."""
    if cap <= 0:
        return takes.limit(0)
    plain = takes.filter(F.coalesce("starred", F.lit(0)) == 0)
    aged = scan(plain, [], ["created_at", "id"], [row_number("_age")]).withColumn("_one", F.lit(1))
    excess = takes.agg((F.count(F.lit(1)) - cap).alias("_excess")).withColumn("_one", F.lit(1))
    return aged.join(F.broadcast(excess), "_one").filter(F.col("_age") <= F.col("_excess")).select(*takes.columns)


def lru_victims(files: DataFrame, budget: int) -> DataFrame:
    """Oldest files to delete until the rest fits the byte budget."""
    aged = scan(files, [], ["mtime", "bytes", "path"], [sum_before("_freed", F.col("bytes"))]).withColumn("_one", F.lit(1))
    total = files.agg(F.sum("bytes").alias("_total")).withColumn("_one", F.lit(1))
    over = F.col("_total") - F.col("_freed") > budget
    return aged.join(F.broadcast(total), "_one").filter(over).select(*files.columns)


def reference_ranking(segs: DataFrame) -> DataFrame:
    """Segments of a speaker ranked clean before adjacent, then longest first."""
    flagged = near_other_speaker(segs).withColumn("dur_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)))
    order = [F.asc("near_other"), F.desc("dur_ms"), F.asc("seg_no")]
    return scan(flagged, ["job_id", "speaker_id"], order, [row_number("rank")])
