"""Energy onsets in waveform columns; every frame is computed inside its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME_S = 0.02
PRE_ROLL_MS = 50
MIN_SHIFT_MS = 150
MIN_SEGMENT_MS = 300
RELATIVE_THRESHOLD = 0.10
RMS_FLOOR = 1e-3
SUSTAIN_WINDOW_S = 0.30
SUSTAIN_MIN_S = 0.16
MAX_SNAP_MS = 1500
AUDIBLE_SHARE = 0.10
AUDIBLE_PEAK_SHARE = 0.02
ONSET_GAP_S = 0.15


def frame_length(rate: int) -> int:
    return max(1, int(FRAME_S * rate))


def _indexes(count: Column) -> Column:
    """0 .. count-1, empty for 0 (a plain sequence would run backwards)."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def frame_rms(wave: Column, length: int) -> Column:
    """RMS of each whole frame; a ragged tail is left out."""

    def energy(frame: Column) -> Column:
        part = F.slice(wave, frame * length + 1, length)
        total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        return F.sqrt(total / length)

    return F.transform(_indexes(F.floor(F.size(wave) / length)), energy)


def threshold(rms: Column) -> Column:
    """Level a frame must reach; null for silence and for waves shorter than a frame."""
    peak = F.array_max(rms)
    return F.when(peak >= RMS_FLOOR, F.greatest(peak * RELATIVE_THRESHOLD, F.lit(RMS_FLOOR)))


def _loud(flags: Column, start: Column, length) -> Column:
    return F.size(F.filter(F.slice(flags, start + 1, length), lambda x: x))


def with_loud_frames(df: DataFrame, wave: str, rate: int) -> DataFrame:
    """Adds ``rms`` and ``loud`` (frames at or over the threshold)."""
    framed = df.withColumn("rms", frame_rms(F.col(wave), frame_length(rate)))
    level = threshold(F.col("rms"))
    return framed.withColumn("_level", level).withColumn(
        "loud", F.transform("rms", lambda v: F.coalesce(v >= F.col("_level"), F.lit(False)))
    ).drop("_level")


def sustained_onset(loud: Column, rate: int) -> Column:
    """First loud frame followed by enough loud frames to be speech, null without one."""
    frame_s = frame_length(rate) / rate
    window = max(1, round(SUSTAIN_WINDOW_S / frame_s))
    need = max(1, round(SUSTAIN_MIN_S / frame_s))
    hits = F.filter(_indexes(F.size(loud)), lambda i: F.get(loud, i) & (_loud(loud, i, window) >= need))
    return F.get(hits, F.lit(0))


def onset_frames(loud: Column, rate: int) -> Column:
    """Loud frames with no loud frame in the gap before them; the first frame is armed."""
    gap = max(1, round(ONSET_GAP_S / FRAME_S))

    def starts(i: Column) -> Column:
        back = F.greatest(i - gap, F.lit(0))
        return F.get(loud, i) & (_loud(loud, back, i - back) == 0)

    return F.filter(_indexes(F.size(loud)), starts)


def snap_starts(segs: DataFrame, wave: str, rate: int) -> DataFrame:
    """Move a segment's start forward to its speech onset; adds ``snapped_ms``.

    ``wave`` holds the segment's own audio from start_ms on. Long jumps are made only over a
    nearly silent span, small ones are ignored, and a minimum length always remains.
    """
    length = frame_length(rate)
    rows = with_loud_frames(segs, wave, rate).withColumn("_onset", sustained_onset(F.col("loud"), rate))
    onset_ms = F.floor(F.col("_onset") * length * 1000 / rate).cast("long")
    start, end = F.col("start_ms"), F.col("end_ms")
    target = F.greatest(start, start + onset_ms - PRE_ROLL_MS)
    shift = target - start
    skipped = F.slice("rms", F.lit(1), F.greatest(F.col("_onset"), F.lit(0)))
    floor = F.greatest(F.lit(RMS_FLOOR), F.array_max(skipped) * AUDIBLE_PEAK_SHARE)
    audible = F.size(F.filter(skipped, lambda v: v >= F.col("_floor")))
    rows = rows.withColumn("_floor", floor).withColumn("_share", audible / F.greatest(F.size(skipped), F.lit(1)))
    final = F.least(target, end - MIN_SEGMENT_MS)
    moves = (
        (end - start >= MIN_SEGMENT_MS + MIN_SHIFT_MS)
        & F.col("_onset").isNotNull()
        & (shift >= MIN_SHIFT_MS)
        & ((shift <= MAX_SNAP_MS) | (F.col("_share") <= AUDIBLE_SHARE))
        & (final - start >= MIN_SHIFT_MS)
    )
    return rows.withColumn("snapped_ms", F.when(moves, final).otherwise(start)).select(*segs.columns, "snapped_ms")
