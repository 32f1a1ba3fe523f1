"""Inputs several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright import views
from cuewright.operators import timeline
from cuewright.operators.intervals import BIN_MS  # noqa: F401  (re-exported for the tests)

NATURAL = "CAST(FLOOR((end_ms-start_ms)*(70+(seg_no*37)%160)/100.0) AS BIGINT)"


def voiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the length of the speech generated for them."""
    natural = F.floor((F.col("end_ms") - F.col("start_ms")) * (70 + (F.col("seg_no") * 37) % 160) / 100.0)
    return views.segments(spark, sf_dir).withColumn("natural_ms", natural.cast("long"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.segments(spark, sf_dir).groupBy("job_id").agg((F.max("end_ms") + 1500).alias("total_ms"))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.fit_plan(voiced(spark, sf_dir), totals(spark, sf_dir))


FIT_SQL = f"""
ahead AS (SELECT s.*, {NATURAL} AS natural_ms, t.total_ms,
  LEAD(start_ms) OVER (PARTITION BY s.job_id ORDER BY seg_no) AS nxt
  FROM v_segments s JOIN (SELECT job_id, MAX(end_ms)+1500 AS total_ms FROM v_segments GROUP BY 1) t USING (job_id)),
slots AS (SELECT *, CASE WHEN nxt IS NOT NULL THEN LEAST(GREATEST(end_ms, nxt-50, start_ms), GREATEST(nxt, end_ms))
    ELSE GREATEST(end_ms, total_ms) END AS effective_ms FROM ahead),
needs AS (SELECT *, GREATEST(effective_ms-start_ms, 1) AS slot_ms,
    CASE WHEN natural_ms > 0 THEN natural_ms/CAST(GREATEST(effective_ms-start_ms, 1) AS DOUBLE) ELSE 0.0::DOUBLE END AS need FROM slots),
rates AS (SELECT *, CASE WHEN need <= 1+1e-9 THEN CASE WHEN need > 1e-9 AND need < 0.95 THEN GREATEST(need, 0.85::DOUBLE) ELSE 1.0::DOUBLE END
    WHEN need <= 1.2+1e-9 THEN need ELSE LEAST(SQRT(need), 1.5::DOUBLE) END AS a FROM needs),
vids AS (SELECT *, CASE WHEN need <= 1.2+1e-9 THEN 1.0::DOUBLE ELSE LEAST(need/a, 2.0::DOUBLE) END AS v FROM rates),
spans AS (SELECT *, CAST(ROUND(slot_ms*1000*v) AS BIGINT) AS span_us,
    GREATEST(COALESCE(nxt-effective_ms, 0), 0)*1000 AS pause_us, natural_ms/a - slot_ms*v AS spill FROM vids),
placed AS (SELECT *, FIRST_VALUE(start_ms) OVER (PARTITION BY job_id ORDER BY seg_no)*1000
    + COALESCE(SUM(span_us+pause_us) OVER (PARTITION BY job_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ns FROM spans),
fit AS (SELECT job_id, seg_no, start_ms, end_ms, effective_ms, total_ms, ROUND_EVEN(a, 6) AS audio_rate, ROUND_EVEN(v, 6) AS video_ratio, ROUND_EVEN(v, 4) AS stretch_ratio,
    CAST(ns AS BIGINT) AS new_start_us, CAST(ns+span_us AS BIGINT) AS new_end_us,
    CASE WHEN spill > 1e-3 THEN 'overflow_trimmed'
      WHEN need <= 1+1e-9 THEN CASE WHEN need > 1e-9 AND need < 0.95 THEN 'audio_slowed' ELSE 'fits' END
      WHEN need <= 1.2+1e-9 THEN 'audio_stretched' WHEN a*v >= need-1e-9 THEN 'hybrid' ELSE 'overflow_trimmed' END AS status,
    ROUND_EVEN(CASE WHEN spill > 1e-3 THEN spill ELSE 0.0::DOUBLE END/1000, 4) AS overflow_s FROM placed)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysed video frame per turn, at the turn's start."""
    t = views.turns(spark, sf_dir)
    span = F.col("turn_end") - F.col("turn_start")
    return (
        t.select(
            "job_id",
            F.col("turn_start").alias("frame_ms"),
            "turn_no",
            F.when(span < 20000, "low").when(span < 40000, "medium").otherwise("high").alias("complexity"),
            F.when(F.col("speaker") == "SPEAKER_01", "calm").otherwise("tense").alias("mood"),
            F.when(F.col("turn_no") < 3, "dark").otherwise("bright").alias("brightness"),
        )
        .groupBy("job_id", "frame_ms")
        .agg(*[F.min_by(c, "turn_no").alias(c) for c in ("complexity", "mood", "brightness")])
    )


FRAMES_SQL = """
frames AS (SELECT job_id, turn_start AS frame_ms,
  ARG_MIN(CASE WHEN turn_end-turn_start < 20000 THEN 'low' WHEN turn_end-turn_start < 40000 THEN 'medium' ELSE 'high' END, turn_no) AS complexity,
  ARG_MIN(CASE WHEN speaker = 'SPEAKER_01' THEN 'calm' ELSE 'tense' END, turn_no) AS mood,
  ARG_MIN(CASE WHEN turn_no < 3 THEN 'dark' ELSE 'bright' END, turn_no) AS brightness
  FROM v_turns GROUP BY 1, 2)"""
