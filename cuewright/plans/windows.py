"""Queries over rows in order: windows, running values, onsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import views
from cuewright.operators import sequences, timeline, waveform
from cuewright.operators.ordered import scan, sum_before
from cuewright.plans import shapes
from cuewright.plans.registry import query
from cuewright.views import table

EVENT_KEEP = 50  # a ring smaller than the default one, so that the given jobs overflow it
RATE_MS = 6 * 3600 * 1000  # the given events are hours apart, not seconds


@query(
    "win_event_seq",
    views="v_job_events",
    sql=f"SELECT job_id, event_id, seq FROM v_job_events QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seq DESC) <= {EVENT_KEEP}",
)
def event_seq(spark, sf_dir):
    return sequences.newest_events(views.job_events(spark, sf_dir), EVENT_KEEP).select("job_id", "event_id", "seq")


@query(
    "win_speaker_gap",
    views="v_segments",
    sql="""WITH g AS (SELECT *, CASE WHEN start_ms - LAG(end_ms) OVER (PARTITION BY job_id ORDER BY seg_no) > 1200 THEN 1 ELSE 0 END AS j FROM v_segments)
SELECT job_id, seg_no, 'Speaker ' || CAST(SUM(j) OVER (PARTITION BY job_id ORDER BY seg_no ROWS UNBOUNDED PRECEDING) % 3 + 1 AS VARCHAR) AS gap_speaker FROM g""",
)
def speaker_gap(spark, sf_dir):
    return timeline.speakers_by_gap(views.segments(spark, sf_dir), 3).select("job_id", "seg_no", "gap_speaker")


@query(
    "win_forward_back_fill",
    views="v_segments",
    sql="""WITH l AS (SELECT job_id, seg_no, CASE WHEN LENGTH(text) > 400 THEN speaker_id END AS label FROM v_segments)
SELECT job_id, seg_no, COALESCE(LAST_VALUE(label IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seg_no ROWS UNBOUNDED PRECEDING),
  FIRST_VALUE(label IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY seg_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM l""",
)
def forward_back_fill(spark, sf_dir):
    label = F.when(F.length("text") > 400, F.col("speaker_id"))
    segs = views.segments(spark, sf_dir).select("job_id", "seg_no", label.alias("label"))
    return sequences.fill_labels(segs, ["job_id"], ["seg_no"], "label").select("job_id", "seg_no", "filled")


@query(
    "win_speaker_runs",
    views="v_words",
    sql="""WITH l AS (SELECT *, CASE WHEN word_start // 4000 % 3 = 0 THEN 'A' WHEN word_start // 4000 % 3 = 1 THEN 'B' END AS label FROM v_words),
c AS (SELECT *, CASE WHEN LAG(label) OVER w IS NOT DISTINCT FROM label AND LAG(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS ch FROM l WINDOW w AS (PARTITION BY job_id, seg_no ORDER BY word_no)),
r AS (SELECT *, SUM(ch) OVER (PARTITION BY job_id, seg_no ORDER BY word_no ROWS UNBOUNDED PRECEDING) AS run_no FROM c)
SELECT job_id, seg_no, CAST(run_no AS BIGINT) AS run_no, ANY_VALUE(label) AS label, MIN(word_start) AS run_start, MAX(word_end) AS run_end, STRING_AGG(word, ' ' ORDER BY word_no) AS run_text
FROM r GROUP BY 1,2,3""",
)
def speaker_runs(spark, sf_dir):
    block = F.floor(F.col("word_start") / 4000) % 3
    words = views.words(spark, sf_dir).withColumn("label", F.when(block == 0, "A").when(block == 1, "B"))
    return sequences.label_runs(words, ["job_id", "seg_no"], "word_no", "label")


@query(
    "win_gap_borrow",
    views="v_segments",
    sql="""WITH t AS (SELECT *, LEAD(start_ms) OVER (PARTITION BY job_id ORDER BY seg_no) AS nxt, MAX(end_ms) OVER (PARTITION BY job_id)+1500 AS tot FROM v_segments),
a AS (SELECT *, GREATEST(end_ms-start_ms, 0) + LEAST(CASE WHEN nxt IS NOT NULL THEN GREATEST(GREATEST(nxt-end_ms, 0)-50, 0) ELSE GREATEST(tot-end_ms, 0) END, 3000) AS av,
  CAST(LENGTH(TRIM(text))*1000.0 AS DOUBLE)/13 AS est FROM t)
SELECT job_id, seg_no, CASE WHEN est <= 0 THEN 'fits' WHEN av <= 0 THEN 'impossible' WHEN est/av <= 1.2+1e-9 THEN 'fits' WHEN est/av <= 3+1e-9 THEN 'tight' ELSE 'impossible' END AS status,
  ROUND_EVEN(est/1000, 3) AS est_dur_s, CAST(av AS DOUBLE)/1000 AS available_s, ROUND_EVEN(GREATEST(est-av, 0)/1000, 3) AS est_overrun_s FROM a""",
)
def gap_borrow(spark, sf_dir):
    return sequences.duration_status(views.segments(spark, sf_dir), shapes.totals(spark, sf_dir))


@query(
    "win_fit_plan",
    views="v_segments",
    sql=f"WITH {shapes.FIT_SQL} SELECT job_id, seg_no, effective_ms, audio_rate, video_ratio, status, overflow_s FROM fit",
)
def fit_plan(spark, sf_dir):
    return shapes.plan(spark, sf_dir).select("job_id", "seg_no", "effective_ms", "audio_rate", "video_ratio", "status", "overflow_s")


@query(
    "win_fit_cursor",
    views="v_segments",
    sql=f"""WITH {shapes.FIT_SQL}, e AS (SELECT job_id, ARG_MAX(new_end_us, seg_no) AS ne, ARG_MAX(effective_ms, seg_no) AS ef, MAX(total_ms) AS tt FROM fit GROUP BY 1)
SELECT f.job_id, f.seg_no, f.new_start_us, f.new_end_us, CAST(GREATEST(ne + GREATEST(tt-ef, 0)*1000, tt*1000) AS BIGINT) AS fitted_us FROM fit f JOIN e USING (job_id)""",
)
def fit_cursor(spark, sf_dir):
    plan = shapes.plan(spark, sf_dir)
    return plan.join(timeline.fitted_total(plan), "job_id").select("job_id", "seg_no", "new_start_us", "new_end_us", "fitted_us")


@query(
    "win_gap_chunks",
    views="v_segments",
    sql=f"""WITH {shapes.FIT_SQL},
c AS (SELECT *, COALESCE(MAX(effective_ms) OVER (PARTITION BY job_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM fit),
k AS (SELECT job_id, cur AS a, start_ms AS b, 1.0::DOUBLE AS r FROM c WHERE start_ms > cur+1 UNION ALL SELECT job_id, start_ms, effective_ms, stretch_ratio FROM c WHERE effective_ms > start_ms
  UNION ALL SELECT job_id, MAX(effective_ms), MAX(total_ms), 1.0 FROM fit GROUP BY 1 HAVING MAX(total_ms) > MAX(effective_ms)+1)
SELECT job_id, a AS chunk_start, b AS chunk_end, r AS ratio, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY a, b) AS chunk_no, (ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY a, b)-1)//4 AS batch_no FROM k""",
)
def gap_chunks(spark, sf_dir):
    return sequences.retime_chunks(shapes.plan(spark, sf_dir), 4)


def cues(spark, sf_dir):
    """Subtitle cues that overlap: the diarizer turns."""
    return views.turns(spark, sf_dir).select(
        "job_id", F.col("turn_no").alias("cue_no"), F.col("turn_start").alias("start_ms"), F.col("turn_end").alias("end_ms")
    )


@query(
    "win_deoverlap",
    views="v_turns",
    sql="""WITH d AS (SELECT job_id, turn_no AS cue_no, turn_end AS end_ms, GREATEST(turn_start, COALESCE(MAX(turn_end) OVER (PARTITION BY job_id ORDER BY turn_start, turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS start_ms FROM v_turns)
SELECT * FROM d WHERE end_ms > start_ms""",
)
def deoverlap(spark, sf_dir):
    return sequences.deoverlap(cues(spark, sf_dir))


@query(
    "win_monotone_cues",
    views="v_turns",
    sql="""SELECT job_id, turn_no AS cue_no, GREATEST(turn_start, COALESCE(MAX(GREATEST(turn_start, turn_end)) OVER (PARTITION BY job_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS start_ms,
  MAX(GREATEST(turn_start, turn_end)) OVER (PARTITION BY job_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING) AS end_ms FROM v_turns""",
)
def monotone_cues(spark, sf_dir):
    return sequences.monotone(cues(spark, sf_dir))


def downloads(spark, sf_dir):
    """Byte samples of one download per user: bytes add up event by event."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
        F.col("event_id").alias("sample_no"),
        F.round(F.col("value") * 100).cast("long").alias("step"),
    )
    done = scan(rows, ["job_id"], ["at_ms", "sample_no"], [sum_before("_b", F.col("step"))])
    return done.select(
        "job_id", "at_ms", "sample_no", (F.col("_b") + F.col("step")).alias("bytes_done"), F.lit(400000).cast("long").alias("total_bytes")
    )


@query(
    "win_rolling_rate",
    sql=f"""WITH d AS (SELECT user_id AS job_id, (epoch_us(ts)//1000) AS at_ms, event_id AS sample_no,
  CAST(SUM(CAST(ROUND(value*100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts)//1000), event_id) AS BIGINT) AS bytes_done FROM events),
f AS (SELECT *, MIN((at_ms, sample_no, bytes_done)) OVER w AS a, MAX((at_ms, sample_no, bytes_done)) OVER w AS b FROM d WINDOW w AS (PARTITION BY job_id ORDER BY at_ms RANGE BETWEEN {RATE_MS} PRECEDING AND CURRENT ROW)),
r AS (SELECT job_id, at_ms, sample_no, bytes_done, 400000::BIGINT AS total_bytes, CASE WHEN b[1]>a[1] THEN (b[3]-a[3])*1000.0::DOUBLE/(b[1]-a[1]) ELSE 0.0::DOUBLE END AS rate FROM f)
SELECT job_id, at_ms, sample_no, bytes_done, ROUND(rate, 9) AS rate, ROUND(CASE WHEN rate>0 AND total_bytes>bytes_done THEN (total_bytes-bytes_done)/rate END, 3) AS eta_s FROM r""",
)
def rolling_rate(spark, sf_dir):
    out = sequences.rolling_rate(downloads(spark, sf_dir), RATE_MS).drop("total_bytes")
    return out.withColumn("rate", F.round("rate", 9)).withColumn("eta_s", F.round("eta_s", 3))


@query(
    "win_history_window",
    views="v_takes",
    sql="""SELECT id, created_at, starred FROM v_takes WHERE (starred=1 OR id IN (SELECT id FROM v_takes ORDER BY created_at DESC, id DESC LIMIT 50))
  AND (audio_path IN (SELECT 'f' || s_suppkey FROM supplier UNION ALL SELECT CASE WHEN p_size > 10 THEN 'f' ELSE 'g' END || p_partkey FROM part) OR audio_path IS NULL)""",
)
def history_window(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("audio_path"))
    folder = F.when(F.col("p_size") > 10, "f").otherwise("g")
    more = table(spark, sf_dir, "part").select(F.concat(folder, F.col("p_partkey").cast("string")).alias("audio_path"))
    files = files.unionByName(more)
    return sequences.history_window(views.takes(spark, sf_dir), files).select("id", "created_at", "starred")


@query(
    "win_retention",
    views="v_takes",
    sql="SELECT id FROM v_takes WHERE starred=0 QUALIFY ROW_NUMBER() OVER (ORDER BY created_at, id) <= (SELECT COUNT(*)-200 FROM v_takes)",
)
def retention(spark, sf_dir):
    return sequences.retention_victims(views.takes(spark, sf_dir).select("id", "created_at", "starred"), 200).select("id")


BUDGET = 500_000_000


@query(
    "win_lru_evict",
    views="v_files",
    sql=f"""WITH p AS (SELECT *, COALESCE(SUM(bytes) OVER (ORDER BY mtime, bytes, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, SUM(bytes) OVER () AS total FROM v_files)
SELECT file_id, path, bytes FROM p WHERE total-freed > {BUDGET}""",
)
def lru_evict(spark, sf_dir):
    return sequences.lru_victims(views.files(spark, sf_dir), BUDGET).select("file_id", "path", "bytes")


RANK_SQL = """rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id, speaker_id ORDER BY near_other, dur_ms DESC, seg_no) AS rank FROM (
  SELECT *, end_ms-start_ms AS dur_ms, EXISTS (SELECT 1 FROM v_segments o WHERE o.job_id=s.job_id AND o.speaker_id<>s.speaker_id
    AND GREATEST(o.start_ms-s.end_ms, s.start_ms-o.end_ms) < 300) AS near_other FROM v_segments s))"""


@query("win_reference_rank", views="v_segments", sql=f"WITH {RANK_SQL} SELECT job_id, seg_no, speaker_id, near_other, dur_ms, rank FROM rk")
def reference_rank(spark, sf_dir):
    out = sequences.reference_ranking(views.segments(spark, sf_dir))
    return out.select("job_id", "seg_no", "speaker_id", "near_other", "dur_ms", "rank")


RATE_HZ = 50


def waves(spark, sf_dir):
    """Short waveforms: each embedding as samples, with a quiet head of varying length."""
    head = F.array_repeat(F.lit(0.0).cast("float"), ((F.col("vec_id") % 4) * 40).cast("int"))
    body = F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 45, x * F.lit(0.02).cast("float")).otherwise(x))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(head, body.cast("array<float>")).alias("wave"))
    return rows.select(
        "vec_id", "wave", F.lit(0).cast("long").alias("start_ms"), (F.size("wave") * 1000 / RATE_HZ).cast("long").alias("end_ms")
    )


WAVE_SQL = """s AS (SELECT vec_id, i-1 AS i, CAST(CASE WHEN i <= h THEN 0 WHEN i-1-h < vec_id%45 THEN CAST(embedding[i-h]*CAST(0.02 AS FLOAT) AS FLOAT) ELSE embedding[i-h] END AS DOUBLE) AS x
  FROM (SELECT vec_id, embedding, (vec_id%4)*40 AS h, UNNEST(range(1, (vec_id%4)*40+len(embedding)+1)) AS i FROM embeddings)),
f AS (SELECT vec_id, i AS f, SQRT(x*x) AS rms FROM s),
l AS (SELECT *, CASE WHEN pk < 1e-3 THEN 0 WHEN rms >= GREATEST(pk*0.1, 1e-3) THEN 1 ELSE 0 END AS loud FROM (SELECT *, MAX(rms) OVER (PARTITION BY vec_id) AS pk FROM f)),
o AS (SELECT *, SUM(loud) OVER (PARTITION BY vec_id ORDER BY f ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS ahead,
  COALESCE(SUM(loud) OVER (PARTITION BY vec_id ORDER BY f ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) AS behind FROM l),
on1 AS (SELECT vec_id, MIN(f) FILTER (loud=1 AND ahead >= 8) AS onset, COUNT(*)*20 AS end_ms FROM o GROUP BY 1)"""


@query("win_rms_onset", sql=f"WITH {WAVE_SQL} SELECT vec_id, CAST(onset*20 AS BIGINT) AS onset_ms FROM on1")
def rms_onset(spark, sf_dir):
    rows = waveform.with_loud_frames(waves(spark, sf_dir), "wave", RATE_HZ)
    frame = waveform.sustained_onset(F.col("loud"), RATE_HZ)
    ms = (frame * waveform.frame_length(RATE_HZ) * 1000 / RATE_HZ).cast("long")
    return rows.select("vec_id", ms.alias("onset_ms"))


@query("win_onset_hysteresis", sql=f"WITH {WAVE_SQL} SELECT vec_id, CAST(f*20 AS BIGINT) AS onset_ms FROM o WHERE loud=1 AND behind=0")
def onset_hysteresis(spark, sf_dir):
    rows = waveform.with_loud_frames(waves(spark, sf_dir), "wave", RATE_HZ)
    frames = rows.select("vec_id", F.explode(waveform.onset_frames(F.col("loud"), RATE_HZ)).alias("f"))
    return frames.select("vec_id", (F.col("f") * waveform.frame_length(RATE_HZ) * 1000 / RATE_HZ).cast("long").alias("onset_ms"))


@query(
    "win_snap_start",
    sql=f"""WITH {WAVE_SQL},
sk AS (SELECT o.vec_id, MAX(rms) AS pk FROM o JOIN on1 USING (vec_id) WHERE f < onset GROUP BY 1),
sh AS (SELECT o.vec_id, AVG(CASE WHEN rms >= GREATEST(1e-3, sk.pk*0.02) THEN 1.0 ELSE 0.0 END) AS share FROM o JOIN on1 USING (vec_id) JOIN sk USING (vec_id) WHERE f < onset GROUP BY 1)
SELECT vec_id, CAST(CASE WHEN end_ms >= 450 AND onset IS NOT NULL AND onset*20-50 >= 150 AND (onset*20-50 <= 1500 OR COALESCE(share, 0) <= 0.1) AND LEAST(onset*20-50, end_ms-300) >= 150
  THEN LEAST(onset*20-50, end_ms-300) ELSE 0 END AS BIGINT) AS snapped_ms FROM on1 LEFT JOIN sh USING (vec_id)""",
)
def snap_start(spark, sf_dir):
    return waveform.snap_starts(waves(spark, sf_dir), "wave", RATE_HZ).select("vec_id", "snapped_ms")
