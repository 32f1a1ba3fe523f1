"""Join queries on the timeline views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import views
from cuewright.functions.hashing import canonical, canonical_sql, short_sha1
from cuewright.operators import timeline
from cuewright.plans import shapes
from cuewright.plans.registry import query


@query(
    "join_overlap_majority",
    views="v_segments v_turns",
    sql="""
WITH ov AS (SELECT s.job_id, s.seg_no, t.speaker, SUM(LEAST(end_ms, turn_end)-GREATEST(start_ms, turn_start)) AS o, MIN(turn_no) AS f
  FROM v_segments s JOIN v_turns t ON s.job_id=t.job_id AND LEAST(end_ms, turn_end) > GREATEST(start_ms, turn_start) GROUP BY 1,2,3),
best AS (SELECT * FROM ov QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id, seg_no ORDER BY o DESC, f) = 1),
mid AS (SELECT s.job_id, s.seg_no, ARG_MIN(t.speaker, t.turn_no) AS speaker FROM v_segments s JOIN v_turns t
  ON s.job_id=t.job_id AND turn_start*2 <= start_ms+end_ms AND start_ms+end_ms <= turn_end*2 GROUP BY 1,2),
gap AS (SELECT job_id, seg_no, SUM(j) OVER (PARTITION BY job_id ORDER BY seg_no ROWS UNBOUNDED PRECEDING) % 2 AS k
  FROM (SELECT *, CASE WHEN start_ms - LAG(end_ms) OVER (PARTITION BY job_id ORDER BY seg_no) > 1200 THEN 1 ELSE 0 END AS j FROM v_segments)),
got AS (SELECT s.*, CASE WHEN s.job_id%9=4 THEN NULL ELSE COALESCE(b.speaker, m.speaker) END AS sp, CASE WHEN s.job_id%9=4 THEN 0 ELSE COALESCE(b.o, 0) END AS o, g.k FROM v_segments s
  JOIN gap g ON g.job_id=s.job_id AND g.seg_no=s.seg_no
  LEFT JOIN best b ON b.job_id=s.job_id AND b.seg_no=s.seg_no LEFT JOIN mid m ON m.job_id=s.job_id AND m.seg_no=s.seg_no)
SELECT job_id, seg_no, speaker_id, start_ms, end_ms, CAST(o AS BIGINT) AS overlap_ms,
  CASE WHEN job_id%9=4 THEN 'Speaker ' || CAST(k+1 AS VARCHAR) WHEN sp IS NULL THEN speaker_id ELSE 'Speaker ' || CAST(CAST(SUBSTR(sp, 9) AS INT)+1 AS VARCHAR) END AS assigned FROM got""",
)
def overlap_majority(spark, sf_dir):
    """The turns of every ninth job lack their speaker, so that job has none to use."""
    speaker = F.when(F.col("job_id") % 9 != 4, F.col("speaker"))
    turns = views.turns(spark, sf_dir).withColumn("speaker", speaker)
    out = timeline.majority_speaker(views.segments(spark, sf_dir), turns)
    return out.select("job_id", "seg_no", "speaker_id", "start_ms", "end_ms", "overlap_ms", "assigned")


def _heard(spark, sf_dir):
    """Second-pass recognition: the turns with their recognised text."""
    texts = views.segments(spark, sf_dir).select("job_id", F.col("seg_no").alias("turn_no"), F.col("text").alias("turn_text"))
    return views.turns(spark, sf_dir).join(texts, ["job_id", "turn_no"])


@query(
    "join_overlap_concat",
    views="v_segments v_turns",
    sql="""
WITH hits AS (SELECT s.job_id, s.seg_no, MIN(turn_start) AS a, MAX(turn_end) AS b, COUNT(*) AS n,
    TRIM(STRING_AGG(TRIM(x.text), ' ' ORDER BY t.turn_no)) AS txt
  FROM v_segments s JOIN v_turns t ON s.job_id=t.job_id AND LEAST(s.end_ms, turn_end) > GREATEST(s.start_ms, turn_start)
  JOIN v_segments x ON x.job_id=t.job_id AND x.seg_no=t.turn_no GROUP BY 1,2)
SELECT s.job_id, s.seg_no, a AS heard_start, b AS heard_end, COALESCE(txt, '') AS heard_text
FROM v_segments s LEFT JOIN hits h ON h.job_id=s.job_id AND h.seg_no=s.seg_no""",
)
def overlap_concat(spark, sf_dir):
    out = timeline.recognised_text(views.segments(spark, sf_dir), _heard(spark, sf_dir))
    return out.select("job_id", "seg_no", "heard_start", "heard_end", "heard_text")


BEST = """
WITH m AS (SELECT t.job_id, t.turn_no, s.seg_no, s.speaker_id, LEAST(end_ms, turn_end)-GREATEST(start_ms, turn_start) AS o
  FROM v_turns t JOIN v_segments s ON s.job_id=t.job_id AND LEAST(end_ms, turn_end) > GREATEST(start_ms, turn_start)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY t.job_id, t.turn_no ORDER BY o DESC, ABS(turn_start+turn_end-start_ms-end_ms), s.seg_no) = 1)"""


@query(
    "join_overlap_best",
    views="v_segments v_turns",
    sql=BEST + " SELECT t.job_id, t.turn_no, m.seg_no AS prior_seg, m.o AS overlap_ms FROM v_turns t LEFT JOIN m ON m.job_id=t.job_id AND m.turn_no=t.turn_no",
)
def overlap_best(spark, sf_dir):
    out = timeline.best_prior_segment(views.turns(spark, sf_dir), views.segments(spark, sf_dir))
    return out.select("job_id", "turn_no", F.col("prior.seg_no").alias("prior_seg"), "overlap_ms")


@query(
    "join_carry_metadata",
    views="v_segments v_turns",
    sql=BEST
    + """ SELECT t.job_id, t.turn_no, t.turn_start AS start_ms, t.turn_end AS end_ms,
  COALESCE(NULLIF(m.speaker_id, ''), 'Speaker 1') AS carried_speaker, m.seg_no AS prior_seg
  FROM v_turns t LEFT JOIN m ON m.job_id=t.job_id AND m.turn_no=t.turn_no""",
)
def carry_metadata(spark, sf_dir):
    out = timeline.carry_metadata(views.turns(spark, sf_dir), views.segments(spark, sf_dir))
    return out.select(
        "job_id",
        "turn_no",
        F.col("turn_start").alias("start_ms"),
        F.col("turn_end").alias("end_ms"),
        "carried_speaker",
        F.col("prior.seg_no").alias("prior_seg"),
    )


VOTE_SQL = """
near AS (SELECT s.job_id, s.seg_no, f.* EXCLUDE (job_id) FROM v_segments s JOIN frames f
  ON f.job_id=s.job_id AND f.frame_ms BETWEEN s.start_ms-500 AND s.end_ms+500),
bare AS (SELECT * FROM v_segments s WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.job_id=s.job_id AND n.seg_no=s.seg_no)),
alls AS (SELECT * FROM near UNION ALL
  SELECT s.job_id, s.seg_no, f.* EXCLUDE (job_id) FROM bare s JOIN frames f ON f.job_id=s.job_id
  QUALIFY ROW_NUMBER() OVER (PARTITION BY s.job_id, s.seg_no ORDER BY ABS(2*f.frame_ms-s.start_ms-s.end_ms), f.frame_ms) = 1)"""


def _vote(column: str, source: str, by: str) -> str:
    return (
        f"(SELECT {by}, {column} AS val FROM (SELECT {by}, {column}, COUNT(*) AS n, MIN(frame_ms) AS f FROM {source} GROUP BY ALL) "
        f"QUALIFY ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY n DESC, f) = 1)"
    )


@query(
    "join_point_window_nearest",
    views="v_segments v_turns",
    sql=f"WITH {shapes.FRAMES_SQL}, {VOTE_SQL} SELECT job_id, seg_no, frame_ms, mood FROM alls",
)
def point_window_nearest(spark, sf_dir):
    near = timeline.frames_near_segments(views.segments(spark, sf_dir), shapes.frames(spark, sf_dir))
    return near.select("job_id", "seg_no", "frame_ms", "mood")


@query(
    "agg_segment_mode",
    views="v_segments v_turns",
    sql=f"""WITH {shapes.FRAMES_SQL}, {VOTE_SQL}
SELECT s.job_id, s.seg_no, COALESCE(b.val,'unknown') AS brightness, COALESCE(m.val,'unknown') AS mood,
  COALESCE(c.val,'unknown') AS complexity, COALESCE(n.n, 0) AS frame_count, gm.val AS job_mood, gb.val AS job_brightness
FROM v_segments s
LEFT JOIN {_vote('brightness', 'alls', 'job_id, seg_no')} b USING (job_id, seg_no)
LEFT JOIN {_vote('mood', 'alls', 'job_id, seg_no')} m USING (job_id, seg_no)
LEFT JOIN {_vote('complexity', 'alls', 'job_id, seg_no')} c USING (job_id, seg_no)
LEFT JOIN (SELECT job_id, seg_no, COUNT(*) AS n FROM alls GROUP BY 1,2) n USING (job_id, seg_no)
LEFT JOIN {_vote('mood', 'frames', 'job_id')} gm USING (job_id)
LEFT JOIN {_vote('brightness', 'frames', 'job_id')} gb USING (job_id)""",
)
def segment_mode(spark, sf_dir):
    segs, frames = views.segments(spark, sf_dir), shapes.frames(spark, sf_dir)
    local = timeline.segment_context(segs, frames, ["brightness", "mood", "complexity"])
    overall = timeline.global_context(frames, ["mood", "brightness"]).select(
        "job_id", F.col("mood").alias("job_mood"), F.col("brightness").alias("job_brightness")
    )
    return local.join(overall, "job_id", "left")


@query(
    "join_piecewise_asof",
    views="v_segments v_turns",
    sql=f"""WITH {shapes.FIT_SQL},
nx AS (SELECT t.job_id, t.turn_no, t.turn_start AS t_ms, f.* EXCLUDE (job_id) FROM v_turns t JOIN fit f ON f.job_id=t.job_id AND f.effective_ms >= t.turn_start
  QUALIFY ROW_NUMBER() OVER (PARTITION BY t.job_id, t.turn_no ORDER BY f.effective_ms, f.seg_no) = 1),
ls AS (SELECT job_id, MAX(effective_ms) AS le, ARG_MAX(new_end_us, seg_no) AS ln FROM fit GROUP BY 1)
SELECT t.job_id, t.turn_no, t.turn_start AS time_ms, CAST(CASE
  WHEN nx.seg_no IS NULL THEN ln + (t.turn_start-le)*1000
  WHEN t.turn_start < nx.start_ms THEN nx.new_start_us - (nx.start_ms-t.turn_start)*1000
  WHEN nx.effective_ms-nx.start_ms <= 0 THEN nx.new_start_us
  ELSE nx.new_start_us + CAST(ROUND((t.turn_start-nx.start_ms)*(nx.new_end_us-nx.new_start_us)/CAST(nx.effective_ms-nx.start_ms AS DOUBLE)) AS BIGINT) END AS BIGINT) AS fitted_us
FROM v_turns t LEFT JOIN nx ON nx.job_id=t.job_id AND nx.turn_no=t.turn_no LEFT JOIN ls ON ls.job_id=t.job_id""",
)
def piecewise_asof(spark, sf_dir):
    times = views.turns(spark, sf_dir).select("job_id", "turn_no", F.col("turn_start").alias("time_ms"))
    return timeline.map_times(times, shapes.plan(spark, sf_dir), "time_ms", "turn_no")


@query(
    "join_proximity_flag",
    views="v_segments",
    sql="""SELECT job_id, seg_no, EXISTS (SELECT 1 FROM v_segments o WHERE o.job_id=s.job_id AND o.speaker_id<>s.speaker_id
  AND GREATEST(o.start_ms-s.end_ms, s.start_ms-o.end_ms) < 300) AS near_other FROM v_segments s""",
)
def proximity_flag(spark, sf_dir):
    return timeline.near_other_speaker(views.segments(spark, sf_dir)).select("job_id", "seg_no", "near_other")


@query(
    "join_fitted_times",
    views="v_segments",
    sql=f"""WITH {shapes.FIT_SQL},
ft AS (SELECT job_id, CASE WHEN job_id%5=0 THEN NULL ELSE seg_no END AS seg_no, new_start_us, new_end_us,
  ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seg_no) AS position FROM fit WHERE status <> 'fits'),
pos AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seg_no) AS position FROM v_segments),
idless AS (SELECT job_id FROM ft GROUP BY 1 HAVING MAX(CASE WHEN seg_no IS NULL THEN 0 ELSE 1 END)=0)
SELECT p.job_id, p.seg_no, COALESCE(a.new_start_us, b.new_start_us, start_ms*1000) AS out_start_us,
  COALESCE(a.new_end_us, b.new_end_us, end_ms*1000) AS out_end_us, a.new_start_us IS NOT NULL OR b.new_start_us IS NOT NULL AS fitted
FROM pos p LEFT JOIN ft a ON a.job_id=p.job_id AND a.seg_no=p.seg_no
LEFT JOIN (SELECT * FROM ft WHERE job_id IN (SELECT job_id FROM idless)) b ON b.job_id=p.job_id AND b.position=p.position""",
)
def fitted_times(spark, sf_dir):
    from cuewright.operators.ordered import row_number, scan

    fitted = shapes.plan(spark, sf_dir).filter(F.col("status") != "fits")
    fitted = scan(fitted, ["job_id"], ["seg_no"], [row_number("position")])
    fitted = fitted.withColumn("seg_no", F.when(F.col("job_id") % 5 != 0, F.col("seg_no")))
    segs = scan(views.segments(spark, sf_dir), ["job_id"], ["seg_no"], [row_number("position")])
    out = timeline.overlay_fitted_times(segs, fitted)
    return out.select("job_id", "seg_no", "out_start_us", "out_end_us", "fitted")


@query(
    "join_lang_overlay",
    views="v_segments",
    sql="""WITH base AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seg_no)-1 AS idx FROM v_segments),
tr AS (SELECT job_id, CASE WHEN speaker_id='user' THEN CAST(seg_no AS VARCHAR) ELSE 'x' || CAST(seg_no AS VARCHAR) END AS k,
  CASE WHEN LENGTH(text) < 200 THEN '  ' ELSE '[' || text || ']' END AS t FROM v_segments)
SELECT b.job_id, b.seg_no, COALESCE(NULLIF(CASE WHEN TRIM(COALESCE(a.t, c.t)) = '' THEN '' ELSE COALESCE(a.t, c.t) END, ''), b.text) AS out_text
FROM base b LEFT JOIN tr a ON a.job_id=b.job_id AND a.k=CAST(b.seg_no AS VARCHAR) LEFT JOIN tr c ON c.job_id=b.job_id AND c.k=CAST(b.idx AS VARCHAR)""",
)
def lang_overlay(spark, sf_dir):
    from cuewright.operators.lookups import overlay_texts
    from cuewright.operators.ordered import row_number, scan

    segs = views.segments(spark, sf_dir)
    numbered = scan(segs, ["job_id"], ["seg_no"], [row_number("rn")]).withColumn("idx", F.col("rn") - 1)
    key = F.when(F.col("speaker_id") == "user", F.col("seg_no").cast("string")).otherwise(
        F.concat(F.lit("x"), F.col("seg_no").cast("string"))
    )
    texts = segs.select("job_id", key.alias("key"), F.when(F.length("text") < 200, "  ").otherwise(F.concat(F.lit("["), "text", F.lit("]"))).alias("new_text"))
    return overlay_texts(numbered, texts).select("job_id", "seg_no", "out_text")


FP = {"text": "text", "speaker": "speaker_id"}


@query(
    "join_incremental_diff",
    views="v_segments",
    sql=f"""WITH cur AS (SELECT job_id, seg_no, LEFT(SHA1({canonical_sql(FP)}), 16) AS fp FROM v_segments),
old AS (SELECT job_id, seg_no, LEFT(SHA1({canonical_sql(FP)}), 16) AS fp
  FROM (SELECT job_id, seg_no, REPLACE(text, ' der ', ' ') AS text, speaker_id FROM v_segments WHERE speaker_id <> 'system') x)
SELECT cur.job_id, cur.seg_no, cur.fp AS fingerprint, CASE WHEN old.fp = cur.fp THEN 'fresh' ELSE 'stale' END AS state
FROM cur LEFT JOIN old ON old.job_id=cur.job_id AND old.seg_no=cur.seg_no""",
)
def incremental_diff(spark, sf_dir):
    from cuewright.operators.lookups import stale_segments

    segs = views.segments(spark, sf_dir)

    def prints(df):
        fields = {name: F.col(col) for name, col in FP.items()}
        return df.select("job_id", "seg_no", short_sha1(canonical(fields)).alias("fingerprint"))

    stored = segs.filter(F.col("speaker_id") != "system").withColumn("text", F.replace("text", F.lit(" der "), F.lit(" ")))
    return stale_segments(prints(segs), prints(stored), ["job_id", "seg_no"])
