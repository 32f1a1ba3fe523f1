"""Speaker assignment, cue matching and fit planning on (job_id, seg_no) segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators.asof import asof
from cuewright.operators.intervals import interval_join
from cuewright.operators.ordered import following, largest_group, previous, row_number, running_max, running_sum, scan, sum_before

AUDIO_ONLY_HARD_CAP = 1.8
UNDERRUN_TOLERANCE = 0.95
EPS = 1e-9
ADJACENT_GUARD_MS = 300
FRAME_MARGIN_MS = 500
GAP_SPEAKERS = 2
SPEAKER_GAP_MS = 1200


@dataclass(frozen=True)
class FitSettings:
    audio_only_rate: float = 1.2
    audio_cap: float = 1.5
    video_cap: float = 2.0
    guard_ms: int = 50
    retime: bool = True
    slowest: float = 0.85


def _touching(segs: DataFrame, turns: DataFrame) -> DataFrame:
    overlap = F.least("end_ms", "turn_end") - F.greatest("start_ms", "turn_start")
    return interval_join(
        segs,
        turns,
        ["job_id"],
        (F.col("start_ms"), F.col("end_ms")),
        (F.col("turn_start"), F.col("turn_end")),
        overlap > 0,
    ).withColumn("overlap_ms", overlap)


def display_label(raw: Column) -> Column:
    """``SPEAKER_00`` reads ``Speaker 1``; labels without a number stay as they are."""
    number = F.regexp_extract(raw, r"(?:^|_)(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("Speaker "), (number.cast("long") + 1).cast("string"))).otherwise(raw)


def speakers_by_gap(segs: DataFrame, speakers: int | None = None, gap_ms: int = SPEAKER_GAP_MS) -> DataFrame:
    """Label moves on to the next speaker after every silence longer than the gap."""
    n = speakers if speakers is not None and speakers >= 1 else 2
    bound = largest_group(segs, ["job_id"])
    seen = scan(segs, ["job_id"], ["seg_no"], [previous("_end", F.col("end_ms"))], bound=bound)
    jump = F.when(F.col("start_ms") - F.col("_end") > gap_ms, 1).otherwise(0)
    counted = scan(seen, ["job_id"], ["seg_no"], [running_sum("_jumps", jump)], bound=bound)
    label = F.concat(F.lit("Speaker "), (F.pmod(F.col("_jumps"), F.lit(n)) + 1).cast("string"))
    return counted.withColumn("gap_speaker", label).drop("_end", "_jumps")


def majority_speaker(segs: DataFrame, turns: DataFrame, relabel: bool = True, by_gap: bool = True) -> DataFrame:
    """Speaker with the largest summed overlap, else the first turn around the midpoint.

    Adds ``assigned`` and ``overlap_ms`` (0 without overlap). Equal sums go to the speaker
    whose turn comes first. Segments nothing covers keep ``speaker_id``; a job without any usable
    turn takes the labels of ``speakers_by_gap``, unless ``by_gap`` is off.
    """
    known = turns.dropna(subset=["speaker", "turn_start", "turn_end"])
    slim = segs.select("job_id", "seg_no", "start_ms", "end_ms")
    overlap = F.least("end_ms", "turn_end") - F.greatest("start_ms", "turn_start")
    # Twice the midpoint stays an integer, compared with doubled turn ends.
    mid2 = F.col("start_ms") + F.col("end_ms")
    around = (F.col("turn_start") * 2 <= mid2) & (mid2 <= F.col("turn_end") * 2)
    met = interval_join(
        slim,
        known,
        ["job_id"],
        (F.col("start_ms"), F.col("end_ms")),
        (F.col("turn_start"), F.col("turn_end")),
        (overlap > 0) | around,
    )
    per_speaker = met.groupBy("job_id", "seg_no", "speaker").agg(
        F.sum(F.when(overlap > 0, overlap)).alias("overlap_ms"),
        F.min(F.when(overlap > 0, F.col("turn_no"))).alias("first_turn"),
        F.min(F.when(around, F.col("turn_no"))).alias("mid_turn"),
    )
    rank = F.when(F.col("overlap_ms").isNotNull(), F.struct("overlap_ms", -F.col("first_turn")))
    best = per_speaker.groupBy("job_id", "seg_no").agg(
        F.max_by(F.struct("speaker", "overlap_ms"), rank).alias("best"), F.min_by("speaker", "mid_turn").alias("mid_speaker")
    )
    found = F.coalesce(F.col("best.speaker"), F.col("mid_speaker"))
    joined, otherwise = segs.join(best, ["job_id", "seg_no"], "left"), [F.col("speaker_id")]
    if by_gap:
        bare = segs.join(known.select("job_id").distinct(), "job_id", "left_anti")
        gaps = speakers_by_gap(bare, GAP_SPEAKERS).select("job_id", "seg_no", "gap_speaker")
        joined, otherwise = joined.join(gaps, ["job_id", "seg_no"], "left"), [F.col("gap_speaker"), *otherwise]
    return joined.select(
        *segs.columns,
        F.coalesce(display_label(found) if relabel else found, *otherwise).alias("assigned"),
        F.coalesce(F.col("best.overlap_ms"), F.lit(0).cast("long")).alias("overlap_ms"),
    )


def recognised_text(segs: DataFrame, heard: DataFrame) -> DataFrame:
    """Text and span of everything recognised while a segment plays.

    ``heard`` has turn_no, turn_start, turn_end and turn_text.
    """
    slim = segs.select("job_id", "seg_no", "start_ms", "end_ms")
    pieces = F.array_sort(F.collect_list(F.struct("turn_no", F.trim("turn_text").alias("piece"))))
    hits = (
        _touching(slim, heard)
        .groupBy("job_id", "seg_no")
        .agg(
            F.trim(F.array_join(F.transform(pieces, lambda p: p.piece), " ")).alias("heard_text"),
            F.min("turn_start").alias("heard_start"),
            F.max("turn_end").alias("heard_end"),
        )
    )
    return segs.join(hits, ["job_id", "seg_no"], "left").withColumn(
        "heard_text", F.coalesce("heard_text", F.lit(""))
    )


def best_prior_segment(cues: DataFrame, prior: DataFrame) -> DataFrame:
    """Per cue the prior segment with most overlap, then nearest midpoint, then lowest number.

    ``cues`` has turn_no, turn_start, turn_end. Adds ``prior`` (struct of the prior columns).
    """
    slim = cues.select("job_id", "turn_no", "turn_start", "turn_end")
    away = F.abs(F.col("turn_start") + F.col("turn_end") - F.col("start_ms") - F.col("end_ms"))
    held = F.struct(*[c for c in prior.columns if c != "job_id"])
    best = (
        _touching(prior, slim)
        .groupBy("job_id", "turn_no")
        .agg(
            F.max_by(F.struct(held.alias("row"), "overlap_ms"), F.struct("overlap_ms", -away, -F.col("seg_no"))).alias("m")
        )
        .select("job_id", "turn_no", F.col("m.row").alias("prior"), F.col("m.overlap_ms").alias("overlap_ms"))
    )
    return cues.join(best, ["job_id", "turn_no"], "left")


def carry_metadata(cues: DataFrame, prior: DataFrame, default_speaker: str = "Speaker 1") -> DataFrame:
    """New cue text and times with the cast of the best prior segment."""
    matched = best_prior_segment(cues, prior)
    return matched.withColumn(
        "carried_speaker", F.coalesce(F.nullif(F.col("prior.speaker_id"), F.lit("")), F.lit(default_speaker))
    )


def near_other_speaker(segs: DataFrame, guard_ms: int = ADJACENT_GUARD_MS, limit: int | None = None) -> DataFrame:
    """Flag ``near_other``: an edge lies within the guard of another speaker's segment.

    A sweep over the job's clock, no pairs: each segment enters at its start and asks at its end plus
    the guard for the latest end of another speaker so far. Two running values answer that: the latest end
    with its speaker, who leads, and the latest end of anyone else. When the lead passes on, the
    old leader's end is the latest of all others, so the second value starts anew from there.
    Segments without a speaker are never near anyone.
    """
    keys = ["job_id"]
    known = F.col("speaker_id").isNotNull()
    asks = segs.select("*", F.lit(0).alias("_kind"), (F.col("end_ms") + guard_ms).alias("_at"))
    enters = segs.filter(known).select("*", F.lit(1).alias("_kind"), F.col("start_ms").alias("_at"))
    order = ["_at", "_kind", "seg_no", "speaker_id"]
    bound = 2 * largest_group(segs, keys)
    events = scan(asks.unionByName(enters), keys, order, [row_number("_nth")], limit, bound)
    entry = F.when(F.col("_kind") == 1, F.struct(F.col("end_ms").alias("end"), (-F.col("_nth")).alias("first"), F.col("speaker_id").alias("who")))
    led = scan(events, keys, ["_nth"], [running_max("_lead", entry)], limit, bound)
    led = scan(led, keys, ["_nth"], [previous("_was", F.col("_lead"))], limit, bound)
    changed = F.col("_was").isNotNull() & (F.col("_was.who") != F.col("_lead.who"))
    reigns = scan(led, keys, ["_nth"], [running_sum("_reign", changed.cast("int"))], limit, bound)
    other = F.when(changed, F.col("_was.end")).when((F.col("_kind") == 1) & (F.col("speaker_id") != F.col("_lead.who")), F.col("end_ms"))
    found = scan(reigns, [*keys, "_reign"], ["_nth"], [running_max("_others", other)], limit, bound)
    latest = F.when(F.col("_lead.who") != F.col("speaker_id"), F.col("_lead.end")).otherwise(F.col("_others"))
    near = F.coalesce(known & (latest > F.col("start_ms") - guard_ms), F.lit(False))
    return found.filter(F.col("_kind") == 0).select(*segs.columns, near.alias("near_other"))


def _first_seen_vote(frames: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Most frequent value of each column per group; equal counts go to the first seen.

    All columns are voted on in one pass: (column, value) pairs are pre-counted first.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]))
    counted = (
        frames.select(*by, "frame_ms", pairs.alias("p"))
        .groupBy(*by, "p.field", "p.value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("frame_ms").alias("seen"))
    )
    pick = [
        F.max_by(
            F.when(F.col("field") == c, F.col("value")),
            F.when(F.col("field") == c, F.struct("n", -F.col("seen"))),
        ).alias(c)
        for c in columns
    ]
    return counted.groupBy(*by).agg(*pick, F.sum(F.when(F.col("field") == columns[0], F.col("n"))).alias("frame_count"))


def frames_near_segments(segs: DataFrame, frames: DataFrame, margin_ms: int = FRAME_MARGIN_MS) -> DataFrame:
    """Frames inside a segment widened by the margin, else the one nearest its midpoint.

    ``frames`` is unique on (job_id, frame_ms).
    """
    slim = segs.select("job_id", "seg_no", "start_ms", "end_ms")
    inside = interval_join(
        slim,
        frames,
        ["job_id"],
        (F.col("start_ms") - margin_ms, F.col("end_ms") + margin_ms),
        (F.col("frame_ms"), F.col("frame_ms")),
        F.col("frame_ms").between(F.col("start_ms") - margin_ms, F.col("end_ms") + margin_ms),
    )
    bare = slim.join(inside.select("job_id", "seg_no").distinct(), ["job_id", "seg_no"], "left_anti")
    doubled = frames.withColumn("mid2", F.col("frame_ms") * 2)
    looked = asof(
        bare.withColumn("mid2", F.col("start_ms") + F.col("end_ms")),
        doubled,
        ["job_id"],
        "mid2",
        "mid2",
        "seg_no",
        "frame_ms",
        largest_group(slim, ["job_id"]),
    )
    back, ahead = F.col("mid2") - F.col("_before.mid2"), F.col("_after.mid2") - F.col("mid2")
    nearest = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    extra = [c for c in frames.columns if c != "job_id"]
    fallback = looked.withColumn("f", nearest).filter(F.col("f").isNotNull())
    fallback = fallback.select(*slim.columns, *[F.col(f"f.{c}").alias(c) for c in extra])
    return inside.select(*slim.columns, *extra).unionByName(fallback)


def segment_context(segs: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """Majority value of each column per segment, ``unknown`` where the job has no frames."""
    voted = _first_seen_vote(frames_near_segments(segs, frames), ["job_id", "seg_no"], columns)
    joined = segs.select("job_id", "seg_no").join(voted, ["job_id", "seg_no"], "left")
    return joined.select(
        "job_id",
        "seg_no",
        *[F.coalesce(c, F.lit("unknown")).alias(c) for c in columns],
        F.coalesce("frame_count", F.lit(0).cast("long")).alias("frame_count"),
    )


def global_context(frames: DataFrame, columns: list[str]) -> DataFrame:
    return _first_seen_vote(frames, ["job_id"], columns)


def fit_rates(need: Column, settings: FitSettings = FitSettings()) -> tuple[Column, Column, Column]:
    """(audio rate, video ratio, status) of one need ratio."""
    s = settings
    slow = (need > EPS) & (need < UNDERRUN_TOLERANCE) & F.lit(s.slowest < 1.0 - EPS)
    under, light = need <= 1.0 + EPS, need <= s.audio_only_rate + EPS
    low = F.when(slow, F.greatest(need, F.lit(s.slowest))).otherwise(F.lit(1.0))
    if s.retime:
        hard_audio = F.least(F.sqrt(need), F.lit(s.audio_cap))
        hard_video = F.least(need / hard_audio, F.lit(s.video_cap))
        held = hard_audio * hard_video >= need - EPS
        hard_status = F.when(held, "hybrid").otherwise("overflow_trimmed")
    else:
        hard_audio, hard_video = F.least(need, F.lit(AUDIO_ONLY_HARD_CAP)), F.lit(1.0)
        hard_status = F.when(hard_audio >= need - EPS, "audio_stretched").otherwise("overflow_trimmed")
    audio = F.when(under, low).when(light, need).otherwise(hard_audio)
    video = F.when(under | light, F.lit(1.0)).otherwise(hard_video)
    status = (
        F.when(under, F.when(slow, "audio_slowed").otherwise("fits")).when(light, "audio_stretched").otherwise(hard_status)
    )
    return audio, video, status


def fit_plan(segs: DataFrame, totals: DataFrame, settings: FitSettings = FitSettings()) -> DataFrame:
    """Smart-fit layout per job: rates, new placement, status and overflow of each segment.

    ``segs`` has natural_ms (length of the generated speech); ``totals`` one total_ms per job.
    Placement is summed in whole microseconds so the result does not depend on slice order.
    """
    bound = largest_group(segs, ["job_id"])
    ahead = scan(segs, ["job_id"], ["seg_no"], [following("next_start", F.col("start_ms"))], bound=bound)
    rows = ahead.join(totals, "job_id")
    start, end, nxt = F.col("start_ms"), F.col("end_ms"), F.col("next_start")
    roomy = F.least(F.greatest(end, nxt - settings.guard_ms, start), F.greatest(nxt, end))
    tail = F.when(F.col("total_ms") > 0, F.greatest(end, F.col("total_ms"))).otherwise(end)
    rows = rows.withColumn("effective_ms", F.when(nxt.isNotNull(), roomy).otherwise(tail))
    slot = F.greatest(F.col("effective_ms") - start, F.lit(1))
    rows = rows.withColumn("slot_ms", slot).withColumn(
        "need", F.when(F.col("natural_ms") > 0, F.col("natural_ms") / F.col("slot_ms")).otherwise(F.lit(0.0))
    )
    audio, video, status = fit_rates(F.col("need"), settings)
    rows = rows.select("*", audio.alias("audio_rate"), video.alias("video_ratio"), status.alias("base_status"))
    rows = rows.withColumn("span_us", F.round(F.col("slot_ms") * 1000 * F.col("video_ratio")).cast("long"))
    pause = F.greatest(F.coalesce(nxt - F.col("effective_ms"), F.lit(0)), F.lit(0)) * 1000
    rows = rows.withColumn("step_us", F.col("span_us") + pause)
    first = F.min_by("start_ms", "seg_no")
    base = segs.groupBy("job_id").agg((first * 1000).alias("origin_us"))
    placed = scan(rows, ["job_id"], ["seg_no"], [sum_before("passed_us", F.col("step_us"))], bound=bound)
    placed = placed.join(base, "job_id")
    new_start = F.col("origin_us") + F.col("passed_us")
    spill = F.col("natural_ms") / F.col("audio_rate") - F.col("slot_ms") * F.col("video_ratio")
    overflow = F.when(spill > 1e-3, spill).otherwise(F.lit(0.0))
    return placed.select(
        "job_id",
        "seg_no",
        "start_ms",
        "end_ms",
        "effective_ms",
        "total_ms",
        F.bround("audio_rate", 6).alias("audio_rate"),
        F.bround("video_ratio", 6).alias("video_ratio"),
        F.bround("video_ratio", 4).alias("stretch_ratio"),
        new_start.alias("new_start_us"),
        (new_start + F.col("span_us")).alias("new_end_us"),
        F.when(overflow > 0, F.lit("overflow_trimmed")).otherwise(F.col("base_status")).alias("status"),
        F.bround(overflow / 1000, 4).alias("overflow_s"),
    )


def fitted_total(plan: DataFrame) -> DataFrame:
    """Length of the fitted track per job: last chunk plus the untouched tail, never shorter."""
    last = F.max_by(F.struct("new_end_us", "effective_ms", "total_ms"), "seg_no")
    ends = plan.groupBy("job_id").agg(last.alias("z"))
    tail = F.greatest(F.col("z.total_ms") - F.col("z.effective_ms"), F.lit(0)) * 1000
    return ends.select("job_id", F.greatest(F.col("z.new_end_us") + tail, F.col("z.total_ms") * 1000).alias("fitted_us"))


def map_times(times: DataFrame, plan: DataFrame, time_col: str, id_col: str) -> DataFrame:
    """Move times (ms) of a job onto its fitted timeline; adds ``fitted_us``.

    Inside a chunk the mapping is linear, in a gap the distance to the next chunk is kept,
    after the last chunk the distance to its end; a job without a plan keeps its times.
    """
    chunks = plan.select(
        "job_id",
        "seg_no",
        F.col("start_ms").alias("o0"),
        F.col("effective_ms").alias("o1"),
        F.col("new_start_us").alias("n0"),
        F.col("new_end_us").alias("n1"),
    )
    looked = asof(times, chunks, ["job_id"], time_col, "o1", id_col, "seg_no")
    t = F.col(time_col)
    after, before = F.col("_after"), F.col("_before")
    span = after["o1"] - after["o0"]
    moved = after["n0"] + F.round((t - after["o0"]) * (after["n1"] - after["n0"]) / span).cast("long")
    inside = F.when(span <= 0, after["n0"]).otherwise(moved)
    gap = after["n0"] - (after["o0"] - t) * 1000
    tail = before["n1"] + (t - before["o1"]) * 1000
    return looked.withColumn(
        "fitted_us",
        F.when(after.isNotNull(), F.when(t < after["o0"], gap).otherwise(inside))
        .when(before.isNotNull(), tail)
        .otherwise(t * 1000),
    ).drop("_before", "_after")


def overlay_fitted_times(segs: DataFrame, fitted: DataFrame) -> DataFrame:
    """Take start and end from ``fitted`` (seg_no, position, new_start_us, new_end_us).

    Rows pair by seg_no; in a job whose fitted rows carry no seg_no at all, by position.
    ``segs`` needs ``position``.
    """
    by_id = fitted.filter(F.col("seg_no").isNotNull()).select(
        "job_id", "seg_no", F.struct("new_start_us", "new_end_us").alias("by_id")
    )
    idless = fitted.groupBy("job_id").agg(F.max(F.col("seg_no").isNotNull()).alias("any_id")).filter(~F.col("any_id"))
    by_pos = fitted.join(idless, "job_id", "left_semi").select(
        "job_id", "position", F.struct("new_start_us", "new_end_us").alias("by_pos")
    )
    cue = F.coalesce("by_id", "by_pos")
    return (
        segs.join(by_id, ["job_id", "seg_no"], "left")
        .join(by_pos, ["job_id", "position"], "left")
        .withColumn("out_start_us", F.coalesce(cue["new_start_us"], F.col("start_ms") * 1000))
        .withColumn("out_end_us", F.coalesce(cue["new_end_us"], F.col("end_ms") * 1000))
        .withColumn("fitted", cue.isNotNull())
        .drop("by_id", "by_pos")
    )


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of each group. Spark keeps n rows per map task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
