"""Segments from words, scene cuts, speaker re-splits, cue merging, references."""

from __future__ import annotations

import re
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.lists import let
from cuewright.operators.greedy import by_size, greedy_groups
from cuewright.operators.intervals import interval_join
from cuewright.operators.ordered import following, largest_group, last_known, next_known, previous, row_number, scan
from cuewright.operators.pergroup import by_group
from cuewright.operators.sequences import label_runs
from cuewright.operators.timeline import display_label, near_other_speaker
from cuewright.session import rows_per_task

# Fixed values (milliseconds and characters).
MIN_MS, IDEAL_MS, MAX_MS = 1500, 4500, 9000
MIN_CHARS, MAX_CHARS, MIN_WORDS = 12, 140, 3
LONG_PAUSE_MS = 350
SENTENCE_BONUS, CLAUSE_BONUS = 2000, 800
SENTENCE_MARK = r"[.!?。！？।؟…؛܀։՝።။၊]"
SENTENCE_TAIL = SENTENCE_MARK + r"[\"')\]]?$"
CLAUSE_TAIL = r"[,;:—、،؍]$"
SLICE_MIN_MS, REF_MIN_MS, REF_IDEAL_MS, REF_MAX_MS, SEGMENT_REF_MS = 1500, 5000, 8000, 15000, 3000
CUE_MIN_MS, CUE_MIN_CHARS, CUE_MAX_CHARS, CUE_MAX_CPS = 1200, 8, 84, 17
WORD_NEEDS = ["word_start", "word_end", "chars", "pause", "ends_sentence", "ends_clause"]
CUE_NEEDS = ["start_ms", "end_ms", "text", "speaker_id"]
LISTS_AT_ONCE = 128


def _sentence_heads(columns: dict[str, list]) -> list[int]:
    """First word of every segment of a greedy grouping into sentences of about the ideal length."""
    begin, stop, chars, pause, sentence, clause = (columns[c] for c in WORD_NEEDS)
    heads, head, held = [0], 0, 0

    def open_at(i: int) -> None:
        nonlocal head, held
        head, held = i, 0
        if i < len(begin):
            heads.append(i)

    for i in range(len(begin)):
        held += chars[i]
        span = stop[i] - begin[head]
        full = span >= MAX_MS or held >= MAX_CHARS
        if sentence[i] and span >= IDEAL_MS and held >= MIN_CHARS:
            open_at(i + 1)
        elif full and (sentence[i] or clause[i] or pause[i] >= LONG_PAUSE_MS):
            open_at(i + 1)
        elif full:
            scored = [
                (abs(stop[k] - begin[head] - IDEAL_MS) - (SENTENCE_BONUS if sentence[k] else CLAUSE_BONUS if clause[k] else 0), k)
                for k in range(head, i)
                if stop[k] - begin[head] >= MIN_MS and stop[i] - begin[k + 1] >= MIN_MS
            ]
            if not scored:
                open_at(i + 1)
                continue
            open_at(min(scored)[1] + 1)
            held = sum(chars[head : i + 1])
    return heads


def words_to_segments(words: DataFrame, limit: int | None = None) -> DataFrame:
    """Words of a job grouped into segments at natural boundaries (job_id, head, start, end, text)."""
    single = [F.array(c).alias(c) for c in ("word", "word_start", "word_end")]
    return word_lists_to_segments(words.select("job_id", "seg_no", "word_no", *single), limit)


def word_lists_to_segments(lists: DataFrame, limit: int | None = None) -> DataFrame:
    """``words_to_segments`` of rows that hold consecutive words of a segment, ``word_no`` being the first one's number.

    Such rows are dealt out and sorted once and become segments in that pass; where they come by job and segment,
    they are not even sorted again. Only jobs with more words than the limit are taken apart and cut into chunks.
    """
    limit = rows_per_task(lists.sparkSession) if limit is None else limit
    in_chunks = lambda large: _segments_in_chunks(_single_words(large), limit)
    return by_size(lists, ["job_id"], limit, _segments_of_jobs, in_chunks, F.size("word").cast("long"))


def _segments_of_jobs(lists: DataFrame) -> DataFrame:
    """Each job in one task, where its words stay until they are segments."""
    kind = lists.schema["job_id"].dataType.simpleString()
    rows = lists.select(
        "job_id",
        "seg_no",
        "word_no",
        "word",
        "word_start",
        "word_end",
        F.transform("word", lambda w: w.rlike(SENTENCE_TAIL)).alias("ends_sentence"),
        F.transform("word", lambda w: w.rlike(CLAUSE_TAIL)).alias("ends_clause"),
    )
    schema = f"job_id {kind}, head long, start_ms long, end_ms long, text string, words long"
    return by_group(rows, ["job_id"], ["seg_no", "word_no"], rows.columns[1:], _job_segments, schema, LISTS_AT_ONCE)


def _job_segments(key: tuple, rows: list[tuple]) -> list[tuple]:
    """Segments of one job from its rows of word lists."""
    word, begin, stop, sentence, clause = ([x for r in rows for x in r[c]] for c in range(2, 7))
    if any(a[0] == b[0] and b[1] < a[1] + len(a[2]) for a, b in pairwise(rows)):  # lists of a repeated segment, word by word
        place, places = 0, []
        for before, row in zip([rows[0], *rows], rows):
            place += before[0] != row[0]
            places += [(place, row[1] + i) for i in range(len(row[2]))]
        turn = sorted(range(len(word)), key=lambda i: (places[i], begin[i], stop[i], word[i]))
        word, begin, stop, sentence, clause = ([c[i] for i in turn] for c in (word, begin, stop, sentence, clause))
    pause = [max(0, b - a) for a, b in zip(stop, begin[1:])] + [0]
    columns = zip(WORD_NEEDS, (begin, stop, [len(w) + 1 for w in word], pause, sentence, clause))
    heads = _sentence_heads(dict(columns))
    return [(*key, a + 1, begin[a], stop[b - 1], " ".join(word[a:b]), b - a) for a, b in pairwise([*heads, len(word)])]


def _single_words(lists: DataFrame) -> DataFrame:
    paired = F.arrays_zip("word", "word_start", "word_end")
    one = lists.select("job_id", "seg_no", "word_no", F.posexplode(paired).alias("_i", "_w"))
    return one.select("job_id", "seg_no", (F.col("word_no") + F.col("_i")).alias("word_no"), "_w.*")


def _segments_in_chunks(words: DataFrame, limit: int) -> DataFrame:
    ahead = scan(words, ["job_id"], ["seg_no", "word_no"], [following("_next", F.col("word_start"))], limit)
    rows = ahead.select(
        *words.columns,
        (F.length("word") + 1).alias("chars"),
        F.greatest(F.coalesce(F.col("_next") - F.col("word_end"), F.lit(0)), F.lit(0)).alias("pause"),
        F.col("word").rlike(SENTENCE_TAIL).alias("ends_sentence"),
        F.col("word").rlike(CLAUSE_TAIL).alias("ends_clause"),
    )
    grouped = greedy_groups(rows, ["job_id"], ["seg_no", "word_no"], _sentence_heads, WORD_NEEDS, limit)
    pieces = F.array_sort(F.collect_list(F.struct("_rn", "word")))
    return grouped.groupBy("job_id", "head").agg(
        F.min_by("word_start", "_rn").alias("start_ms"),
        F.max_by("word_end", "_rn").alias("end_ms"),
        F.array_join(F.transform(pieces, lambda p: p["word"]), " ").alias("text"),
        F.count(F.lit(1)).alias("words"),
    )


def _boundary(text: str, ideal: int) -> int:
    """Offset of the sentence end, else clause end, else blank, nearest the ideal place."""
    for pattern in (rf"({SENTENCE_MARK}[\"')\]]?)(?:\s+|$)", r"([,;:—、،؍])(?:\s+|$)"):
        ends = [m.end(1) for m in re.finditer(pattern, text)]
        if ends:
            return min(ends, key=lambda o: abs(o - ideal))
    blanks = [i for i, ch in enumerate(text) if ch == " "]
    return min(blanks, key=lambda o: abs(o - ideal)) if blanks else len(text)


def cut_at_scenes(start: int, end: int, text: str, cuts: list[int]) -> list[tuple[int, int, str]]:
    """Pieces of a segment at those cuts that leave two viable halves."""
    out = []
    for cut in sorted(c for c in cuts if start + MIN_MS < c < end - MIN_MS):
        at = _boundary(text, int(len(text) * ((cut - start) / (end - start))))
        left, right = text[:at].strip(), text[at:].strip()
        if min(len(left), len(right)) >= MIN_CHARS and min(cut - start, end - cut) >= MIN_MS:
            out.append((start, cut, left))
            start, text = cut, right
    return [*out, (start, end, text)]


def scene_cuts(segs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Segments split at scene cuts; ``cuts`` has job_id and cut_ms.

    Only cuts inside a segment reach it, through the binned interval join.
    """
    inside = interval_join(
        segs.select("job_id", "seg_no", "start_ms", "end_ms"),
        cuts.filter(F.col("cut_ms") > 0).select("job_id", "cut_ms"),
        ["job_id"],
        (F.col("start_ms"), F.col("end_ms")),
        (F.col("cut_ms"), F.col("cut_ms")),
        (F.col("cut_ms") > F.col("start_ms") + MIN_MS) & (F.col("cut_ms") < F.col("end_ms") - MIN_MS),
    )
    listed = inside.groupBy("job_id", "seg_no").agg(F.collect_list("cut_ms").alias("cuts"))

    @F.pandas_udf("array<struct<start_ms: long, end_ms: long, text: string>>")
    def split(start: pd.Series, end: pd.Series, text: pd.Series, at: pd.Series) -> pd.Series:
        rows = [cut_at_scenes(a, b, t, list(c)) for a, b, t, c in zip(start, end, text, at)]
        return pd.Series([[{"start_ms": a, "end_ms": b, "text": t} for a, b, t in r] for r in rows], dtype="object")

    joined = segs.join(listed, ["job_id", "seg_no"], "left")
    cut = joined.filter(F.col("cuts").isNotNull()).select(
        "job_id", "seg_no", "speaker_id", F.posexplode(split("start_ms", "end_ms", "text", "cuts")).alias("piece", "p")
    )
    cut = cut.select("job_id", "seg_no", "speaker_id", F.col("piece").cast("long").alias("piece"), "p.*")
    whole = joined.filter(F.col("cuts").isNull()).select(
        "job_id", "seg_no", "speaker_id", F.lit(0).cast("long").alias("piece"), "start_ms", "end_ms", "text"
    )
    return whole.unionByName(cut)


def smoothed(rows: DataFrame, keys: list[str], order: str, label: str, limit: int | None = None, bound: int | None = None) -> DataFrame:
    """``rows`` with single-label flips between equal neighbours removed one after another, in place.

    A label is a flip where its neighbours agree and differ from it. Removing a flip makes the label equal to the
    one before, so the next cannot be removed as well: of flips that follow each other every other one goes,
    from the first on. That is a count from the last label that was none.
    """
    looks = [row_number("_i"), previous("_back", F.struct(label)), following("_ahead", F.struct(label))]
    seen = scan(rows, keys, [order], looks, limit, bound)
    flip = F.coalesce(F.col("_back").eqNullSafe(F.col("_ahead")) & ~F.col(f"_back.{label}").eqNullSafe(F.col(label)) & F.col("_back").isNotNull(), F.lit(False))
    counted = scan(seen.withColumn("_flip", flip), keys, [order], [last_known("_calm", F.when(~F.col("_flip"), F.col("_i")))], limit, bound)
    gone = F.col("_flip") & ((F.col("_i") - F.col("_calm")) % 2 == 1)
    return counted.select(*[F.when(gone, F.col(f"_back.{label}")).otherwise(F.col(label)).alias(label) if c == label else F.col(c) for c in rows.columns])


def labelled_words(words: DataFrame, turns: DataFrame) -> DataFrame:
    """``words`` with ``label``, the majority speaker of every word, null where no turn covers it.

    Turns meet segments, not words: each segment carries the turns around it as an array in turn order, and
    a word is labelled from the array of its segment. The largest summed overlap wins, at a tie the
    speaker whose turn comes first; a word without overlap takes the first turn around its midpoint.
    """
    keys = ["job_id", "seg_no"]
    spans = words.groupBy(*keys).agg(F.min("word_start").alias("_from"), F.max("word_end").alias("_to"))
    known = turns.dropna(subset=["speaker", "turn_start", "turn_end"]).select("job_id", "turn_no", "turn_start", "turn_end", "speaker")
    touch = (F.col("turn_start") <= F.col("_to")) & (F.col("turn_end") >= F.col("_from"))
    met = interval_join(spans, known, ["job_id"], (F.col("_from"), F.col("_to")), (F.col("turn_start"), F.col("turn_end")), touch)
    listed = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn_no", "turn_start", "turn_end", "speaker"))).alias("_turns"))

    def overlap(t: Column) -> Column:
        return F.least("word_end", t["turn_end"]) - F.greatest("word_start", t["turn_start"])

    def most(heard: Column) -> Column:
        def score(name: Column, i: Column) -> Column:
            own = F.filter(heard, lambda t: t["speaker"] == name)
            total = F.aggregate(own, F.lit(0).cast("long"), lambda n, t: n + overlap(t))
            return F.struct(total.alias("ms"), (-i).alias("order"), name.alias("name"))

        ranked = F.transform(F.array_distinct(F.transform(heard, lambda t: t["speaker"])), score)
        return F.when(F.size(heard) <= 1, F.get(heard, F.lit(0))["speaker"]).otherwise(F.array_max(ranked)["name"])

    mid2 = F.col("word_start") + F.col("word_end")
    around = F.filter("_turns", lambda t: (t["turn_start"] * 2 <= mid2) & (mid2 <= t["turn_end"] * 2))
    best = let(F.filter("_turns", lambda t: overlap(t) > 0), most)
    found = F.coalesce(best, F.get(around, F.lit(0))["speaker"])
    return words.join(listed, keys, "left").select(*words.columns, display_label(found).alias("label"))


def smoothed_words(words: DataFrame, turns: DataFrame, limit: int | None = None) -> DataFrame:
    """Words with their speaker label, gaps filled and single flips smoothed inside the segment."""
    keys = ["job_id", "seg_no"]
    labelled = labelled_words(words, turns).select(*keys, "word_no", "word", "word_start", "word_end", "label")
    bound = largest_group(words, keys)
    sides = [last_known("_back", F.col("label")), next_known("_ahead", F.col("label"))]
    filled = scan(labelled, keys, ["word_no"], sides, limit, bound)
    filled = filled.withColumn("label", F.coalesce("_back", "_ahead")).drop("_back", "_ahead")
    return smoothed(filled, keys, "word_no", "label", limit, bound)


def resplit_speakers(segs: DataFrame, words: DataFrame, turns: DataFrame) -> DataFrame:
    """Segments split where the word-level speaker changes; one-speaker segments stay as they are.

    Pieces cover the segment exactly: outer edges are its own, inner ones word times.
    """
    runs = label_runs(smoothed_words(words, turns), ["job_id", "seg_no"], "word_no", "label")
    w = Window.partitionBy("job_id", "seg_no")
    many = runs.withColumn("_n", F.max("run_no").over(w)).filter(F.col("_n") > 1)
    joined = segs.join(many, ["job_id", "seg_no"], "left")
    split = F.col("run_no").isNotNull()
    first, last = F.col("run_no") == 1, F.col("run_no") == F.col("_n")
    return joined.select(
        "job_id",
        "seg_no",
        F.when(split, F.col("run_no") - 1).otherwise(F.lit(0)).cast("long").alias("piece"),
        F.when(split & ~first, F.col("run_start")).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(split & ~last, F.col("run_end")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(split, F.col("run_text")).otherwise(F.col("text")).alias("text"),
        F.when(split, F.coalesce("label", F.col("speaker_id"))).otherwise(F.col("speaker_id")).alias("speaker_id"),
    )


def _cue_heads(columns: dict[str, list]) -> list[int]:
    """First cue of every merged cue."""
    heads: list[int] = []
    start = end = 0
    text = who = ""
    for i, (a, b, t, s) in enumerate(zip(*columns.values())):
        tiny = min(end - start, b - a) < CUE_MIN_MS or min(len(text), len(t)) < CUE_MIN_CHARS
        joined = f"{text} {t}".strip()
        fits = len(joined) <= CUE_MAX_CHARS and len(joined) * 1000 <= CUE_MAX_CPS * max(1, b - start)
        closed = re.search(r"[.!?。！？]+\s+", f"{text} ") is not None
        other = bool(who) and bool(s) and who != s
        if heads and tiny and fits and not closed and not other:
            end, text, who = b, joined, s or who
        else:
            heads.append(i)
            start, end, text, who = a, b, t, s
    return heads


def merge_cues(cues: DataFrame, limit: int | None = None) -> DataFrame:
    """Tiny cues folded left to right unless limits, a sentence end or a speaker change forbid it."""
    limit = rows_per_task(cues.sparkSession) if limit is None else limit
    return by_size(cues, ["job_id"], limit, _cues_of_jobs, lambda large: _cues_in_chunks(large, limit))


def _cues_of_jobs(cues: DataFrame) -> DataFrame:
    """Each job in one task, which returns its merged cues."""
    kinds = {f.name: f.dataType.simpleString() for f in cues.schema}
    schema = f"job_id {kinds['job_id']}, head long, start_ms {kinds['start_ms']}, end_ms {kinds['end_ms']}, text string, speaker_id string, merged long"
    return by_group(cues, ["job_id"], ["cue_no"], CUE_NEEDS, _job_cues, schema)


def _job_cues(key: tuple, rows: list[tuple]) -> list[tuple]:
    """Merged cues of one job from its cues."""
    start, end, text, who = columns = [list(c) for c in zip(*rows)]
    out = []
    for a, b in pairwise([*_cue_heads(dict(zip(CUE_NEEDS, columns))), len(rows)]):
        joined = " ".join(t for t in text[a:b] if t is not None).strip(" ")
        out.append((*key, a + 1, start[a], end[b - 1], joined, next((s for s in reversed(who[a:b]) if s), None), b - a))
    return out


def _cues_in_chunks(cues: DataFrame, limit: int) -> DataFrame:
    grouped = greedy_groups(cues, ["job_id"], ["cue_no"], _cue_heads, CUE_NEEDS, limit)
    pieces = F.array_sort(F.collect_list(F.struct("_rn", "text")))
    return grouped.groupBy("job_id", "head").agg(
        F.min_by("start_ms", "_rn").alias("start_ms"),
        F.max_by("end_ms", "_rn").alias("end_ms"),
        F.trim(F.array_join(F.transform(pieces, lambda p: p["text"]), " ")).alias("text"),
        F.max_by("speaker_id", F.when(F.coalesce("speaker_id", F.lit("")) != "", F.col("_rn"))).alias("speaker_id"),
        F.count(F.lit(1)).alias("merged"),
    )


def reference_slices(segs: DataFrame) -> DataFrame:
    """Segments of each speaker to cut a voice reference from; none for estimated labels.

    Candidates are ranked clean first, longest first, and taken until the ideal length, leaving
    out those that would pass the maximum. At most ten are ever taken, and equal lengths are
    interchangeable, so ten rows per length (in milliseconds, all beyond the maximum as one)
    are enough: that bounds a group however many segments a speaker has.
    """
    flagged = near_other_speaker(segs).withColumn("dur_ms", F.col("end_ms") - F.col("start_ms"))
    fit = flagged.filter((F.col("dur_ms") >= SLICE_MIN_MS) & (F.coalesce("label_source", F.lit("")) != "heuristic"))
    step = F.least("dur_ms", F.lit(REF_MAX_MS + 1))
    w = Window.partitionBy("job_id", "speaker_id", "near_other", step).orderBy(F.desc("dur_ms"), "seg_no")
    few = fit.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= REF_MAX_MS // SLICE_MIN_MS)

    def pick(key: tuple, ranked: list[tuple]) -> list[tuple]:
        total, taken = 0, []
        for ms, number in ranked:
            if taken and total + ms > REF_MAX_MS:
                continue
            taken.append((*key, number, ms))
            total += ms
            if total >= REF_IDEAL_MS:
                break
        return sorted(taken, key=lambda t: t[2]) if total >= REF_MIN_MS else []

    ranked = few.withColumn("_longest", -F.col("dur_ms"))
    order = ["near_other", "_longest", "seg_no"]
    return by_group(
        ranked, ["job_id", "speaker_id"], order, ["dur_ms", "seg_no"], pick, "job_id long, speaker_id string, seg_no long, dur_ms long"
    )


def segment_references(segs: DataFrame) -> DataFrame:
    """Segments long enough to be a reference of their own, with the source text."""
    text = F.trim(F.coalesce(F.nullif(F.col("text_original"), F.lit("")), F.col("text"), F.lit("")))
    kept = segs.filter(F.col("end_ms") - F.col("start_ms") >= SEGMENT_REF_MS)
    return kept.select("job_id", "seg_no", text.alias("ref_text"), (F.col("end_ms") - F.col("start_ms")).alias("dur_ms"))
