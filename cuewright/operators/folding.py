"""Folding of fragments and stitching of brief segments, pass after pass, over jobs of any length.

Passes decide by times, speakers and the size of a text, never by its words, so only numbers go through
Python; texts and all other columns are put together afterwards. A job within the limit is one group.
Longer jobs are cut into chunks, and each pass is settled chunk by chunk: what a pass knows at a place is
the last finished part and the part at hand, so a chunk that starts from the state in which the one
before it ended does what a single pass would do. Chunks first start from a guess, the state after the last
rows of the chunk before; those whose guess differs from the true state run again.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators.ordered import largest_group, row_number, scan
from cuewright.operators.pergroup import by_group
from cuewright.operators.segmenting import MAX_MS, MIN_CHARS, MIN_MS, MIN_WORDS
from cuewright.session import rows_per_task, shared_dir

# Fixed values (milliseconds and characters).
MERGE_GAP_MS, STRAY_GAP_MS, STRAY_MS, STRAY_CHARS = 600, 2000, 500, 4
STITCH_MS, STITCH_GAP_MS = 2500, 900
FOLD_PASSES, STITCH_PASSES = 64, 32
WARM_UP = 64  # rows of the chunk before that a guess is made from

NUMBERS = ["start_ms", "end_ms", "chars", "tokens", "glyphs", "speaker_id", "first", "last", "owner"]
NUMBER_SCHEMA = "start_ms long, end_ms long, chars long, tokens long, glyphs long, speaker_id string, first long, last long, owner long"
BACK, CURRENT, OWN = 0, 1, 2


class Part:
    """A segment while it is being folded: its span, the size of its text, its rows and the row it began as."""

    __slots__ = NUMBERS

    def __init__(self, *values):
        for name, value in zip(NUMBERS, values):
            setattr(self, name, value)

    def row(self) -> tuple:
        return tuple(getattr(self, name) for name in NUMBERS)

    @property
    def length(self) -> int:
        return self.end_ms - self.start_ms

    def short(self) -> bool:
        """Below the floor in time, characters or words; unspaced text counts half its glyphs as words."""
        words = self.tokens if self.tokens >= MIN_WORDS else max(self.tokens, self.glyphs // 2)
        return self.length < MIN_MS or self.chars < MIN_CHARS or words < MIN_WORDS

    def stray(self) -> bool:
        return self.length < STRAY_MS or self.chars < STRAY_CHARS

    def _join(self, other: Part) -> None:
        self.chars, self.tokens, self.glyphs = self.chars + 1 + other.chars, self.tokens + other.tokens, self.glyphs + other.glyphs
        self.first, self.last = min(self.first, other.first), max(self.last, other.last)

    def take_after(self, other: Part, end: int) -> None:
        self._join(other)
        self.end_ms = end

    def take_before(self, other: Part) -> None:
        self._join(other)
        self.start_ms = min(self.start_ms, other.start_ms)


Step = Callable[[Part, Part | None, Part | None], bool | None]


def fold(part: Part, back: Part | None, ahead: Part | None) -> bool | None:
    """Fold a fragment into a neighbour: close same speaker (the shorter), same speaker, then anyone.

    A step changes the neighbour and says where the part went: True back, False ahead, None nowhere.
    """
    if not part.short():
        return None
    near = STRAY_GAP_MS if part.stray() else MERGE_GAP_MS
    gaps = {}
    if back:
        gaps[True] = part.start_ms - back.end_ms
    if ahead:
        gaps[False] = ahead.start_ms - part.end_ms
    sides = {True: back, False: ahead}
    same = [s for s in gaps if sides[s].speaker_id == part.speaker_id]
    close = [s for s in same if gaps[s] <= near]
    if close:
        where = min(close, key=lambda s: sides[s].length)
    elif same:
        where = same[0]
    elif part.stray() and len(gaps) == 2:
        where = min(gaps, key=gaps.get)
    elif gaps:
        where = next(iter(gaps))
    else:
        return None
    if where:
        back.take_after(part, max(back.end_ms, part.end_ms))
    else:
        ahead.take_before(part)
    return where


def join_brief(part: Part, back: Part | None, ahead: Part | None) -> bool | None:
    """Join a part to the one before it: same speaker, little gap, both brief, not too long together."""
    if (
        back is None
        or back.speaker_id != part.speaker_id
        or part.start_ms - back.end_ms > STITCH_GAP_MS
        or max(back.length, part.length) > STITCH_MS
        or part.end_ms - back.start_ms > MAX_MS
    ):
        return None
    back.take_after(part, part.end_ms)
    return True


def walk(step: Step, back: Part | None, parts: list[Part], final: bool) -> tuple[list[Part], Part | None, Part | None]:
    """One pass: (finished parts, the open one behind, the one at hand), both None at the end of a job.

    Short of the end, the last part waits for the one after it.
    """
    done = [back] if back else []
    waiting = deque(parts)
    while len(waiting) > (0 if final else 1):
        part = waiting.popleft()
        where = step(part, done[-1] if done else None, waiting[0] if waiting else None)
        if where is None:
            done.append(part)
    if final:
        return done, None, None
    return done[:-1], done[-1] if done else None, waiting[0] if waiting else None


def repeat(step: Step, parts: list[Part], passes: int) -> list[Part]:
    for _ in range(passes):
        before = len(parts)
        parts = walk(step, None, parts, True)[0]
        if len(parts) == before:
            break
    return parts


Plan = list[tuple[Step, int]]


def _measured(rows: DataFrame) -> DataFrame:
    """``job_id`` and the numbers of every row; ``_rn`` is its place in the job."""
    space = r"(?U)\s+"
    tokens = F.size(F.filter(F.split("text", space), lambda t: t != ""))
    glyphs = F.length(F.regexp_replace("text", space, ""))
    sizes = [F.length("text").alias("chars"), tokens.alias("tokens"), glyphs.alias("glyphs")]
    places = [F.col("_rn").alias(c) for c in ("first", "last", "owner")]
    return rows.select("job_id", "start_ms", "end_ms", *[s.cast("long") for s in sizes], "speaker_id", *places)


def _whole(rows: DataFrame, plan: Plan, key_type: str) -> DataFrame:
    def run(key: tuple, found: list[tuple]) -> list[tuple]:
        parts = [Part(*row) for row in found]
        for step, passes in plan:
            parts = repeat(step, parts, passes)
        return [(*key, *p.row()) for p in parts]

    return by_group(rows, ["job_id"], ["first"], NUMBERS, run, f"job_id {key_type}, {NUMBER_SCHEMA}")


def _pass_in_chunks(rows: DataFrame, step: Step, key_type: str) -> DataFrame:
    """One pass over ``rows``, which carry ``chunk``; finished parts stay with the chunk that finished them."""
    by = ["job_id", "chunk"]
    w = Window.partitionBy("job_id").orderBy("chunk")
    order = rows.select(*by).distinct().select(*by, F.lead("chunk").over(w).alias("_next")).checkpoint()
    final = F.col("_next").isNull()
    same = lambda a, b: a["job_id"].eqNullSafe(b["job_id"]) & (a["chunk"] == b["chunk"])
    own = rows.join(order.withColumnsRenamed({"job_id": "_j", "chunk": "_c"}), F.col("job_id").eqNullSafe(F.col("_j")) & (F.col("chunk") == F.col("_c")))
    own = own.select(*by, final.alias("final"), F.lit(OWN).alias("kind"), *NUMBERS)

    def run(key: tuple, found: list[tuple]) -> list[tuple]:
        start = {kind: Part(*row) for _, kind, *row in found if kind != OWN}
        parts = [Part(*row) for _, kind, *row in found if kind == OWN]
        if CURRENT in start:
            parts.insert(0, start[CURRENT])
        done, back, current = walk(step, start.get(BACK), parts, found[-1][0])
        return [(*key, OWN, *p.row()) for p in done] + [(*key, k, *p.row()) for k, p in ((BACK, back), (CURRENT, current)) if p]

    def guess(key: tuple, found: list[tuple]) -> list[tuple]:
        _, back, current = walk(step, None, [Part(*row) for _, _, *row in found[-WARM_UP:]], False)
        return [(*key, k, *p.row()) for k, p in ((BACK, back), (CURRENT, current)) if p]

    schema = f"job_id {key_type}, chunk long, kind int, {NUMBER_SCHEMA}"
    needs = ["final", "kind", *NUMBERS]
    grouped = lambda df, f: by_group(df, by, ["first"], needs, f, schema).checkpoint()

    def starts(ends: DataFrame) -> DataFrame:
        """End states of chunks as start states of the next ones."""
        onward = order.filter(F.col("_next").isNotNull()).alias("o")
        moved = ends.filter(F.col("kind") != OWN).alias("e").join(onward, same(ends, order))
        return moved.select("e.job_id", F.col("o._next").alias("chunk"), *[F.col(f"e.{c}") for c in ["kind", *NUMBERS]])

    def with_starts(chunks: DataFrame, states: DataFrame) -> DataFrame:
        last = order.select(F.col("job_id").alias("_j"), F.col("chunk").alias("_c"), final.alias("final"))
        told = states.join(last, F.col("job_id").eqNullSafe(F.col("_j")) & (F.col("chunk") == F.col("_c")))
        return chunks.unionByName(told.select(*by, "final", "kind", *NUMBERS))

    used = starts(grouped(own, guess)).checkpoint()
    done = grouped(with_starts(own, used), run)
    while True:
        true = starts(done).checkpoint()
        wrong = true.exceptAll(used).unionByName(used.exceptAll(true)).select(F.col("job_id").alias("_j"), F.col("chunk").alias("_c")).distinct().checkpoint()
        if wrong.limit(1).count() == 0:
            return done.filter(F.col("kind") == OWN).drop("kind")
        here = F.col("job_id").eqNullSafe(F.col("_j")) & (F.col("chunk") == F.col("_c"))
        again = with_starts(own.join(wrong, here, "left_semi"), true.join(wrong, here, "left_semi"))
        done = done.join(wrong, here, "left_anti").unionByName(grouped(again, run)).checkpoint()
        used = true


def _chunked(rows: DataFrame, plan: Plan, key_type: str, limit: int) -> DataFrame:
    shared_dir(rows.sparkSession)
    rows = rows.withColumn("chunk", F.floor((F.col("first") - 1) / limit)).checkpoint()
    for step, passes in plan:
        count = rows.count()
        for _ in range(passes):
            rows = _pass_in_chunks(rows, step, key_type).checkpoint()
            before, count = count, rows.count()
            if count == before:
                break
    return rows.drop("chunk")


def _assembled(rows: DataFrame, parts: DataFrame, columns: list[str]) -> DataFrame:
    """Texts in order, ``words`` in order, and of every other column the value of the row that took the others in, else the first known."""
    spans = parts.select(
        F.col("job_id").alias("_job"), F.explode(F.sequence("first", "last")).alias("_at"), "owner",
        F.struct("first", "last", "start_ms", "end_ms", "speaker_id").alias("_part"),
    )
    own = ["job_id", "start_ms", "end_ms", "speaker_id"]
    named = rows.select("job_id", "_rn", *[c for c in columns if c not in own])
    joined = named.join(spans, named["job_id"].eqNullSafe(spans["_job"]) & (named["_rn"] == spans["_at"]))
    at = F.col("_rn")

    def listed(column: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(at, column.alias("x")))), lambda p: p["x"])

    def carried(name: str) -> Column:
        value = F.col(name)
        return F.coalesce(F.max_by(value, F.when(at == F.col("owner"), 1)), F.min_by(value, F.when(value.isNotNull(), at)))

    made = {"seg_no": F.min_by("seg_no", at), "text": F.array_join(listed(F.col("text")), " ")}
    if "words" in columns:
        made["words"] = F.flatten(listed(F.coalesce("words", F.array())))
    others = {c: made.get(c, carried(c)) for c in columns if c not in own}
    grouped = joined.groupBy("job_id", "_part").agg(*[v.alias(c) for c, v in others.items()])
    inner = {c: F.col(f"_part.{c}") for c in own[1:]}
    joined_rows = (F.col("_part.last") - F.col("_part.first") + 1).alias("joined")
    return grouped.select(*[inner.get(c, F.col(c)).alias(c) for c in columns], joined_rows)


def run_plan(segs: DataFrame, plan: Plan, limit: int | None = None) -> DataFrame:
    """``segs`` after the passes of ``plan``, with all columns and ``joined``, the number of rows in each."""
    spark = segs.sparkSession
    limit = rows_per_task(spark) if limit is None else limit
    biggest = largest_group(segs, ["job_id"])
    key_type = segs.schema["job_id"].dataType.simpleString()
    numbered = scan(segs, ["job_id"], ["seg_no"], [row_number("_rn")], limit, biggest)
    if biggest > limit:
        shared_dir(spark)
        numbered = numbered.checkpoint()
    rows = _measured(numbered)
    parts = _whole(rows, plan, key_type) if biggest <= limit else _chunked(rows, plan, key_type, limit)
    return _assembled(numbered, parts, segs.columns)


def tidy(segs: DataFrame) -> DataFrame:
    """Texts with single blanks, a speaker for every row, no empty row."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    speaker = F.coalesce(F.nullif(F.col("speaker_id"), F.lit("")), F.lit("Speaker 1"))
    rows = segs.withColumn("text", text).withColumn("speaker_id", speaker)
    return rows.filter((F.col("end_ms") > F.col("start_ms")) & (F.col("text") != ""))


def merge_short(segs: DataFrame, limit: int | None = None) -> DataFrame:
    """Fold fragments into neighbours until none is left that can be.

    Rows are taken in the order of ``seg_no``, which must be unique in a job.
    """
    return run_plan(segs, [(fold, FOLD_PASSES)], limit)


def stitch(segs: DataFrame, limit: int | None = None) -> DataFrame:
    """Join close neighbours of one speaker while both are brief."""
    return run_plan(segs, [(join_brief, STITCH_PASSES)], limit)


def clean_up(segs: DataFrame, limit: int | None = None) -> DataFrame:
    """Drop empty segments, then fold, stitch and fold again."""
    plan = [(fold, FOLD_PASSES), (join_brief, STITCH_PASSES), (fold, FOLD_PASSES)]
    return run_plan(tidy(segs), plan, limit).drop("joined")
