"""Chat transcripts to canonical turns: a hidden Markov model finds who speaks each line.

States are a role and whether the line begins a turn or goes on with it. A line shows a speaker
marker or none, whether a blank line stands before it, its length class and a closing question mark.
Start, transition and emission probabilities are counted over labelled turns; Viterbi decoding then
labels the lines of unlabelled transcripts, and runs of lines become turns.

A transcript is cut into parts of bounded size. Each part is reduced to a 6 x 6 matrix of best path
scores between its first and last state; the matrices of a transcript are chained to fix the states
at the cuts, and the parts are decoded on their own. The result equals decoding in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import stored
from cuewright.session import ship_package

ROLES = ("system", "user", "assistant")
MARKERS = {
    "system": ("system", "instructions", "context", "sys"),
    "user": ("user", "human", "question", "q", "customer", "student"),
    "assistant": ("assistant", "bot", "ai", "answer", "a", "agent", "teacher"),
}
OPEN = r"^\s*[#>*\[<|(]{0,4}\s*"
CLOSE = r"\s*(?:[\]>|*):]{1,4})[ \t]*"
LENGTHS = (20, 80, 200, 500)
SIZES = (4, 2, len(LENGTHS) + 1, 2)  # marker, blank before, length class, question mark
LINES_PER_PART = 2048
STATES = 6


def _marker(names: tuple[str, ...]) -> str:
    return f"(?i){OPEN}(?:{'|'.join(names)}){CLOSE}"


ANY_MARKER = _marker(tuple(n for names in MARKERS.values() for n in names))


def observation(line: Column, blank: Column) -> Column:
    """One small integer for what a line shows."""
    marker = F.lit(0)
    for code, role in enumerate(ROLES, 1):
        marker = F.when(line.rlike(_marker(MARKERS[role])), code).otherwise(marker)
    length = sum((F.length(line) >= cut).cast("int") for cut in LENGTHS)
    asks = line.rlike(r"\?\s*$").cast("int")
    return ((marker * SIZES[1] + blank.cast("int")) * SIZES[2] + length) * SIZES[3] + asks


def transcript_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``conv, part, no, line, blank`` of transcripts held as one text each; blank lines are dropped.

    A null or empty transcript has no lines.
    """
    rows = docs.select(docs[id_col].alias("conv"), F.split(F.coalesce(docs[text_col], F.lit("")), "\r?\n").alias("lines"))
    each = F.transform("lines", lambda x, i: F.struct(x.alias("line"), (F.trim(F.coalesce(F.get("lines", i - 1), F.lit("x"))) == "").alias("blank")))
    flat = rows.select("conv", F.posexplode(each).alias("no", "l"))
    part = F.floor(F.col("no") / LINES_PER_PART).cast("long")
    return flat.select("conv", part.alias("part"), F.col("no").cast("long").alias("no"), "l.line", "l.blank").filter(F.trim("line") != "")


@dataclass(frozen=True)
class Model:
    """Log probabilities: ``start`` (6), ``move`` (6 x 6), ``show`` (6 x observations)."""

    start: np.ndarray
    move: np.ndarray
    show: np.ndarray


def train(lines: DataFrame, smooth: float = 0.5) -> Model:
    """Count a model over labelled ``conv, turn, no, line, blank, role`` rows; ``no`` counts from 0 in each turn.

    Only the counts, a few hundred numbers, reach the driver. Roles outside ``ROLES`` are not used;
    without rows every event is equally likely.
    """
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    rows = lines.select("conv", "turn", "no", role.alias("r"), observation(F.col("line"), F.col("blank")).alias("o")).filter("r >= 0")
    state = (F.col("r") * 2 + (F.col("no") > 0).cast("int")).cast("int")
    shown = rows.groupBy(state.alias("s"), "o").agg(F.count(F.lit(1)).alias("n")).collect()
    turns = rows.groupBy("conv", "turn").agg(F.first("r").alias("r"), F.count(F.lit(1)).alias("n"))
    ahead = turns.select("conv", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next"))
    pairs = turns.join(ahead, ["conv", "turn"], "left")
    ends = (F.col("r") * 2 + (F.col("n") > 1).cast("int")).alias("s")
    moved = pairs.groupBy(ends, "r", "next").agg(
        F.count(F.lit(1)).alias("turns"), F.sum((F.col("n") > 1).cast("long")).alias("into"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("on")
    )
    first = turns.join(turns.select("conv", (F.col("turn") + 1).alias("turn"), F.lit(1).alias("has")), ["conv", "turn"], "left")
    begun = first.filter("has IS NULL").groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()

    show = np.ones((STATES, 1))
    counts = np.zeros((STATES, *SIZES))
    for row in shown:
        counts.reshape(STATES, -1)[row["s"], row["o"]] += row["n"]
    for axis, size in enumerate(SIZES, 1):
        kept = counts.sum(axis=tuple(a for a in range(1, 5) if a != axis)) + smooth
        show = (show[:, :, None] * (kept / kept.sum(axis=1, keepdims=True))[:, None, :]).reshape(STATES, -1)
    move = np.full((STATES, STATES), 1e-6)
    move[:, ::2] = smooth
    for r in range(3):
        move[2 * r : 2 * r + 2, 2 * r + 1] = smooth  # a turn goes on only in its own role
    for row in moved.collect():
        r, into, on = row["r"], row["into"], row["on"]
        move[2 * r, 2 * r + 1] += into
        move[2 * r + 1, 2 * r + 1] += on
        if row["next"] is not None:
            move[row["s"], 2 * row["next"]] += row["turns"]
    start = np.full(STATES, 1e-6)
    start[::2] = smooth
    for row in begun:
        start[2 * row["r"]] += row["n"]
    return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), np.log(show))


def best_scores(model: Model, seen: np.ndarray) -> np.ndarray:
    """Best log score of a path over ``seen`` from each first state (row) to each last one (column)."""
    score = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(score, model.show[:, seen[0]])
    for o in seen[1:]:
        score = (score[:, :, None] + model.move[None]).max(axis=1) + model.show[:, o]
    return score


def decode(model: Model, seen: np.ndarray, first: int, last: int) -> np.ndarray:
    """The best path from state ``first`` to ``last``; of equal ones, the one with the lower states at the end."""
    score = np.full(STATES, -np.inf)
    score[first] = model.show[first, seen[0]]
    back = np.zeros((len(seen), STATES), np.int8)
    for t, o in enumerate(seen[1:], 1):
        ways = score[:, None] + model.move
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + model.show[:, o]
    path = np.empty(len(seen), np.int64)
    path[-1] = last
    for t in range(len(seen) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _cuts(model: Model, table: pa.Table) -> pa.Table:
    """First and last state of every part of one transcript."""
    order = np.argsort(table.column("part").to_numpy())
    table = table.take(order)
    parts = [np.frombuffer(x, np.float64).reshape(STATES, STATES) for x in table.column("scores").to_pylist()]
    entry = model.start
    arrive, came = [], []
    for m in parts:
        ways = entry[:, None] + m  # by first state of the part
        came.append(ways.argmax(axis=0))
        out = ways.max(axis=0)
        step = out[:, None] + model.move
        arrive.append(step.argmax(axis=0))
        entry = step.max(axis=0)
    firsts, lasts = [0] * len(parts), [0] * len(parts)
    last = int(out.argmax())
    for i in range(len(parts) - 1, -1, -1):
        lasts[i], firsts[i] = last, int(came[i][last])
        if i:
            last = int(arrive[i - 1][firsts[i]])
    arrays = [table.column("conv").combine_chunks(), table.column("part").combine_chunks(), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())]
    return pa.Table.from_arrays(arrays, names=["conv", "part", "first", "last"])


def recover(lines: DataFrame, model: Model) -> DataFrame:
    """``conv, part, no, role, begins, turn``: the role of every line and the number of its turn."""
    ship_package(lines.sparkSession)
    kind = lines.schema["conv"].dataType.simpleString()
    seen = lines.select("conv", "part", "no", observation(F.col("line"), F.col("blank")).cast("int").alias("o"))

    def reduce(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("no").to_numpy())
        scores = best_scores(model, table.column("o").to_numpy()[order])
        arrays = [table.column("conv").slice(0, 1).combine_chunks(), table.column("part").slice(0, 1).combine_chunks(), pa.array([scores.tobytes()], pa.binary())]
        return pa.Table.from_arrays(arrays, names=["conv", "part", "scores"])

    def label(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("no").to_numpy()))
        ends = [table.column(c)[0].as_py() for c in ("first", "last")]
        path = decode(model, table.column("o").to_numpy(), *ends)
        begins = path % 2 == 0
        columns = [table.column(c).combine_chunks() for c in ("conv", "part", "no")]
        arrays = [*columns, pa.array(path // 2, pa.int32()), pa.array(begins), pa.array(np.cumsum(begins), pa.int64())]
        return pa.Table.from_arrays(arrays, names=["conv", "part", "no", "r", "begins", "k"])

    scores = seen.groupBy("conv", "part").applyInArrow(reduce, f"conv {kind}, part long, scores binary")
    cuts = scores.groupBy("conv").applyInArrow(lambda t: _cuts(model, t), f"conv {kind}, part long, first int, last int")
    on = seen["conv"].eqNullSafe(cuts["conv"]) & (seen["part"] == cuts["part"])
    joined = seen.join(cuts, on).select(seen["conv"], seen["part"], "no", "o", "first", "last")
    made = joined.groupBy("conv", "part").applyInArrow(label, f"conv {kind}, part long, no long, r int, begins boolean, k long")
    made = stored(made, "roles")
    per_part = made.groupBy("conv", "part").agg(F.max("k").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_part.select(F.col("conv").alias("c2"), F.col("part").alias("p2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("past"))
    whole = made.join(offset, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2")))
    role = F.element_at(F.array(*[F.lit(x) for x in ROLES]), F.col("r") + 1)
    return whole.select("conv", "part", "no", role.alias("role"), "begins", (F.col("past") + F.col("k")).alias("turn"))


def render(lines: DataFrame, model: Model) -> DataFrame:
    """``conv_id, turn, part, role, text, rendered`` of the recovered turns, turns counted from 1.

    Markers are taken off, lines of a turn are joined by line ends and blank lines inside it kept.
    ``rendered`` is ``<|role|>``, the text and ``<|end|>`` on lines of their own. A turn that crosses
    a cut between parts gives one row per part. Lines without id form one transcript of their own;
    an empty table gives no rows.
    """
    roles = recover(lines, model)
    r = roles.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("no").alias("m"), "role", "begins", "turn")
    same = lines["conv"].eqNullSafe(r["c"]) & (lines["part"] == r["p"]) & (lines["no"] == r["m"])
    body = F.regexp_replace("line", ANY_MARKER, "")
    shown = F.when(F.col("begins"), body).when(F.col("blank"), F.concat(F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
    rows = lines.join(r, same).select("conv", "part", "no", "turn", "role", shown.alias("shown"))
    grouped = rows.groupBy("conv", "turn", "part").agg(F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("no", "shown"))).alias("all"))
    text = F.regexp_replace(F.array_join(F.transform("all", lambda x: x["shown"]), "\n"), r"^\s+|\s+$", "")
    out = grouped.select(F.col("conv").alias("conv_id"), "turn", "part", "role", text.alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))
