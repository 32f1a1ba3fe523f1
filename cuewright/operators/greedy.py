"""Greedy grouping of ordered rows: each group's extent depends only on the rows from its head on.

Most keys fit one task. A key beyond the limit is cut into chunks that run at once, each from a
guessed head. A chunk's last group is open and belongs to the next chunk, so the true head of
every chunk is the last head of the one before it; chunks whose guess was wrong run again from
there. Greedy groupings fall into step within a few groups, so few chunks ever run a third time,
and the result is the one a single pass would give.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators.ordered import largest_group, row_number, scan
from cuewright.operators.pergroup import by_group
from cuewright.session import rows_per_task, shared_dir

Heads = Callable[[dict[str, list]], Sequence[int]]


def _runner(heads: Heads, needs: Sequence[str]):
    """Head row numbers of one run of rows, each row led by its own number."""

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        numbers, *columns = zip(*rows)
        starts = list(heads({name: list(c) for name, c in zip(needs, columns)}))
        sizes = np.diff([*starts, len(rows)])
        head = np.repeat(np.asarray(numbers)[starts], sizes)
        return [(*key, n, h) for n, h in zip(numbers, head.tolist())]

    return run


def by_size(
    df: DataFrame,
    keys: Sequence[str],
    limit: int,
    whole: Callable[[DataFrame], DataFrame],
    chunked: Callable[[DataFrame], DataFrame],
    rows: Column | None = None,
) -> DataFrame:
    """``whole`` of the keys within the limit and ``chunked`` of those beyond it; rows with a null key are left out.

    ``whole`` can end a group in the pass that finds it, so its rows need not be joined with their heads.
    ``rows`` is how many a row of ``df`` stands for, if not one.
    """
    df = df.dropna(subset=list(keys))
    if largest_group(df, keys, rows) <= limit:
        return whole(df)
    sizes = df.groupBy(*keys).agg(F.sum(F.lit(1) if rows is None else rows).alias("_n"))
    large = sizes.filter(F.col("_n") > limit).select(*keys)
    return whole(df.join(large, list(keys), "left_anti")).unionByName(chunked(df.join(large, list(keys), "left_semi")))


def greedy_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], heads: Heads, needs: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Adds ``head``, the row number of the first row of each row's group.

    ``heads(columns)`` gets the ``needs`` columns of rows in order, beginning at a head, and
    returns the positions of all heads. Everything before its last head must be settled by the
    rows it saw.
    """
    limit = rows_per_task(df.sparkSession) if limit is None else limit
    biggest = largest_group(df, keys)
    numbered = scan(df, keys, order, [row_number("_rn")], limit, biggest)
    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema}
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    if biggest <= limit:
        found = _whole(numbered, keys, heads, needs, key_schema)
    else:
        shared_dir(df.sparkSession)
        numbered = numbered.checkpoint()
        found = _chunked(numbered, keys, heads, needs, key_schema, limit)
    return numbered.join(found, [*keys, "_rn"])


def _whole(numbered, keys, heads, needs, key_schema) -> DataFrame:
    run = _runner(heads, needs)
    return by_group(numbered, keys, ["_rn"], ["_rn", *needs], run, f"{key_schema}, _rn long, head long")


def _chunked(numbered, keys, heads, needs, key_schema, limit) -> DataFrame:
    own = numbered.select(*keys, "_rn", *needs, F.floor((F.col("_rn") - 1) / limit).alias("_chunk"))
    # A chunk may begin inside the one before it: every row is offered to both.
    offered = own.unionByName(own.withColumn("_chunk", F.col("_chunk") + 1))
    by = [*keys, "_chunk"]
    entries = own.select(*by).distinct().withColumn("_entry", F.col("_chunk") * limit + 1)
    w = Window.partitionBy(*keys).orderBy("_chunk")

    run = _runner(heads, needs)

    def grouped(todo: DataFrame) -> DataFrame:
        rows = offered.join(todo, by).filter(F.col("_rn") >= F.col("_entry"))
        return by_group(rows, by, ["_rn"], ["_rn", *needs], run, f"{key_schema}, _chunk long, _rn long, head long")

    done = grouped(entries).checkpoint()
    while True:
        last = done.groupBy(*by).agg(F.max("head").alias("_open"))
        expected = last.select(*by, F.lag("_open").over(w).alias("_before"), "_open")
        current = expected.join(entries, by)
        renewed = current.select(*by, F.coalesce("_before", F.lit(1)).alias("_entry"), (F.coalesce("_before", F.lit(1)) != F.col("_entry")).alias("_moved"))
        renewed = renewed.checkpoint()
        if renewed.filter((F.col("_entry") <= (F.col("_chunk") - 1) * limit) & (F.col("_chunk") > 0)).limit(1).count():
            return _chunked(numbered, keys, heads, needs, key_schema, 2 * limit)  # a group is longer than a chunk
        moved = renewed.filter("_moved").select(*by, "_entry")
        entries = renewed.select(*by, "_entry")
        if moved.limit(1).count() == 0:
            break
        done = done.join(moved.select(*by), by, "left_anti").unionByName(grouped(moved)).checkpoint()
    last = done.groupBy(*by).agg(F.max("head").alias("_open"))
    final = last.select(*by, "_open", F.lead("_chunk").over(w).isNull().alias("_final"))
    settled = done.join(final, by).filter(F.col("_final") | (F.col("head") < F.col("_open")))
    return settled.select(*keys, "_rn", "head")
