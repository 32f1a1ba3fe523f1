"""Corpus preparation: shards, batches, packing, shuffling and mixing of manifests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cuewright.operators.ordered import largest_group, row_number, running_sum, scan
from cuewright.operators.pergroup import by_group

BUCKETS, SHORTEST_MS, LONGEST_MS = 20, 500, 30_000
PAD_POSITION, PAD_DOCUMENT, NO_LOSS = 0, -1, -100
ROWS_AT_ONCE = 128


def uniform(*parts: Column) -> Column:
    """Repeatable draw from [0, 1): the first 48 bits of the MD5 of the parts joined by colons."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.left(digest, F.lit(12)), 16, 10).cast("long") / F.lit(float(1 << 48))


def shard_size(total: int, per_shard: int, min_shards: int) -> int:
    """Samples per shard, lowered when too few shards would result."""
    if total > 0 and -(-total // per_shard) < min_shards:
        return max(1, total // min_shards)
    return per_shard


def assign_shards(df: DataFrame, order: Sequence[str], per_shard: int, min_shards: int = 1) -> DataFrame:
    """Adds ``shard``: consecutive samples in a global order, a fixed number per shard."""
    total = largest_group(df, [])
    size = shard_size(total, per_shard, min_shards)
    numbered = scan(df, [], order, [row_number("_rn")], bound=total)
    return numbered.withColumn("shard", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def assign_workers(df: DataFrame, order: Sequence[str], workers: int) -> DataFrame:
    """Adds ``worker``: row i goes to worker i mod n."""
    numbered = scan(df, [], order, [row_number("_rn")])
    return numbered.withColumn("worker", F.pmod(F.col("_rn") - 1, F.lit(workers))).drop("_rn")


def shard_manifest(df: DataFrame, root: str) -> DataFrame:
    """One row per non-empty shard: paths, number of items, seconds with three decimals."""
    name = F.lpad(F.col("shard").cast("string"), 6, "0")
    per = df.groupBy("shard").agg(F.count(F.lit(1)).alias("num_items"), F.sum("duration_ms").alias("ms"))
    seconds = F.concat(
        F.expr("ms div 1000").cast("string"), F.lit("."), F.lpad((F.col("ms") % 1000).cast("string"), 3, "0")
    )
    return per.select(
        "shard",
        F.concat(F.lit(f"{root}/shard-"), name, F.lit(".tar")).alias("tar_path"),
        F.concat(F.lit(f"{root}/shard-"), name, F.lit(".jsonl")).alias("label_path"),
        "num_items",
        seconds.alias("num_seconds"),
    )


def shard_stats(df: DataFrame) -> DataFrame:
    """Processed, filtered and failed samples and seconds per shard and overall (null shard).

    ``df`` has shard, state (ok, filtered, error) and duration_ms.
    """
    ok = F.col("state") == "ok"
    return df.rollup("shard").agg(
        F.count_if(ok).alias("processed"),
        F.count_if(F.col("state") == "filtered").alias("filtered"),
        F.count_if(F.col("state") == "error").alias("errors"),
        F.coalesce(F.sum(F.when(ok, F.col("duration_ms"))), F.lit(0)).alias("duration_ms"),
    )


def dataset_totals(manifests: DataFrame) -> DataFrame:
    """Items and seconds per split after repeating each manifest."""
    return manifests.groupBy("split").agg(
        F.sum(F.col("num_items") * F.col("repeat")).alias("items"),
        F.sum(F.col("ms") * F.col("repeat")).alias("ms"),
    )


def repeat_rows(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times (none for 0), with its copy number."""
    copies = F.when(times >= 1, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("copy_no", F.explode(copies))


def duration_bucket(ms: Column, low: int = SHORTEST_MS, high: int = LONGEST_MS, buckets: int = BUCKETS) -> Column:
    """Index of the first equal-width boundary not below the duration (right-closed buckets)."""
    return F.greatest(F.ceil((ms - low) * buckets / (high - low)) - 1, F.lit(0)).cast("long")


def batches_by_duration(df: DataFrame, size: int) -> DataFrame:
    """Longest first in batches of a fixed number of rows."""
    numbered = scan(df, [], [F.desc("duration_ms"), F.asc("id")], [row_number("_rn")])
    return numbered.withColumn("batch_no", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def seeded_shuffle(df: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Adds ``position`` in a permutation fixed by seed and epoch."""
    keyed = df.withColumn("_key", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), F.lit(str(epoch)))))
    return scan(keyed, [], ["_key", "id"], [row_number("position")]).drop("_key")


def weighted_mux(df: DataFrame, weights: Column, seed: int, stop_early: bool = False) -> DataFrame:
    """Interleave sources, each next row drawn from a source by weight.

    Every source gets exponential arrival times with its weight as rate; merging them by time
    draws sources with the same law as choosing one by weight at each step, without a serial
    loop. With ``stop_early`` rows after the first exhausted source's next arrival are left out.
    ``df`` has source and id. Waits are whole numbers of 2**-20, so that running sums do not depend
    on how the rows are sliced.
    """

    def waiting(draw: Column, weight: Column) -> Column:
        return F.floor(-F.log(F.lit(1.0) - draw) / weight * float(1 << 20)).cast("long")

    wait = waiting(uniform(F.lit(seed), F.col("source"), F.col("id")), weights)
    timed = scan(df.withColumn("_wait", wait), ["source"], ["id"], [running_sum("_at", F.col("_wait"))])
    if stop_early:
        ends = timed.groupBy("source").agg(F.max("_at").alias("_end"), F.first(weights).alias("_w"))
        extra = waiting(uniform(F.lit(seed), F.col("source"), F.lit("end")), F.col("_w"))
        cut = ends.agg(F.min(F.col("_end") + extra).alias("_cut")).withColumn("_one", F.lit(1))
        timed = timed.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one").filter(F.col("_at") < F.col("_cut"))
        timed = timed.drop("_one", "_cut")
    placed = scan(timed, [], ["_at", "source", "id"], [row_number("position")])
    return placed.drop("_wait", "_at")


def fill_batches(lengths: np.ndarray, budget: int) -> np.ndarray:
    """Batch number of each row when batches are filled in order up to the budget."""
    reach = np.cumsum(lengths)
    numbers = np.empty(len(lengths), dtype=np.int64)
    start = number = 0
    while start < len(lengths):
        used = reach[start - 1] if start else 0
        stop = max(int(np.searchsorted(reach, used + budget, side="right")), start + 1)
        numbers[start:stop] = number
        start, number = stop, number + 1
    return numbers


def pack_tokens(df: DataFrame, budget: int) -> DataFrame:
    """In-order packing to a token budget inside each shard; longer samples are left out.

    ``df`` has shard, id and length. A shard holds a fixed number of samples, which bounds the
    group; packing has always been local to the shards one loader reads.
    """

    fits = df.filter(F.col("length") <= budget)
    out = "shard long, id long, length long, batch_no long"
    return by_group(fits, ["shard"], ["id"], ["id", "length"], _filler(budget), out)


def _filler(budget: int):
    def pack(key: tuple, rows: list[tuple]) -> list[tuple]:
        numbers = fill_batches(np.array([size for _, size in rows], dtype=np.int64), budget)
        return [(*key, ident, size, n) for (ident, size), n in zip(rows, numbers.tolist())]

    return pack


def pack_longest_first(df: DataFrame, budget_ms: int) -> DataFrame:
    """Longest-first packing to a duration budget inside each shard; a longer sample stands alone.

    ``df`` has shard, id and duration_ms. A shard holds a fixed number of samples, which bounds the
    group, so the batches do not depend on the size of the table.
    """
    ranked = df.select("shard", (-F.col("duration_ms")).alias("_rank"), "id", "duration_ms")
    out = "shard long, id long, duration_ms long, batch_no long"
    return by_group(ranked, ["shard"], ["_rank", "id"], ["id", "duration_ms"], _filler(budget_ms), out)


def pack_buckets(df: DataFrame, budget_ms: int, max_rows: int | None = None, drop_last: bool = False) -> DataFrame:
    """Duration-bucket batches inside each shard: emitted once one more of the longest would overflow.

    ``df`` has shard, id and duration_ms within the bucket range.
    """

    def pack(key: tuple, rows: list[tuple]) -> list[tuple]:
        out, number, held, longest = [], 0, 0, 0
        for ident, ms in rows:
            held, longest = held + 1, max(longest, ms)
            out.append((*key, ident, ms, number))
            if longest * (held + 1) >= budget_ms or (max_rows is not None and held >= max_rows):
                number, held, longest = number + 1, 0, 0
        return out[: len(out) - held] if drop_last else out

    kept = df.filter(F.col("duration_ms").between(SHORTEST_MS, LONGEST_MS))
    keyed = kept.select("shard", duration_bucket(F.col("duration_ms")).alias("bucket"), "id", "duration_ms")
    out = "shard long, bucket long, id long, duration_ms long, batch_no long"
    return by_group(keyed, ["shard", "bucket"], ["id"], ["id", "duration_ms"], pack, out)


def packed_rows(packed: DataFrame, budget: int) -> DataFrame:
    """One padded row per batch: positions restart per sample, document ids count samples.

    A batch holds at most ``budget`` tokens, which bounds the arrays.
    """
    parts = F.array_sort(F.collect_list(F.struct("id", "length")))
    rows = packed.groupBy("shard", "batch_no").agg(parts.alias("parts"))
    lengths = F.transform("parts", lambda p: p.length.cast("int"))
    real = F.filter(lengths, lambda n: n > 0)
    positions = F.flatten(F.transform(real, lambda n: F.sequence(F.lit(0), n - 1)))
    documents = F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))
    used = F.aggregate(lengths, F.lit(0), lambda a, n: a + n)
    pad = F.lit(budget) - used

    def padded(values: Column, filler: int) -> Column:
        return F.concat(values, F.array_repeat(F.lit(filler), pad))

    return rows.select(
        "shard",
        "batch_no",
        used.alias("tokens"),
        padded(positions, PAD_POSITION).alias("position_ids"),
        padded(documents, PAD_DOCUMENT).alias("document_ids"),
    )


def condition_flags(df: DataFrame, seed: int, drop_ratio=0.1, language_ratio=0.8, instruct_ratio=0.5, only_ratio=0.3,
                    prompt_range=(0.0, 0.3), mask_range=(0.0, 1.0)) -> DataFrame:
    """Repeatable conditioning choices per sample. A dropped condition turns the others off;
    samples with a clean start (``clean_start`` not null) are never dropped."""

    def draw(salt: str) -> Column:
        return uniform(F.col("id"), F.lit(seed), F.lit(salt))

    def between(salt: str, span: tuple[float, float]) -> Column:
        return F.lit(span[0]) + draw(salt) * (span[1] - span[0])

    drop = F.col("clean_start").isNull() & (draw("drop") < drop_ratio)
    flagged = df.withColumn("drop_cond", drop)
    flagged = flagged.withColumn("use_language", ~F.col("drop_cond") & (draw("language") < language_ratio))
    flagged = flagged.withColumn("use_instruct", ~F.col("drop_cond") & (draw("instruct") < instruct_ratio))
    alone = F.col("use_instruct") & (draw("only") < only_ratio)
    prompt = F.when(F.col("drop_cond") | alone, F.lit(0.0)).otherwise(between("prompt", prompt_range))
    return flagged.withColumn("prompt_ratio", prompt).withColumn("mask_ratio", between("mask", mask_range))


def mask_tokens(df: DataFrame, seed: int, mask_id: int) -> DataFrame:
    """Mask tokens after the prompt; labels carry loss only where a token was masked.

    ``df`` has id, tokens, prompt_length, mask_ratio and drop_cond. With the condition dropped
    the prompt keeps its loss.
    """

    def masked(i: Column) -> Column:
        return (i >= F.col("prompt_length")) & (uniform(F.col("id"), F.lit(seed), i) < F.col("mask_ratio"))

    inputs = F.transform("tokens", lambda t, i: F.when(masked(i), F.lit(mask_id)).otherwise(t))
    lossy = F.transform(
        "tokens",
        lambda t, i: F.when(masked(i) | (F.col("drop_cond") & (i < F.col("prompt_length"))), t).otherwise(F.lit(NO_LOSS)),
    )
    return df.withColumn("input_ids", inputs).withColumn("labels", lossy)


def style_prompt(language: Column, instruct: Column, denoise: Column) -> Column:
    head = F.when(denoise, "<|denoise|>").otherwise("")
    lang, inst = F.coalesce(language, F.lit("None")), F.coalesce(instruct, F.lit("None"))
    return F.concat(head, F.lit("<|lang_start|>"), lang, F.lit("<|lang_end|><|instruct_start|>"), inst, F.lit("<|instruct_end|>"))


def text_prompt(text: Column, pinyin: Column, use_pinyin: Column) -> Column:
    chosen = F.when(use_pinyin & pinyin.isNotNull(), pinyin).otherwise(text)
    return F.concat(F.lit("<|text_start|>"), chosen, F.lit("<|text_end|>"))


def process_samples(df: DataFrame, process, columns: Sequence[str], schema: str) -> DataFrame:
    """Run a batch function over samples; failing samples become rows with ``error`` set.

    ``process(pdf)`` maps a frame, of ``ROWS_AT_ONCE`` rows at most, to one with the schema's columns. When
    a batch raises, its rows are tried again in halves, down to the bad ones.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def safe(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return process(pdf).assign(error=None)
        except Exception as failure:
            if len(pdf) == 1:
                blank = {n: [pdf[n].iloc[0] if n in pdf else None] for n in names}
                return pd.DataFrame({**blank, "error": [f"{type(failure).__name__}: {failure}"]})
            half = len(pdf) // 2
            return pd.concat([safe(pdf.iloc[:half]), safe(pdf.iloc[half:])], ignore_index=True)

    out = schema + ", error string"
    arrow = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                done = safe(batch.slice(at, ROWS_AT_ONCE).to_pandas())
                yield pa.RecordBatch.from_pandas(done[[*names, "error"]], arrow, preserve_index=False)

    return df.select(*columns).mapInArrow(run, out)
