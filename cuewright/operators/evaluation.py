"""Error rates, similarity, opinion scores and real-time factors, per group and overall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = ["insertions", "deletions", "substitutions"]


def _rate(digits: int) -> Column:
    total = F.col("insertions") + F.col("deletions") + F.col("substitutions")
    return F.bround(total / F.col("words") * 100, digits)


def micro_wer(scores: DataFrame, by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Errors over words in percent per group; groups without words are left out."""
    sums = [F.sum(c).alias(c) for c in ERRORS] + [F.sum("word_num").alias("words")]
    grouped = scores.groupBy(*by).agg(*sums) if by else scores.agg(*sums)
    return grouped.filter(F.col("words") > 0).withColumn("wer", _rate(digits))


def macro_wer(scores: DataFrame, by: str, digits: int = 3) -> DataFrame:
    """Unweighted mean of the rounded group rates; no row unless several groups have words."""
    groups = micro_wer(scores, [by], digits)
    out = groups.agg(F.avg("wer").alias("macro_wer"), F.count(F.lit(1)).alias("groups"))
    return out.filter(F.col("groups") > 1).withColumn("macro_wer", F.bround("macro_wer", 2))


def mean_of_rows(scores: DataFrame) -> DataFrame:
    """Mean utterance rate next to the weighted one; NaN when there is nothing to average."""
    nan = F.lit(float("nan"))
    total = F.sum(F.col("insertions") + F.col("deletions") + F.col("substitutions"))
    words = F.sum("word_num")
    return scores.agg(
        F.coalesce(F.bround(F.avg("wer") * 100, 2), nan).alias("mean_wer"),
        F.coalesce(F.bround(F.when(words > 0, total / words * 100), 2), nan).alias("weighted_wer"),
        F.count(F.lit(1)).alias("utterances"),
    )


def score_means(scores: DataFrame, by: str, value: str, digits: int = 3) -> DataFrame:
    """Mean per group, mean of group means (when there are several) and overall mean.

    One aggregation by group; the other two levels are taken from its small result.
    """
    groups = scores.groupBy(by).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("n"))
    per = groups.select(F.lit("group").alias("level"), F.col(by).cast("string").alias("name"), (F.col("_sum") / F.col("n")).alias("mean"), "n")
    macro = groups.agg(
        F.lit("macro").alias("level"), F.lit(None).cast("string").alias("name"), F.avg(F.col("_sum") / F.col("n")).alias("mean"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") > 1)
    overall = groups.agg(
        F.lit("overall").alias("level"), F.lit(None).cast("string").alias("name"), (F.sum("_sum") / F.sum("n")).alias("mean"), F.sum("n").alias("n")
    ).filter(F.col("n") > 0)
    return per.unionByName(macro).unionByName(overall).withColumn("mean", F.round("mean", digits))


def real_time_factor(runs: DataFrame) -> DataFrame:
    """Total synthesis and audio time and their ratio; ``runs`` has synth_ms and audio_ms."""
    return runs.agg(
        F.sum("synth_ms").alias("synth_ms"),
        F.sum("audio_ms").alias("audio_ms"),
        F.round(F.sum("synth_ms") / F.nullif(F.sum("audio_ms"), F.lit(0)), 4).alias("rtf"),
        F.count_if(F.col("audio_ms") == 0).alias("infinite_rows"),
    )


def row_rtf(synth_ms: Column, audio_ms: Column) -> Column:
    return F.when(audio_ms > 0, synth_ms / audio_ms).otherwise(F.lit(float("inf")))


def wer_report(scores: DataFrame, by: str, name: str) -> DataFrame:
    """Report lines in three sections: utterances, groups, overall."""
    tab = F.lit("\t")
    counts = [F.col(c).cast("string") for c in ERRORS]
    detail = scores.select(
        F.lit(1).alias("section"), F.col(name).cast("string").alias("name"),
        F.concat_ws("\t", F.col(name).cast("string"), F.round("wer", 6).cast("string"), *counts).alias("line"),
    )

    def summary(rows: DataFrame, section: int, label: Column) -> DataFrame:
        line = F.concat(F.lit("["), label, F.lit("]"), tab, F.col("wer").cast("string"), tab, F.concat_ws("\t", *counts, F.col("words").cast("string")))
        return rows.select(F.lit(section).alias("section"), label.alias("name"), line.alias("line"))

    per = summary(micro_wer(scores, [by], 3), 2, F.col(by))
    return detail.unionByName(per).unionByName(summary(micro_wer(scores), 3, F.lit("Overall")))


def score_cases(cases: DataFrame, run, judge, columns: Sequence[str]) -> DataFrame:
    """Run and judge evaluation cases batch by batch; one failing case never stops the others.

    ``run(row) -> str`` may raise an exception carrying ``partial``; what it produced is still
    judged. ``judge(row, transcript) -> float`` may raise too. A case without a transcript, or
    whose judge failed, scores 0.
    """
    import pandas as pd

    def one(row) -> tuple:
        transcript = error = None
        try:
            transcript = run(row)
        except Exception as failure:
            transcript, error = getattr(failure, "partial", None), f"{type(failure).__name__}: {failure}"
        if transcript is None:
            return None, 0.0, error or "no transcript"
        try:
            return transcript, float(judge(row, transcript)), error
        except Exception as failure:
            return transcript, 0.0, f"judge: {type(failure).__name__}: {failure}"

    def batch(frames):
        for pdf in frames:
            out = pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=["transcript", "score", "error"], index=pdf.index)
            yield pd.concat([pdf, out], axis=1)

    source = cases.select(*columns)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInPandas(batch, f"{kept}, transcript string, score double, error string")
