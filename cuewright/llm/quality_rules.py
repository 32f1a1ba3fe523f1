"""Quality rules whose cut-offs come from the corpus: quantile sketches per language and source.

Every text is measured once and the few numbers are written to the shared folder. KLL sketches of
four rates are built for each (language, source); sketches of thin groups are merged into those of
their language, and these into one of the corpus. A document is kept when none of its rates lies
beyond the fence of its group. Only DataFrame functions run here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import stored, text_key, words

RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length")
TWO_SIDED = ("word_length",)
SPAN = 8


@dataclass(frozen=True)
class Fences:
    """``upper = u + reach * (u - median) + tail * (q99 - u) + guard``, ``u`` being the rate's ``level`` quantile.

    All of it but ``guard`` comes from the group, so a rate that is usual in a source is not odd there.
    Symbols are rare in prose and mark damage, so their fence starts from the 0.9 quantile; sound texts
    repeat lines and windows now and then, so theirs starts from 0.99. Only ``word_length`` has a lower
    fence, the mirror image: few symbols or repeats are never a fault. ``guard`` is a tie guard for
    groups without spread. A quantile is taken from a sketch with ``beyond`` documents or more above
    it: thinner groups use the sketch of their language, and thin languages that of the corpus.
    ``sketch_k`` sets the sketch size: ranks are exact up to that many values and within about
    2 / sketch_k of the group beyond.
    """

    level: tuple[float, ...] = (0.9, 0.99, 0.99, 0.9)
    guard: tuple[float, ...] = (0.01, 0.01, 0.01, 0.5)
    reach: float = 2.0
    tail: float = 0.1
    beyond: int = 10
    sketch_k: int = 4096


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """One row of counts per row of ``docs``: base measures, rates, language and source.

    A null text counts as empty: all counts 0, rates 0, ``base_failed``. Columns beyond id, text,
    ``lang`` and ``source`` are not read. ``with_key`` adds the row's ``key``, the hash of its text.
    """
    carried = ["key"] * with_key
    plain = docs.select(
        docs[id_col].alias("doc_id"),
        docs["lang"].alias("lang"),
        docs["source"].alias("source"),
        F.coalesce(docs[text_col], F.lit("")).alias("t"),
        *[text_key(docs[text_col]).alias(c) for c in carried],
    )
    split = plain.select(
        "doc_id",
        "lang",
        "source",
        words(F.col("t")).alias("w"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        *carried,
    )
    counted = split.select(
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        *carried,
    )
    base = [c for c in counted.columns if c != "h"]
    # Hashes of one word become hashes of 2, 4 and 8 words from the same place on.
    for step in (1, 2, 4):
        pair = F.transform("h", lambda x, i: F.xxhash64(x, F.get("h", i + step)))
        counted = counted.select(*base, pair.alias("h"))
    counted = counted.select(*base, F.slice("h", F.lit(1), F.greatest(F.size("h") - (SPAN - 1), F.lit(0))).alias("h"))
    # Most texts repeat no window; only the others sort theirs.
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    numbered = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    sorted_rows = counted.select(*base, F.when(repeats, numbered).otherwise(none).alias("s"))
    twice = F.filter("s", lambda v, k: (F.get("s", k - 1)["x"] == v["x"]) | (F.get("s", k + 1)["x"] == v["x"]))
    starts = sorted_rows.select(*base, F.sort_array(F.transform(twice, lambda v: v["i"])).alias("p"))
    runs = F.transform("p", lambda v, k: F.least(F.lit(SPAN), F.coalesce(F.get("p", k + 1) - v, F.lit(SPAN))))
    repeated = F.aggregate(runs, F.lit(0), lambda a, b: a + b).cast("long")
    out = starts.select(*base, repeated.alias("n_repeat_words"))
    return out.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        _rate("n_symbols", "word_chars").alias("symbol_rate"),
        _rate("n_dup_lines", "n_lines").alias("dup_line_rate"),
        _rate("n_repeat_words", "n_words").alias("repeat_rate"),
        _rate("word_chars", "n_words").alias("word_length"),
        *carried,
    )


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def thresholds(measured: DataFrame, fences: Fences = Fences()) -> DataFrame:
    """``lang, source`` and a lower and upper limit per rate, one row per group.

    Null languages and sources are groups of their own. Documents that fail the base rule are out
    whatever the fences say, so they take no part in them.
    """
    sketches = [F.kll_sketch_agg_double(r, F.lit(fences.sketch_k)).alias(r) for r in RATES]
    group = measured.filter("NOT base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *sketches)
    group = stored(group, "quality-sketches")

    def merged(by: list[str], mark: str) -> DataFrame:
        merge = [F.kll_merge_agg_double(r, F.lit(fences.sketch_k)).alias(f"{mark}_{r}") for r in RATES]
        return group.groupBy(*by).agg(F.sum("n").alias(f"{mark}_n"), *merge)

    lang = merged(["lang"], "l").withColumnRenamed("lang", "l_lang")
    whole = merged([], "c")
    wide = group.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").join(whole, F.lit(True), "left")
    limits = []
    for rate, level, guard in zip(RATES, fences.level, fences.guard):
        least = round(fences.beyond / (1 - level))
        chosen = (
            F.when(F.col("n") >= least, F.col(rate)).when(F.col("l_n") >= least, F.col(f"l_{rate}")).otherwise(F.col(f"c_{rate}"))
        )

        def fence(start: float, end: float) -> Column:
            q, middle, last = (F.kll_sketch_get_quantile_double(chosen, F.lit(x)) for x in (start, 0.5, end))
            return q + fences.reach * (q - middle) + fences.tail * (last - q)

        low = fence(round(1 - level, 6), 0.01) - guard if rate in TWO_SIDED else F.lit(float("-inf"))
        limits += [low.alias(f"{rate}_low"), (fence(level, 0.99) + guard).alias(f"{rate}_high")]
    return wide.select("lang", "source", *limits)


def judge(docs: DataFrame, fences: Fences = Fences(), id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """Counts and verdict of every row: ``doc_id, lang, source``, counts, rates, ``base_failed, kept``.

    ``kept`` is false where ``base_failed`` is true (fewer than 20 words, or over 30 % of the words
    in repeated 8-word windows) or a rate lies outside the fences of the row's (language, source).
    Rows without id, language or source are judged like others; repeated rows each get a row; an
    empty table gives no rows; ties at a fence are kept. ``with_key`` adds ``key``, the hash of the text.
    """
    measured = stored(measure(docs, id_col, text_col, with_key), "quality-measures")
    limits = thresholds(measured, fences).select(
        F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *[f"{r}_{e}" for r in RATES for e in ("low", "high")]
    )
    on = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    inside = F.lit(True)
    for rate in RATES:
        inside = inside & F.col(rate).between(F.col(f"{rate}_low"), F.col(f"{rate}_high"))
    joined = measured.join(limits, on, "left")
    return joined.select(*measured.columns, (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))
