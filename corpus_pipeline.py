"""Training-data pipeline: rules, near duplicates, repeated substrings, benchmark passages, mixing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
documents of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import decontamination, mixing, near_dup, quality_rules, suffix_dedup
from cuewright.llm.common import KEY, text_key
from cuewright.llm.plans import MIX, domains, table
from cuewright.plans.registry import query
from cuewright.session import scratch_path


def _same(docs: DataFrame, found: DataFrame, by: list[str]) -> Column:
    """``_c`` of ``found`` for each c of ``by`` is that of the row: its id, the hash of its text, columns; null is null."""
    mine = {"doc_id": docs["doc_id"].cast("long"), "key": text_key(docs["text"])}
    return reduce(and_, [(mine[c] if c in mine else docs[c]).eqNullSafe(found[f"_{c}"]) for c in by])


def _selected(docs: DataFrame, verdicts: DataFrame, keep: Column, by: list[str] = KEY) -> DataFrame:
    """Rows of ``docs`` that their own verdict keeps; rows that share an id, or have none, are told apart by ``by``."""
    chosen = verdicts.filter(keep).select(*[F.col(c).alias(f"_{c}") for c in by]).distinct()
    return docs.join(chosen, _same(docs, chosen, by), "left_semi")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return _selected(docs, quality_rules.judge(docs, with_key=True), F.col("kept"), [*KEY, "lang", "source"])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    return _selected(docs, near_dup.near_duplicates(docs, with_key=True, by_id=False), F.col("kept"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat; bytes of a character that was cut through go as well.

    ``text`` and ``n_chars`` change where something was removed; documents with nothing left go.
    """
    cut = suffix_dedup.remove_repeats(docs, with_key=True, whole=True).filter("n_removed > 0")
    changed = cut.select(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key"), F.col("kept").cast("string").alias("_text"))
    changed = changed.dropDuplicates(["_doc_id", "_key"])  # repeated rows share one result
    joined = docs.join(changed, _same(docs, changed, KEY), "left")
    text = F.coalesce(F.col("_text"), docs["text"])
    new = {"text": text, "n_chars": F.when(F.col("_text").isNull(), docs["n_chars"]).otherwise(F.length("_text"))}
    kept = joined.filter(F.col("_text").isNull() | (F.trim("_text") != ""))
    return kept.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else docs[c] for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), with_key=True)
    return _selected(docs, found, ~F.col("contaminated"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates of the remaining documents for the target mix, with posteriors."""
    mixed = mixing.mix(docs, domains(docs, table(spark, sf_dir, "labels")), MIX)
    return mixed.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(MIX)], "rate")


STAGES = [
    ("quality_rules", rules),
    ("near_dup", near),
    ("suffix_dedup", substrings),
    ("decontamination", benchmark),
    ("mixing", mixture),
]
ORACLE_SQL = None  # signatures, suffix sorting and fitted rates are beyond SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline", ORACLE_SQL)(run)
