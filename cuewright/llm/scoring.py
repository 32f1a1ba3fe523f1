"""Training samples and scores of text classifiers: bounded samples in, one score per text out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.session import ship_package


def remainder(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id reads as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, feature: Callable[[str], np.ndarray]
) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Features of trusted positives, of unlabelled texts, and the class prior.

    Rows of the held-out remainder are left out. ``most`` bounds either list: the ids with the
    smallest hashes are taken, so the choice does not depend on the layout of the tables. The prior
    is the share of positives among all trusted labels; labels are used for nothing else, and
    unlabelled texts are drawn from all documents whatever their label. Only the sampled texts reach
    the feature code, and only their features the driver.
    """
    ship_package(docs.sparkSession)
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    ids = ids.filter(remainder("doc_id", folds) != held)
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("y"))
    known = known.filter((remainder("doc_id", folds) != held) & F.col("y").isNotNull())
    share = known.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    draw = [F.xxhash64(F.col("doc_id"), F.lit(17)), F.col("doc_id")]
    positive = known.filter("y > 0").select("doc_id").distinct().orderBy(*draw).limit(most)
    unlabelled = ids.distinct().orderBy(*draw).limit(most)
    chosen = positive.withColumn("p", F.lit(1)).withColumn("u", F.lit(0)).unionByName(
        unlabelled.withColumn("p", F.lit(0)).withColumn("u", F.lit(1))
    )
    chosen = chosen.groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))  # at most 2 * most rows
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("p", "u", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [feature(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["p", "u", "x"]
            )

    got = rows.mapInArrow(features, "p int, u int, x binary").toArrow()
    kind = feature("").dtype
    vectors = [np.frombuffer(x, kind) for x in got.column("x").to_pylist()]
    flags = zip(got.column("p").to_pylist(), got.column("u").to_pylist(), vectors)
    flags = sorted(flags, key=lambda r: r[2].tobytes())  # sums in one order, whatever order rows arrive in
    return [x for p, _, x in flags if p], [x for _, u, x in flags if u], 0.5 if share is None else share


def scored(docs: DataFrame, folds: int, held: int, score: Callable[[str], float], cut: float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; the text is the only input of a score.

    A null text is scored as the empty text; repeated rows each get their row.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id",
        (remainder("doc_id", folds) == held).alias("held_out"),
        "score",
        F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"),
    )
