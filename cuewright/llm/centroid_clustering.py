"""Centroid clustering in whole numbers with JVM expressions only.

Vectors become arrays of integers. ``zip_with`` and ``aggregate`` give the squared distance to each
centroid of a literal array, ``array_min`` of (distance, number) structs chooses the cluster, and plain
column sums, combined on the map side, give the next centroids. Vectors are never shuffled: each round is
one scan that leaves one row of sums per cluster, and only those reach the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 256
REACH = 1 << 28  # components beyond it could overflow a distance of 64 bits


def whole_vectors(vectors: DataFrame, size: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the vectors with exactly ``size`` finite components; ``v`` holds ``floor(256 * x)`` as longs."""
    x = F.transform(vectors[vector_col], lambda c: c.cast("double"))
    finite = (F.size(vector_col) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c * F.lit(float(LEVELS))))
    too_far = F.lit(f"a component is too large: |x| must stay below {REACH // LEVELS}")
    safe = F.transform(scaled, lambda c: F.when(F.abs(c) <= REACH, c).otherwise(F.raise_error(too_far).cast("long")))
    return vectors.filter(F.coalesce(finite, F.lit(False))).select(vectors[id_col].cast("long").alias("vec_id"), safe.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """Vectors with the ``k`` smallest hashes of ``seed:vec_id``, in that order; at most ``k`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), F.col("v").asc()).limit(k)
    return [list(r["v"]) for r in chosen.collect()]


def _literal(centroids: list[list[int]]) -> Column:
    """All centroids as one literal, parsed at once."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{c}L" for c in row) + ")" for row in centroids) + ")")


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, v, near``: ``near`` is the struct (distance, number) of the nearest centroid, the smaller number at a tie."""

    def distance(c: Column) -> Column:
        squares = F.zip_with("v", c, lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda s, d: s + d)

    to_all = F.transform(_literal(centroids), lambda c, i: F.struct(distance(c).alias("distance"), i.alias("number")))
    return vectors.select("vec_id", "v", F.array_min(to_all).alias("near"))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: exact floor of each component's mean; empty ones stay."""
    sums = [F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(len(centroids[0]))]
    number = F.col("near.number").alias("number")
    out = [list(c) for c in centroids]
    for row in assigned(vectors, centroids).groupBy(number).agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[row["number"]] = [row[f"s{j}"] // row["n"] for j in range(len(centroids[0]))]
    return out


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid`` of every kept vector.

    Vectors that are null, of another length, or hold a null or non-finite component are left out.
    Components become ``floor(256 * x)``; one beyond 2**20 stops the job with a message, as its distances
    could pass 64 bits. Centroids start as the vectors with the smallest hashes of their ids; vectors
    without id rank last there, and repeated ids by their components. Repeated rows each count and
    each come out. With fewer than ``k`` vectors there are as many centroids as vectors; an empty
    table gives an empty result. Other columns are not read.
    """
    kept = whole_vectors(vectors, size, id_col, vector_col)
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids)
    if not centroids:
        centroids = [[0] * size]
    found = assigned(kept, centroids).select("vec_id", F.col("near.number").alias("number"), F.col("near.distance").alias("distance"))
    sums = {r["number"]: r["s"] for r in found.groupBy("number").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda column: F.element_at(column, F.col("number") + 1)
    inertia = F.array(*[F.lit(sums.get(i, 0)).cast("long") for i in range(len(centroids))])
    return found.select(
        "vec_id",
        F.col("number").alias("cluster"),
        "distance",
        of(inertia).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        of(F.array(*[F.lit(d) for d in digests])).alias("centroid_sha256"),
        of(_literal(centroids)).alias("centroid"),
    )
