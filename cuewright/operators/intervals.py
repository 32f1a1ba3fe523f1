"""Interval, point and proximity joins over millisecond spans.

Both sides are cut into time bins, so the equi-join key is (key, bin) and one long recording
spreads over many tasks. A pair that shares several bins is emitted in the first one only;
no distinct is needed afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_MS = 60_000


def interval_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    keep: Column,
    bin_ms: int = BIN_MS,
) -> DataFrame:
    """Inner join of rows whose spans may touch, restricted by ``keep``.

    Column names other than ``on`` must differ between the sides. ``keep`` decides open or
    closed ends; the bins only bound which pairs are looked at.
    """

    def binned(df: DataFrame, span: tuple[Column, Column], first: str) -> DataFrame:
        lo = F.floor(span[0] / bin_ms)
        hi = F.greatest(F.floor(span[1] / bin_ms), lo)
        return df.withColumn(first, lo).withColumn("_bin", F.explode(F.sequence(lo, hi)))

    lhs = binned(left, left_span, "_lbin")
    rhs = binned(right, right_span, "_rbin")
    met = lhs.join(rhs, [*on, "_bin"])
    once = F.col("_bin") == F.greatest("_lbin", "_rbin")
    return met.filter(once & keep).drop("_bin", "_lbin", "_rbin")
