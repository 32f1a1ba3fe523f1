"""As-of and nearest lookups by one ordered scan over both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.operators.ordered import largest_group, last_known, next_known, scan


def asof(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    left_bound: int | None = None,
) -> DataFrame:
    """``left`` plus ``_before`` (latest right row at or before) and ``_after`` (first at or after).

    Both are structs of all right columns, null when there is none. Ids settle equal times:
    ``_before`` takes the last id, ``_after`` the first. ``left_bound`` is a number of left rows
    no key exceeds, where counting them would cost more than it tells.
    """
    left_bound = largest_group(left, on) if left_bound is None else left_bound
    bound = left_bound + 2 * largest_group(right, on)
    rstruct = F.struct(*[F.col(c) for c in right.columns])
    rtype = right.select(rstruct.alias("s")).schema["s"].dataType
    ltype = left.select(F.struct("*").alias("s")).schema["s"].dataType

    def side(df, rank, time, ident, l, r):
        return df.select(
            *on, F.col(time).alias("_t"), F.lit(rank).alias("_rank"), F.col(ident).cast("string").alias("_tie"),
            F.col(ident).cast("long").alias("_id"), l.alias("_l"), r.alias("_r"),
        )

    # A right row at the very time must be seen from both directions: it is placed before
    # the left row for the backward look and repeated after it for the forward look.
    lrows = side(left, 1, left_time, left_id, F.struct(*left.columns), F.lit(None).cast(rtype))
    early = side(right, 0, right_time, right_id, F.lit(None).cast(ltype), rstruct)
    late = side(right, 2, right_time, right_id, F.lit(None).cast(ltype), rstruct)
    rows = lrows.unionByName(early).unionByName(late)
    seen = scan(
        rows,
        on,
        ["_t", "_rank", "_id", "_tie"],
        [
            last_known("_before", F.when(F.col("_rank") == 0, F.col("_r"))),
            next_known("_after", F.when(F.col("_rank") == 2, F.col("_r"))),
        ],
        bound=bound,
    )
    return seen.filter(F.col("_rank") == 1).select("_l.*", "_before", "_after")
