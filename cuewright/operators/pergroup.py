"""Small Python functions over the ordered rows of each key.

Rows are hashed and sorted by Spark and stream through the workers in Arrow batches; a worker
holds one key at a time, and small keys cost no call into Spark each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def by_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    needs: Sequence[str],
    run: Callable[[tuple, list[tuple]], list[tuple]],
    schema: str,
    at_once: int = 10_000,
) -> DataFrame:
    """``run(key, rows)`` for each key, ``rows`` being tuples of the ``needs`` columns in order.

    At most ``at_once`` rows of a batch are Python objects at a time, besides those of an open key.

    Rows with a null key form one group per null key. The number of partitions is fixed: the work is
    in Python, where merging small partitions would leave cores idle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = list(dict.fromkeys([*keys, *order, *needs]))
    sorted_rows = df.select(*columns).repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    places = [columns.index(c) for c in needs]
    width = len(keys)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        values = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, kinds)], schema=kinds)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            parts_of = (batch.slice(at, at_once) for at in range(0, batch.num_rows, at_once))
            rows = chain.from_iterable(zip(*[part.column(c).to_pylist() for c in columns]) for part in parts_of)
            for key, group in groupby(rows, key=lambda r: r[:width]):
                if held and key != open_key:
                    out += run(open_key, held)
                    held = []
                open_key = key
                held += [tuple(r[p] for p in places) for r in group]
            yield batch_of(out)
        if held:
            yield batch_of(run(open_key, held))

    return sorted_rows.select(*[F.col(c) for c in columns]).mapInArrow(stream, schema)
