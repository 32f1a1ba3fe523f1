"""Exact deduplication against a stored index: minimal perfect hash tables over historical digests.

History is reduced to its distinct digests, dealt out to shards by the digest, and each shard becomes
one minimal perfect hash: levels of bit arrays in which a key keeps the place where it is alone, and the
rank of that bit is its slot. A slot holds the full 32-byte digest, the locator of the row that wins so
far and the number of rows. New rows are grouped by digest before the lookup, so a text that makes up a
third of all rows is looked up once; the byte comparison with the slot tells members, which repeat
history, from nonmembers, which form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import BLANKS, NO_ID, stored
from cuewright.session import ship_package

SHARD_DIGESTS = 100_000  # about 7 MB a shard
LEAST_SHARDS = 64
GAMMA = 2.0  # places per key of a level
INDEX = "shard int, levels binary, sizes binary, digests binary, points binary, ids binary, places binary, counts binary"
GROUPS = "digest binary, doc_id long, place long, n long, known boolean"


def normalised(text: Column) -> Column:
    """The text without blanks, tabs and line ends; null reads as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, place, points, digest`` of every row, written once: ``place`` tells rows apart, texts go no further."""
    ship_package(docs.sparkSession)
    ident = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc_id")
    points = F.length(F.coalesce(docs[text_col], F.lit(""))).cast("long").alias("points")
    digest = F.unhex(F.sha2(normalised(docs[text_col]).cast("binary"), 256)).alias("digest")
    return stored(docs.select(ident, F.monotonically_increasing_id().alias("place"), points, digest), "digests")


def winners(rows: DataFrame) -> DataFrame:
    """``digest, best, n``: ``best`` is the struct (-points, doc_id, place) that sorts first. Combined on the map side."""
    order = F.struct((-F.col("points")).alias("minus"), "doc_id", "place")
    return rows.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def _words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view(np.uint64).reshape(-1, 4)


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key on a level: words of the digest mixed with the level's number."""
    x = words[:, level % 4] ^ (words[:, (level + 1) % 4] * np.uint64(2 * level + 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(levels, slot of each key) for distinct digests as rows of 32 bytes; slots are 0 to n - 1 without gaps."""
    words = _words(digests)
    left = np.arange(len(words))
    slots = np.zeros(len(words), np.int64)
    levels: list[np.ndarray] = []
    used = 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = _places(words[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1 + used
        placed = alone[at]
        slots[left[placed]] = rank[at[placed]]
        used += int(placed.sum())
        levels.append(alone)
        left = left[~placed]
    return levels, slots


def slots_of(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """Slot that each digest would have, -1 where no level has its place. A stranger may get a slot: compare bytes."""
    words = _words(digests)
    out = np.full(len(words), -1, np.int64)
    left = np.arange(len(words))
    used = 0
    for level, alone in enumerate(levels):
        if not len(left):
            break
        at = _places(words[left], level, len(alone))
        found = alone[at]
        rank = np.cumsum(alone) - 1 + used
        out[left[found]] = rank[at[found]]
        used += int(alone.sum())
        left = left[~found]
    return out


def _digest_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _longs(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy().astype(np.int64) for n in names]


def _build(table: pa.Table) -> pa.Table:
    digests = _digest_rows(table.column("digest"))
    levels, slots = perfect_hash(digests)
    order = np.argsort(slots)
    minus, ids, places, counts = _longs(table, "minus", "doc_id", "place", "n")
    bits = b"".join(np.packbits(a).tobytes() for a in levels)
    sizes = np.array([len(a) for a in levels], np.int64)
    row = [bits, sizes.tobytes(), digests[order].tobytes(), *(x[order].tobytes() for x in (-minus, ids, places, counts))]
    names = [c.split()[0] for c in INDEX.split(", ")]
    return pa.Table.from_arrays([pa.array([table.column("shard")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names=names)


def build_index(history: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per shard of the index of ``winners``; write it to keep it.

    A shard holds about ``SHARD_DIGESTS`` digests, as hashes spread evenly, however often a text occurs.
    """
    shards = shards or max(LEAST_SHARDS, -(-history.count() // SHARD_DIGESTS))
    flat = history.select(_shard(shards), "digest", "best.minus", "best.doc_id", "best.place", "n")
    return flat.groupBy("shard").applyInArrow(_build, INDEX).withColumn("shards", F.lit(shards))


def _lookup(new: pa.Table, index: pa.Table) -> pa.Table:
    digests = _digest_rows(new.column("digest"))
    minus, ids, places, counts = _longs(new, "minus", "doc_id", "place", "n")
    known = np.zeros(len(digests), bool)
    if index.num_rows:
        row = {c: index.column(c)[0].as_py() for c in index.column_names}
        sizes = np.frombuffer(row["sizes"], np.int64)
        ends = np.cumsum((sizes + 7) // 8)
        bits = np.frombuffer(row["levels"], np.uint8)
        levels = [np.unpackbits(bits[e - (s + 7) // 8 : e], count=s).astype(bool) for s, e in zip(sizes.tolist(), ends.tolist())]
        held = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        old = [np.frombuffer(row[c], np.int64) for c in ("points", "ids", "places", "counts")]
        slot = slots_of(levels, digests)
        known[slot >= 0] = (held[slot[slot >= 0]] == digests[slot >= 0]).all(axis=1)
        at = slot[known]
        theirs = np.stack([-old[0][at], old[1][at], old[2][at]])
        mine = np.stack([minus[known], ids[known], places[known]])
        first = _before(theirs, mine)
        best = np.where(first, theirs, mine)
        minus[known], ids[known], places[known] = best
        counts[known] += old[3][at]
        quiet = np.ones(len(held), bool)
        quiet[at] = False
        digests = np.concatenate([digests, held[quiet]])
        ids, places, counts = (np.concatenate([a, b[quiet]]) for a, b in zip((ids, places, counts), old[1:]))
        known = np.concatenate([known, np.ones(int(quiet.sum()), bool)])
    columns = [[d.tobytes() for d in digests], ids, places, counts, known]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in GROUPS.split(", ")])


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each column of ``a`` sorts before that of ``b``."""
    lower = np.zeros(a.shape[1], bool)
    same = np.ones(a.shape[1], bool)
    for x, y in zip(a, b):
        lower |= same & (x < y)
        same &= x == y
    return lower


def groups(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """``digest, doc_id, place, n, known`` of every distinct text in the index or among ``winners`` of new rows.

    ``doc_id`` and ``place`` locate the row that stays, ``n`` counts all rows, ``known`` marks texts of history.
    """
    new = arrivals.select(_shard(shards), "digest", "best.minus", "best.doc_id", "best.place", "n")
    return new.groupBy("shard").cogroup(index.drop("shards").groupBy("shard")).applyInArrow(_lookup, GROUPS)


def deduplicate(docs: DataFrame, historical: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, known`` of every row of ``docs``, dropped ones too.

    Texts are equal when they agree after blanks, tabs and line ends are deleted; null counts as empty,
    and all empty texts are equal. The row with the most code points in its original text stays, then that
    with the smallest id; a row without id comes after those with one, and among repeated rows one stays.
    ``historical``, a condition on ``doc_id``, says which rows are indexed beforehand (none: the lower half
    of the ids); the result does not depend on it but for ``known``, which marks texts of history.
    Digests and counts are combined on the map side before every shuffle. An empty table gives an empty
    result; other columns are not read.
    """
    rows = located(docs, id_col, text_col)
    if historical is None:
        ends = rows.filter(F.col("doc_id") != NO_ID).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
        historical = F.col("doc_id") <= ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    old = F.coalesce(historical, F.lit(False))
    history = stored(winners(rows.filter(old)), "history")
    index = stored(build_index(history), "index")
    first = index.select("shards").limit(1).collect()
    shards = first[0]["shards"] if first else LEAST_SHARDS
    found = groups(index, winners(rows.filter(~old)), shards).select(
        F.col("digest").alias("_digest"), F.col("doc_id").alias("_keep"), F.col("place").alias("_place"), "n", "known"
    )
    ident = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(found, rows["digest"] == found["_digest"]).select(
        ident("doc_id").alias("doc_id"),
        ident("_keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("_place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "known",
    )
