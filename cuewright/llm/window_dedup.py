"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A polynomial hash of each window comes from prefix sums over the hashes of the words. Hashes go to
buckets, where the smallest document id of each is found; a window whose hash starts in a document
with a smaller id is repeated, and runs of repeated windows merge into maximal removal intervals.

A hash that many documents share is sent once per chunk of texts: inside a chunk only the document
with the smallest id asks, all others are settled on the spot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuewright.llm.common import keyed, pieces, real_id
from cuewright.llm.exchange import PACKED, answered, answers, chunks, mix, packed_rows, read_codes

WINDOW = 50
BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
UNBASE = pow(BASE, -1, 1 << 64)
BUCKET_BYTES = 16 << 20
_codes: dict[bytes, int] = {}


def word_codes(words: list[bytes]) -> np.ndarray:
    """A 64-bit digest of each word; the words of a task are digested once."""
    if len(_codes) > 500_000:
        _codes.clear()
    for w in set(words).difference(_codes):
        _codes[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter((_codes[w] for w in words), np.uint64, len(words))


def rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` codes, modulo 2**64."""
    n = len(codes)
    if n < size:
        return np.empty(0, np.uint64)
    powers = np.full(n, BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
    back = np.full(n - size + 1, UNBASE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mix((sums[size:] - sums[: n - size + 1]) * back)


def window_hashes(text: bytes, size: int) -> tuple[list[bytes], np.ndarray]:
    words = text.split()  # bytes split at exactly 0x20 and 0x09 to 0x0D
    return words, rolling(word_codes(words), size)


def _pack(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for ids, keys, texts in chunks(batches):
        made = [window_hashes(t, size)[1] for t in texts]
        hashes = np.concatenate(made)
        owner = np.repeat(np.arange(len(texts)), [len(m) for m in made])
        order = np.argsort(hashes, kind="stable")  # documents stand by ascending id
        fresh = np.ones(len(order), bool)
        fresh[1:] = hashes[order][1:] != hashes[order][:-1]
        first = np.empty(len(order), np.int64)
        first[order] = ids[owner[order[fresh]]][np.cumsum(fresh) - 1]
        known = ids[owner] > first
        yield packed_rows(ids, keys, hashes[:, None], owner, known.astype(np.uint8), np.empty((0, 1), np.uint64), buckets)


def _smaller_elsewhere(hashes: np.ndarray, ids: np.ndarray, silent: np.ndarray) -> np.ndarray:
    hashes = hashes[:, 0]
    order = np.argsort(hashes)
    if not len(order):
        return np.zeros(0, np.uint8)
    ranked, their = hashes[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    least = np.repeat(np.minimum.reduceat(their, starts), np.diff(np.append(starts, len(order))))
    out = np.empty(len(order), np.uint8)
    out[order] = their > least
    return out


def covered(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Mask of the places inside any window of ``size`` from a marked start."""
    edges = np.zeros(length + 1, np.int64)
    at = np.flatnonzero(starts)
    edges[at] += 1
    np.add.at(edges, np.minimum(at + size, length), -1)
    return np.cumsum(edges[:-1]) > 0


def runs(mask: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal runs of a mask, end excluded."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2)


OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def _cut(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("kept", pa.string()),
        ]
    )
    for batch in batches:
        rows = []
        for ident, text, replies in zip(batch.column(0), batch.column(1), batch.column(2)):
            words, told = text.as_buffer().to_pybytes().split(), replies.as_py()
            spans = np.empty((0, 2), np.int64)
            kept, removed = words, 0
            if told:
                marks = read_codes(told, rolling(word_codes(words), size), buckets)
                gone = covered(marks, size, len(words))
                spans, removed = runs(gone), int(gone.sum())
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            rows.append((ident.as_py(), len(words), removed, [{"start": int(a), "end": int(b)} for a, b in spans], b" ".join(kept).decode("utf-8")))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def remove_repeats(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` of every row of ``docs``.

    Words stand between blanks, tabs and line ends. A word goes when a window of ``size`` words that
    covers it also starts in a document with a smaller id; windows are judged on the input. ``spans``
    are the removal intervals in words, end excluded; ``kept`` is what is left, joined by one space.
    Texts shorter than a window, empty and null ones lose nothing. Rows without id rank after all
    others and do not remove from each other; rows with the same id do not either. Windows agree when
    their 64-bit hashes do (among n windows about n * n / 2**65 false matches are to be expected).
    """
    rows = keyed(docs, id_col, text_col)
    buckets = pieces(rows, BUCKET_BYTES)
    packed = rows.mapInArrow(lambda it: _pack(it, size, buckets), PACKED)
    joined = answered(rows, answers(packed, _smaller_elsewhere, 1, buckets))
    cut = joined.select("doc_id", "text", "replies").mapInArrow(lambda it: _cut(it, size, buckets), OUT)
    return cut.select(real_id(), "n_words", "n_removed", "spans", "kept")
