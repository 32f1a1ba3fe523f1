"""Hashes of many small items, packed by bucket, and answers for each document that sent them.

A map task turns a chunk of texts into one hash array per bucket instead of one row per item, so
Spark shuffles a few hundred binary rows per task. What a bucket finds out about an item goes back
as a two-bit code at the item's place in the sequence its document sent to that bucket; the document is
met again by its (doc_id, key) and recomputes the sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cuewright.llm.common import KEY

CHUNK_BYTES = 6 << 20
SLICE_BYTES = 1 << 20
PACKED = "bucket int, tag long, ids binary, keys binary, counts binary, hashes binary, silent binary, known binary"
REPLIES = "docs int, ids binary, keys binary, tags binary, places binary, sizes binary, codes binary"
ANSWERS = "doc_id long, key long, replies array<struct<tag:bigint,bucket:int,codes:binary>>"


def chunks(batches: Iterable[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, keys, texts as bytes) of runs of rows with about ``most`` bytes, by ascending id inside each."""
    rows: list[tuple[int, int, bytes]] = []
    held = 0
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for ident, key, text in zip(ids, keys, batch.column(2)):
            data = text.as_buffer()
            rows.append((ident, key, data.to_pybytes() if data is not None else b""))
            held += len(rows[-1][2])
            if held >= most:
                yield _columns(rows)
                rows, held = [], 0
    if rows:
        yield _columns(rows)


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in parts whose ``text`` has about ``most`` bytes: only those become Python objects at once."""
    for batch in batches:
        full = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // most
        edges = [0, *(np.flatnonzero(full[1:] > full[:-1]) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def _columns(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    rows.sort(key=lambda r: r[:2])
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper bits of a mixed hash."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(codes: np.ndarray) -> bytes:
    """Codes 0 to 3, two bits each."""
    return np.packbits(np.stack([codes >> 1, codes & 1], axis=1).astype(np.uint8)).tobytes()


def unpack(data: bytes, count: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * count).reshape(-1, 2)
    return bits[:, 0] * 2 + bits[:, 1]


def packed_rows(
    ids: np.ndarray, keys: np.ndarray, hashes: np.ndarray, owner: np.ndarray, known: np.ndarray, silent: np.ndarray, buckets: int
) -> pa.RecordBatch:
    """Rows for one chunk. ``hashes`` (items x columns) with ``owner`` (row in the chunk) stand in document order.

    ``known`` holds the codes of items settled in this chunk, 0 for those that need an answer;
    ``silent`` are hashes that only take part in the decision. Settled codes pass through as bits
    over all items of the document under bucket -1. ``tag`` names the chunk, so that answers to
    repeated rows of other chunks are kept apart.
    """
    tag = int(mix(np.array([ids[0] ^ keys[0], len(ids)], np.int64).view(np.uint64)).view(np.int64).sum()) if len(ids) else 0
    asks = known == 0
    place = bucket_of(hashes[asks][:, 0], buckets)
    order = np.argsort(place, kind="stable")
    asked, who, cuts = hashes[asks][order], owner[asks][order], np.searchsorted(place[order], np.arange(buckets + 1))
    quiet_place = bucket_of(silent[:, 0], buckets)
    quiet_order = np.argsort(quiet_place, kind="stable")
    quiet, quiet_cuts = silent[quiet_order], np.searchsorted(quiet_place[quiet_order], np.arange(buckets + 1))
    out: dict[str, list] = {c.split()[0]: [] for c in PACKED.split(", ")}

    def add(*values) -> None:
        for column, value in zip(out.values(), values):
            column.append(value)

    for b in range(buckets):
        part = who[cuts[b] : cuts[b + 1]]
        extra = quiet[quiet_cuts[b] : quiet_cuts[b + 1]]
        if len(part) or len(extra):
            docs, counts = np.unique(part, return_counts=True)
            sent = asked[cuts[b] : cuts[b + 1]].tobytes()
            add(b, tag, ids[docs].tobytes(), keys[docs].tobytes(), counts.astype(np.int32).tobytes(), sent, extra.tobytes(), None)
    edges = np.searchsorted(owner, np.arange(len(ids) + 1))
    settled = np.concatenate([[0], np.cumsum(known > 0)])
    for d in np.flatnonzero(settled[edges[1:]] > settled[edges[:-1]]):
        codes = pack(known[edges[d] : edges[d + 1]])
        add(int(ids[d] % buckets), tag, ids[d].tobytes(), keys[d].tobytes(), None, None, None, codes)
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def answers(packed: DataFrame, decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], width: int, buckets: int) -> DataFrame:
    """``doc_id, key, replies``: for each document with any answer but 0, its codes of each bucket.

    ``decide(hashes, ids, silent)`` gets all items of a bucket with their document ids, and the
    silent hashes, both with ``width`` columns; it returns a code from 0 to 3 for each item. A bucket
    packs its replies by groups of documents, and each group is unpacked into one row per document.
    """

    def judge(table: pa.Table) -> pa.Table:
        known, tags = table.column("known").to_pylist(), table.column("tag").to_pylist()
        ids = [np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()]
        keys = [np.frombuffer(x, np.int64) for x in table.column("keys").to_pylist()]
        replies: dict[int, list[tuple[int, int, int, int, bytes]]] = {}

        def reply(ident: int, key: int, tag: int, bucket: int, codes: bytes) -> None:
            replies.setdefault(ident % buckets, []).append((ident, key, tag, bucket, codes))

        for i, codes in enumerate(known):
            if codes is not None:
                reply(int(ids[i][0]), int(keys[i][0]), tags[i], -1, codes)
        rows = [i for i, codes in enumerate(known) if codes is None]
        if rows:
            bucket = table.column("bucket")[0].as_py()
            picked = table.take(rows)
            join = lambda name, kind: np.frombuffer(b"".join(picked.column(name).to_pylist()), kind)
            counts = join("counts", np.int32)
            hashes, silent = (join(c, np.uint64).reshape(-1, width) for c in ("hashes", "silent"))
            doc_ids, doc_keys = np.concatenate([ids[i] for i in rows]), np.concatenate([keys[i] for i in rows])
            doc_tags = np.repeat([tags[i] for i in rows], [len(ids[i]) for i in rows])
            codes = decide(hashes, np.repeat(doc_ids, counts), silent)
            ends = np.cumsum(counts)
            total = np.concatenate([[0], np.cumsum(codes > 0)])
            starts = ends - counts
            for d in np.flatnonzero(total[ends] > total[starts]):
                reply(int(doc_ids[d]), int(doc_keys[d]), int(doc_tags[d]), bucket, pack(codes[starts[d] : ends[d]]))
        columns: list[list] = [[] for _ in REPLIES.split(", ")]
        for group, told in replies.items():
            ids, keys, tags, places, codes = zip(*told)
            numbers = (np.array(v, np.int64).tobytes() for v in (ids, keys, tags, places, [len(c) for c in codes]))
            for column, value in zip(columns, [group, *numbers, b"".join(codes)]):
                column.append(value)
        kinds = [pa.int32()] + [pa.binary()] * 6
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in REPLIES.split(", ")])

    def deliver(table: pa.Table) -> pa.Table:
        told: dict[tuple[int, int], dict[tuple[int, int], bytes]] = {}
        for row in table.to_pylist():
            ids, keys, tags, places, sizes = (np.frombuffer(row[c], np.int64) for c in ("ids", "keys", "tags", "places", "sizes"))
            ends = np.cumsum(sizes)
            for ident, key, tag, place, a, b in zip(*(v.tolist() for v in (ids, keys, tags, places, ends - sizes, ends))):
                told.setdefault((ident, key), {})[tag, place] = row["codes"][a:b]
        lists = [[{"tag": t, "bucket": b, "codes": x} for (t, b), x in sorted(r.items())] for r in told.values()]
        kind = pa.list_(pa.struct([("tag", pa.int64()), ("bucket", pa.int32()), ("codes", pa.binary())]))
        arrays = [pa.array([k[0] for k in told], pa.int64()), pa.array([k[1] for k in told], pa.int64()), pa.array(lists, kind)]
        return pa.Table.from_arrays(arrays, names=["doc_id", "key", "replies"])

    return packed.groupBy("bucket").applyInArrow(judge, REPLIES).groupBy("docs").applyInArrow(deliver, ANSWERS)


def answered(docs: DataFrame, replies: DataFrame, how: str = "left") -> DataFrame:
    """``doc_id, key, text, replies``: each document with its answers; repeated rows share theirs.

    ``how="inner"`` leaves out documents without any answer.
    """
    return docs.join(replies, KEY, how).select(*KEY, "text", "replies")


def read_codes(replies: list[dict] | None, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The code of each of a document's items. Where repeated rows got several, the smallest but 0."""
    out = np.zeros(len(hashes), np.uint8)
    by_tag: dict[int, dict[int, bytes]] = {}
    for r in replies or ():
        by_tag.setdefault(r["tag"], {})[r["bucket"]] = r["codes"]
    for told in by_tag.values():
        codes = unpack(told.pop(-1), len(hashes)) if -1 in told else np.zeros(len(hashes), np.uint8)
        sent = np.flatnonzero(codes == 0)
        place = bucket_of(hashes[sent], buckets)
        for b, got in told.items():
            mine = sent[place == b]
            codes[mine] = unpack(got, len(mine))
        out = np.where((out == 0) | ((codes > 0) & (codes < out)), codes, out)
    return out
