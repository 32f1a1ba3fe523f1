"""Suffix-array deduplication of exact substrings, by deep-shallow sorting.

Two equal strings of 200 bytes hold the same smallest hash of 96 bytes at the same place. So a
text is cut into stretches of windows that share that place (their anchor), and only stretches whose
anchor occurs more than once in the corpus are sorted: their windows, all suffixes that a repeat can
start with, meet in the task of their anchor. There multikey quicksort orders them to a shallow
depth, and what still agrees is ordered by blind tries: each member of a group is compared once with
the first one, branches off at its first differing word, and members on one branch form the next,
smaller trie. Equal suffixes end in one leaf; a leaf that was reached twice is a repeat.

Equal stretches are merged before they are sorted: of those with one content only the one in the
document with the smallest id travels, with the weight of two, so a passage that many documents
share is sorted once. A string of 96 to 199 bytes, which is too short to go, can be the anchor of very
many different stretches. Where there are more than ``CROWD``, they are not sorted in one task: their
windows are dealt out by their own hashes, which equal windows share, and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import KEY, NO_ID, keyed, pieces, real_id, stored
from cuewright.llm.exchange import PACKED, answered, answers, bucket_of, chunks, mix, packed_rows, read_codes, slices
from cuewright.llm.window_dedup import BASE, UNBASE, runs

LENGTH = 200
GRAM = 96
SEGMENT = 1 << 19
BUCKET_BYTES = 24 << 20
BLOCK = 1 << 19
CROWD = 4096
WORD = 8
SHALLOW = 2
STRETCHES = "bucket int, gram long, place int, many boolean, doc_id long, key long, start long, body binary, spans binary"
SPANS = "doc_id long, key long, spans binary"
WINDOWS = "window long, weight int, doc_id long, key long, start long"


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, number of windows, anchor place, anchor hash) of all stretches of a text."""
    found = [[], [], [], []]
    for base in range(0, len(data) - LENGTH + 1, SEGMENT):
        x = np.frombuffer(data, np.uint8, min(SEGMENT + LENGTH - 1, len(data) - base), base)
        n = len(x)
        codes = mix(x.astype(np.uint64) + np.uint64(1))
        powers = np.full(n, BASE, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
        back = np.full(n - GRAM + 1, UNBASE, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        grams = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * back)
        # Smallest of each window: the upper 44 bits rank the hashes, the place breaks ties to the left.
        low = (grams >> np.uint64(20) << np.uint64(20)) | np.arange(len(grams), dtype=np.uint64)
        span, have = LENGTH - GRAM + 1, 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
        place = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found[0].append(first + base)
        found[1].append(np.diff(np.append(first, len(place))))
        found[2].append(place[first] + base)
        found[3].append(grams[place[first]])
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate(f) if f else np.empty(0, k) for f, k in zip(found, kinds))


ALONE, FIRST, AGAIN = 1, 2, 3  # of stretches with a repeated anchor: the only one, the first, another of its content


def contents(data: bytes, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each stretch."""
    ends = (first + count + LENGTH - 1).tolist()
    made = (hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), ends))
    return np.frombuffer(b"".join(made), np.uint64)


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for ids, keys, texts in chunks(batches):
        items = []
        for data in texts:
            first, count, _, grams = anchors(data)
            items.append(np.stack([grams, contents(data, first, count)], axis=1))
        again = np.concatenate([[False], (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1])])  # repeated rows ask once
        owner = np.repeat(np.arange(len(texts)), [len(m) for m in items])
        pairs = np.concatenate(items)
        asking = ~again[owner]
        own, owner = pairs[asking], owner[asking]
        _, lead, back, counts = np.unique(own, axis=0, return_index=True, return_inverse=True, return_counts=True)
        known = np.where(lead[back.ravel()] == np.arange(len(own)), 0, AGAIN).astype(np.uint8)
        silent = np.concatenate([own[lead[counts > 1]], np.unique(pairs[~asking], axis=0)])
        yield packed_rows(ids, keys, own, owner, known, silent, buckets)


def _roles(pairs: np.ndarray, ids: np.ndarray, silent: np.ndarray) -> np.ndarray:
    every = np.concatenate([pairs, silent])
    order = np.lexsort((np.concatenate([ids, np.full(len(silent), NO_ID)]), every[:, 1], every[:, 0]))
    ranked = every[order]
    new_gram = np.concatenate([[True], ranked[1:, 0] != ranked[:-1, 0]])[: len(order)]
    new_pair = new_gram | np.concatenate([[True], ranked[1:, 1] != ranked[:-1, 1]])[: len(order)]

    def group_sizes(fresh: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(fresh)
        return np.repeat(np.diff(np.append(starts, len(fresh))), np.diff(np.append(starts, len(fresh))))

    of_gram, of_pair = group_sizes(new_gram), group_sizes(new_pair)
    who = np.concatenate([ids, np.full(len(silent), NO_ID)])[order]
    least = who[np.maximum.accumulate(np.where(new_pair, np.arange(len(order)), 0))]
    code = np.where(of_pair > 1, np.where(who == least, FIRST, AGAIN), np.where(of_gram > 1, ALONE, 0))
    out = np.empty(len(order), np.uint8)
    out[order] = code
    return out[: len(pairs)]


def _sent(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple]:
    """(doc_id, key, bytes, stretches as in ``anchors``, their codes) of each row."""
    for ident, key, text, replies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
        data = text.as_buffer().to_pybytes()
        found = anchors(data)
        yield ident, key, data, found, read_codes(replies, found[3], buckets)


def _anchored(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """How many stretches of a batch are to be sorted around each anchor."""
    for batch in slices(batches):
        grams = [found[3][(codes == ALONE) | (codes == FIRST)] for *_, found, codes in _sent(batch, buckets)]
        values, counts = np.unique(np.concatenate(grams) if grams else np.empty(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["gram", "n"])


def _windows(batches: Iterator[pa.RecordBatch], buckets: int, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows around crowded anchors; those of a repeated stretch weigh two."""
    for batch in slices(batches):
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in WINDOWS.split(", ")]
        for ident, key, data, (first, count, _, grams), codes in _sent(batch, buckets):
            for s in np.flatnonzero(((codes == ALONE) | (codes == FIRST)) & np.isin(grams, crowded)).tolist():
                starts = np.arange(first[s], first[s] + count[s])
                hashes = contents(data, starts, np.ones(len(starts), np.int64)).view(np.int64)
                for column, value in zip(out, (hashes, 2 if codes[s] == FIRST else 1, ident, key, starts)):
                    column.append(np.broadcast_to(np.asarray(value, np.int64), len(starts)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(np.concatenate(c)).cast(k) for c, k in zip(out, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in WINDOWS.split(", ")])


def _window_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [np.array([a, a + LENGTH], np.int64).tobytes() for a in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.binary())], names=["doc_id", "key", "spans"])


def _stretches(batches: Iterator[pa.RecordBatch], buckets: int, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stretches to sort, and spans that are settled because their stretch occurs again."""
    columns = [c.split()[0] for c in STRETCHES.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in slices(batches):
        out: list[list] = [[] for _ in columns]
        for ident, key, data, (first, count, place, grams), codes in _sent(batch, buckets):
            sent = np.flatnonzero(((codes == ALONE) | (codes == FIRST)) & ~np.isin(grams, crowded))
            rows = list(zip(bucket_of(grams[sent], buckets).tolist(), grams[sent].view(np.int64).tolist(), (place - first)[sent].tolist()))
            for (b, g, p), a, n, code in zip(rows, first[sent].tolist(), count[sent].tolist(), codes[sent].tolist()):
                row = (b, g, p, code == FIRST, ident, key, a, data[a : a + n + LENGTH - 1], None)
                for column, value in zip(out, row):
                    column.append(value)
            twice = codes >= FIRST
            if twice.any():
                spans = _joined(np.stack([first[twice], (first + count)[twice] + LENGTH - 1], axis=1))
                for column, value in zip(out, (ident % buckets, 0, 0, False, ident, key, 0, None, spans.tobytes())):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=columns)


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) with touching ones merged, as one int64 array of pairs."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(spans) - 1)
    return np.stack([spans[fresh, 0], reach[last]], axis=1)


def deep_shallow(text: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes by (group, first ``length`` bytes): (order, leaf of each suffix).

    ``length`` is a multiple of 8 and every suffix has that many bytes. Equal suffixes of a group
    share a leaf; leaves are numbered in no particular order.
    """
    words = np.ndarray((len(text) - WORD + 1,), ">u8", text, strides=(1,))
    depth = length // WORD
    # Shallow: three-way partitions by group and the first words, one multikey pass per word.
    keys = [words[starts + WORD * d] for d in range(min(SHALLOW, depth))]
    order = np.lexsort((*reversed(keys), group))
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for k in (group, *keys):
        ranked = k[order]
        changed[1:] |= ranked[1:] != ranked[:-1]
    leaf = np.full(len(starts), -1, np.int64)
    rows, head = order, np.maximum.accumulate(np.where(changed, np.arange(len(order)), 0))
    # Deep: one level of all blind tries per round.
    leaves = 0
    while len(rows):
        pivots = rows[head]
        split = np.full(len(rows), depth, np.int64)
        branch = np.zeros(len(rows), np.uint64)
        alive = np.flatnonzero(pivots != rows)
        for d in range(min(SHALLOW, depth), depth):
            if not len(alive):
                break
            mine, theirs = words[starts[rows[alive]] + WORD * d], words[starts[pivots[alive]] + WORD * d]
            off = mine != theirs
            split[alive[off]], branch[alive[off]] = d, mine[off]
            alive = alive[~off]
        same = split == depth
        opened = np.cumsum(np.arange(len(rows)) == head) - 1
        leaf[rows[same]] = leaves + opened[same]
        leaves += int(opened[-1]) + 1
        rest = np.flatnonzero(~same)
        if not len(rest):
            break
        at = np.lexsort((branch[rest], split[rest], head[rest]))
        rest = rest[at]
        new = np.ones(len(rest), bool)
        new[1:] = (head[rest][1:] != head[rest][:-1]) | (split[rest][1:] != split[rest][:-1]) | (branch[rest][1:] != branch[rest][:-1])
        rows = rows[rest]
        head = np.maximum.accumulate(np.where(new, np.arange(len(rest)), 0))
    return order, leaf


def _repeated(bodies: list[bytes], gram: np.ndarray, place: np.ndarray, many: np.ndarray) -> list[np.ndarray]:
    """For each stretch of one block, which of its windows occur again in the block."""
    text = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    counts = sizes - LENGTH + 1
    which = np.repeat(np.arange(len(bodies)), counts)
    step = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(sizes) - sizes)[which] + step
    _, rank = np.unique(gram, return_inverse=True)
    group = rank[which] * LENGTH + (place[which] - step)  # equal windows have their anchor at one place
    _, leaf = deep_shallow(text, starts, group)
    weight = np.bincount(leaf, weights=np.where(many[which], 2, 1))
    return np.split(weight[leaf] > 1, np.cumsum(counts)[:-1])


def _sorted(table: pa.Table) -> pa.Table:
    out_id, out_key, out_spans = [], [], []
    ids, keys, spans = (table.column(c).to_pylist() for c in ("doc_id", "key", "spans"))
    for i, s in enumerate(spans):
        if s is not None:
            out_id.append(ids[i]), out_key.append(keys[i]), out_spans.append(s)
    rows = np.array([i for i, s in enumerate(spans) if s is None], np.int64)
    if len(rows):
        grams, places, many, begin = (table.column(c).to_numpy() for c in ("gram", "place", "many", "start"))
        body = table.column("body")
        rows = rows[np.argsort(grams[rows], kind="stable")]
        block: list[int] = []
        held = 0

        def flush() -> None:
            texts = [body[i].as_py() for i in block]
            at = np.array(block)
            marks = _repeated(texts, grams[at], places[at], many[at])
            for i, mask in zip(block, marks):
                if not many[i] and mask.any():
                    found = runs(mask) + begin[i]
                    found[:, 1] += LENGTH - 1
                    out_id.append(ids[i]), out_key.append(keys[i]), out_spans.append(_joined(found).tobytes())

        for i in rows.tolist():
            if held > BLOCK and grams[i] != grams[block[-1]]:
                flush()
                block, held = [], 0
            block.append(i)
            held += len(body[i].as_buffer()) - LENGTH + 1
        flush()
    arrays = [pa.array(out_id, pa.int64()), pa.array(out_key, pa.int64()), pa.array(out_spans, pa.binary())]
    return pa.Table.from_arrays(arrays, names=["doc_id", "key", "spans"])


OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, key long"
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.binary()),
        ("key", pa.int64()),
    ]
)


def _cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for ident, text, told, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            data = text.as_buffer().to_pybytes()
            spans = _joined(np.frombuffer(b"".join(told), np.int64).reshape(-1, 2)) if told else np.empty((0, 2), np.int64)
            edges = [0, *spans.ravel().tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            removed = len(data) - len(kept)
            if whole:
                kept = kept.decode("utf-8", "ignore").encode()
            rows.append((ident, len(data), removed, [{"start": a, "end": b} for a, b in spans.tolist()], kept, key))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def judged(rows: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(rows with the answers about their stretches, stretches to sort and settled spans, crowded anchors)."""
    packed = rows.mapInArrow(lambda it: _ask(it, buckets), PACKED)
    marked = answered(rows, stored(answers(packed, _roles, 2, buckets), "replies"), "inner")
    around = marked.mapInArrow(lambda it: _anchored(it, buckets), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    crowded = np.array([r["gram"] for r in around.filter(F.col("n") > CROWD).collect()], np.int64).view(np.uint64)
    return marked, marked.mapInArrow(lambda it: _stretches(it, buckets, crowded), STRETCHES), crowded


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``doc_id, key, spans`` of keyed rows: pairs of byte offsets, possibly several rows a document."""
    buckets = pieces(rows, BUCKET_BYTES)
    marked, stretches, crowded = judged(rows, buckets)
    spans = stretches.groupBy("bucket").applyInArrow(_sorted, SPANS)
    if not len(crowded):
        return spans
    counted = stored(marked.mapInArrow(lambda it: _windows(it, buckets, crowded), WINDOWS), "crowded")
    twice = counted.groupBy("window").agg(F.sum("weight").alias("total")).filter("total > 1").select("window")
    again = counted.filter("weight = 1").join(twice, "window").select("doc_id", "key", "start")
    return spans.unionByName(again.mapInArrow(_window_spans, SPANS))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False, whole: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of every row of ``docs``.

    Every byte goes that lies in a string of 200 bytes which also starts anywhere else, in the same
    text or another; overlapping places count and strings are judged on the input. ``spans`` are the
    maximal removed runs as byte offsets, end excluded, ``kept`` the remaining bytes. Null and empty
    texts, and texts under 200 bytes, lose nothing. Repeated rows count as separate texts and so
    remove each other. ``with_key`` adds the row's ``key``, the hash of its text. ``whole`` takes out of
    ``kept``, but does not count, what is left of a character that was cut through.
    """
    rows = keyed(docs, id_col, text_col)
    found = repeated_spans(rows).groupBy(*KEY).agg(F.collect_list("spans").alias("spans"))
    joined = rows.join(found, KEY, "left").select("doc_id", "text", "spans", "key")
    cut = joined.mapInArrow(lambda it: _cut(it, whole), OUT)
    return cut.select(real_id(), "n_bytes", "n_removed", "spans", "kept", *["key"] * with_key)
