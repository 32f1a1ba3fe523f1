"""Phrase collocations from suffix subtrees that are built by vertical partitioning.

Every word starts a suffix of its piece, cut to the longest phrase length. A first pass weighs the
prefixes: words, and pairs after a frequent word, that could exceed the memory budget are found from
what is frequent inside a chunk of texts. Suffixes are then grouped by their first word, or by their
first two or three words where the shorter prefix is too heavy, into groups of about the budget. Each group
builds its subtree alone: its suffixes in order, nodes where a prefix of some depth changes, and counts
as differences of running leaf totals. Chunks send each distinct suffix of a group once, with its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import stored
from cuewright.llm.exchange import mix
from cuewright.llm.window_dedup import word_codes
from cuewright.session import ship_package

DEPTH = 3
BUDGET = 2_000_000  # suffixes a group should hold, some 200 MB
LEAST_GROUPS = 64
CHUNK_BYTES = 8 << 20
NO_LANG = "und"
HEAVY = "lang string, first string, second string, f long"
PACKED = "part int, lang string, words binary, wide boolean, ids binary, counts binary"
COUNTS = "lang string, phrase string, k int, f long"

_KIND = np.zeros(256, np.uint8)  # 0 inside a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def segments(text: bytes, most: int = CHUNK_BYTES) -> Iterator[tuple[bytes, int]]:
    """(bytes, owned) of a text: suffixes that start before ``owned`` count; the rest is context of the last ones."""
    at = 0
    while len(text) - at > most:
        kinds = _KIND[np.frombuffer(text, np.uint8)[at + most :]]
        starts = np.flatnonzero((kinds == 0) & (np.concatenate([[1], kinds[:-1]]) > 0))
        starts = starts[starts > 0] if kinds[0] == 0 else starts
        if len(starts) == 0:
            break
        cut = at + most + int(starts[0])
        end = at + most + int(starts[DEPTH]) if len(starts) > DEPTH else len(text)
        yield text[at:end], cut - at
        at = cut
    yield text[at:], len(text) - at


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
    """(lang, segments) of runs of rows with about ``CHUNK_BYTES``."""
    held: dict[str, list[tuple[bytes, int]]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer()
            for part in segments(data.to_pybytes() if data is not None else b""):
                held.setdefault(lang, []).append(part)
                size += len(part[0])
                if size >= CHUNK_BYTES:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def suffixes(parts: list[tuple[bytes, int]]) -> tuple[pa.Array, np.ndarray]:
    """(words, ids): the distinct words of texts, and for each counted word the numbers of it and its followers.

    Numbers count from 1 in ``words``; 0 stands after the end of a piece.
    """
    data = _LOWER[np.frombuffer(b"\n".join([p for p, _ in parts] or [b""]), np.uint8)]
    kinds = _KIND[data]
    inside = kinds == 0
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if len(data) else np.empty(0, np.int64)
    upto = np.cumsum(inside, dtype=np.int32)
    offsets = np.append(upto[starts] - 1, upto[-1:] if len(upto) else [0]).astype(np.int32)
    del upto
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())])
    coded = column.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    piece = np.cumsum(kinds == 2, dtype=np.int32)[starts]
    out = np.zeros((DEPTH, len(ids)), np.int64)
    out[0] = ids
    for d in range(1, DEPTH):
        same = piece[d:] == piece[:-d] if len(ids) > d else np.empty(0, bool)
        out[d, : len(same)] = np.where(same, ids[d:], 0)
    if any(owned < len(p) for p, owned in parts):
        ends = np.cumsum([len(p) + 1 for p, _ in parts])
        which = np.searchsorted(ends, starts, side="right")
        begins = ends - [len(p) + 1 for p, _ in parts]
        out = out[:, starts - begins[which] < np.array([o for _, o in parts])[which]]
    return coded.dictionary, out


def distinct(ids: np.ndarray, size: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(columns in order, counts) of the distinct columns of ``ids``, whose numbers are below ``size``."""
    pair = ids[0] * size + ids[1]
    if size**DEPTH >= 1 << 63:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * size + ids[2]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.empty(0, np.int64)
    if weights is None:
        counts = np.diff(np.append(first, len(ranked)))
    else:
        counts = np.add.reduceat(weights[order], first) if len(first) else np.empty(0, np.int64)
    return ids[:, order[first]], counts


def _weigh(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    for lang, parts in by_language(batches):
        words, ids = suffixes(parts)
        n = ids.shape[1]
        least = max(1, int(share * n))
        ones = np.bincount(ids[0], minlength=len(words) + 1)
        firsts = np.flatnonzero(ones >= least)
        size = len(words) + 1
        follows = np.isin(ids[0], firsts) & (ids[1] > 0)
        pairs, f = np.unique(ids[0][follows] * size + ids[1][follows], return_counts=True)
        pairs, f = pairs[f >= least], f[f >= least]
        first = words.take(pa.array(np.concatenate([firsts, pairs // size]) - 1))
        second = words.take(pa.array(pairs % size - 1))
        none = pa.nulls(len(firsts), pa.binary())
        first = pa.concat_arrays([pa.nulls(1, pa.binary()), first])
        second = pa.concat_arrays([pa.nulls(1, pa.binary()), none, second])
        counts = pa.array(np.concatenate([[n], ones[firsts], f]), pa.int64())
        langs = pa.array([lang] * len(counts), pa.string())
        yield pa.RecordBatch.from_arrays([langs, first.cast(pa.string()), second.cast(pa.string()), counts], names=["lang", "first", "second", "f"])


def _numbers(words: pa.Array, wanted: list[str]) -> np.ndarray:
    """Numbers of wanted words, 0 where a word does not occur."""
    at = pc.index_in(pa.array([w.encode() for w in wanted], pa.binary()), value_set=words)
    return pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _depths(words: pa.Array, ids: np.ndarray, heavy: dict[str, list[tuple[str, str | None]]], lang: str) -> np.ndarray:
    """How many words of each suffix make up the prefix that it is grouped by."""
    depth = np.ones(ids.shape[1], np.int64)
    mine = heavy.get(lang, [])
    single, double = [a for a, b in mine if b is None], [p for p in mine if p[1] is not None]
    if single:
        long = np.isin(ids[0], np.setdiff1d(_numbers(words, single), [0]))
        depth[long] = 2
        if double:
            size = len(words) + 1
            a, b = _numbers(words, [p[0] for p in double]), _numbers(words, [p[1] for p in double])
            found = (a > 0) & (b > 0)
            depth[long & np.isin(ids[0] * size + ids[1], a[found] * size + b[found])] = 3
    return depth


def _pack(batches: Iterator[pa.RecordBatch], heavy: dict[str, list[tuple[str, str | None]]], parts: int) -> Iterator[pa.RecordBatch]:
    for lang, texts in by_language(batches):
        words, ids = suffixes(texts)
        ids, counts = distinct(ids, len(words) + 1)
        if not len(counts):
            continue
        codes = np.concatenate([np.zeros(1, np.uint64), word_codes(words.to_pylist())])
        depth = _depths(words, ids, heavy, lang)
        code = word_codes([b"\n" + lang.encode()])[0] + codes[ids[0]]
        for d in range(1, DEPTH):
            code = np.where(depth > d, mix(code) + codes[ids[d]], code)
        part = (mix(code) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0, [True]]))
        rows: list[tuple] = []
        held = 0
        for a, b in zip(edges[:-1], edges[1:]):
            mine = order[a:b]
            used, local = np.unique(ids[:, mine], return_inverse=True)
            zero = used[0] == 0
            local = local.reshape(DEPTH, -1) + (not zero)
            names = words.take(pa.array(used[1:] - 1 if zero else used - 1))
            wide = len(names) >= 1 << 16
            row = b"\n".join(names.to_pylist()), bool(wide), local.astype(np.uint32 if wide else np.uint16).tobytes(), counts[mine].astype(np.uint32).tobytes()
            rows.append((int(part[mine[0]]), lang, *row))
            held += len(row[0]) + len(row[2])
            if held > 8 << 20:
                yield _packed(rows)
                rows, held = [], 0
        if rows:
            yield _packed(rows)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in PACKED.split(", ")])


def subtree(words: pa.Array, ids: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, first suffix of each node, count of each node) of the tree of weighted suffixes in order."""
    totals = np.concatenate([[0], np.cumsum(weights)])
    new = np.zeros(ids.shape[1], bool)
    new[:1] = True
    for d in range(DEPTH):
        new[1:] |= ids[d, 1:] != ids[d, :-1]
        heads = np.flatnonzero(new)
        counts = totals[np.append(heads[1:], ids.shape[1])] - totals[heads]
        real = ids[d, heads] > 0
        yield d + 1, heads[real], counts[real]


def _grow(table: pa.Table, heavy: dict[str, list[tuple[str, str | None]]], least: int) -> pa.Table:
    """Counts of the phrases of one group; those that other groups share come whatever their count."""
    out = []
    langs = table.column("lang")
    for lang in pc.unique(langs).to_pylist():
        rows = table.filter(pc.equal(langs, lang)).to_pylist()
        lists = [r["words"].split(b"\n") for r in rows]
        coded = pa.array([w for names in lists for w in names], pa.binary()).dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.cumsum([len(names) for names in lists])
        ids = []
        for row, names, end in zip(rows, lists, ends):
            known = np.concatenate([[0], numbers[end - len(names) : end]])
            ids.append(known[np.frombuffer(row["ids"], np.uint32 if row["wide"] else np.uint16).reshape(DEPTH, -1)])
        words, weights = coded.dictionary, np.concatenate([np.frombuffer(r["counts"], np.uint32).astype(np.int64) for r in rows])
        found, weights = distinct(np.concatenate(ids, axis=1), len(words) + 1, weights)
        depths = _depths(words, found, heavy, lang)
        for k, heads, counts in subtree(words, found, weights):
            told = (counts >= least) | (depths[heads] > k)
            heads, counts = heads[told], counts[told]
            picked = [words.take(pa.array(found[d, heads] - 1)) for d in range(k)]
            phrase = pc.binary_join_element_wise(*picked, pa.scalar(b" ", pa.binary())) if k > 1 else picked[0]
            out.append([pa.array([lang] * len(heads), pa.string()), phrase.cast(pa.string()), pa.array([k] * len(heads), pa.int32()), pa.array(counts, pa.int64())])
    names = [c.split()[0] for c in COUNTS.split(", ")]
    return pa.concat_tables([pa.Table.from_arrays(c, names=names) for c in out])


def phrase_counts(docs: DataFrame, least: int, budget: int = BUDGET, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``lang, phrase, k, f`` of the phrases of up to ``DEPTH`` words that occur ``least`` times; ``lang, n``).

    Heavy prefixes reach the driver, at most ``8 * words / budget`` of them: raise ``budget`` with the memory of
    the executors to keep them few. A prefix that holds more than half a budget is always among them: what
    chunks leave unsaid adds up to less than a quarter of it.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    share = budget / 4 / max(1, size // 2 + 1)
    weighed = stored(rows.mapInArrow(lambda it: _weigh(it, share), HEAVY), "prefixes")
    totals = weighed.filter("first IS NULL").groupBy("lang").agg(F.sum("f").alias("n")).filter("n > 0")
    words = totals.agg(F.sum("n")).first()[0] or 0
    over = weighed.filter("first IS NOT NULL").groupBy("lang", "first", "second").agg(F.sum("f").alias("f")).filter(F.col("f") > budget // 4)
    heavy: dict[str, list[tuple[str, str | None]]] = {}
    for r in over.collect():
        heavy.setdefault(r["lang"], []).append((r["first"], r["second"]))
    parts = max(LEAST_GROUPS, -(-2 * words // budget))
    packed = rows.mapInArrow(lambda it: _pack(it, heavy, parts), PACKED)
    grown = packed.groupBy("part").applyInArrow(lambda t: _grow(t, heavy, least), COUNTS)
    counted = grown.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return stored(counted, "phrases"), totals


def _joined(words: Column, first: int, count: int) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def collocations(
    docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50, budget: int = BUDGET, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of two to three words of each language.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at blanks and tabs. ``a`` counts a
    phrase, ``l`` and ``r`` the two parts of the cut that scores least, the first such cut at a tie, and the
    score is ``floor(1000000 * a * a / (l * r))`` in exact arithmetic. Phrases that occur fewer than ``least`` times
    are no candidates; one goes when a longer candidate around it has ``inside`` percent of its count.
    Ranks go by score, count, then phrase in byte order, so they never tie. Null texts count as empty, a
    null language as ``und``; repeated rows count each. Tables without any candidate give an empty
    result, and other columns are not read. Phrases below ``least`` are dropped inside their group; that
    loses nothing, as each part of a candidate is at least as frequent as the candidate.
    """
    counted, totals = phrase_counts(docs, least, budget, lang_col, text_col)
    words = F.split("phrase", " ")
    pick = counted.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))
    cut = lambda n, at: F.array(F.struct(F.lit(at).alias("cut"), F.lit(True).alias("left"), _joined(F.col("w"), 1, at).alias("part")),
                                F.struct(F.lit(at).alias("cut"), F.lit(False).alias("left"), _joined(F.col("w"), at + 1, n - at).alias("part")))
    cuts = F.when(F.col("k") == 2, cut(2, 1)).otherwise(F.concat(cut(3, 1), cut(3, 2)))
    parts = pick.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    sizes = counted.select("lang", F.col("phrase").alias("part"), F.col("f"))
    both = parts.join(sizes, ["lang", "part"]).groupBy("lang", "phrase", "a", "cut")
    whole = both.agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = whole.withColumns({"_top": exact("a") * exact("a") * F.lit(1000000).cast("decimal(7,0)"), "_under": exact("l") * exact("r")})
    scored = scored.withColumn("score", F.expr("_top div _under"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    longer = pick.filter("k = 3").select("lang", "a", F.explode(F.array_distinct(F.array(_joined(F.col("w"), 1, 2), _joined(F.col("w"), 2, 2)))).alias("phrase"))
    around = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    free = weakest.join(around, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * inside))
    ranked = free.select("lang", "phrase", "a", "m.*").selectExpr(
        "lang", "phrase", "a", "l", "r", "score", "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank"
    )
    best = ranked.filter(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
