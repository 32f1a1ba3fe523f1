"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature has 64 symbols of 16 bits, cut into 16 chunks of 4. Two signatures that differ in at most
31 symbols have, by the pigeonhole principle, a chunk with at most one wrong symbol; so each chunk is
indexed once per symbol that may be wrong, under the other three, and every pair within the
threshold meets under a key. At a similarity of 0.75 a pair differs in 16 symbols on average and in
more than 31 with a chance near 1e-5; that all chunks have two wrong symbols has a chance of 5e-10.

Texts with equal shingle sets are one class, and only classes are compared. Members of a key are
first linked to one leader each. Keys with the same leader then make a bundle, in which a member and
its shingle set stand once, however many keys it has there. Bundles that still span components are
searched in tasks of bounded size: every pair that meets under a key is compared on full sets there,
nothing is screened out but by set sizes, and only links that join two components leave the task. So
rows follow the members, not the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import KEY, NO_ID, keyed, real_id, stored
from cuewright.llm.components import smallest_reachable
from cuewright.llm.exchange import mix
from cuewright.llm.window_dedup import rolling
from cuewright.session import small_side

SHINGLE = 5
SYMBOLS = 64
CHUNK = 4
BLOCK = 1 << 20  # shingles that a block of members may hold in expectation; a task holds two blocks
FOLLOWERS = 1 << 20  # shingles of members compared with one copy of their leader's set
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(0, 1 << 31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint32)
OTHERS = np.array([[c for c in range(CHUNK) if c != skip] for skip in range(CHUNK)])
PLACES = np.arange(SYMBOLS, dtype=np.uint64).reshape(-1, CHUNK) << np.uint64(48)


class _Codes(dict):
    """64-bit digests of words, each made when it is first met."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_codes = _Codes()


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; one for a shorter text, none without words."""
    words = text.lower().split()  # of bytes: A-Z only
    if not words:
        return np.empty(0, np.uint64)
    if len(_codes) > 500_000:
        _codes.clear()
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    return np.unique(rolling(codes, min(size, len(codes))))


def minima(items: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a set, mixed, as symbols of 16 bits."""
    short = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(items), 1024):
        low = np.minimum(low, (FACTORS[:, None] * short[at : at + 1024] + SHIFTS[:, None]).min(axis=1))
    return mix(low.astype(np.uint64)).astype(np.uint16)


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """One exact key per chunk and symbol left out: 6 bits of place, then three 16-bit symbols."""
    a, b, c = np.moveaxis(symbols.astype(np.uint64).reshape(-1, CHUNK)[:, OTHERS], 2, 0)
    return (PLACES | a << np.uint64(32) | b << np.uint64(16) | c).ravel().view(np.int64)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


SIGNED = "doc_id long, key long, n_shingles long, node long, keys array<long>, symbols binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, keys, symbols = [], [], [], []
        for text in batch.column(2):
            items = shingles(text.as_buffer().to_pybytes())
            sizes.append(len(items))
            if len(items):
                low = minima(items)
                nodes.append(int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True))
                keys.append(chunk_keys(low))
                symbols.append(low.tobytes())
            else:
                nodes.append(None), keys.append(None), symbols.append(None)
        arrays = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(symbols, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=_names(SIGNED))
    _codes.clear()  # the worker stays


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = pa.array([shingles(t.as_buffer().to_pybytes()).tobytes() for t in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["node", "items"])
    _codes.clear()


def full_sets(nodes: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """``node, items`` of the classes in ``nodes``, made again from the text of one document each."""
    chosen = small_side(stored(nodes.distinct().join(reps.select("node", *KEY), "node"), "needed"))
    texts = rows.join(chosen, KEY).select("node", "text")
    return stored(texts.mapInArrow(_sets, "node long, items binary").dropDuplicates(["node"]), "sets")


LINKS = "a long, b long"


def _links(a: list[int], b: list[int]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=_names(LINKS))


class Overlaps:
    """The shingle sets of one task, with small codes for their items."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in column]
        self.sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
        items, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes = np.split(codes, np.cumsum(self.sizes)[:-1])
        self.marks = np.zeros(len(items), bool)

    def similar(self, one: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` with ``100 * intersection >= 75 * union``."""
        others = others[100 * np.minimum(self.sizes[others], self.sizes[one]) >= 75 * np.maximum(self.sizes[others], self.sizes[one])]
        if not len(others):
            return others
        self.marks[self.codes[one]] = True
        hits = self.marks[np.concatenate([self.codes[o] for o in others])].astype(np.int64)
        self.marks[self.codes[one]] = False
        both = np.add.reduceat(hits, np.cumsum(self.sizes[others]) - self.sizes[others])
        return others[100 * both >= 75 * (self.sizes[others] + self.sizes[one] - both)]


def shared_entries(reps: DataFrame) -> DataFrame:
    """``k, node, n`` of the keys that n > 1 classes share."""
    entries = reps.select("node", F.explode("keys").alias("k"))
    sizes = entries.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return entries.join(sizes, "k")


def with_leaders(entries: DataFrame) -> DataFrame:
    """``k, node, leader``: the leader of a key is the member that meets most others under all its keys.

    That is the text that the others were made from, where it is there.
    """
    met = entries.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = entries.join(met, "node").groupBy("k").agg(F.max(F.struct("met", "node")).alias("m")).select("k", F.col("m.node").alias("leader"))
    return entries.join(leaders, "k").select("k", "node", "leader")


def _follow(table: pa.Table) -> pa.Table:
    nodes, leader = table.column("node").to_pylist(), table.column("leader")[0].as_py()
    one = nodes.index(leader)
    near = Overlaps(table.column("items")).similar(one, np.array([i for i in range(len(nodes)) if i != one], np.int64))
    return _links([leader] * len(near), [nodes[i] for i in near])


def leader_links(led: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Confirmed links of members with the leader each shares most keys with.

    The followers of one leader are dealt over parts, each of which gets a copy of the leader's set.
    """
    shared = led.filter("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("node").agg(F.max(F.struct("n", "leader")).alias("m")).select("node", F.col("m.leader").alias("leader"))
    sizes = reps.select("node", "n_shingles")
    sized = best.join(sizes, "node").join(sizes.select(F.col("node").alias("leader"), F.col("n_shingles").alias("theirs")), "leader")
    sized = stored(sized.filter("100 * least(n_shingles, theirs) >= 75 * greatest(n_shingles, theirs)"), "followers")
    parts = sized.groupBy("leader").agg(F.ceil(F.sum("n_shingles") / FOLLOWERS).cast("int").alias("parts"))
    followers = sized.join(parts, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    filled = followers.select("leader", "part").distinct().select(F.col("leader").alias("node"), "leader", "part")
    sets = full_sets(sized.select(F.explode(F.array("node", "leader")).alias("node")), rows, reps)
    return followers.unionByName(filled).join(sets, "node").groupBy("leader", "part").applyInArrow(_follow, LINKS)


def with_component(df: DataFrame, components: DataFrame, name: str) -> DataFrame:
    now = components.select("node", F.col("component").alias(name))
    return df.join(now, "node", "left").withColumn(name, F.coalesce(name, "node"))


def bundles(led: DataFrame, components: DataFrame, reps: DataFrame) -> DataFrame:
    """``leader, u, v, block, node, home``: the members of bundles that span components, by pairs of blocks.

    The heaviest component of a bundle needs no comparison within itself: its members are dealt to
    blocks of their own, and only the blocks of the others are paired with all blocks. A bundle that
    fits one block stays one group.
    """
    members = led.select("leader", "node").distinct().join(reps.select("node", "n_shingles"), "node")
    members = with_component(members, components, "home").withColumn("weight", F.col("n_shingles") + SYMBOLS)
    homes = members.groupBy("leader", "home").agg(F.sum("weight").alias("w"))
    heavy = F.max(F.struct("w", "home")).alias("top")
    spans = homes.groupBy("leader").agg(heavy, F.sum("w").alias("all"), F.count(F.lit(1)).alias("homes")).filter("homes > 1")
    whole = F.col("all") <= BLOCK
    spans = spans.select(
        "leader",
        F.col("top.home").alias("main"),
        F.when(whole, 1).otherwise(F.ceil((F.col("all") - F.col("top.w")) / BLOCK)).cast("int").alias("rest"),
        F.when(whole, 0).otherwise(F.ceil(F.col("top.w") / BLOCK)).cast("int").alias("mains"),
    )
    dealt = members.join(spans, "leader")
    draw, in_main = F.xxhash64("node"), (F.col("home") == F.col("main")) & (F.col("mains") > 0)
    block = F.when(in_main, F.col("rest") + F.pmod(draw, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(draw, "rest")).cast("int")
    peers = F.sequence(F.lit(0), F.when(in_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)
    paired = dealt.select("leader", "node", "home", block.alias("block"), F.explode(peers).alias("peer"))
    return paired.select("leader", F.least("block", "peer").alias("u"), F.greatest("block", "peer").alias("v"), "block", "node", "home")


def _meet(symbols: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` that share a key with ``one``: a chunk with at most one wrong symbol."""
    same = (symbols[others] == symbols[one]).view(np.uint32)  # the four symbols of a chunk, a byte each
    equal = (same * np.uint32(0x01010101)) >> np.uint32(24)
    return others[(equal >= CHUNK - 1).any(axis=1)]


def _search(table: pa.Table) -> pa.Table:
    """Links that join two components, among the pairs of one or of two blocks that meet under a key."""
    nodes, home, block = (table.column(c).to_numpy() for c in ("node", "home", "block"))
    within = table.column("u")[0].as_py() == table.column("v")[0].as_py()
    first = table.column("u")[0].as_py()
    symbols = np.frombuffer(b"".join(table.column("symbols").to_pylist()), np.uint16).reshape(len(nodes), -1)
    seekers = np.arange(len(nodes)) if within else np.flatnonzero(block == first)
    sought = seekers if within else np.flatnonzero(block != first)
    if not len(seekers) or not len(sought):
        return _links([], [])
    sets, now, a, b = Overlaps(table.column("items")), home.copy(), [], []
    for i in seekers:
        others = sought[now[sought] != now[i]]
        if within:
            others = others[others > i]
        for j in sets.similar(i, _meet(symbols, i, others)) if len(others) else ():
            if now[j] != now[i]:
                now[now == now[j]] = now[i]
                a.append(int(nodes[i])), b.append(int(nodes[j]))
    return _links(a, b)


def shared_ids(usable: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id but not a set: they are one document."""
    rows = usable.select("doc_id", "node")
    spread = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
    return rows.join(spread, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def components(rows: DataFrame, signed: DataFrame, by_id: bool = True) -> DataFrame:
    """``node, component_id``: the smallest document id that the members of a class can reach, over shared ids too where ``by_id``."""
    usable = signed.filter(f"node IS NOT NULL AND doc_id <> {NO_ID}")
    first = F.min(F.struct("doc_id", "key", "n_shingles", "keys", "symbols")).alias("m")
    picked = usable.groupBy("node").agg(first).select("node", "m.doc_id", "m.key", "m.n_shingles", "m.keys", "m.symbols")
    reps = stored(picked, "classes")
    led = stored(with_leaders(stored(shared_entries(reps), "entries")), "led")
    known = leader_links(led, rows, reps)
    links = stored(known.unionByName(shared_ids(usable)) if by_id else known, "links")
    paired = stored(bundles(led, smallest_reachable(links), reps), "bundles")
    sets = full_sets(paired.select("node"), rows, reps).join(reps.select("node", "symbols"), "node")
    found = paired.join(sets, "node").groupBy("leader", "u", "v").applyInArrow(_search, LINKS)
    reached = with_component(reps.select("node", "doc_id"), smallest_reachable(links.unionByName(stored(found, "links"))), "component")
    smallest = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return reached.join(smallest, "component").select("node", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False, by_id: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Words are lower-cased (A-Z) and stand between blanks, tabs and line ends; a document's set holds
    its distinct 5-word shingles, or its whole word sequence when it has fewer words. Documents with
    a similarity of 0.75 or more are linked; ``component_id`` is the smallest id that can be reached
    over links and ``kept`` marks the document that bears it. Null, empty and wordless texts have an
    empty set and stay alone. Rows without id are not linked: no component, kept. Rows that share an
    id count as one document, so the sets of all of them share a component; without ``by_id`` each of
    their texts is linked and kept by itself. ``with_key`` adds the row's ``key``, the hash of its text.
    """
    rows = keyed(docs, id_col, text_col)
    signed = stored(rows.mapInArrow(_sign, SIGNED), "signatures")
    joined = signed.select(*KEY, "n_shingles", "node").join(components(rows, signed, by_id), "node", "left")
    component: Column = F.when(F.col("doc_id") != NO_ID, F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return joined.select(real_id(), "n_shingles", component.alias("component_id"), kept.alias("kept"), *["key"] * with_key)
