"""Suffix, window and near-duplicate operators against plain loops."""

from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest
from plain import sentence

from cuewright.llm import components, near_dup, suffix_dedup, window_dedup
from cuewright.llm.common import keyed


def ids(rows):
    return [(r[0], r[1]) for r in rows]


def test_suffix_awkward(make_docs, awkward):
    got = suffix_dedup.remove_repeats(make_docs(awkward)).collect()
    rows = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got)
    assert rows == Counter(plain.suffix_dedup(ids(awkward)))


def test_suffix_overlap_and_edges(make_docs):
    s = sentence(11, 60)
    rows = [(1, "x" + s[:200] + "y"), (2, "z" + s[:200]), (3, s[:199]), (4, s[1:201] + s[:200]), (5, "ü" * 150 + "ü" * 150), (6, s[:200] * 3)]
    got = suffix_dedup.remove_repeats(make_docs(rows)).collect()
    want = Counter(plain.suffix_dedup(rows))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == want


def test_deep_shallow_sorts_suffixes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[1000:1400] = text[2000:2400]
    starts = np.arange(0, len(text) - 200)
    order, leaf = suffix_dedup.deep_shallow(text, starts, np.zeros(len(starts), np.int64))
    data = text.tobytes()
    suffixes = [data[i : i + 200] for i in starts]
    groups = {}
    for s, one in zip(suffixes, leaf):
        assert groups.setdefault(s, one) == one
    assert len(set(groups.values())) == len(groups)
    assert sorted(order) == list(range(len(starts)))


def test_long_text_crosses_segments():
    data = (sentence(1, 2) * 9000).encode()[: suffix_dedup.SEGMENT // 4] + sentence(9, 3000).encode()
    whole = suffix_dedup.anchors(data)
    old = suffix_dedup.SEGMENT
    try:
        suffix_dedup.SEGMENT = 1000
        parts = suffix_dedup.anchors(data)
    finally:
        suffix_dedup.SEGMENT = old
    spread = lambda f: {p: (a, h) for first, n, a, h in zip(*f) for p in range(first, first + n)}
    assert spread(whole) == spread(parts)


def test_window_awkward(make_docs, awkward):
    got = window_dedup.remove_repeats(make_docs(awkward)).collect()
    rows = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got)
    assert rows == Counter(plain.window_dedup(ids(awkward)))


def test_window_spans_are_maximal(make_docs):
    s = sentence(21, 80)
    rows = [(1, s), (2, "a b " + s + " c " + s)]
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in window_dedup.remove_repeats(make_docs(rows)).collect()}
    assert got == {1: [], 2: [(2, 82), (83, 163)]}


def test_near_awkward(make_docs, awkward):
    got = near_dup.near_duplicates(make_docs(awkward)).collect()
    want = plain.near_duplicates(ids(awkward))
    assert {r["doc_id"]: tuple(r[1:]) for r in got if r["doc_id"] is not None} == want
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2
    assert len(got) == len(awkward)


def test_near_chain_and_group(make_docs):
    base = sentence(31, 200).split()
    rows = [(k, " ".join(w if j % 200 not in (k * 7 % 200, k * 11 % 200) else f"n{k}" for j, w in enumerate(base))) for k in range(1, 60)]
    drift, words = [], sentence(32, 150).split()
    for k in range(12):
        words = [w if j != k * 12 else f"d{k}" for j, w in enumerate(words)]
        drift.append((100 + k, " ".join(words)))
    rows += drift
    got = {r["doc_id"]: tuple(r[1:]) for r in near_dup.near_duplicates(make_docs(rows)).collect()}
    assert got == plain.near_duplicates(rows)


def test_blocks_of_a_large_bundle_lose_no_pair(make_docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3000)
    monkeypatch.setattr(near_dup, "FOLLOWERS", 1000)
    test_near_chain_and_group(make_docs)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (50, 100)]
    got = components.smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 1 for i in range(1, 41)}, 100: 50, 101: 50, 50: 50}


@pytest.mark.parametrize("run", [suffix_dedup.remove_repeats, window_dedup.remove_repeats, near_dup.near_duplicates])
def test_empty_table(make_docs, run):
    assert run(make_docs([(1, "x")]).filter("doc_id < 0")).count() == 0


def test_replies_to_repeated_rows_of_other_chunks(make_docs, monkeypatch):
    """Chunks of one row: equal rows ask in different chunks and still share one right answer."""
    from cuewright.llm import exchange

    monkeypatch.setattr(exchange.chunks, "__defaults__", (1,))
    a, b = sentence(41, 120), sentence(42, 80)
    rows = [(3, a + " " + b), (3, a + " " + b), (2, a), (7, b), (7, b), (9, "z " + a)]
    got = window_dedup.remove_repeats(make_docs(rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == Counter(plain.window_dedup(rows))
    got = suffix_dedup.remove_repeats(make_docs(rows)).collect()
    want = Counter(plain.suffix_dedup(rows))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == want


def test_pair_at_the_threshold(make_docs):
    """A pair at exactly 0.75 is confirmed on full sets, however many symbols of its signatures agree."""
    w = [f"w523x{j}" for j in range(11)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:10], "other"])), (3, sentence(51, 40))]
    got = {r["doc_id"]: tuple(r[1:]) for r in near_dup.near_duplicates(make_docs(rows)).collect()}
    assert got == plain.near_duplicates(rows) and got[2] == (7, 1, False)


def test_rows_of_a_shared_id_are_one_document(make_docs):
    a, b = sentence(71, 60), sentence(72, 60)
    rows = [(1, a), (9, a), (9, b), (12, b), (15, b + " more"), (20, sentence(73, 60)), (9, "")]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(make_docs(rows)).collect())
    assert got == Counter([(1, 1, True), (9, 1, False), (9, 1, False), (12, 1, False), (15, 1, False), (20, 20, True), (9, 9, True)])


def test_hostile_group_links_and_rows(make_docs, spark, monkeypatch):
    """A group far below and around the threshold, more members than a block: the brute-force components, rows by members."""
    rng = np.random.default_rng(8)
    base = sentence(81, 120).split()
    rows = []
    for k in range(150):
        change = set(rng.choice(len(base), int(rng.integers(1, 9)), replace=False).tolist())
        rows.append((k, " ".join(w if j not in change else f"x{k}y{j}" for j, w in enumerate(base))))
    monkeypatch.setattr(near_dup, "BLOCK", 6000)
    got = {r["doc_id"]: tuple(r[1:]) for r in near_dup.near_duplicates(make_docs(rows)).collect()}
    want = plain.near_duplicates(rows)
    assert got == want and 1 < len({v[1] for v in want.values()}) < 150


def test_crowded_anchor_is_not_sorted_in_one_group(make_docs, monkeypatch):
    """A line of 150 bytes with different neighbours, some of which repeat: no group holds more than CROWD stretches."""
    line, tail = sentence(61, 60)[:150], sentence(62, 60)
    rows = [(k, sentence(300 + k, 20) + line + sentence(400 + k, 20)) for k in range(40)]
    rows += [(50, "x " + tail[:90] + line + tail[100:130]), (51, "y " + tail[:90] + line + "z" + tail[140:]), (None, "q" + line + sentence(403, 20))]
    rows += [(60, rows[0][1]), (60, rows[0][1]), (61, rows[0][1][:-1] + "#")]
    monkeypatch.setattr(suffix_dedup, "CROWD", 8)
    _, stretches, crowded = suffix_dedup.judged(keyed(make_docs(rows)), 8)
    groups = stretches.filter("body IS NOT NULL").groupBy("gram").count().collect()
    assert len(crowded) and max(r["count"] for r in groups) <= 8
    got = suffix_dedup.remove_repeats(make_docs(rows)).collect()
    want = Counter(plain.suffix_dedup(rows))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in got) == want


def test_few_texts_of_a_batch_are_objects_at_once():
    """A batch of 8 MB is cut in parts of about a MB, no row lost, and a text above that goes alone."""
    texts = [sentence(k % 7, 150) for k in range(8000)] + ["x" * (3 << 20), "", "y"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "spans": [[]] * len(texts), "key": [0] * len(texts)})
    made = list(suffix_dedup._cut(iter([batch, batch.slice(0, 0)]), False))
    assert [i for b in made for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))
    sizes = [sum(b.column("n_bytes").to_pylist()) for b in made]
    assert len(sizes) > 4 and sorted(sizes)[-2] < 1 << 21 and max(sizes) < 5 << 20


def test_workers_get_bounded_batches_and_give_memory_back(spark, make_docs):
    def seen(batches):
        import os

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes], "limit": [os.environ.get("MALLOC_MMAP_THRESHOLD_")]})

    rows = keyed(spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 3000) AS text"))
    got = rows.mapInArrow(seen, "n long, limit string").collect()
    assert max(r["n"] for r in got) < 8 << 20 and {r["limit"] for r in got} == {"1048576"}
