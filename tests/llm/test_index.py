"""Exact copies, phrase counts and centroids against plain loops."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from plain import sentence
from pyspark.sql import functions as F

from cuewright.llm import centroid_clustering, collocations, exact_dedup

BLANKS = {c: None for c in (0x20, *range(0x09, 0x0E))}


def copies(rows):
    """(doc_id, keep_id, group_size, text hash) and how many rows of each group stay."""
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(BLANKS)].append((-len(t or ""), math.inf if i is None else i))
    out = []
    for i, t, *_ in rows:
        same = (t or "").translate(BLANKS)
        best = min(groups[same])[1]
        out.append((i, None if best == math.inf else best, len(groups[same]), plain.sha(same.encode())))
    return Counter(out), len(groups)


@pytest.mark.parametrize("historical", [None, "true", "false", "doc_id % 2 = 0"])
def test_copies_awkward(make_docs, awkward, historical):
    rows = awkward + [(20, " a b ", "en", "s"), (21, "ab", "en", "s"), (22, "a  b  ", "en", "s"), (22, "a  b  ", "en", "s"), (19, "a b\t\t\n\n", "en", "s")]
    got = exact_dedup.deduplicate(make_docs(rows), historical and F.expr(historical)).collect()
    want, groups = copies(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_copies_known_marks_history(make_docs):
    rows = [(1, "a"), (2, "b"), (8, "a "), (9, "c")]
    got = exact_dedup.deduplicate(make_docs(rows), F.col("doc_id") < 5).collect()
    assert {r["doc_id"]: (r["keep_id"], r["kept"], r["known"]) for r in got} == {1: (8, False, True), 2: (2, True, True), 8: (8, True, True), 9: (9, True, False)}


def test_copies_empty(make_docs):
    assert exact_dedup.deduplicate(make_docs([])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 63, 5000])
def test_perfect_hash_has_no_gaps(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    levels, slots = exact_dedup.perfect_hash(digests)
    assert sorted(slots) == list(range(n))
    assert (exact_dedup.slots_of(levels, digests) == slots).all()
    strangers = np.frombuffer(b"".join(hashlib.sha256(b"x%d" % i).digest() for i in range(200)), np.uint8).reshape(-1, 32)
    assert (exact_dedup.slots_of(levels, strangers) < n).all()


def phrases(rows, least=10, top=2000, inside=50):
    counts, words = defaultdict(Counter), Counter()
    for _, t, lang, *_ in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\0")
        for piece in low.split("\0"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            words[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p for q, a in cand.items() if len(q) == 3 for p in (q[:2], q[1:]) if p in cand and 100 * a >= inside * cand[p]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.fixture()
def phrase_rows(awkward):
    common = "the cat sat on the mat. The CAT\tsat, on the mat; new york city! new york\x0bnew york city is new york "
    return awkward + [(100 + i, common * (1 + i % 3), ("en", None, "de")[i % 3], "s") for i in range(12)] + [(200, "the the " * 40, "en", "s")]


@pytest.mark.parametrize("budget", [collocations.BUDGET, 400, 40])
def test_phrases_for_every_budget(make_docs, phrase_rows, budget):
    got = collocations.collocations(make_docs(phrase_rows), budget=budget).collect()
    assert sorted(tuple(r) for r in got) == phrases(phrase_rows)


def test_phrases_top_and_ties(make_docs, phrase_rows):
    got = collocations.collocations(make_docs(phrase_rows), least=3, top=4).collect()
    assert sorted(tuple(r) for r in got) == phrases(phrase_rows, least=3, top=4)


def test_phrases_nothing(make_docs):
    assert collocations.collocations(make_docs([])).collect() == []
    assert collocations.collocations(make_docs([(1, None, None, None), (2, "one two", "en", "s")])).collect() == []


def test_long_text_in_segments():
    text = (sentence(3, 200) + ", " + sentence(4, 3) + "\t. ") * 5
    whole = collocations.suffixes([(text.encode(), len(text))])
    cut = list(collocations.segments(text.encode(), 150))
    assert len(cut) > 5
    parts = collocations.suffixes(cut)

    def said(found):
        names = [None, *found[0].to_pylist()]
        return Counter(tuple(names[i] for i in column) for column in found[1].T)

    assert said(parts) == said(whole)


def centroids(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in ranked[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[near(v)[1]].append(v)
        c = [[sum(x) // len(mine[n]) for x in zip(*mine[n])] if mine[n] else x for n, x in enumerate(c)]
    found = [(i, *near(v)) for i, v in kept]
    total = Counter()
    for _, d, n in found:
        total[n] += d
    return Counter((i, n, d, total[n], sum(total.values()), plain.sha(",".join(map(str, c[n])).encode())) for i, d, n in found)


VECTORS = "vec_id long, embedding array<double>, label int, v string, near string, number int, distance string"


@pytest.mark.parametrize("k", [1, 4, 50])
def test_centroids(spark, k):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    rows += [(40, rows[0][1]), (40, rows[1][1]), (41, rows[0][1]), (41, rows[0][1]), (None, rows[2][1]), (50, None), (51, []), (52, [1.0] * 5)]
    rows += [(53, [1.0, None, 1.0, 1.0]), (54, [1.0, math.nan, 1.0, 1.0]), (55, [math.inf, 0.0, 0.0, 0.0]), (56, [-0.001, 0.0, -3.0, 2.5])]
    table = spark.createDataFrame([(*r, 1, "v", "n", 2, "d") for r in rows], VECTORS)
    got = centroid_clustering.cluster(table, k=k, rounds=3, size=4).drop("centroid").collect()
    assert Counter(tuple(r) for r in got) == centroids(rows, k, 3, 4)


def test_centroids_none(spark):
    assert centroid_clustering.cluster(spark.createDataFrame([], VECTORS), size=4).collect() == []
    only = spark.createDataFrame([(1, [1.0], 1, "", "", 1, "")], VECTORS)
    assert centroid_clustering.cluster(only, size=4).collect() == []
