"""Sliced scans and chunked groupings give what a single pass gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.operators import ordered
from cuewright.operators.asof import asof
from cuewright.operators.corpus import fill_batches
from cuewright.operators.greedy import greedy_groups
from cuewright.operators.rollups import exact_median


def hot_rows(n=400, seed=3):
    """A key with most of the rows, ties in the order column, nulls in the values."""
    rnd = random.Random(seed)
    return [
        (rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.randint(0, 60), i, rnd.choice([None, rnd.randint(-50, 50)]))
        for i in range(n)
    ]


def steps():
    return [
        ordered.row_number("rn"),
        ordered.running_sum("s", F.col("v")),
        ordered.sum_before("sb", F.col("v")),
        ordered.running_max("m", F.col("v")),
        ordered.max_before("mb", F.col("v")),
        ordered.previous("p", F.col("v")),
        ordered.following("f", F.col("v")),
        ordered.last_known("lk", F.col("v")),
        ordered.next_known("nk", F.col("v")),
    ]


@pytest.mark.parametrize("keys", [["k"], []])
def test_sliced_scan_equals_plain_window(spark, keys):
    df = spark.createDataFrame(hot_rows(), "k string, t int, i int, v int")
    plain = ordered.scan(df, keys, ["t", "i"], steps(), limit=10_000)
    sliced = ordered.scan(df, keys, ["t", "i"], steps(), limit=37)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))


def test_sliced_scan_keeps_descending_order(spark):
    df = spark.createDataFrame(hot_rows(), "k string, t int, i int, v int")
    order = [F.desc("t"), F.asc("i")]
    plain = ordered.scan(df, ["k"], order, steps()[:2], limit=10_000)
    sliced = ordered.scan(df, ["k"], order, steps()[:2], limit=25)
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))


def test_exact_median_over_slices(spark):
    import statistics

    rows = [(k or "n", float(t), i) for k, t, i, _ in hot_rows()]
    df = spark.createDataFrame(rows, "k string, x double, i int")
    spark.conf.set("cuewright.rowsPerTask", "30")
    try:
        got = {r["k"]: (r["samples"], r["median"]) for r in exact_median(df, ["k"], "x", ["i"]).collect()}
    finally:
        spark.conf.unset("cuewright.rowsPerTask")
    for key in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == key]
        assert got[key] == (len(values), statistics.median(values))


def test_asof_both_directions(spark):
    left = spark.createDataFrame([(1, 0, 5), (1, 1, 10), (1, 2, 99), (2, 3, 1)], "job_id int, n int, t int")
    right = spark.createDataFrame([(1, 0, 10), (1, 1, 10), (1, 2, 20)], "job_id int, r int, u int")
    got = {r["n"]: (r["_before"] and r["_before"]["r"], r["_after"] and r["_after"]["r"]) for r in asof(left, right, ["job_id"], "t", "u", "n", "r").collect()}
    assert got == {0: (None, 0), 1: (1, 0), 2: (2, None), 3: (None, None)}


def test_chunked_grouping_equals_single_pass(spark):
    def pack_heads(columns):
        numbers = fill_batches(np.array(columns["size"]), 20)
        return [i for i in range(len(numbers)) if i == 0 or numbers[i] != numbers[i - 1]]

    rnd = random.Random(5)
    rows = [(rnd.choice([1, 1, 1, 1, 2]), i, rnd.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "job_id int, i int, size int")
    whole = greedy_groups(df, ["job_id"], ["i"], pack_heads, ["size"], limit=10_000)
    chunked = greedy_groups(df, ["job_id"], ["i"], pack_heads, ["size"], limit=40)
    assert sorted(whole.collect()) == sorted(chunked.collect())


def test_chunks_widen_for_a_group_longer_than_they_are(spark):
    df = spark.createDataFrame([(1, i) for i in range(60)], "job_id int, i int")
    found = greedy_groups(df, ["job_id"], ["i"], lambda columns: [0], [], limit=10).collect()
    assert len(found) == 60 and {r["head"] for r in found} == {1}


def test_fill_batches_matches_a_plain_loop():
    rnd = random.Random(1)
    for _ in range(300):
        sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(0, 40))]
        number = used = 0
        want = []
        for size in sizes:
            if want and used + size > 25:
                number, used = number + 1, 0
            want.append(number)
            used += size
        assert fill_batches(np.array(sizes, dtype=np.int64), 25).tolist() == want


def test_null_keys_are_one_group(spark):
    from cuewright.operators.pergroup import by_group

    big = 2**60 + 1
    rows = spark.createDataFrame([(None, 1, big), (None, 2, None), (7, 1, 5), (None, 3, 4)], "k long, o long, v long")
    got = by_group(rows, ["k"], ["o"], ["o", "v"], lambda key, held: [(*key, len(held), held[0][1])], "k long, n long, first long")
    assert sorted(map(tuple, got.collect()), key=str) == [(7, 1, 5), (None, 3, big)]
