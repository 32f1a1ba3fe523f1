"""Merges into a stored table: what they read and rewrite, repeats, failures."""

import random

import pytest
from pyspark.sql import functions as F

from cuewright.session import scratch_path
from cuewright.sources.keyed_store import BUCKET, KeyedStore, upsert

SCHEMA = "id long, v string"


@pytest.fixture()
def store(spark):
    return KeyedStore(spark, scratch_path(spark, "store"), SCHEMA, ["id"], 8)


def rows(store):
    return {r["id"]: r["v"] for r in store.read().collect()}


def test_upserts_equal_a_dictionary(spark, store):
    rnd, want = random.Random(1), {}
    assert rows(store) == {}
    for n in range(5):
        changes = {rnd.randint(1, 60): f"v{n}" for _ in range(20)}
        want |= changes
        assert store.merge(spark.createDataFrame(list(changes.items()), SCHEMA), upsert(["id"]), f"m{n}")
        assert rows(store) == want
    assert {r["id"]: r["v"] for r in store.lookup(spark.createDataFrame([(k,) for k in (1, 2, 3, 99)], "id long")).collect()} == {k: want[k] for k in (1, 2, 3) if k in want}


def test_untouched_buckets_are_left_alone(spark, store):
    store.merge(spark.range(200).select("id", F.lit("old").alias("v")), upsert(["id"]), "load")
    before = store.current()["folders"]
    one = spark.createDataFrame([(7, "new")], SCHEMA)
    bucket = store._placed(one).first()[BUCKET]
    store.merge(one, upsert(["id"]), "one")
    after = store.current()["folders"]
    assert store.rewritten == [bucket]
    assert {b for b in before if before[b] != after[b]} == {str(bucket)} and len(before) == 8
    assert rows(store)[7] == "new" and len(rows(store)) == 200


def test_deleting_and_repeating(spark, store):
    store.merge(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), upsert(["id"]), "x")
    gone = spark.createDataFrame([(1, None)], SCHEMA)
    drop = lambda stored, changes: stored.join(changes.select("id"), "id", "left_anti")
    assert store.merge(gone, drop, "y") and rows(store) == {2: "b"}
    assert not store.merge(gone, drop, "y")


def test_a_failing_merge_leaves_the_last_version(spark, store):
    store.merge(spark.createDataFrame([(1, "a")], SCHEMA), upsert(["id"]), "x")
    broken = lambda stored, changes: changes.withColumn("v", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        store.merge(spark.createDataFrame([(1, "b")], SCHEMA), broken, "y")
    assert rows(store) == {1: "a"}
    assert store.merge(spark.createDataFrame([(1, "b")], SCHEMA), upsert(["id"]), "y") and rows(store) == {1: "b"}


def test_two_writers_of_one_version(spark, store):
    other = KeyedStore(spark, store.path, SCHEMA, ["id"], 8)
    state = other.current()
    store.merge(spark.createDataFrame([(1, "a")], SCHEMA), upsert(["id"]), "x")
    with pytest.raises(RuntimeError, match="another writer"):
        other._commit({"version": state["version"] + 1, "label": "z", "folders": {}})
    assert rows(store) == {1: "a"}
