"""Streams fed in several batches give what one batch, or a plain loop, gives."""

import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuewright.functions.sentences import Release, flush, push
from cuewright.session import scratch_path
from cuewright.sources.keyed_store import KEEP_VERSIONS
from cuewright.streaming import jobs
from cuewright.streaming.processors import earliest


def feed(spark, frames, files_per_batch=1):
    """A stream of the frames, one file each in this order."""
    import time

    path = scratch_path(spark, "feed")
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(path)
        stamp = time.time() - 1000 + i
        for name in os.listdir(path.removeprefix("file:")):
            full = os.path.join(path.removeprefix("file:"), name)
            if name.endswith(".parquet") and name not in feed.seen:
                os.utime(full, (stamp, stamp))
                feed.seen.add(name)
    return jobs.read_stream(spark, path, frames[0].schema, files_per_batch)


feed.seen = set()


@pytest.fixture(autouse=True)
def store(spark):
    jobs.use_state_store(spark)


def collect(spark, stream):
    out = scratch_path(spark, "out")
    jobs.run_append(stream, out, scratch_path(spark, "checkpoint"))
    return spark.read.schema(stream.schema).parquet(out).collect()


TEXTS = {1: "Hello there. This is a sentence that is long enough. Mr. Jones agrees!", 2: "Short. Yes it is, and it ends here without a mark"}


def test_sentences_over_batches(spark):
    rows = []
    for session, text in TEXTS.items():
        words = [w + " " for w in text.split()]
        rows += [(session, 1_700_000_000 + i, i, w, i == len(words) - 1) for i, w in enumerate(words)]
    rows.sort(key=lambda r: r[2])
    schema = "session long, t long, token_no long, token string, is_last boolean"
    frames = [spark.createDataFrame(rows[k::1][: 0] or part, schema) for k, part in enumerate([rows[:9], rows[9:15], rows[15:]])]
    frames = [f.select("session", F.timestamp_seconds("t").alias("ts"), "token_no", "token", "is_last") for f in frames]
    got = sorted((r["session"], r["sentence_no"], r["sentence"]) for r in collect(spark, jobs.sentences(feed(spark, frames), Release())))
    want = []
    for session, text in TEXTS.items():
        buffer, first, out = "", True, []
        for word in text.split():
            done, buffer, first = push(buffer, first, word + " ", Release())
            out += done
        want += [(session, i, s) for i, s in enumerate(out + flush(buffer), 1)]
    assert got == sorted(want)


def test_idle_session_is_flushed_by_the_timer(spark):
    schema = "session long, t long, token_no long, token string, is_last boolean"
    first = spark.createDataFrame([(1, 1_700_000_000, 0, "Left open", False)], schema)
    later = spark.createDataFrame([(2, 1_700_005_000, 0, "Other", False)], schema)
    last = spark.createDataFrame([(2, 1_700_005_001, 1, " one.", True)], schema)
    frames = [f.select("session", F.timestamp_seconds("t").alias("ts"), "token_no", "token", "is_last") for f in (first, later, last)]
    got = sorted((r["session"], r["sentence"]) for r in collect(spark, jobs.sentences(feed(spark, frames), Release())))
    assert got == [(1, "Left open"), (2, "Other one.")]


def utterances_by_steps(rows):
    """Step through every two-second check of one session."""
    out, start, last, total, partials, paused, check = [], None, None, 0, 0, False, None
    for at, size, kind in rows:
        while start is not None and check < at:
            if not paused:
                if check - last > 3000 and total > 64000:
                    out.append((start, last, check, total, partials))
                    start = None
                    break
                if total >= 64000:
                    partials += 1
            check += 2000
        if start is None:
            start, total, partials, check, paused = at, 0, 0, at + 2000, False
        paused = kind == "pause" or (paused and kind != "resume")
        last = at
        if kind == "audio":
            total += size
    return out


def test_utterances_match_a_stepwise_loop(spark):
    rnd, rows = random.Random(9), []
    for session in range(6):
        at = 1_700_000_000_000 + rnd.randint(0, 999)
        for _ in range(120):
            at += rnd.choice([150, 400, 900, 1700, 2600, 3300, 5200, 9100])
            rows.append((session, at, len(rows), rnd.choice([3000, 9000, 21000, 64000]), rnd.choice(["audio"] * 8 + ["pause", "resume"])))
    rows.sort(key=lambda r: r[1])
    end = rows[-1][1] + 3_600_000
    rows += [(99, end, 10_000, 10, "audio"), (99, end + 1000, 10_001, 10, "audio")]
    schema = "session long, at_ms long, row_no long, bytes long, kind string"
    cut = [rows[:200], rows[200:500], rows[500:-1], rows[-1:]]
    frames = [spark.createDataFrame(p, schema).withColumn("ts", F.timestamp_millis("at_ms")) for p in cut]
    got = sorted(tuple(r) for r in collect(spark, jobs.utterances(feed(spark, frames))) if r["session"] != 99)
    want = []
    for session in range(6):
        own = [(r[1], r[3], r[4]) for r in rows if r[0] == session]
        want += [(session, *u) for u in utterances_by_steps([*own, (end - 1_200_000, 0, "audio")])]
    assert got == sorted(want)


def test_capped_log_over_batches(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(1, 5), i, 1_700_000_000 + i) for i in range(300)]
    frames = [spark.createDataFrame(p, "job_id long, seq long, t long") for p in (rows[:100], rows[100:180], rows[180:])]
    out = scratch_path(spark, "log")
    jobs.run_batches(feed(spark, frames), jobs.capped_log(out, 7), scratch_path(spark, "checkpoint"))
    got = sorted((r["job_id"], r["seq"]) for r in jobs.read_capped_log(spark, out, 7).collect())
    want = sorted((j, s) for j in range(1, 6) for s in sorted((r[1] for r in rows if r[0] == j), reverse=True)[:7])
    assert got == want
    target = scratch_path(spark, "compact")
    jobs.compact_capped_log(spark, out, target, 7)
    assert sorted((r["job_id"], r["seq"]) for r in spark.read.parquet(target).collect()) == want


def test_rollup_is_kept_in_few_files_and_repeats_change_nothing(spark):
    rnd = random.Random(4)
    rows = [(str(rnd.randint(1, 5)), 1_700_000_000 + i) for i in range(120)]
    frames = [spark.createDataFrame(rows[i : i + 10], "fingerprint string, t long") for i in range(0, 120, 10)]
    frames = [f.select("fingerprint", F.timestamp_seconds("t").alias("created_at")) for f in frames]
    out, checkpoint = scratch_path(spark, "rollup"), scratch_path(spark, "checkpoint")
    store = jobs.ERROR_ROLLUP.store(spark, out, 4)
    jobs.maintain(feed(spark, frames), jobs.ERROR_ROLLUP, store, checkpoint)
    want = {}
    for name, t in rows:
        n, first, last = want.get(name, (0, t, t))
        want[name] = (n + 1, min(first, t), max(last, t))

    def found():
        seconds = [F.unix_seconds(c).alias(c) for c in ("first_seen", "last_seen")]
        return {r["fingerprint"]: tuple(r)[1:] for r in store.read().select("fingerprint", "count", *seconds).collect()}

    assert found() == want
    files = [f for _, _, names in os.walk(out.removeprefix("file:")) for f in names if f.endswith(".parquet")]
    assert len(files) <= 4 * KEEP_VERSIONS + 12  # buckets of the kept versions and the last reduced batch
    last = store.current()["label"]
    again = jobs.ERROR_ROLLUP.reduce(frames[-1])
    assert store.merge(again, jobs.ERROR_ROLLUP.combine, last) is False
    assert found() == want


def test_status_over_batches(spark):
    changes = [(1, "pending", 10, 1), (2, "pending", 11, 2), (1, "done", 30, 5), (2, "running", 20, 3), (1, "running", 20, 4)]
    frames = [spark.createDataFrame([c], "job_id long, status string, t long, event_id long").select("job_id", "status", F.timestamp_seconds("t").alias("created_at"), "event_id") for c in changes]
    store = jobs.JOB_STATUS.store(spark, scratch_path(spark, "status"), 2)
    jobs.maintain(feed(spark, frames), jobs.JOB_STATUS, store, scratch_path(spark, "checkpoint"))
    got = {r["job_id"]: r["status"] for r in jobs.sweep_orphans(jobs.job_status(store.read())).collect()}
    assert got == {1: "done", 2: "failed"}


def error_frames(spark, rows, *cuts):
    schema = "session long, fingerprint string, t long, event_id long"
    parts = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)))]
    return [spark.createDataFrame(p, schema).select("session", "fingerprint", F.timestamp_seconds("t").alias("created_at"), "event_id") for p in parts]


def first_by_loop(rows, cap):
    want, sent = [], {}
    for session, fp, _, event in rows:
        known = sent.setdefault(session, [])
        if fp not in known and len(known) < cap:
            known.append(fp)
            want.append((session, event))
    return sorted(want)


def test_first_errors_over_batches_and_a_restart(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(1, 3), f"f{rnd.randint(1, 9)}", 1_700_000_000 + i, i) for i in range(90)]
    frames = error_frames(spark, rows, 20, 50)
    out, checkpoint = scratch_path(spark, "errors"), scratch_path(spark, "checkpoint")
    path = scratch_path(spark, "feed")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
        jobs.run_append(jobs.first_errors(jobs.read_stream(spark, path, frame.schema), 4), out, checkpoint)
    got = sorted((r["session"], r["event_id"]) for r in spark.read.parquet(out).collect())
    assert got == first_by_loop(rows, 4)


def state_rows(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()


def test_sent_errors_are_forgotten_after_a_day(spark):
    rows = [(1, "a", 0, 1), (2, "b", 0, 2), (3, "c", 200_000, 3), (3, "c", 200_001, 4), (2, "b", 200_002, 5)]
    frames = error_frames(spark, [(s, f, 1_700_000_000 + t, i) for s, f, t, i in rows], 2, 3, 4)
    out, checkpoint = scratch_path(spark, "errors"), scratch_path(spark, "checkpoint")
    jobs.run_append(jobs.first_errors(feed(spark, frames), 4), out, checkpoint)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 5]
    assert state_rows(spark, checkpoint, "sent") == 2


def test_pruning_keeps_the_first_occurrences():
    rnd = random.Random(3)
    rows = [(f"f{rnd.randint(1, 12)}", rnd.randint(1, 40), i) for i in range(200)]
    firsts = {}
    for i in range(0, 200, 7):
        firsts = earliest(firsts, pd.DataFrame(rows[i : i + 7], columns=["fingerprint", "created_at", "event_id"]), {"f3"}, 4)
    want = {}
    for name, at, event in rows:
        if name != "f3":
            want[name] = min(want.get(name, (at, event)), (at, event))
    assert firsts == dict(sorted(want.items(), key=lambda x: (x[1], x[0]))[:4])


def test_replay_ends_with_the_job_and_leaves_no_state(spark):
    kinds = ["running", "progress", "progress", "done", "progress"]
    rows = [(job, 1_700_000_000 + 10 * i, i + 1, 100 * job + i, k if job == 1 else "progress") for job in (1, 2, 3) for i, k in enumerate(kinds)]
    rows += [(9, 1_700_100_000, 1, 900, "progress"), (9, 1_700_100_001, 2, 901, "progress")]
    schema = "job_id long, t long, seq long, event_id long, kind string"
    cuts = [[r for r in rows if r[2] <= 2 and r[0] != 9], [r for r in rows if r[2] > 2 and r[0] != 9], rows[-2:-1], rows[-1:]]
    frames = [spark.createDataFrame(c, schema).select("job_id", F.timestamp_seconds("t").alias("ts"), "seq", "event_id", "kind") for c in cuts]
    out, checkpoint = scratch_path(spark, "replay"), scratch_path(spark, "checkpoint")
    jobs.run_append(jobs.replay(feed(spark, frames), 1, job_ids=[1, 2]), out, checkpoint)
    got = sorted((r["job_id"], r["seq"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (2, 2), (2, 3), (2, 4), (2, 5)]
    out, checkpoint = scratch_path(spark, "replay"), scratch_path(spark, "checkpoint")
    jobs.run_append(jobs.replay(feed(spark, frames), 0), out, checkpoint)
    assert state_rows(spark, checkpoint, "ended") == 0


def test_rates_of_complete_and_idle_downloads_are_forgotten(spark):
    rows = [(1, 1_700_000_000_000 + i * 1000, i, 1000 * i, 3000) for i in range(4)]  # completes
    rows += [(2, 1_700_000_000_000 + i * 1000, 50 + i, 10 * i, 9000) for i in range(4)]  # falls silent
    rows += [(3, 1_700_000_900_000 + i, 90 + i, i, 9000) for i in range(2)]
    schema = "job_id long, at_ms long, sample_no long, bytes_done long, total_bytes long"
    frames = [spark.createDataFrame(p, schema) for p in (rows[:8], rows[8:9], rows[9:])]
    out, checkpoint = scratch_path(spark, "rates"), scratch_path(spark, "checkpoint")
    jobs.run_append(jobs.rolling_rates(feed(spark, frames), 8000), out, checkpoint)
    assert {r["job_id"]: r["n"] for r in spark.read.parquet(out).groupBy("job_id").agg(F.count("*").alias("n")).collect()} == {1: 4, 2: 4, 3: 1}
    left = spark.read.format("statestore").option("stateVarName", "emitted").load(checkpoint).select("key.job_id").collect()
    assert [r["job_id"] for r in left] == [3]
