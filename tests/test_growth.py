"""What a row, a batch or a key costs: bounds that keep larger tables in proportion."""

import random
import re
import time

from pyspark.sql import functions as F

from cuewright.functions import chunks, scoring, sentences
from cuewright.functions import text as T
from cuewright.operators import corpus
from cuewright.plans import evaluation, grouped, streams
from cuewright.streaming import jobs


def test_altered_words_are_counted_without_a_table():
    ref = [f"w{i}" for i in range(4000)]
    hyp = [w if i % 3 else f"{w}x" for i, w in enumerate(ref)]
    began = time.process_time()
    assert scoring.edit_counts(ref, hyp + ["more"]) == (1334, 0, 1)
    assert scoring.edit_counts(ref + ["q", "r"], hyp) == (1334, 2, 0)
    assert time.process_time() - began < 0.1


def test_pairing_gives_the_counts_of_the_table():
    rnd, paired = random.Random(6), 0
    for _ in range(3000):
        ref = [rnd.choice("abcd") for _ in range(rnd.randint(0, 8))]
        hyp = [w if rnd.random() < 0.7 else rnd.choice("abcde") for w in ref] + [rnd.choice("abe")] * rnd.randint(0, 2)
        assert scoring.edit_counts(ref, hyp[rnd.randint(0, 1) :]) is not None
        found = scoring._paired_counts(ref, hyp)
        paired += found is not None
        assert found in (None, scoring._aligned_counts(ref, hyp))
    assert paired > 1000


def test_report_scores_pairs_once(spark, monkeypatch):
    seen = []

    def lines(df, path, group, order):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        df.select(F.lit(1).alias(group), F.lit("x").alias("value")).write.partitionBy(group).text(path)

    monkeypatch.setattr(evaluation.writers, "write_ordered_lines", lines)
    evaluation.report(spark, "/root/testdata/sf0.001")
    assert "score(" not in seen[0] and "PythonUDF" not in seen[0]


def test_pieces_hold_few_rows_at_once(spark):
    made = []

    def piece(text):
        made.append(1)
        return [text, str(len(made))]

    rows = spark.range(1000).coalesce(1).select("id", F.col("id").cast("string").alias("t"))
    kept = spark.createDataFrame([(1, None)], "id long, t string").unionByName(rows.limit(1))
    got = kept.select(chunks.list_udf(piece, "string")("t").alias("p")).collect()
    assert sorted(len(r["p"]) for r in got) == [0, 2]
    out = rows.select("id", chunks.list_udf(lambda t: [t], "string")("t").alias("p")).collect()
    assert all(r["p"] == [str(r["id"])] for r in out) and len(out) == 1000


def test_a_processor_gets_small_frames(spark):
    def measure(pdf):
        if (pdf["id"] == 700).any():
            raise ValueError("bad")
        return pdf.assign(rows=len(pdf))[["id", "rows"]]

    got = corpus.process_samples(spark.range(1000).coalesce(1), measure, ["id"], "id long, rows long").collect()
    assert sorted(r["id"] for r in got) == list(range(1000))
    assert max(r["rows"] or 0 for r in got) <= corpus.ROWS_AT_ONCE
    assert [(r["id"], r["rows"], r["error"]) for r in got if r["error"]] == [(700, None, "ValueError: bad")]


def test_rows_of_a_key_reach_the_state_packed(spark):
    rows = spark.range(600).coalesce(1).select((F.col("id") % 3).alias("job_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"))
    got = sorted(jobs.packed(rows, "job_id", ["seq"]).select("job_id", "seq", F.unix_seconds("ts").alias("t")).collect())
    assert [(r["job_id"], r["t"], len(r["seq"])) for r in got] == [(0, 597, 200), (1, 598, 200), (2, 599, 200)]
    assert sorted(s for r in got for s in r["seq"]) == list(range(600))


def test_open_text_without_a_mark_is_not_split(monkeypatch):
    calls = []
    whole = sentences.split_sentences
    monkeypatch.setattr(sentences, "split_sentences", lambda *a: calls.append(a) or whole(*a))
    buffer, first, out = "", True, []
    for word in ["one "] * 50 + ["end. ", "And ", "another "]:
        done, buffer, first = sentences.push(buffer, first, word, sentences.Release())
        out += done
    assert out == [("one " * 50 + "end.")] and len(calls) <= 3


def test_tokens_are_split_once_per_turn(spark):
    plan = streams.tokens(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "split(" not in above


def test_loops_are_cut_as_the_pattern_finds_them():
    rnd, cut = random.Random(2), 0
    for _ in range(500):
        text = ""
        for _ in range(rnd.randint(1, 8)):
            unit = "".join(rnd.choice("ab é𝄞") for _ in range(rnd.choice((1, 2, 3, 5, 20, 59, 60, 61))))
            text += unit * rnd.randint(1, 9) + unit[: rnd.randint(0, len(unit))]
        found = T.cut_loops(text, 6, 60)
        cut += found is not None
        assert (text if found is None else found) == re.sub(r"(?s)(.{2,60}?)\1{5,}", "", text)
    assert cut > 100


def test_a_long_text_is_searched_for_loops_in_bulk():
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefghijkl mnop") for _ in range(100_000))
    began = time.process_time()
    assert T.cut_loops(text + "so " * 6, 6, 60) == text
    assert time.process_time() - began < 0.1


def test_two_steps_cut_what_the_pattern_cuts(spark):
    rnd = random.Random(5)
    texts = [None, "", " ", "a  b", "so " * 9, "x y z " * 7 + "end"]
    texts += ["".join(rnd.choice("ab ,") * rnd.choice((1, 1, 2, 7)) for _ in range(40)) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    once = rows.select("k", T.without_loops(F.col("t")).alias("want"), T.without_token_loops(F.col("t")).alias("once"))
    got = once.select("want", T.without_character_loops(F.col("once")).alias("out")).collect()
    assert len(got) == len(texts) and all(r["want"] == r["out"] for r in got)


def test_words_stay_in_their_task_until_they_are_segments(spark):
    plan = grouped.words_to_segments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Join" not in plan and "explode" not in plan


def test_cues_are_not_joined_with_their_heads(spark):
    plan = grouped.subtitle_merge(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
