"""File sources and sinks on small files."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cuewright.operators import corpus, filters, lookups
from cuewright.session import scratch_path
from cuewright.sources import readers, subtitles, writers


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_text(text, encoding=encoding)
    return str(path)


def test_test_list_separates_bad_lines(spark, tmp_path):
    path = write(tmp_path, "t.jsonl", '{"id": "a", "text": "x", "duration": 1.5}\n\n{"id": "b", "te\n{"id": "c", "extra": 1, "duration": "3.5"}\n{"id": "d"} x\n')
    good, bad = readers.test_list(spark, path)
    assert [(r["id"], r["duration"], r["language_id"]) for r in good.orderBy("id").collect()] == [("a", 1.5, None), ("c", 3.5, None)]
    assert good.filter("id = 'c'").first()["extras"] == {"extra": "1"}
    assert sorted(r["value"] for r in bad.collect()) == ['{"id": "b", "te', '{"id": "d"} x']


def test_shard_manifest_needs_four_fields(spark, tmp_path):
    good = readers.shard_manifest(spark, write(tmp_path, "a.lst", "\tx.tar  x.jsonl 3 4.500\n\ny.tar y.jsonl 1 0.1\n"))
    assert sorted(tuple(r) for r in good.collect()) == [("x.tar", "x.jsonl", 3, 4.5), ("y.tar", "y.jsonl", 1, 0.1)]
    with pytest.raises(PySparkException, match="four fields"):
        readers.shard_manifest(spark, write(tmp_path, "b.lst", "x.tar x.jsonl 3\n")).collect()


def test_training_csv(spark, tmp_path):
    text = "audio_path,transcription\r\n 'a.wav' , hello \r\n\"b.wav\",\r\n,text\r\n\"c.wav\",\"x, y\"\r\n\"d.wav\",\"one\ntwo\"\r\n"
    rows = readers.training_csv(spark, write(tmp_path, "t.csv", text, "utf-8-sig"))
    assert sorted(tuple(r) for r in rows.collect()) == [("a.wav", "hello"), ("c.wav", "x, y"), ("d.wav", "one\ntwo")]
    with pytest.raises(ValueError, match="no usable rows"):
        readers.training_csv(spark, write(tmp_path, "e.csv", "audio_path,transcription\n,\n"))


def test_counters_come_with_the_rows(spark, tmp_path):
    text = "audio_path,transcription\na.wav,hello\nb.wav,\n,text\n"
    seen = Observation("csv")
    assert readers.training_csv(spark, write(tmp_path, "t.csv", text), seen).count() == 1
    assert seen.get == {"kept": 1, "rejected": 2}
    seen = Observation("srt")
    frame = spark.createDataFrame([("d", SRT)], "doc string, srt string")
    assert len(readers.parse_srt(frame, "srt", seen).collect()) == 3
    assert seen.get == {"kept": 3, "skipped": 1}


def test_missing_labels_are_counted_or_fail(spark):
    samples = spark.createDataFrame([(1, "s"), (2, "s"), (None, "s")], "id long, shard string")
    labels = spark.createDataFrame([(1, 5)], "id long, quality long")
    seen = Observation("labels")
    got = {r["id"]: r["label_state"] for r in lookups.join_labels(samples, labels, ["id"], seen).collect()}
    assert got == {1: "ok", 2: "missing", None: "missing"} and seen.get == {"samples": 3, "missing": 2}
    assert lookups.join_labels(samples.filter("id = 1"), labels, ["id"], strict=True).count() == 1
    with pytest.raises(PySparkException, match="no label for id 2"):
        lookups.join_labels(samples.filter("id = 2"), labels, ["id"], strict=True).collect()


def test_rows_without_id_are_neither_fresh_nor_stale(spark):
    schema = "job_id long, seg_no long, fingerprint string"
    current = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, None, "c"), (None, 1, "d")], schema)
    stored = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (1, None, "c")], schema)
    got = {(r["job_id"], r["seg_no"]): r["state"] for r in lookups.stale_segments(current, stored, ["job_id", "seg_no"]).collect()}
    assert got == {(1, 1): "fresh", (1, 2): "stale"}


def test_languages_by_alias_base_and_name(spark):
    dim = spark.createDataFrame(
        [("ne", "Nepali", ["npi", "नेपाली", "nepali (nepal)"]), ("xx", "Other", ["npi"]), ("hi", "Hindi", None), ("zz", "hindi", [])], "code string, name string, aliases array<string>"
    )
    cases = {" NPI ": "ne", "npi_XX": "ne", "नेपाली": "ne", "Nepali (Nepal)": "ne", "HINDI": "hi", "hi-IN": "hi", "Auto": None, "": None, None: None, "qq-A": "qq", "klingon": None}
    frame = spark.createDataFrame([(k,) for k in cases], "label string")
    assert {r["label"]: r["iso_code"] for r in filters.resolve_languages(frame, "label", dim).collect()} == cases
    assert filters.resolve_languages(frame.filter("label = 'hi-IN'"), "label", dim.drop("aliases")).first()["iso_code"] == "hi"


def test_stored_tables_with_an_added_column(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, status string").write.parquet(str(tmp_path / "jobs"))
    spark.createDataFrame([(2, "b", 7)], "id long, status string, owner long").write.mode("append").parquet(str(tmp_path / "jobs"))
    spark.range(1).write.parquet(str(tmp_path / "projects"))
    found = readers.stored_tables(spark, str(tmp_path))
    assert sorted(found) == ["jobs", "projects"]
    assert sorted(tuple(r) for r in found["jobs"].select("id", "status", "owner").collect()) == [(1, "a", None), (2, "b", 7)]


def test_data_config(spark, tmp_path):
    path = write(tmp_path, "c.json", '{"train": [{"language_id": "en", "manifest_path": ["a", "b"], "repeat": 2}, {"manifest_path": ["c"]}], "dev": [{"manifest_path": ["d"], "repeat": 0}]}')
    rows = readers.data_config(spark, path).collect()
    assert sorted((r["split"], r["manifest_path"]) for r in rows) == [("train", p) for p in "aabbc"]


SRT = "﻿1\r\n00:00:01,5 --> 00:00:02,000 X1:0\r\n Hello \r\n\r\nagain\r\n\r\n2\r\n00:00:03.000 --> 00:00:02.000\r\nback\r\n\r\n3\r\n0:0:4,25 --> 0:0:5,250\r\n42\r\n\r\n4\r\n00:00:06,000 --> 00:00:07,000\r\nlast\r\n"


def test_srt_parsing(spark):
    frame = spark.createDataFrame([("d", SRT)], "doc string, srt string")
    got = [(r["cue_no"], r["start_ms"], r["end_ms"], r["cue_text"]) for r in readers.parse_srt(frame, "srt").orderBy("cue_no").collect()]
    assert got == [(1, 1500, 2000, "Hello\nagain"), (3, 4250, 5250, "42"), (4, 6000, 7000, "last")]


def test_srt_of_blank_lines_is_quick(spark):
    frame = spark.createDataFrame([("d", "\n" * 200_000)], "doc string, srt string")
    assert readers.parse_srt(frame, "srt").count() == 0


@pytest.mark.parametrize("per_slice", [50_000, 7])
def test_subtitle_files_keep_cue_order(spark, tmp_path, monkeypatch, per_slice):
    monkeypatch.setattr(subtitles, "SLICE_CUES", per_slice)
    rows = [(j, i, i * 1000, i * 1000 + 900, f"t{i}", f"o{i}" if i % 2 else f"t{i}") for j in range(60) for i in range(1, 40)]
    cues = spark.createDataFrame(rows, "job_id long, cue_no long, start_ms long, end_ms long, text string, orig string")
    path = str(tmp_path / "srt")
    subtitles.write_subtitles(subtitles.cue_blocks(cues, ",", "orig"), path)
    files = list((tmp_path / "srt").glob("part-*.txt"))
    assert 0 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = {r["job_id"]: r["content"] for r in subtitles.read_subtitles(spark, path).collect()}
    assert len(found) == 60 and len(set(found.values())) == 1
    text = found[1]
    numbers = [int(line) for line in text.split("\n") if line.isdigit()]
    assert numbers == list(range(1, 40))
    assert "00:00:01,000 --> 00:00:01,900\nt1\n<i>o1</i>" in text and "<i>t2" not in text


def test_files_of_failed_tasks_are_in_no_index(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1, "ä\n"), (None, 1, "no job\n")], "job_id long, cue_no long, block string")
    path = str(tmp_path / "srt")
    subtitles.write_subtitles(cues, path)
    (tmp_path / "srt" / "part-left.txt").write_text("half a fi")
    assert {r["job_id"]: r["content"] for r in subtitles.read_subtitles(spark, path).collect()} == {1: "ä\n\n", None: "no job\n\n"}
    assert subtitles.clean_subtitles(spark, path) == 1
    subtitles.write_subtitles(cues.filter("job_id = 1"), path)
    assert subtitles.clean_subtitles(spark, path) >= 1
    assert subtitles.read_subtitles(spark, path).count() == 1


def test_karaoke_starts_never_run_backwards(spark):
    cue = spark.createDataFrame([(1, 1, 0, 1000, "a b c d")], "job_id long, cue_no long, start_ms long, end_ms long, text string")
    for starts in ([100.0, 50.0, 400.0, 2000.0], [100.0, 200.0, 400.0, 800.0]):
        words = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(s).alias("start"), F.lit(0.0).alias("end")) for t, s in zip("abcd", starts)])
        event = subtitles.karaoke_events(cue.withColumn("words", words)).first()["event"]
        clamped = [min(max(starts[: i + 1]), 1000.0) for i in range(4)] + [1000.0]
        want = "".join(f"{{\\kf{max(1, round((b - a) / 10))}}}{t}" + (" " if t != "d" else "") for t, a, b in zip("abcd", clamped, clamped[1:]))
        assert event.endswith(want), (event, want)


def test_karaoke_uses_given_words(spark):
    cue = spark.createDataFrame([(1, 1, 1000, 3000, "{a} b")], "job_id long, cue_no long, start_ms long, end_ms long, text string")
    words = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(s).alias("start"), F.lit(e).alias("end")) for t, s, e in [("{a}", 1500.0, 1800.0), ("b", 1400.0, 9000.0)]])
    event = subtitles.karaoke_events(cue.withColumn("words", words)).first()["event"]
    assert event == "Dialogue: 0,0:00:01.00,0:00:03.00,Default,,0,0,0,,{\\k50}{\\kf1}\\{a\\} {\\kf150}b"


def test_shards_and_rejects(spark, tmp_path):
    rows = spark.createDataFrame([(i, 100 * i) for i in range(25)], "id long, duration_ms long")
    sharded = corpus.assign_shards(rows, ["id"], 10, 1)
    assert sorted(r["n"] for r in sharded.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [5, 10, 10]
    assert corpus.shard_size(25, 100, 5) == 5 and corpus.shard_size(0, 100, 5) == 100
    reason = F.when(F.col("duration_ms") < 500, "short")
    counts = writers.write_with_rejects(rows, reason, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert counts == {"kept": 20, "rejected": 5}


def test_mux_and_shuffle_are_repeatable_and_whole(spark):
    rows = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(200)], "id long, source string")
    weight = F.when(F.col("source") == "a", 3.0).otherwise(1.0)
    first = [(r["position"], r["id"]) for r in corpus.weighted_mux(rows, weight, 5).orderBy("position").collect()]
    assert [p for p, _ in first] == list(range(1, 201)) and sorted(i for _, i in first) == list(range(200))
    assert first == [(r["position"], r["id"]) for r in corpus.weighted_mux(rows, weight, 5).orderBy("position").collect()]
    early = corpus.weighted_mux(rows, weight, 5, stop_early=True).orderBy("position").collect()
    assert [(r["position"], r["id"]) for r in early] == first[: len(early)] and len(early) <= 200
    one = [r["id"] for r in corpus.seeded_shuffle(rows, 1, 0).orderBy("position").collect()]
    two = [r["id"] for r in corpus.seeded_shuffle(rows, 1, 1).orderBy("position").collect()]
    assert sorted(one) == sorted(two) == list(range(200)) and one != two


def test_masking(spark):
    rows = spark.range(50).select("id", F.sequence(F.lit(1), F.lit(40)).alias("tokens"), F.lit(10).alias("prompt_length"), F.lit(0.5).alias("mask_ratio"), (F.col("id") % 2 == 0).alias("drop_cond"))
    for r in corpus.mask_tokens(rows, 3, 99).collect():
        for i, (token, seen, label) in enumerate(zip(r["tokens"], r["input_ids"], r["labels"])):
            if i < 10:
                assert seen == token and label == (token if r["drop_cond"] else -100)
            else:
                assert (seen, label) in ((99, token), (token, -100))


def test_bucket_packing_drops_the_open_batch_on_request(spark):
    rows = spark.createDataFrame([(0, i, 1000) for i in range(7)], "shard long, id long, duration_ms long")
    assert corpus.pack_buckets(rows, 4000).agg(F.max("batch_no")).first()[0] == 2
    assert corpus.pack_buckets(rows, 4000, drop_last=True).count() == 6
    assert corpus.pack_buckets(rows, 10**9, max_rows=3).groupBy("batch_no").count().count() == 3


def test_batches_do_not_depend_on_rows_per_task(spark):
    rows = spark.range(30).selectExpr("id", "id % 2 AS shard", "(id * 37) % 29 + 1 AS duration_ms")
    whole = sorted(corpus.pack_longest_first(rows, 60).collect())
    spark.conf.set("cuewright.rowsPerTask", "7")
    try:
        assert sorted(corpus.pack_longest_first(rows, 60).collect()) == whole
    finally:
        spark.conf.unset("cuewright.rowsPerTask")
