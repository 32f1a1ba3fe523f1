"""Queries of the corpus pipeline: sources, filters, shards, packing, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import views
from cuewright.operators import corpus, filters, sequences
from cuewright.plans.registry import query
from cuewright.session import scratch_path
from cuewright.sources import readers, subtitles, writers
from cuewright.views import table

PER_SHARD, MIN_SHARDS = 300, 5


def sharded(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).select("id", "audio_path", "language_id", "duration_ms")
    return corpus.assign_shards(rows, ["id"], PER_SHARD, MIN_SHARDS)


SHARD_SQL = f"""sz AS (SELECT CASE WHEN CEIL(COUNT(*)/{PER_SHARD}.0) < {MIN_SHARDS} THEN GREATEST(1, COUNT(*)//{MIN_SHARDS}) ELSE {PER_SHARD} END AS n FROM v_manifest),
sh AS (SELECT id, audio_path, language_id, duration_ms, (ROW_NUMBER() OVER (ORDER BY id)-1)//(SELECT n FROM sz) AS shard FROM v_manifest)"""


@query(
    "src_test_list",
    sql="""SELECT conv_id || '-' || turn AS id, text, role AS ref_text, CASE WHEN turn=1 THEN NULL ELSE 'en' END AS language_id, LENGTH(text)/15.0::DOUBLE AS duration
FROM conversations WHERE turn NOT IN (3, 5)""",
)
def src_test_list(spark, sf_dir):
    """Write a test list with blank and broken lines, numbers in quotes and text after the object, then read it."""
    rows = table(spark, sf_dir, "conversations")
    entry = F.struct(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
        "text",
        F.col("role").alias("ref_text"),
        F.when(F.col("turn") != 1, "en").alias("language_id"),
        (F.length("text") / 15.0).alias("duration"),
    )
    line = F.to_json(entry)
    length = F.col("duration").cast("string")
    quoted = F.regexp_replace("line", '"duration":[^,}]+', F.concat(F.lit('"duration":"'), length, F.lit('"')))
    broken = (
        F.when(F.col("turn") == 3, F.expr("left(line, length(line) - 4)"))
        .when(F.col("turn") == 5, F.concat("line", F.lit(" junk")))
        .when(F.col("turn") == 4, quoted)
        .otherwise(F.col("line"))
    )
    path = scratch_path(spark, "test-list")
    lines = rows.select(line.alias("line"), "turn", entry["duration"].alias("duration")).select(F.explode(F.array(broken, F.lit(""))).alias("value"))
    lines.write.text(path)
    good, _ = readers.test_list(spark, path)
    return good.select("id", "text", "ref_text", "language_id", "duration")


@query(
    "src_manifest_jsonl",
    views="v_manifest",
    sql="SELECT CAST(id AS VARCHAR) AS id, audio_path, text, language_id FROM v_manifest WHERE language_id <> 'es'",
)
def src_manifest(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    rows = views.manifest(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("language_id") != "es", F.col("audio_path")).alias("audio_path"),
        "text",
        "language_id",
    )
    rows.write.json(path)
    return readers.manifest(spark, path).select("id", "audio_path", "text", "language_id")


@query(
    "src_shard_manifest",
    views="v_manifest",
    sql=f"""WITH {SHARD_SQL} SELECT 'out/shard-' || LPAD(CAST(shard AS VARCHAR), 6, '0') || '.tar' AS tar_path, 'out/shard-' || LPAD(CAST(shard AS VARCHAR), 6, '0') || '.jsonl' AS label_path,
  CAST(COUNT(*) AS INTEGER) AS num_items, CAST(SUM(duration_ms) AS DOUBLE)/1000 AS num_seconds FROM sh GROUP BY shard""",
)
def src_shard_manifest(spark, sf_dir):
    path = scratch_path(spark, "shards")
    lines = corpus.shard_manifest(sharded(spark, sf_dir), "out")
    writers.write_lines(lines, path, ["tar_path", "label_path", "num_items", "num_seconds"])
    return readers.shard_manifest(spark, path)


@query(
    "src_data_config",
    sql="""SELECT CASE WHEN n_nationkey < 20 THEN 'train' ELSE 'dev' END AS split, r_name AS language_id, n_name || '/data.lst' AS manifest_path, CAST(k AS INTEGER) AS copy_no
FROM nation JOIN region ON r_regionkey=n_regionkey, (SELECT UNNEST(range(1, 10)) AS k) WHERE k <= CASE WHEN r_regionkey=0 THEN 1 ELSE r_regionkey END""",
)
def src_data_config(spark, sf_dir):
    return readers.data_config(spark, _write_config(spark, sf_dir))


def _write_config(spark, sf_dir):
    """A data config of the fixed nation and region tables as one JSON file."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    split = F.when(F.col("n_nationkey") < 20, "train").otherwise("dev")
    paths = F.collect_list(F.concat("n_name", F.lit("/data.lst")))
    groups = (
        nation.join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .groupBy(split.alias("split"), "r_name", "r_regionkey")
        .agg(paths.alias("manifest_path"))
    )
    repeat = F.when(F.col("r_regionkey") > 0, F.col("r_regionkey"))
    entry = F.struct(F.col("r_name").alias("language_id"), "manifest_path", repeat.alias("repeat"))
    config = groups.groupBy("split").agg(F.collect_list(entry).alias("entries"))
    whole = config.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("split", "entries")))).alias("value"))
    path = scratch_path(spark, "config")
    whole.write.text(path)
    return path


@query(
    "src_training_csv",
    sql="""SELECT 'wav/' || c_custkey || '.wav' AS audio_path, c_mktsegment || CASE WHEN c_custkey%5=0 THEN chr(10) || 'second, "line"' ELSE '' END AS text
FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3""",
)
def src_training_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    name = F.concat(F.lit(" 'wav/"), F.col("c_custkey").cast("string"), F.lit(".wav' "))
    second = F.when(F.col("c_custkey") % 5 == 0, F.lit("\nsecond, \"line\"")).otherwise("")
    rows = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_acctbal") > 0, name).otherwise("  ").alias("audio_path"),
        F.when(F.col("c_nationkey") != 3, F.concat(F.lit("  "), "c_mktsegment", second, F.lit(" "))).otherwise("").alias("transcription"),
    )
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.training_csv(spark, path)


@query(
    "src_lang_map",
    sql="SELECT LOWER(n_name) AS language_id, n_name AS language_name, 'x' || n_nationkey AS iso_639_3_id, n_regionkey*10.5::DOUBLE AS train_data_duration FROM nation",
)
def src_lang_map(spark, sf_dir):
    path = scratch_path(spark, "langs")
    rows = table(spark, sf_dir, "nation").select(
        F.lower("n_name").alias("language_id"),
        F.col("n_name").alias("language_name"),
        F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("iso_639_3_id"),
        (F.col("n_regionkey") * 10.5).alias("train_data_duration"),
    )
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return readers.language_map(spark, path)


def subtitle_cues(spark, sf_dir):
    return views.segments(spark, sf_dir).select(
        "job_id", (F.col("seg_no") + 1).alias("cue_no"), "start_ms", "end_ms", "text", F.upper("speaker_id").alias("original")
    )


LINES_SQL = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: TRIM(x)), lambda x: x <> ''), chr(10))"
SRT_BLOCK = 50


@query(
    "src_srt",
    views="v_segments",
    sql=f"""WITH c AS (SELECT job_id, seg_no//{SRT_BLOCK} AS doc_no, seg_no, start_ms, end_ms, {LINES_SQL} AS cue_text FROM v_segments WHERE end_ms > start_ms AND TRIM(text) <> '')
SELECT job_id, doc_no, ROW_NUMBER() OVER (PARTITION BY job_id, doc_no ORDER BY seg_no) AS cue_no, start_ms, end_ms, cue_text FROM c""",
)
def src_srt(spark, sf_dir):
    """SRT documents of at most fifty cues written with CRLF and parsed again."""
    blocks = subtitles.cue_blocks(subtitle_cues(spark, sf_dir).filter(F.trim("text") != ""), ",")
    pieces = F.array_sort(F.collect_list(F.struct("cue_no", "block")))
    docs = blocks.groupBy("job_id", F.floor((F.col("cue_no") - 1) / SRT_BLOCK).alias("doc_no")).agg(
        F.concat(F.lit("﻿"), F.array_join(F.transform(pieces, lambda p: p.block), "\n")).alias("srt")
    )
    cues = readers.parse_srt(docs.withColumn("srt", F.replace("srt", F.lit("\n"), F.lit("\r\n"))), "srt")
    clean = sequences.deoverlap(cues.select(F.struct("job_id", "doc_no").alias("job_id"), "cue_no", "start_ms", "end_ms", "cue_text"))
    return clean.select("job_id.job_id", "job_id.doc_no", "cue_no", "start_ms", "end_ms", "cue_text")


@query(
    "src_sql_tables",
    sql="""SELECT o_orderkey AS id, o_custkey AS project_id, c_name AS project, o_orderstatus AS status, CASE WHEN o_orderkey%2=0 THEN NULL ELSE o_orderdate END AS created_at
FROM orders JOIN customer ON c_custkey=o_custkey""",
)
def src_sql_tables(spark, sf_dir):
    """Jobs and projects; the job table has parts from before and from after a column was added."""
    root = scratch_path(spark, "tables")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    jobs.filter("id % 2 = 0").drop("created_at").write.parquet(f"{root}/jobs")
    jobs.filter("id % 2 <> 0").write.mode("append").parquet(f"{root}/jobs")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("project")).write.parquet(f"{root}/projects")
    found = readers.stored_tables(spark, root)
    named = found["jobs"].join(found["projects"].withColumnRenamed("id", "project_id"), "project_id")
    return named.select("id", "project_id", "project", "status", "created_at")


@query(
    "src_file_inventory",
    views="v_manifest",
    sql=f"""WITH {SHARD_SQL} SELECT shard, CAST(SUM(LENGTH('{{"id":' || id || ',"audio_path":"' || audio_path || '","language_id":"' || language_id || '","duration_ms":' || duration_ms || '}}')+1) AS BIGINT) AS bytes FROM sh GROUP BY 1""",
)
def src_file_inventory(spark, sf_dir):
    path = scratch_path(spark, "inventory")
    writers.write_shards(sharded(spark, sf_dir), path, PER_SHARD)
    files = readers.file_inventory(spark, path)
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("long")
    return files.filter(F.col("path").contains("shard=")).select(shard.alias("shard"), "bytes")


@query(
    "src_event_log",
    views="v_job_events",
    sql="SELECT job_id, seq, event_id, kind FROM v_job_events WHERE job_id=17 AND seq > 5 ORDER BY seq LIMIT 100",
)
def src_event_log(spark, sf_dir):
    return readers.events_since(views.job_events(spark, sf_dir), 17, 5, 100).select("job_id", "seq", "event_id", "kind")


@query("sink_sharded", views="v_manifest", sql=f"WITH {SHARD_SQL} SELECT CAST(id AS BIGINT) AS id, CAST(shard AS INTEGER) AS shard, duration_ms FROM sh")
def sink_sharded(spark, sf_dir):
    path = scratch_path(spark, "sharded")
    writers.write_shards(sharded(spark, sf_dir), path, PER_SHARD)
    stored = spark.read.schema("id long, audio_path string, language_id string, duration_ms long, shard int").json(path)
    return stored.select("id", "shard", "duration_ms")


@query(
    "sink_shard_manifest",
    views="v_manifest",
    sql=f"""WITH {SHARD_SQL} SELECT shard, 'out/shard-' || LPAD(CAST(shard AS VARCHAR), 6, '0') || '.tar' AS tar_path, 'out/shard-' || LPAD(CAST(shard AS VARCHAR), 6, '0') || '.jsonl' AS label_path,
  COUNT(*) AS num_items, CAST(SUM(duration_ms)//1000 AS VARCHAR) || '.' || LPAD(CAST(SUM(duration_ms)%1000 AS VARCHAR), 3, '0') AS num_seconds FROM sh GROUP BY shard""",
)
def sink_shard_manifest(spark, sf_dir):
    return corpus.shard_manifest(sharded(spark, sf_dir), "out")


def _reject_reason():
    return (
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text")
        .when(F.col("duration_ms") < 2000, "too short")
        .when(F.col("duration_ms") >= 200000, "too long")
    )


@query(
    "sink_rejects",
    views="v_manifest",
    sql="""SELECT CAST(id AS BIGINT) AS id, CASE WHEN TRIM(text)='' THEN 'no text' WHEN duration_ms < 2000 THEN 'too short' ELSE 'too long' END AS reason FROM v_manifest
WHERE TRIM(text)='' OR duration_ms < 2000 OR duration_ms >= 200000""",
)
def sink_rejects(spark, sf_dir):
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "errors")
    writers.write_with_rejects(views.manifest(spark, sf_dir), _reject_reason(), good, bad)
    return spark.read.schema("id long, reason string").json(bad)


CLOCK_SQL = """LPAD(CAST({c}//3600000 AS VARCHAR), 2, '0') || ':' || LPAD(CAST({c}//60000%60 AS VARCHAR), 2, '0') || ':' || LPAD(CAST({c}//1000%60 AS VARCHAR), 2, '0') || '{m}' || LPAD(CAST({c}%1000 AS VARCHAR), 3, '0')"""


def _span_sql(mark: str) -> str:
    return f"{CLOCK_SQL.format(c='start_ms', m=mark)} || ' --> ' || {CLOCK_SQL.format(c='end_ms', m=mark)}"


DUAL_SQL = "TRIM(text) || CASE WHEN TRIM(UPPER(speaker_id))=TRIM(text) THEN '' ELSE chr(10) || '<i>' || UPPER(speaker_id) || '</i>' END"


def stored_files(spark, blocks, label: str, body: str = "block"):
    """Write one subtitle file per job and read the files back whole."""
    path = scratch_path(spark, label)
    subtitles.write_subtitles(blocks, path, body)
    return subtitles.read_subtitles(spark, path)


def _files_sql(rows: str) -> str:
    return f"SELECT job_id, STRING_AGG(block || chr(10), '' ORDER BY cue_no) AS content FROM ({rows}) GROUP BY 1"


@query(
    "sink_srt",
    views="v_segments",
    sql=_files_sql(
        f"SELECT job_id, seg_no+1 AS cue_no, CAST(seg_no+1 AS VARCHAR) || chr(10) || {_span_sql(',')} || chr(10) || {DUAL_SQL} || chr(10) AS block FROM v_segments"
    ),
)
def sink_srt(spark, sf_dir):
    return stored_files(spark, subtitles.cue_blocks(subtitle_cues(spark, sf_dir), ",", "original"), "srt")


@query(
    "sink_vtt",
    views="v_segments",
    sql=_files_sql(
        f"""SELECT job_id, seg_no+1 AS cue_no, CAST(seg_no+1 AS VARCHAR) || chr(10) || {_span_sql('.')} || chr(10) || TRIM(text) || chr(10) AS block FROM v_segments
UNION ALL SELECT DISTINCT job_id, 0, 'WEBVTT' || chr(10) FROM v_segments"""
    ),
)
def sink_vtt(spark, sf_dir):
    return stored_files(spark, subtitles.vtt_blocks(subtitle_cues(spark, sf_dir)), "vtt")


ASS_HEADER_SQL = subtitles.ASS_HEADER.rstrip().replace("'", "''").replace("\n", "' || chr(10) || '")
ASS_CLOCK = """CAST({c}//360000 AS VARCHAR) || ':' || LPAD(CAST({c}//6000%60 AS VARCHAR), 2, '0') || ':' || LPAD(CAST({c}//100%60 AS VARCHAR), 2, '0') || '.' || LPAD(CAST({c}%100 AS VARCHAR), 2, '0')"""


@query(
    "sink_ass_karaoke",
    views="v_segments",
    sql=f"""WITH t AS (SELECT job_id, seg_no+1 AS cue_no, start_ms, CASE WHEN end_ms > start_ms THEN end_ms ELSE start_ms+100 END AS end_ms,
  string_split(TRIM(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS tk FROM v_segments WHERE TRIM(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
w AS (SELECT *, UNNEST(range(1, len(tk)+1)) AS i, CAST(end_ms-start_ms AS DOUBLE)/len(tk) AS step FROM t),
g AS (SELECT job_id, cue_no, start_ms, end_ms, STRING_AGG('{{\\kf' || CAST(GREATEST(1, CAST(ROUND_EVEN((CASE WHEN i < len(tk) THEN start_ms+i*step ELSE end_ms END - (start_ms+(i-1)*step))/10, 0) AS BIGINT)) AS VARCHAR)
  || '}}' || REPLACE(REPLACE(tk[i], '{{', '\\{{'), '}}', '\\}}'), ' ' ORDER BY i) AS k FROM w GROUP BY ALL),
cs AS (SELECT *, CAST(ROUND_EVEN(start_ms/10.0::DOUBLE, 0) AS BIGINT) AS a, CAST(ROUND_EVEN(end_ms/10.0::DOUBLE, 0) AS BIGINT) AS b FROM g),
e AS (SELECT job_id, cue_no, 'Dialogue: 0,' || {ASS_CLOCK.format(c='a')} || ',' || {ASS_CLOCK.format(c='b')} || ',Default,,0,0,0,,' || k AS block FROM cs
  UNION ALL SELECT DISTINCT job_id, 0, '{ASS_HEADER_SQL}' FROM cs)
{_files_sql('SELECT * FROM e')}""",
)
def sink_ass_karaoke(spark, sf_dir):
    return stored_files(spark, subtitles.karaoke_blocks(subtitle_cues(spark, sf_dir)), "ass")


@query(
    "arr_even_split_words",
    views="v_segments",
    sql="""WITH t AS (SELECT job_id, seg_no, start_ms, end_ms, string_split(TRIM(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS tk FROM v_segments WHERE TRIM(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
w AS (SELECT *, UNNEST(range(1, len(tk)+1)) AS i FROM t)
SELECT job_id, seg_no, i-1 AS pos, tk[i] AS word, ROUND_EVEN(start_ms+(i-1)*(CAST(end_ms-start_ms AS DOUBLE)/len(tk)), 3) AS word_start, ROUND_EVEN(start_ms+i*(CAST(end_ms-start_ms AS DOUBLE)/len(tk)), 3) AS word_end FROM w""",
)
def even_split_words(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    words = subtitles.even_split(F.col("text"), F.col("start_ms"), F.col("end_ms"))
    rows = segs.filter(F.trim("text") != "").select("job_id", "seg_no", F.posexplode(words).alias("pos", "w"))
    return rows.select(
        "job_id",
        "seg_no",
        F.col("pos").cast("long").alias("pos"),
        F.col("w.text").alias("word"),
        F.bround("w.start", 3).alias("word_start"),
        F.bround("w.end", 3).alias("word_end"),
    )


@query(
    "arr_scale_words",
    views="v_segments",
    sql="""WITH t AS (SELECT job_id, seg_no, start_ms, end_ms, CASE WHEN seg_no=2 THEN start_ms ELSE CAST(FLOOR(end_ms*1.25) AS BIGINT) END AS new_end, string_split(TRIM(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS tk FROM v_segments WHERE TRIM(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
w AS (SELECT *, UNNEST(range(1, len(tk)+1)) AS i, CAST(end_ms-start_ms AS DOUBLE)/len(tk) AS step FROM t WHERE end_ms > start_ms AND new_end > start_ms)
SELECT job_id, seg_no, i-1 AS pos, ROUND_EVEN(start_ms+((start_ms+(i-1)*step)-start_ms)*((new_end-start_ms)/CAST(end_ms-start_ms AS DOUBLE)), 3) AS word_start FROM w""",
)
def scale_words(spark, sf_dir):
    segs = views.segments(spark, sf_dir).filter(F.trim("text") != "")
    new_end = F.when(F.col("seg_no") == 2, F.col("start_ms")).otherwise(F.floor(F.col("end_ms") * 1.25))
    words = subtitles.even_split(F.col("text"), F.col("start_ms"), F.col("end_ms"))
    scaled = subtitles.scale_words(words, (F.col("start_ms"), F.col("end_ms")), (F.col("start_ms"), new_end))
    rows = segs.select("job_id", "seg_no", F.posexplode(scaled).alias("pos", "w"))
    return rows.select("job_id", "seg_no", F.col("pos").cast("long").alias("pos"), F.col("w.start").alias("word_start"))


@query("flt_duration_closed", views="v_manifest", sql="SELECT id, duration_ms FROM v_manifest WHERE duration_ms BETWEEN 500 AND 30000")
def duration_closed(spark, sf_dir):
    return filters.duration_closed(views.manifest(spark, sf_dir), 500, 30000).select("id", "duration_ms")


@query("flt_duration_half_open", views="v_manifest", sql="SELECT id, duration_ms FROM v_manifest WHERE duration_ms >= 1000 AND duration_ms < 20000")
def duration_half_open(spark, sf_dir):
    return filters.duration_half_open(views.manifest(spark, sf_dir), 1000, 20000).select("id", "duration_ms")


TOKENS_SQL = "CAST(LENGTH(text)//4+1 AS BIGINT)"


def tokens(spark, sf_dir):
    """Samples with a token count and their shard."""
    rows = views.manifest(spark, sf_dir).select("id", F.expr("length(text) div 4 + 1").alias("length"))
    return corpus.assign_shards(rows, ["id"], PER_SHARD, MIN_SHARDS)


@query("flt_max_tokens", views="v_manifest", sql=f"SELECT id, {TOKENS_SQL} AS length FROM v_manifest WHERE {TOKENS_SQL} <= 800")
def max_tokens(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).select("id", F.expr("length(text) div 4 + 1").alias("length"))
    return rows.filter(F.col("length") <= 800)


@query("flt_partition_modulo", views="v_manifest", sql="SELECT id, (ROW_NUMBER() OVER (ORDER BY id)-1)%7 AS worker FROM v_manifest")
def partition_modulo(spark, sf_dir):
    return corpus.assign_workers(views.manifest(spark, sf_dir).select("id"), ["id"], 7)


@query(
    "prj_test_defaults",
    views="v_manifest",
    sql="SELECT id, COALESCE(NULLIF(CASE WHEN source='src1' THEN '' WHEN source='src2' THEN NULL ELSE language_id END, ''), 'unknown') AS language_id FROM v_manifest",
)
def test_defaults(spark, sf_dir):
    lang = F.when(F.col("source") == "src1", "").when(F.col("source") == "src2", None).otherwise(F.col("language_id"))
    return filters.or_unknown(views.manifest(spark, sf_dir).select("id", lang.alias("language_id")), ["language_id"])


@query(
    "agg_dataset_totals",
    views="v_manifest",
    sql=f"""WITH {SHARD_SQL}, m AS (SELECT shard, COUNT(*) AS n, SUM(duration_ms) AS ms, CASE WHEN shard%4=0 THEN 'dev' ELSE 'train' END AS split, shard%3+1 AS rep FROM sh GROUP BY 1)
SELECT split, CAST(SUM(n*rep) AS BIGINT) AS items, CAST(SUM(ms*rep) AS BIGINT) AS ms FROM m GROUP BY 1""",
)
def dataset_totals(spark, sf_dir):
    per = sharded(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("num_items"), F.sum("duration_ms").alias("ms"))
    split = F.when(F.col("shard") % 4 == 0, "dev").otherwise("train")
    return corpus.dataset_totals(per.withColumn("split", split).withColumn("repeat", F.col("shard") % 3 + 1))


@query(
    "agg_shard_stats",
    views="v_manifest",
    sql=f"""WITH {SHARD_SQL}, s AS (SELECT *, CASE WHEN language_id='es' THEN 'error' WHEN duration_ms < 10000 OR duration_ms >= 100000 THEN 'filtered' ELSE 'ok' END AS state FROM sh)
SELECT shard, COUNT(*) FILTER (state='ok') AS processed, COUNT(*) FILTER (state='filtered') AS filtered, COUNT(*) FILTER (state='error') AS errors,
  CAST(COALESCE(SUM(duration_ms) FILTER (state='ok'), 0) AS BIGINT) AS duration_ms FROM s GROUP BY ROLLUP(shard)""",
)
def shard_stats(spark, sf_dir):
    far = (F.col("duration_ms") < 10000) | (F.col("duration_ms") >= 100000)
    state = F.when(F.col("language_id") == "es", "error").when(far, "filtered").otherwise("ok")
    return corpus.shard_stats(sharded(spark, sf_dir).withColumn("state", state))


@query(
    "sort_duration_batches",
    views="v_manifest",
    sql="SELECT id, duration_ms, (ROW_NUMBER() OVER (ORDER BY duration_ms DESC, id)-1)//16 AS batch_no FROM v_manifest",
)
def duration_batches(spark, sf_dir):
    return corpus.batches_by_duration(views.manifest(spark, sf_dir).select("id", "duration_ms"), 16)


@query(
    "shuffle_seeded",
    views="v_manifest",
    sql="SELECT id, ROW_NUMBER() OVER (ORDER BY MD5(id || ':42:1'), id) AS position FROM v_manifest",
)
def shuffle_seeded(spark, sf_dir):
    return corpus.seeded_shuffle(views.manifest(spark, sf_dir).select("id"), 42, 1)


@query(
    "set_union_splits",
    views="v_manifest",
    sql="""SELECT id, 'train' AS split, CAST(k AS INTEGER) AS copy_no FROM v_manifest, (SELECT UNNEST([1,2]) AS k) WHERE source<>'src0' AND (k=1 OR language_id<>'en')
UNION ALL SELECT id, 'dev', 1 FROM v_manifest WHERE source='src0'""",
)
def union_splits(spark, sf_dir):
    rows = views.manifest(spark, sf_dir)
    times = F.when(F.col("language_id") == "en", 1).otherwise(2)
    train = corpus.repeat_rows(rows.filter(F.col("source") != "src0"), times).select("id", F.lit("train").alias("split"), "copy_no")
    dev = rows.filter(F.col("source") == "src0").select("id", F.lit("dev").alias("split"), F.lit(1).alias("copy_no"))
    return train.unionAll(dev)


MUX_SQL = """WITH w AS (SELECT id, language_id AS source, CAST(FLOOR(-LN(1.0 - CAST('0x' || LEFT(MD5('7:' || language_id || ':' || id), 12) AS BIGINT)/281474976710656.0::DOUBLE)
    / CASE WHEN language_id='en' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * 1048576.0::DOUBLE) AS BIGINT) AS wait FROM v_manifest),
t AS (SELECT *, SUM(wait) OVER (PARTITION BY source ORDER BY id ROWS UNBOUNDED PRECEDING) AS due FROM w)
SELECT id, source, ROW_NUMBER() OVER (ORDER BY due, source, id) AS position FROM t"""


@query("set_weighted_mux", views="v_manifest", sql=MUX_SQL)
def mux(spark, sf_dir):
    rows = views.manifest(spark, sf_dir).select("id", F.col("language_id").alias("source"))
    weight = F.when(F.col("source") == "en", 2.0).otherwise(1.0)
    return corpus.weighted_mux(rows, weight, 7)


@query(
    "set_repeat_oversample",
    views="v_manifest",
    sql="""SELECT id, language_id, CAST(k AS INTEGER) AS copy_no FROM v_manifest, (SELECT UNNEST(range(1, 5)) AS k) WHERE k <= CASE language_id WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 0 ELSE 4 END""",
)
def repeat_oversample(spark, sf_dir):
    lang = F.col("language_id")
    times = F.when(lang == "en", 1).when(lang == "de", 2).when(lang == "es", 0).otherwise(4)
    return corpus.repeat_rows(views.manifest(spark, sf_dir).select("id", "language_id"), times)


@query(
    "num_linspace_bucket",
    views="v_manifest",
    sql="""WITH b AS (SELECT UNNEST(range(0, 20)) AS k) SELECT id, duration_ms, (SELECT COUNT(*) FROM b WHERE 500+(k+1)*1475 < duration_ms) AS bucket FROM v_manifest WHERE duration_ms BETWEEN 500 AND 30000""",
)
def linspace_bucket(spark, sf_dir):
    rows = filters.duration_closed(views.manifest(spark, sf_dir), 500, 30000)
    return rows.select("id", "duration_ms", corpus.duration_bucket(F.col("duration_ms")).alias("bucket"))


PACK_SQL = """, r AS ({rows}), walk AS (
  SELECT grp, rn, id, len, 0::BIGINT AS batch_no, len AS used FROM r WHERE rn=1
  UNION ALL SELECT r.grp, r.rn, r.id, r.len, CASE WHEN w.used+r.len > {budget} THEN w.batch_no+1 ELSE w.batch_no END, CASE WHEN w.used+r.len > {budget} THEN r.len ELSE w.used+r.len END
  FROM walk w JOIN r ON r.grp=w.grp AND r.rn=w.rn+1)"""
TOKEN_ROWS = f"SELECT shard AS grp, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY id) AS rn, id, {TOKENS_SQL} AS len FROM sh JOIN (SELECT id, text FROM v_manifest) USING (id) WHERE {TOKENS_SQL} <= 2000"


@query(
    "grp_pack_tokens",
    views="v_manifest",
    sql=f"WITH RECURSIVE {SHARD_SQL} {PACK_SQL.format(rows=TOKEN_ROWS, budget=2000)} SELECT grp AS shard, id, len AS length, batch_no FROM walk",
)
def pack_tokens(spark, sf_dir):
    return corpus.pack_tokens(tokens(spark, sf_dir), 2000)


@query(
    "arr_position_ids",
    views="v_manifest",
    sql=f"""WITH RECURSIVE {SHARD_SQL} {PACK_SQL.format(rows=TOKEN_ROWS, budget=2000)},
e AS (SELECT grp, batch_no, id, len, ROW_NUMBER() OVER (PARTITION BY grp, batch_no ORDER BY id)-1 AS doc, UNNEST(range(0, len)) AS pos FROM walk),
b AS (SELECT grp AS shard, batch_no, COUNT(*) AS tokens, LIST(pos ORDER BY id, pos) AS p, LIST(doc ORDER BY id, pos) AS d FROM e GROUP BY 1,2)
SELECT shard, batch_no, CAST(tokens AS INTEGER) AS tokens, MD5(array_to_string(list_concat(p, list_transform(range(0, 2000-tokens), lambda x: 0)), ',')) AS positions,
  MD5(array_to_string(list_concat(d, list_transform(range(0, 2000-tokens), lambda x: -1)), ',')) AS documents FROM b""",
)
def position_ids(spark, sf_dir):
    rows = corpus.packed_rows(corpus.pack_tokens(tokens(spark, sf_dir), 2000), 2000)
    return rows.select(
        "shard",
        "batch_no",
        "tokens",
        F.md5(F.array_join("position_ids", ",")).alias("positions"),
        F.md5(F.array_join("document_ids", ",")).alias("documents"),
    )


@query(
    "grp_pack_duration",
    views="v_manifest",
    sql=f"""WITH RECURSIVE {SHARD_SQL} {PACK_SQL.format(rows='SELECT shard AS grp, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY duration_ms DESC, id) AS rn, id, duration_ms AS len FROM sh', budget=120000)}
SELECT grp AS shard, id, len AS duration_ms, batch_no FROM walk""",
)
def pack_duration(spark, sf_dir):
    return corpus.pack_longest_first(sharded(spark, sf_dir), 120000)


@query(
    "grp_pack_bucket",
    views="v_manifest",
    sql=f"""WITH RECURSIVE {SHARD_SQL},
r AS (SELECT shard, b AS bucket, id, duration_ms, ROW_NUMBER() OVER (PARTITION BY shard, b ORDER BY id) AS rn FROM (SELECT *, CAST(GREATEST(CEIL((duration_ms-500)*20/29500.0)-1, 0) AS BIGINT) AS b FROM sh WHERE duration_ms BETWEEN 500 AND 30000)),
walk AS (SELECT shard, bucket, rn, id, duration_ms, 0::BIGINT AS batch_no, 1 AS held, duration_ms AS longest FROM r WHERE rn=1
  UNION ALL SELECT r.shard, r.bucket, r.rn, r.id, r.duration_ms, CASE WHEN w.longest*(w.held+1) >= 60000 OR w.held >= 6 THEN w.batch_no+1 ELSE w.batch_no END,
    CASE WHEN w.longest*(w.held+1) >= 60000 OR w.held >= 6 THEN 1 ELSE w.held+1 END, CASE WHEN w.longest*(w.held+1) >= 60000 OR w.held >= 6 THEN r.duration_ms ELSE GREATEST(w.longest, r.duration_ms) END
  FROM walk w JOIN r ON r.shard=w.shard AND r.bucket=w.bucket AND r.rn=w.rn+1)
SELECT shard, bucket, id, duration_ms, batch_no FROM walk""",
)
def pack_bucket(spark, sf_dir):
    return corpus.pack_buckets(sharded(spark, sf_dir), 60000, 6)


def _draw_sql(salt: str) -> str:
    return f"(CAST('0x' || LEFT(MD5(id || ':11:' || {salt}), 12) AS BIGINT)/281474976710656.0::DOUBLE)"


def _flags_sql(clean: str) -> str:
    return f"""d AS (SELECT *, {clean} AS clean_start FROM v_manifest),
e AS (SELECT *, clean_start IS NULL AND {_draw_sql("'drop'")} < 0.1 AS drop_cond FROM d),
f AS (SELECT *, NOT drop_cond AND {_draw_sql("'language'")} < 0.8 AS use_language, NOT drop_cond AND {_draw_sql("'instruct'")} < 0.5 AS use_instruct FROM e),
fl AS (SELECT *, CASE WHEN drop_cond OR (use_instruct AND {_draw_sql("'only'")} < 0.3) THEN 0.0::DOUBLE ELSE 0.0::DOUBLE + {_draw_sql("'prompt'")} * 0.3::DOUBLE END AS prompt_ratio,
  0.0::DOUBLE + {_draw_sql("'mask'")} * 1.0::DOUBLE AS mask_ratio FROM f)"""


@query(
    "num_cond_flags",
    views="v_manifest",
    sql=f"WITH {_flags_sql('CASE WHEN source=$$src3$$ THEN 40 END')} SELECT id, clean_start, drop_cond, use_language, use_instruct, prompt_ratio, mask_ratio FROM fl",
)
def cond_flags(spark, sf_dir):
    clean = F.when(F.col("source") == "src3", 40)
    return corpus.condition_flags(views.manifest(spark, sf_dir).select("id", clean.alias("clean_start")), 11)


MASK_SQL = f"""WITH {_flags_sql('NULL')},
t AS (SELECT id, drop_cond, mask_ratio, string_split_regex(text, '\\s+') AS w, CAST(FLOOR(len(string_split_regex(text, '\\s+')) * prompt_ratio) AS INTEGER) AS prompt_length FROM fl),
u AS (SELECT *, UNNEST(range(0, len(w))) AS i FROM t),
m AS (SELECT *, i >= prompt_length AND {_draw_sql('i')} < mask_ratio AS masked FROM u)
SELECT id, CAST(len(w) AS INTEGER) AS n, prompt_length, CAST(COUNT(*) FILTER (masked) AS INTEGER) AS masked,
  CAST(COUNT(*) FILTER (NOT (masked OR (drop_cond AND i < prompt_length))) AS INTEGER) AS no_loss FROM m GROUP BY ALL"""


@query("num_mask_tokens", views="v_manifest", sql=MASK_SQL)
def mask_tokens(spark, sf_dir):
    """Word lengths of each text stand in for its audio tokens."""
    words = F.transform(F.split("text", r"\s+"), lambda w: F.length(w))
    rows = views.manifest(spark, sf_dir).select("id", words.alias("tokens"), F.lit(None).cast("int").alias("clean_start"))
    flagged = corpus.condition_flags(rows, 11)
    prompt = F.floor(F.size("tokens") * F.col("prompt_ratio")).cast("int")
    out = corpus.mask_tokens(flagged.withColumn("prompt_length", prompt), 11, 1024)
    lossless = F.size(F.filter("labels", lambda x: x == corpus.NO_LOSS))
    masked = F.size(F.filter("input_ids", lambda x: x == 1024))
    return out.select("id", F.size("tokens").alias("n"), "prompt_length", masked.alias("masked"), lossless.alias("no_loss"))


@query(
    "str_style_prompt",
    views="v_manifest",
    sql="""SELECT id, CASE WHEN source='src1' THEN '<|denoise|>' ELSE '' END || '<|lang_start|>' || CASE WHEN source='src2' THEN 'None' ELSE language_id END || '<|lang_end|><|instruct_start|>None<|instruct_end|>' AS style,
  '<|text_start|>' || text || '<|text_end|>' AS prompt FROM v_manifest""",
)
def style_prompt(spark, sf_dir):
    lang = F.when(F.col("source") != "src2", F.col("language_id"))
    none = F.lit(None).cast("string")
    return views.manifest(spark, sf_dir).select(
        "id",
        corpus.style_prompt(lang, none, F.col("source") == "src1").alias("style"),
        corpus.text_prompt(F.col("text"), none, F.lit(True)).alias("prompt"),
    )


@query("udf_processor", sql="SELECT doc_id AS id, CASE WHEN lang='es' THEN NULL ELSE CAST(LENGTH(text) AS BIGINT) END AS length, CASE WHEN lang='es' THEN 'ValueError: unsupported language es' END AS error FROM documents")
def udf_processor(spark, sf_dir):
    def measure(pdf):
        if (pdf["language_id"] == "es").any():
            raise ValueError("unsupported language es")
        return pdf.assign(length=pdf["text"].str.len())[["id", "length"]]

    rows = views.manifest(spark, sf_dir)
    return corpus.process_samples(rows, measure, ["id", "text", "language_id"], "id long, length long")


@query(
    "sink_eval_json",
    sql="""WITH c AS (SELECT event_type AS suite, event_id AS case_id, user_id%9<>0 AND user_id%10<>0 AND value > 20 AS passed FROM events)
SELECT suite, '{"suite":"' || suite || '","total":' || COUNT(*) || ',"passed":' || COUNT(*) FILTER (passed) || ',"failed":' || COUNT(*) FILTER (NOT passed) || ',"pass_rate":' || CAST(ROUND(COUNT(*) FILTER (passed)/CAST(COUNT(*) AS DOUBLE), 4) AS VARCHAR) || '}' AS line FROM c GROUP BY 1
UNION ALL SELECT suite, '{"case_id":' || case_id || ',"passed":' || CASE WHEN passed THEN 'true' ELSE 'false' END || '}' FROM c""",
)
def eval_json(spark, sf_dir):
    from cuewright.operators.rollups import pass_rate
    from cuewright.plans.history import _cases

    cases = _cases(spark, sf_dir)
    ok = F.col("transcript").isNotNull() & F.col("judge_error").isNull() & F.col("judge_passed")
    path = scratch_path(spark, "evaluation")
    writers.write_ordered_lines(writers.eval_report_lines(cases.withColumn("passed", ok), pass_rate(cases, ["suite"])), path, "suite", "line_no")
    return spark.read.schema("value string, suite string").text(path).select("suite", F.col("value").alias("line"))
