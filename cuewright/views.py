"""Speech-shaped views over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.operators.ordered import row_number, scan, sum_before

MS_PER_CHAR_NUM, MS_PER_CHAR_DEN = 1000, 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation turn, laid end to end on the job's clock."""
    text_ms = F.floor(F.length("text") * MS_PER_CHAR_NUM / MS_PER_CHAR_DEN).cast("long")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("job_id"),
        F.col("turn").cast("long").alias("seg_no"),
        F.col("role").alias("speaker_id"),
        "text",
        text_ms.alias("dur_ms"),
        ((F.col("turn") * 7 % 5) * 400).cast("long").alias("gap_ms"),
    )
    placed = scan(
        rows, ["job_id"], ["seg_no"], [sum_before("start_ms", F.col("dur_ms") + F.col("gap_ms"))]
    )
    return placed.select(
        "job_id", "seg_no", "speaker_id", "text", "start_ms", (F.col("start_ms") + F.col("dur_ms")).alias("end_ms")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarizer turns: the segments shifted in time and labelled by role."""
    shift = 250 + (F.col("seg_no") % 3) * 12000
    return segments(spark, sf_dir).select(
        "job_id",
        F.col("seg_no").alias("turn_no"),
        (F.col("start_ms") + shift).alias("turn_start"),
        (F.col("end_ms") + shift).alias("turn_end"),
        F.when(F.col("speaker_id") == "system", "SPEAKER_00")
        .when(F.col("speaker_id") == "user", "SPEAKER_01")
        .otherwise("SPEAKER_02")
        .alias("speaker"),
    )


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``words``, those of a segment as arrays in one row; ``word_no`` is the number of the first."""
    tokens = F.split(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), " ")
    rows = segments(spark, sf_dir).filter(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")) != "").withColumn("tokens", tokens)
    return rows.select(
        "job_id",
        "seg_no",
        "speaker_id",
        F.lit(1).cast("long").alias("word_no"),
        F.col("tokens").alias("word"),
        F.transform("tokens", lambda _, i: _word_edge(i)).alias("word_start"),
        F.transform("tokens", lambda _, i: _word_edge(i + 1)).alias("word_end"),
    )


def _word_edge(pos: Column) -> Column:
    """Where the first ``pos`` words of a segment's ``tokens`` end."""
    return F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * pos / F.size("tokens"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a segment spread evenly over it, in integer milliseconds."""
    tokens = F.split(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), " ")
    return (
        segments(spark, sf_dir)
        .filter(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")) != "")
        .withColumn("tokens", tokens)
        .select("*", F.posexplode("tokens").alias("pos", "word"))
        .select(
            "job_id",
            "seg_no",
            "speaker_id",
            (F.col("pos") + 1).cast("long").alias("word_no"),
            "word",
            _word_edge(F.col("pos")).alias("word_start"),
            _word_edge(F.col("pos") + 1).alias("word_end"),
        )
    )


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation history: one take per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("mode"),
        F.col("user_id").alias("profile_id"),
        F.col("value").alias("duration_seconds"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 17 == 0, 1).otherwise(0).cast("int").alias("starred"),
        F.concat(F.lit("f"), (F.col("event_id") % 700).cast("string")).alias("audio_path"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log with a gapless sequence number per job."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        "event_id",
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("kind"),
        F.col("props").alias("payload"),
    )
    return scan(rows, ["job_id"], ["created_at", "event_id"], [row_number("seq")])


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("audio_path"),
        "text",
        F.col("lang").alias("language_id"),
        "source",
        F.floor(F.col("n_chars") * MS_PER_CHAR_NUM / MS_PER_CHAR_DEN).cast("long").alias("duration_ms"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and recognised text of an evaluation run."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.col("role").alias("lang_name"),
        F.col("text").alias("truth"),
        F.replace(F.col("text"), F.lit(" th"), F.lit(" ")).alias("hypo"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        F.concat(
            F.lit("dir"), F.substring("o_orderpriority", 1, 1), F.lit("/f"), F.col("o_orderkey").cast("string")
        ).alias("path"),
        F.floor("o_totalprice").cast("long").alias("bytes"),
        F.col("o_orderdate").alias("mtime"),
    )


def emb_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    nxt = emb.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("eval_emb"))
    ref = emb.select(F.col("vec_id").alias("id"), F.col("label").alias("lang"), F.col("embedding").alias("ref_emb"))
    return ref.join(nxt, "id")


SQL = {
    "v_segments": """
SELECT job_id, seg_no, speaker_id, text,
  CAST(COALESCE(SUM(dur_ms+gap_ms) OVER (PARTITION BY job_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS start_ms,
  CAST(COALESCE(SUM(dur_ms+gap_ms) OVER (PARTITION BY job_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)+dur_ms AS BIGINT) AS end_ms
FROM (SELECT conv_id AS job_id, CAST(turn AS BIGINT) AS seg_no, role AS speaker_id, text,
        CAST(FLOOR(LENGTH(text)*1000.0/15) AS BIGINT) AS dur_ms, ((turn*7)%5)*400 AS gap_ms FROM conversations) t""",
    "v_turns": """
SELECT job_id, seg_no AS turn_no, start_ms+250+(seg_no%3)*12000 AS turn_start, end_ms+250+(seg_no%3)*12000 AS turn_end,
  CASE speaker_id WHEN 'system' THEN 'SPEAKER_00' WHEN 'user' THEN 'SPEAKER_01' ELSE 'SPEAKER_02' END AS speaker FROM v_segments""",
    "v_words": """
SELECT job_id, seg_no, speaker_id, pos AS word_no, tokens[pos] AS word,
  start_ms + CAST(FLOOR((end_ms-start_ms)*(pos-1)/len(tokens)) AS BIGINT) AS word_start,
  start_ms + CAST(FLOOR((end_ms-start_ms)*pos/len(tokens)) AS BIGINT) AS word_end
FROM (SELECT *, UNNEST(range(1, len(tokens)+1)) AS pos FROM (
  SELECT *, string_split(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), ' ') AS tokens FROM v_segments
  WHERE trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) <> '') a) b""",
    "v_takes": """
SELECT event_id AS id, event_type AS mode, user_id AS profile_id, value AS duration_seconds, ts AS created_at,
  CASE WHEN event_id%17=0 THEN 1 ELSE 0 END AS starred, CONCAT('f', CAST(event_id%700 AS VARCHAR)) AS audio_path FROM events""",
    "v_job_events": """
SELECT user_id AS job_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts AS created_at, event_type AS kind, props AS payload FROM events""",
    "v_manifest": """
SELECT doc_id AS id, CONCAT('a/', CAST(doc_id AS VARCHAR), '.wav') AS audio_path, text, lang AS language_id, source, CAST(FLOOR(n_chars*1000.0/15) AS BIGINT) AS duration_ms FROM documents""",
    "v_pairs": """
SELECT conv_id, CAST(turn AS BIGINT) AS turn, role AS lang_name, text AS truth, REPLACE(text,' th',' ') AS hypo FROM conversations""",
    "v_files": """
SELECT o_orderkey AS file_id, CONCAT('dir', SUBSTR(o_orderpriority,1,1), '/f', CAST(o_orderkey AS VARCHAR)) AS path, CAST(FLOOR(o_totalprice) AS BIGINT) AS bytes, o_orderdate AS mtime FROM orders""",
    "v_emb_pairs": """
SELECT a.vec_id AS id, a.label AS lang, a.embedding AS ref_emb, b.embedding AS eval_emb FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1""",
}
NEEDS = {"v_turns": ["v_segments"], "v_words": ["v_segments"]}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views (and the views they need) as leading CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    heads = ", ".join(f"{n} AS ({SQL[n].strip()})" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"
