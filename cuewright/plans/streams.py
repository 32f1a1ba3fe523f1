"""Streaming queries, run over what is there now and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import views
from cuewright.functions.sentences import Release
from cuewright.plans.history import ERR_SQL, errors
from cuewright.plans.registry import query
from cuewright.plans.windows import EVENT_KEEP, RATE_MS, downloads
from cuewright.session import scratch_path
from cuewright.streaming import jobs
from cuewright.views import table


def as_stream(spark, df, label):
    """Store a derived table and open it as a stream."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return jobs.read_stream(spark, path, df.schema)


def paths(spark, label):
    return scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")


@query(
    "stm_event_replay",
    views="v_job_events",
    sql="""SELECT job_id, seq, event_id, kind FROM (SELECT *, MIN(CASE WHEN kind='purchase' THEN seq END) OVER (PARTITION BY job_id) AS final FROM v_job_events) x WHERE seq > 5 AND seq <= COALESCE(final, seq)""",
)
def event_replay(spark, sf_dir):
    """Events of jobs that a purchase ends."""
    jobs.use_state_store(spark)
    out, checkpoint = paths(spark, "replay")
    log = views.job_events(spark, sf_dir).select("job_id", F.col("created_at").cast("timestamp").alias("ts"), "seq", "event_id", "kind")
    jobs.run_append(jobs.replay(as_stream(spark, log, "log"), 5, ("purchase",)), out, checkpoint)
    return spark.read.parquet(out)


def audio(spark, sf_dir):
    """Audio bursts of a session per user: bytes by event value, purchases pause and signups resume."""
    kind = F.when(F.col("event_type") == "purchase", "pause").when(F.col("event_type") == "signup", "resume").otherwise("audio")
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        at.alias("ts"),
        F.unix_millis(at).alias("at_ms"),
        F.col("event_id").alias("row_no"),
        F.round(F.col("value") * 2000).cast("long").alias("bytes"),
        kind.alias("kind"),
    )


@query("stm_silence_session")
def silence_session(spark, sf_dir):
    jobs.use_state_store(spark)
    out, checkpoint = paths(spark, "utterances")
    jobs.run_append(jobs.utterances(as_stream(spark, audio(spark, sf_dir), "audio")), out, checkpoint)
    return spark.read.parquet(out)


def tokens(spark, sf_dir):
    """Words of every conversation turn as a token stream, a tenth of a second apart."""
    words = F.split("text", "(?<=[ \n])")
    start = F.lit("2024-01-01").cast("timestamp")
    rows = table(spark, sf_dir, "conversations").filter(F.trim("text") != "")
    # Split and counted once per turn, before there is a row per word.
    rows = rows.select((F.shiftleft("conv_id", 32) + F.col("turn")).alias("session"), words.alias("words"), F.size(words).alias("n"))
    rows = rows.select("session", F.posexplode("words").alias("token_no", "token"), "n")
    return rows.select(
        "session",
        (start + F.make_dt_interval(secs=F.col("token_no") * 0.1)).alias("ts"),
        F.col("token_no").cast("long").alias("token_no"),
        "token",
        (F.col("token_no") == F.col("n") - 1).alias("is_last"),
    )


@query("stm_sentence_chunker")
def sentence_chunker(spark, sf_dir):
    jobs.use_state_store(spark)
    out, checkpoint = paths(spark, "sentences")
    jobs.run_append(jobs.sentences(as_stream(spark, tokens(spark, sf_dir), "tokens"), Release(early_clause=True)), out, checkpoint)
    return spark.read.parquet(out)


@query(
    "stm_rolling_rate",
    sql=f"""WITH d AS (SELECT user_id AS job_id, epoch_us(ts)//1000 AS at_ms, event_id AS sample_no,
  CAST(SUM(CAST(ROUND(value*100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)//1000, event_id) AS BIGINT) AS bytes_done FROM events),
f AS (SELECT *, MIN((at_ms, sample_no, bytes_done)) OVER w AS a, MAX((at_ms, sample_no, bytes_done)) OVER w AS b FROM d WINDOW w AS (PARTITION BY job_id ORDER BY at_ms RANGE BETWEEN {RATE_MS} PRECEDING AND CURRENT ROW))
SELECT job_id, at_ms, sample_no, bytes_done, ROUND(CASE WHEN b[1]>a[1] THEN (b[3]-a[3])*1000.0::DOUBLE/(b[1]-a[1]) ELSE 0.0::DOUBLE END, 9) AS rate FROM f
QUALIFY at_ms - COALESCE(LAG(at_ms) OVER (PARTITION BY job_id ORDER BY at_ms, sample_no), -1000) >= 300""",
)
def rolling_rate(spark, sf_dir):
    jobs.use_state_store(spark)
    out, checkpoint = paths(spark, "rates")
    jobs.run_append(jobs.rolling_rates(as_stream(spark, downloads(spark, sf_dir), "samples"), RATE_MS), out, checkpoint)
    return spark.read.parquet(out).withColumn("rate", F.round("rate", 9))


SESSION_CAP = 5


def session_errors(spark, sf_dir):
    return errors(spark, sf_dir).select(F.col("user_id").alias("session"), "fingerprint", F.col("created_at").cast("timestamp").alias("created_at"), "event_id")


@query(
    "stm_error_dedupe",
    sql=f"""WITH {ERR_SQL}, f AS (SELECT user_id AS session, fingerprint, MIN((created_at, event_id)) AS k FROM fp GROUP BY 1,2)
SELECT session, fingerprint, k[2] AS event_id FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY session ORDER BY k, fingerprint) <= {SESSION_CAP}""",
)
def error_dedupe(spark, sf_dir):
    out, checkpoint = paths(spark, "first-errors")
    jobs.use_state_store(spark)
    stream = as_stream(spark, session_errors(spark, sf_dir), "errors")
    jobs.run_append(jobs.first_errors(stream, SESSION_CAP), out, checkpoint)
    return spark.read.parquet(out).select("session", "fingerprint", "event_id")


@query(
    "stm_error_rollup",
    sql=f"WITH {ERR_SQL} SELECT fingerprint, COUNT(*) AS count, CAST(MIN(created_at) AS VARCHAR) AS first_seen, CAST(MAX(created_at) AS VARCHAR) AS last_seen FROM fp GROUP BY 1",
)
def error_rollup(spark, sf_dir):
    out, checkpoint = paths(spark, "rollup")
    store = jobs.ERROR_ROLLUP.store(spark, out)
    jobs.maintain(as_stream(spark, session_errors(spark, sf_dir), "errors"), jobs.ERROR_ROLLUP, store, checkpoint)
    return store.read().select("fingerprint", "count", *[F.col(c).cast("string").alias(c) for c in ("first_seen", "last_seen")])


@query(
    "stm_job_status",
    sql="""SELECT user_id AS job_id, CASE ARG_MAX(event_type, (ts, event_id)) WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'failed' END AS status, CAST(MAX(ts) AS VARCHAR) AS updated_at FROM events GROUP BY 1""",
)
def job_status(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "purchase", "done").when(kind == "error", "failed").otherwise("running")
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("created_at"), "event_id")
    out, checkpoint = paths(spark, "status")
    store = jobs.JOB_STATUS.store(spark, out)
    jobs.maintain(as_stream(spark, changes, "changes"), jobs.JOB_STATUS, store, checkpoint)
    rows = jobs.sweep_orphans(jobs.job_status(store.read()))
    return rows.withColumn("updated_at", F.col("updated_at").cast("string"))


@query(
    "stm_capped_log",
    views="v_job_events",
    sql=f"SELECT job_id, seq, event_id FROM v_job_events QUALIFY ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seq DESC) <= {EVENT_KEEP}",
)
def capped_log(spark, sf_dir):
    out, checkpoint = paths(spark, "capped")
    log = views.job_events(spark, sf_dir).select("job_id", "seq", "event_id")
    jobs.run_batches(as_stream(spark, log, "log"), jobs.capped_log(out, EVENT_KEEP), checkpoint)
    return jobs.read_capped_log(spark, out, EVENT_KEEP)


@query(
    "stm_token_rate",
    sql="""WITH e AS (SELECT user_id AS session, epoch_us(ts)//1000 AS t, CASE WHEN event_type IN ('view', 'click') THEN CAST(ROUND(value*1000) AS BIGINT) END AS a FROM events)
SELECT session, MIN(CASE WHEN a IS NOT NULL THEN t END)-MIN(t) AS first_audio_ms, MAX(t)-MIN(t) AS elapsed_ms, CAST(COALESCE(SUM(a), 0) AS BIGINT) AS audio_ms, ROUND((MAX(t)-MIN(t))/CAST(SUM(a) AS DOUBLE), 4) AS rtf FROM e GROUP BY 1""",
)
def token_rate(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "audio").otherwise("token")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        kind.alias("kind"),
        F.round(F.col("value") * 1000).cast("long").alias("audio_ms"),
    )
    out, checkpoint = paths(spark, "token-rate")
    store = jobs.TOKEN_TIMES.store(spark, out)
    jobs.maintain(as_stream(spark, rows, "token-events"), jobs.TOKEN_TIMES, store, checkpoint)
    return jobs.token_rates(store.read())
