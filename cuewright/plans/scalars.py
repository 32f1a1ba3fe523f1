"""Queries of numeric, time, JSON and hash scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import views
from cuewright.functions import hashing, speech
from cuewright.functions.hashing import canonical_sql
from cuewright.operators import documents, timeline
from cuewright.plans import shapes
from cuewright.plans.registry import query
from cuewright.session import spread
from cuewright.sources.subtitles import clock
from cuewright.views import table


def _count(t: str, cls: str) -> str:
    return f"LENGTH(regexp_replace({t}, '[^{cls}]', '', 'g'))"


def _classes(t: str) -> str:
    """Weight in tenths for texts of Latin letters with kana marks put in."""
    other = f"LENGTH(regexp_replace({t}, '[\\pM\\x{{640}}\\pP\\pS\\pZ\\pN]', '', 'g'))"
    kana = _count(t, "か")
    return f"({_count(t, chr(92) + 'pZ')}*2 + {_count(t, chr(92) + 'pP' + chr(92) + 'pS')}*5 + {_count(t, chr(92) + 'pN')}*35 + {other}*10 + {kana}*12)"


@query(
    "num_script_weight",
    sql=f"WITH t AS (SELECT doc_id, REPLACE(text, 'th', 'か') AS t FROM documents) SELECT doc_id, {_classes('t')}/10.0::DOUBLE AS weight FROM t",
)
def script_weight(spark, sf_dir):
    kana = F.replace("text", F.lit("th"), F.lit("か"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", speech.script_weight(kana).alias("weight"))


@query(
    "num_estimate_duration",
    views="v_pairs",
    sql=f"""WITH w AS (SELECT conv_id, turn, {_classes('truth')}/10.0::DOUBLE AS rw, {_classes('hypo')}/10.0::DOUBLE AS tw, CASE WHEN turn=5 THEN 0.0::DOUBLE ELSE LENGTH(truth)/15.0::DOUBLE END AS rd FROM v_pairs),
e AS (SELECT *, CASE WHEN rd <= 0 OR rw=0 THEN NULL ELSE tw/(rw/rd) END AS raw FROM w)
SELECT conv_id, turn, ROUND(CASE WHEN raw IS NULL THEN 0 WHEN raw < 50 THEN POWER(raw/50, 1/3.0::DOUBLE)*50 ELSE raw END, 6) AS seconds FROM e""",
)
def estimate_duration(spark, sf_dir):
    seconds = F.when(F.col("turn") == 5, 0.0).otherwise(F.length("truth") / 15.0)
    rows = views.pairs(spark, sf_dir).select(
        "conv_id", "turn", seconds.alias("rd"), speech.script_weight(F.col("truth")).alias("rw"), speech.script_weight(F.col("hypo")).alias("tw")
    )
    out = speech.estimate_duration(F.col("tw"), F.col("rw"), F.col("rd"))
    return rows.select("conv_id", "turn", F.round(out, 6).alias("seconds"))


CPS_SQL = "CASE lang WHEN 'en' THEN 15.0::DOUBLE WHEN 'de' THEN 14.0 WHEN 'fr' THEN 15.0 WHEN 'es' THEN 15.5 ELSE 13.0 END"


@query("num_expected_duration", sql=f"SELECT doc_id, ROUND(LENGTH(text)/{CPS_SQL}, 6) AS seconds FROM documents")
def expected_duration(spark, sf_dir):
    tag = F.concat("lang", F.lit("-XX"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(speech.expected_duration(F.col("text"), tag), 6).alias("seconds"))


@query(
    "num_rate_ratio",
    sql=f"SELECT doc_id, ROUND(CASE WHEN doc_id%9=0 THEN 1.0 ELSE LENGTH(text)/{CPS_SQL}/(doc_id%9*10) END, 6) AS ratio FROM documents",
)
def rate_ratio(spark, sf_dir):
    slot = (F.col("doc_id") % 9 * 10).cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(speech.rate_ratio(F.col("text"), slot, F.col("lang")), 6).alias("ratio"))


@query(
    "num_fit_one",
    sql="""WITH n AS (SELECT event_id, value/20 AS need FROM events),
r AS (SELECT *, CASE WHEN need <= 1+1e-9 THEN CASE WHEN need > 1e-9 AND need < 0.95 THEN GREATEST(need, 0.85::DOUBLE) ELSE 1.0::DOUBLE END WHEN need <= 1.2+1e-9 THEN need ELSE LEAST(need, 1.8::DOUBLE) END AS a FROM n)
SELECT event_id, ROUND(a, 6) AS audio_rate, 1.0::DOUBLE AS video_ratio, CASE WHEN need <= 1+1e-9 THEN CASE WHEN need > 1e-9 AND need < 0.95 THEN 'audio_slowed' ELSE 'fits' END
  WHEN need <= 1.2+1e-9 THEN 'audio_stretched' WHEN a >= need-1e-9 THEN 'audio_stretched' ELSE 'overflow_trimmed' END AS status FROM r""",
)
def fit_one(spark, sf_dir):
    """Rates without video retiming; win_fit_plan covers the hybrid split."""
    audio, video, status = timeline.fit_rates(F.col("need"), timeline.FitSettings(retime=False))
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 20).alias("need"))
    return rows.select("event_id", F.round(audio, 6).alias("audio_rate"), video.alias("video_ratio"), status.alias("status"))


@query(
    "num_cosine",
    views="v_emb_pairs",
    sql="SELECT id, ROUND(list_cosine_similarity(CAST(ref_emb AS DOUBLE[]), CAST(eval_emb AS DOUBLE[])), 9) AS similarity FROM v_emb_pairs",
)
def cosine(spark, sf_dir):
    return views.emb_pairs(spark, sf_dir).select("id", F.round(speech.cosine(F.col("ref_emb"), F.col("eval_emb")), 9).alias("similarity"))


@query(
    "num_peak_normalize",
    sql="""WITH x AS (SELECT vec_id, UNNEST(embedding) AS v, UNNEST(range(0, len(embedding))) AS pos FROM embeddings)
SELECT vec_id, pos, ROUND(CAST(v AS DOUBLE)/(MAX(ABS(CAST(v AS DOUBLE))) OVER (PARTITION BY vec_id)+1e-7)*0.9, 9) AS sample FROM x""",
)
def peak_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(speech.peak_normalize(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 9).alias("sample"))


@query(
    "num_uptime_bucket",
    sql="""WITH u AS (SELECT event_id, CASE WHEN user_id=3 THEN NULL ELSE value*value*value END AS s FROM events)
SELECT event_id, CASE WHEN s IS NULL THEN 'unknown' WHEN s < 10 THEN 'lt_10s' WHEN s < 60 THEN 'lt_1m' WHEN s < 600 THEN 'lt_10m' WHEN s < 3600 THEN 'lt_1h' WHEN s < 86400 THEN 'lt_1d' ELSE 'ge_1d' END AS bucket FROM u""",
)
def uptime_bucket(spark, sf_dir):
    s = F.when(F.col("user_id") != 3, F.col("value") * F.col("value") * F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", speech.uptime_bucket(s).alias("bucket"))


@query(
    "time_epoch",
    sql="SELECT event_id, CAST(make_timestamp(1700000000000000 + event_id*3600000000) AS VARCHAR) AS at_text, CAST(CAST(make_timestamp(1700000000000000 + event_id*3600000000) AS DATE) AS VARCHAR) AS day FROM events",
)
def time_epoch(spark, sf_dir):
    at = speech.epoch_to_timestamp((F.col("event_id") * 3600 + 1700000000).cast("double"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at_text"), F.to_date(at).cast("string").alias("day")
    )


@query("time_srt", views="v_segments", sql="SELECT job_id, seg_no, start_ms AS parsed_ms FROM v_segments")
def time_srt(spark, sf_dir):
    """A cue time formatted and parsed again."""
    return views.segments(spark, sf_dir).select("job_id", "seg_no", speech.parse_clock(clock(F.col("start_ms"), ",")).alias("parsed_ms"))


@query(
    "json_explode_segments",
    sql="""SELECT o_orderkey AS job_id, k AS pos, 's' || k AS id, CAST(k*1.5 AS DOUBLE) AS start, CAST(k*1.5+1 AS DOUBLE) AS end, o_orderpriority AS text
FROM orders, (SELECT UNNEST(range(0, 2)) AS k) WHERE o_orderstatus <> 'P'""",
)
def explode_segments(spark, sf_dir):
    seg = lambda k: F.struct(F.lit(f"s{k}").alias("id"), F.lit(k * 1.5).alias("start"), F.lit(k * 1.5 + 1).alias("end"), F.col("o_orderpriority").alias("text"))
    whole = F.to_json(F.struct(F.array(seg(0), seg(1)).alias("segments")))
    broken = F.when(F.col("o_orderstatus") == "P", F.left(whole, F.lit(20))).otherwise(whole)
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), broken.alias("job_data"))
    return documents.explode_segments(jobs, "job_data")


@query(
    "json_flatten_keys",
    sql="""SELECT p_partkey AS id, UNNEST(['common.name', 'common.size.value', 'common.size.unit', 'type']) AS path, UNNEST([p_name, CAST(p_size AS VARCHAR), 'mm', p_type]) AS value FROM part""",
)
def flatten_keys(spark, sf_dir):
    size = F.struct(F.col("p_size").alias("value"), F.lit("mm").alias("unit"))
    nested = F.to_json(F.struct(F.struct(F.col("p_name").alias("name"), size.alias("size")).alias("common"), F.col("p_type").alias("type")))
    return documents.flatten_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), nested.alias("doc")), "doc")


@query(
    "json_words_from_asr",
    views="v_words",
    sql="""SELECT job_id, seg_no, word_no-1 AS pos, word AS text, word_start/1000.0::DOUBLE AS start, CASE WHEN word_end <= word_start THEN word_start/1000.0::DOUBLE+0.05 ELSE word_end/1000.0::DOUBLE END AS end FROM v_words WHERE seg_no%2=0
UNION ALL SELECT job_id, seg_no, k, CASE k WHEN 0 THEN 'hello' ELSE 'you' END, s+k*((e-s)/2), s+(k+1)*((e-s)/2) FROM (SELECT DISTINCT job_id, seg_no, seg_no*1.0::DOUBLE AS s, seg_no+2.0::DOUBLE AS e FROM v_words WHERE seg_no%2=1) x, (SELECT UNNEST(range(0, 2)) AS k)""",
)
def words_from_asr(spark, sf_dir):
    """Recogniser output per segment: word timings for even ones, a chunk only for odd ones."""
    entry = F.struct("word_no", F.col("word"), (F.col("word_start") / 1000).alias("start"), (F.col("word_end") / 1000).alias("end"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    per = views.words(spark, sf_dir).groupBy("job_id", "seg_no").agg(ordered.alias("words"))
    exact = F.to_json(F.struct(F.array(F.struct("words")).alias("segments")))
    s = F.col("seg_no").cast("double")
    chunk = F.struct(F.lit(" hello   you ").alias("text"), F.array(s, s + 2).alias("timestamp"))
    coarse = F.to_json(F.struct(F.array(chunk).alias("chunks")))
    result = F.when(F.col("seg_no") % 2 == 0, exact).otherwise(coarse)
    return documents.recognised_words(per.select("job_id", "seg_no", result.alias("asr")), "asr")


SEG_FIELDS = {"text": "text", "target_lang": "'de'", "profile_id": "speaker_id", "instruct": "NULL", "speed": "CAST(1 AS DOUBLE)", "direction": "''", "effect_preset": "'broadcast'"}


@query(
    "hash_segment_fingerprint",
    views="v_segments",
    sql=f"SELECT job_id, seg_no, LEFT(SHA1({canonical_sql(SEG_FIELDS)} || 'track_lang=de'), 16) AS fingerprint FROM v_segments",
)
def segment_fingerprint(spark, sf_dir):
    fields = {"text": F.col("text"), "target_lang": F.lit("de"), "profile_id": F.col("speaker_id"), "speed": F.lit(1), "effect_preset": F.lit("")}
    fp = hashing.segment_fingerprint(fields, F.lit("de"), F.lit("per_line"))
    return views.segments(spark, sf_dir).select("job_id", "seg_no", fp.alias("fingerprint"))


FIT_FIELDS = {"timing_strategy": "'smart_fit'", "max_audio_only_rate": "'1.2'", "audio_rate_cap": "CASE WHEN o_custkey%2=0 THEN '1.5' ELSE '1.7' END", "video_slow_cap": "'2.0'", "gap_guard_s": "'0.05'", "allow_video_retime": "'true'"}


@query("hash_fit_fingerprint", sql=f"SELECT o_orderkey AS job_id, LEFT(SHA1({canonical_sql(FIT_FIELDS)}), 16) AS fingerprint FROM orders")
def fit_fingerprint(spark, sf_dir):
    cap = F.when(F.col("o_custkey") % 2 == 1, F.lit(1.7))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), hashing.fit_fingerprint({"audio_rate_cap": cap}).alias("fingerprint"))


@query(
    "hash_transcript",
    views="v_segments",
    sql="""WITH b AS (SELECT job_id, seg_no//4096 AS b, SHA256(STRING_AGG(TRIM(text) || chr(0), '' ORDER BY seg_no)) AS d FROM v_segments GROUP BY 1,2)
SELECT job_id, LEFT(SHA256(STRING_AGG(d, '' ORDER BY b)), 16) AS digest FROM b GROUP BY 1""",
)
def transcript_hash(spark, sf_dir):
    return documents.transcript_digest(views.segments(spark, sf_dir))


SPAN_FIELDS = {"voice": "speaker_id", "text": "text", "pause": "CAST(350 AS VARCHAR)", "speed": "NULL"}
SEGMENT_KEY = {"sr": "'24000'", "engine": "'e'", "voice": "speaker_id", "text": "text", "speed": "NULL", "extra": "'lex'"}


@query(
    "hash_cache_keys",
    views="v_segments",
    sql=f"""WITH s AS (SELECT job_id, seg_no, SHA1({canonical_sql(SPAN_FIELDS)}) AS d, LEFT(SHA1({canonical_sql(SEGMENT_KEY)} || CASE WHEN seg_no=3 THEN 'nonce=3' ELSE '' END), 20) AS k FROM v_segments),
b AS (SELECT job_id, seg_no//4096 AS b, SHA1('sr=24000;engine=e;' || STRING_AGG(d, '' ORDER BY seg_no)) AS d FROM s GROUP BY 1,2),
c AS (SELECT job_id, LEFT(SHA1(STRING_AGG(d, '' ORDER BY b)), 20) AS cache_key FROM b GROUP BY 1)
SELECT job_id, seg_no, k AS segment_key, cache_key FROM s JOIN c USING (job_id)""",
)
def cache_keys(spark, sf_dir):
    segs = views.segments(spark, sf_dir)
    none = F.lit(None).cast("double")
    spans = segs.select("job_id", F.col("seg_no").alias("span_no"), F.col("speaker_id").alias("voice"), "text", F.lit(350).alias("pause_ms"), none.alias("speed"))
    chapters = documents.chapter_cache_key(spans, ["job_id"], 24000, "e")
    nonce = F.when(F.col("seg_no") == 3, 3).otherwise(0)
    key = documents.segment_cache_key(F.col("text"), F.col("speaker_id"), none, 24000, "e", "lex", nonce)
    return segs.select("job_id", "seg_no", key.alias("segment_key")).join(chapters, "job_id")


# CRC-32 by bytes: the table of a byte comes from eight steps of the reversed polynomial.
CRC_SQL = """tab AS (SELECT LIST(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) AS r(n))),
bytes AS (SELECT job_id, seg_no, list_transform(range(1, octet_length(encode(text)) + 1), lambda i: CAST('0x' || SUBSTR(hex(encode(text)), 2*i-1, 2) AS BIGINT)) AS b FROM v_segments),
crc AS (SELECT job_id, seg_no, xor(list_reduce(b, lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM bytes, tab)"""


@query(
    "hash_segment_seed",
    views="v_segments",
    sql=f"WITH {CRC_SQL} SELECT job_id, seg_no, CAST((1234 + crc + seg_no * {documents.NONCE_MIX}) % {documents.SEED_SPACE} AS BIGINT) AS seed FROM crc",
)
def segment_seed(spark, sf_dir):
    seed = documents.segment_seed(F.lit(1234).cast("long"), F.col("text"), F.col("seg_no"))
    return views.segments(spark, sf_dir).select("job_id", "seg_no", seed.alias("seed"))


@query(
    "map_voice_signature",
    sql="""SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus='P' THEN '' ELSE '{"Alice":"p' || o_custkey || '","Zoe":"q' || o_orderstatus || '"}' END AS signature FROM orders""",
)
def voice_signature(spark, sf_dir):
    voices = F.create_map(
        F.lit("Zoe"), F.concat(F.lit("q"), "o_orderstatus"), F.lit("Alice"), F.concat(F.lit("p"), F.col("o_custkey").cast("string"))
    )
    given = F.when(F.col("o_orderstatus") != "P", voices)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), documents.map_signature(given).alias("signature"))
