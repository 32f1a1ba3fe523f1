"""Queries of evaluation scores and their averages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright import views
from cuewright.functions import scoring, speech
from cuewright.functions import text as T
from cuewright.operators import evaluation
from cuewright.plans.registry import query
from cuewright.session import scratch_path, spread
from cuewright.sources import writers
from cuewright.views import table

# Counting errors by position needs pairs with one best alignment. Words altered here carry a letter
# that occurs nowhere else, so an altered word matches nothing: any other alignment costs more.
# Words are lost at the end of some turns and added at the end of others.
MARK = "ǂ"
PAIRS_SQL = f"""pairs AS (SELECT conv_id, turn, lang_name, CASE turn%3 WHEN 0 THEN truth || ' {MARK}q {MARK}r' ELSE truth END AS truth,
  CASE turn%3 WHEN 1 THEN REPLACE(truth, ' th', ' {MARK}') || ' {MARK}x' ELSE REPLACE(truth, ' th', ' {MARK}') END AS hypo FROM v_pairs)"""
SCORES_SQL = """
n AS (SELECT conv_id, turn, lang_name, TRIM(regexp_replace(LOWER(truth), '\\s+', ' ', 'g')) AS t, TRIM(regexp_replace(LOWER(hypo), '\\s+', ' ', 'g')) AS h FROM pairs),
w AS (SELECT *, string_split(t, ' ') AS tw, list_filter(string_split(h, ' '), lambda x: x <> '') AS hw FROM n),
e AS (SELECT *, len(list_filter(list_zip(tw, hw), lambda p: p[1] <> p[2])) AS substitutions, GREATEST(len(tw)-len(hw), 0) AS deletions, GREATEST(len(hw)-len(tw), 0) AS insertions FROM w),
sc AS (SELECT conv_id, turn, lang_name, substitutions, deletions, insertions, (substitutions+deletions+insertions)/CAST(GREATEST(len(tw), 1) AS DOUBLE) AS wer, len(tw) AS word_num FROM e)"""


def pairs(spark, sf_dir):
    """Evaluation pairs with substituted, lost and added words."""
    rows = views.pairs(spark, sf_dir)
    turn = F.col("turn") % 3
    heard = F.replace("truth", F.lit(" th"), F.lit(f" {MARK}"))
    return rows.select(
        "conv_id",
        "turn",
        "lang_name",
        F.when(turn == 0, F.concat("truth", F.lit(f" {MARK}q {MARK}r"))).otherwise(F.col("truth")).alias("truth"),
        F.when(turn == 1, F.concat(heard, F.lit(f" {MARK}x"))).otherwise(heard).alias("hypo"),
    )


def scores(spark, sf_dir):
    rows = spread(pairs(spark, sf_dir))
    lang, name = F.col("lang_name"), F.lit("plain")
    norm = [scoring.normalize_by_name(F.col(c), lang, name) for c in ("truth", "hypo")]
    return scoring.wer_counts(rows, ["conv_id", "turn", "lang_name"], *norm)


@query(
    "str_wer_counts",
    views="v_pairs",
    sql=f"WITH {PAIRS_SQL}, {SCORES_SQL} SELECT conv_id, turn, substitutions, deletions, insertions, ROUND(wer, 9) AS wer, word_num FROM sc",
)
def wer_counts(spark, sf_dir):
    out = scores(spark, sf_dir)
    return out.select("conv_id", "turn", "substitutions", "deletions", "insertions", F.round("wer", 9).alias("wer"), "word_num")


MICRO = "CAST(SUM(insertions) AS BIGINT) AS insertions, CAST(SUM(deletions) AS BIGINT) AS deletions, CAST(SUM(substitutions) AS BIGINT) AS substitutions, CAST(SUM(word_num) AS BIGINT) AS words, ROUND_EVEN(SUM(insertions+deletions+substitutions)/CAST(SUM(word_num) AS DOUBLE)*100, {d}) AS wer"


@query("agg_wer_micro", views="v_pairs", sql=f"WITH {PAIRS_SQL}, {SCORES_SQL} SELECT {MICRO.format(d=2)} FROM sc")
def wer_micro(spark, sf_dir):
    return evaluation.micro_wer(scores(spark, sf_dir))


@query("agg_wer_by_language", views="v_pairs", sql=f"WITH {PAIRS_SQL}, {SCORES_SQL} SELECT lang_name, {MICRO.format(d=3)} FROM sc GROUP BY 1")
def wer_by_language(spark, sf_dir):
    return evaluation.micro_wer(scores(spark, sf_dir), ["lang_name"], 3).orderBy("lang_name")


@query(
    "agg_wer_macro",
    views="v_pairs",
    sql=f"WITH {PAIRS_SQL}, {SCORES_SQL}, g AS (SELECT lang_name, {MICRO.format(d=3)} FROM sc GROUP BY 1) SELECT ROUND_EVEN(AVG(wer), 2) AS macro_wer, COUNT(*) AS groups FROM g",
)
def wer_macro(spark, sf_dir):
    return evaluation.macro_wer(scores(spark, sf_dir), "lang_name")


@query(
    "agg_wer_mean_of_rows",
    views="v_pairs",
    sql=f"WITH {PAIRS_SQL}, {SCORES_SQL} SELECT ROUND_EVEN(AVG(wer)*100, 2) AS mean_wer, ROUND_EVEN(SUM(insertions+deletions+substitutions)/CAST(SUM(word_num) AS DOUBLE)*100, 2) AS weighted_wer, COUNT(*) AS utterances FROM sc",
)
def wer_mean_of_rows(spark, sf_dir):
    return evaluation.mean_of_rows(scores(spark, sf_dir))


@query(
    "sink_wer_report",
    views="v_pairs",
    sql=f"""WITH {PAIRS_SQL}, {SCORES_SQL}, g AS (SELECT lang_name, {MICRO.format(d=3)} FROM sc GROUP BY 1), o AS (SELECT {MICRO.format(d=2)} FROM sc)
SELECT 1 AS section, conv_id || '-' || turn || chr(9) || CAST(ROUND(wer, 6) AS VARCHAR) || chr(9) || insertions || chr(9) || deletions || chr(9) || substitutions AS line FROM sc
UNION ALL SELECT 2, '[' || lang_name || ']' || chr(9) || CAST(wer AS VARCHAR) || chr(9) || insertions || chr(9) || deletions || chr(9) || substitutions || chr(9) || words FROM g
UNION ALL SELECT 3, '[Overall]' || chr(9) || CAST(wer AS VARCHAR) || chr(9) || insertions || chr(9) || deletions || chr(9) || substitutions || chr(9) || words FROM o""",
)
def report(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("name", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    # Three sections read the scores, and ordering the lines reads them again: pairs are scored once.
    scored = scratch_path(spark, "wer-scores")
    rows.drop("truth", "hypo").write.parquet(scored)
    rows = spark.read.schema(rows.drop("truth", "hypo").schema).parquet(scored)
    path = scratch_path(spark, "wer-report")
    writers.write_ordered_lines(evaluation.wer_report(rows, "lang_name", "name"), path, "section", "name")
    return spark.read.schema("value string, section int").text(path).select("section", F.col("value").alias("line"))


MEANS_SQL = """g AS (SELECT grp, SUM(v) AS s, COUNT(*) AS n FROM x GROUP BY 1)
SELECT 'group' AS level, CAST(grp AS VARCHAR) AS name, ROUND(s/n, 3) AS mean, n FROM g UNION ALL SELECT 'macro', NULL, ROUND(AVG(s/n), 3), COUNT(*) FROM g UNION ALL SELECT 'overall', NULL, ROUND(SUM(s)/SUM(n), 3), CAST(SUM(n) AS BIGINT) FROM g"""


@query(
    "agg_similarity",
    views="v_emb_pairs",
    sql=f"WITH x AS (SELECT lang AS grp, list_cosine_similarity(CAST(ref_emb AS DOUBLE[]), CAST(eval_emb AS DOUBLE[])) AS v FROM v_emb_pairs), {MEANS_SQL}",
)
def similarity(spark, sf_dir):
    rows = views.emb_pairs(spark, sf_dir).select("lang", speech.cosine(F.col("ref_emb"), F.col("eval_emb")).alias("v"))
    return evaluation.score_means(rows, "lang", "v")


@query("agg_mos", sql=f"WITH x AS (SELECT event_type AS grp, value/20 AS v FROM events), {MEANS_SQL}")
def mos(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 20).alias("v"))
    return evaluation.score_means(rows, "event_type", "v")


@query(
    "agg_rtf",
    sql="""WITH r AS (SELECT CAST(ROUND(value*100) AS BIGINT) AS s, CAST(json_extract_string(props, '$.k') AS BIGINT)*100 AS a FROM events)
SELECT CAST(SUM(s) AS BIGINT) AS synth_ms, CAST(SUM(a) AS BIGINT) AS audio_ms, ROUND(SUM(s)/CAST(SUM(a) AS DOUBLE), 4) AS rtf, COUNT(*) FILTER (a=0) AS infinite_rows FROM r""",
)
def rtf(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.round(F.col("value") * 100).cast("long").alias("synth_ms"), (F.get_json_object("props", "$.k").cast("long") * 100).alias("audio_ms")
    )
    return evaluation.real_time_factor(rows)


@query(
    "str_norm_multilingual",
    sql="""SELECT doc_id, TRIM(regexp_replace(regexp_replace(regexp_replace(LOWER(nfc_normalize(t)), '\\([^)]*[0-9][^)]*\\)', ' ', 'g'), '[\\pP<>]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm
FROM (SELECT doc_id, '(Sam 23:17) x ' || regexp_replace(text, '[^a-zA-ZÀ-ÿ0-9 .,;:!?%*#&@()\\n-]', ' ', 'g') AS t FROM documents) x""",
)
def norm_multilingual(spark, sf_dir):
    body = F.concat(F.lit("(Sam 23:17) x "), F.regexp_replace("text", r"[^a-zA-ZÀ-ÿ0-9 .,;:!?%*#&@()\n-]", " "))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", body.alias("t"), F.when(F.col("lang") == "en", "eng").otherwise("*").alias("iso"))
    return rows.select("doc_id", scoring.normalize_multilingual(F.col("t"), F.col("iso")).alias("norm"))


@query(
    "udf_normalizer",
    sql="""SELECT doc_id, CASE WHEN lang='en' THEN TRIM(regexp_replace(regexp_replace(LOWER(text), '[^a-zA-Z0-9'']', ' ', 'g'), '\\s+', ' ', 'g')) ELSE TRIM(regexp_replace(LOWER(text), '\\s+', ' ', 'g')) END AS norm
FROM (SELECT doc_id, lang, REPLACE(REPLACE(text, '‘', ''''), '’', '''') AS text FROM documents) x""",
)
def udf_normalizer(spark, sf_dir):
    """The normaliser is chosen by a column of the row."""
    name = F.when(F.col("lang") == "en", "alnum").otherwise("plain")
    straight = F.translate("text", "‘’", "''")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", scoring.normalize_by_name(straight, F.col("lang"), name).alias("norm"))


@query(
    "udf_case_runner",
    sql="""SELECT event_id AS case_id, CASE WHEN user_id%5=0 THEN NULL WHEN user_id%5=1 THEN 'part' ELSE props END AS transcript,
  CASE WHEN user_id%5=0 OR user_id%5=2 THEN 0.0::DOUBLE ELSE 1.0 END AS score, CASE user_id%5 WHEN 0 THEN 'RuntimeError: no agent' WHEN 1 THEN 'TimeoutError: slow' WHEN 2 THEN 'judge: ValueError: unreadable' END AS error FROM events""",
)
def case_runner(spark, sf_dir):
    def run(row):
        if row.user_id % 5 == 0:
            raise RuntimeError("no agent")
        if row.user_id % 5 == 1:
            late = TimeoutError("slow")
            late.partial = "part"
            raise late
        return row.props

    def judge(row, transcript):
        if row.user_id % 5 == 2:
            raise ValueError("unreadable")
        return 1.0

    cases = table(spark, sf_dir, "events").withColumnRenamed("event_id", "case_id")
    out = evaluation.score_cases(cases, run, judge, ["case_id", "user_id", "props"])
    return out.select("case_id", "transcript", "score", "error")


@query("udaf_wer", views="v_pairs", sql=f"WITH {PAIRS_SQL}, {SCORES_SQL} SELECT lang_name, {MICRO.format(d=2)} FROM sc GROUP BY 1")
def udaf_wer(spark, sf_dir):
    """Error rates need sums only; no custom aggregate function."""
    return evaluation.micro_wer(scores(spark, sf_dir), ["lang_name"])


@query(
    "str_token_drift",
    views="v_pairs",
    sql=f"""WITH {PAIRS_SQL}, t AS (SELECT conv_id, turn, regexp_extract_all(LOWER(truth), '[\\pL\\pM\\pN_]+') AS tw, regexp_extract_all(LOWER(hypo), '[\\pL\\pM\\pN_]+') AS hw FROM pairs),
d AS (SELECT conv_id, turn, CASE WHEN len(tw)=0 THEN CASE WHEN len(hw)=0 THEN 0.0::DOUBLE ELSE 1.0 END ELSE (len(list_filter(list_zip(tw, hw), lambda p: p[1] IS DISTINCT FROM p[2])))/CAST(len(tw) AS DOUBLE) END AS d FROM t)
SELECT conv_id, turn, ROUND_EVEN(d, 3) AS drift, d >= 0.5 AS flagged FROM d""",
)
def token_drift(spark, sf_dir):
    drift = T.token_drift(F.col("truth"), F.col("hypo"))
    rows = spread(pairs(spark, sf_dir)).select("conv_id", "turn", drift.alias("d"))
    return rows.select("conv_id", "turn", F.bround("d", 3).alias("drift"), (F.col("d") >= 0.5).alias("flagged"))
