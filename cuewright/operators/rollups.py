"""Rollups of history, errors, crashes, storage and evaluation cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.hashing import short_sha1
from cuewright.functions.text import scrub
from cuewright.operators.ordered import row_number, scan

JOURNAL_SIZE = 50
LANGUAGE_ROWS = 12
# Crash sub-classes and their title patterns, first match wins.
CRASH_TITLES = [
    ("unreachable", r"(?i)can'?t reach the local .* backend|not answered|stopped responding"),
    ("never-started", r"(?i)still starting|abandoned before ready|failed to start"),
    ("backend-died", r"(?i)backend (died|ended uncleanly)|\[crash\]"),
]
BUILDS = ["current", "outdated", "unknown"]


def usage_summary(takes: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """One row of totals: takes, starred, audio and compute seconds, active days, first and last, table counts.

    Seconds are summed as whole milliseconds.
    """

    def seconds(column: str) -> Column:
        ms = F.round(F.col(column) * 1000).cast("long")
        return F.round(F.coalesce(F.sum(ms), F.lit(0)) / 1000, 1)

    out = takes.agg(
        F.count(F.lit(1)).alias("takes"),
        F.count_if(F.coalesce("starred", F.lit(0)) == 1).alias("starred"),
        seconds("duration_seconds").alias("audio_seconds"),
        seconds("generation_time").alias("compute_seconds"),
        F.count_distinct(F.to_date("created_at")).alias("active_days"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    ).withColumn("_one", F.lit(1))
    for name, df in dims.items():
        out = out.join(df.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def distribution(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; null and blank stay two groups named ``unknown``."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    counted = counted.orderBy(F.desc("count"), F.asc_nulls_last(column))
    if limit is not None:
        counted = counted.limit(limit)
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    return counted.select(F.when(blank, "unknown").otherwise(F.col(column)).alias("name"), "count")


def error_fingerprint(error_class: Column, kind: Column, message: Column) -> Column:
    """Digest of class, kind and the start of the message, personal parts taken out first."""
    return short_sha1(F.concat_ws("|", error_class, kind, F.left(scrub(message), F.lit(200))))


def error_journal(errors: DataFrame, keep: int = JOURNAL_SIZE) -> DataFrame:
    """Per fingerprint: count, first and last seen, first message (scrubbed), last non-empty route.

    ``errors`` has fingerprint, error_class, message, route, created_at, event_id.
    """
    at = F.struct("created_at", "event_id")
    routed = F.when(F.coalesce("route", F.lit("")) != "", at)
    entries = errors.groupBy("fingerprint").agg(
        F.min_by("error_class", at).alias("error_class"),
        scrub(F.min_by("message", at)).alias("message"),
        F.max_by("route", routed).alias("route"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.count(F.lit(1)).alias("count"),
    )
    return entries.orderBy(F.desc("last_seen"), "fingerprint").limit(keep)


def crash_class(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CRASH_TITLES):
        out = F.when(title.rlike(pattern), name).otherwise(out)
    return out


def build_bucket(body: Column, version: str | None = None) -> Column:
    """``current``, ``outdated`` or ``unknown``; a version line decides when a version is asked for."""
    stamp = (
        F.when(body.contains("**Build status:** OUTDATED"), "outdated")
        .when(body.contains("**Build status:** current at filing time"), "current")
        .otherwise("unknown")
    )
    if not version:
        return stamp
    line = F.regexp_extract(body, r"\*\*Version:\*\* `([^`]+)`", 1)
    base = F.split_part(line, F.lit("-"), F.lit(1))
    return F.when(line == "", stamp).when(base == version, "current").otherwise("outdated")


def crash_report(reports: DataFrame, version: str | None = None) -> DataFrame:
    """Counts per crash class and build bucket; classes without reports show zeros.

    ``recurrence`` is the number of reports of any class from current builds.
    """
    names = [n for n, _ in CRASH_TITLES]
    rows = reports.select(crash_class(F.col("title")).alias("crash_class"), build_bucket(F.col("body"), version).alias("b"))
    counted = rows.filter(F.col("crash_class").isNotNull()).groupBy("crash_class").agg(
        *[F.count_if(F.col("b") == b).alias(b) for b in BUILDS]
    )
    classes = reports.sparkSession.createDataFrame([(n,) for n in names], "crash_class string")
    whole = F.broadcast(classes).join(counted, "crash_class", "left").fillna(0, BUILDS)
    total = counted.agg(F.coalesce(F.sum(BUILDS[0]), F.lit(0)).alias("recurrence"))
    return whole.crossJoin(F.broadcast(total))  # one row


def exact_median(df: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str]) -> DataFrame:
    """Exact median and row count per key.

    Ranks come from the ordered scan, so a key with most of the rows is spread over slices
    instead of being gathered in one percentile buffer.
    """
    placed = scan(df, keys, [value, *ids], [row_number("_rn")])
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    n = F.col("samples")
    middle = F.col("_rn").between(F.floor((n + 1) / 2), F.ceil((n + 1) / 2))
    return placed.join(sizes, list(keys)).filter(middle).groupBy(*keys, "samples").agg(F.avg(value).alias("median"))


def cps_calibration(samples: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Median characters per second over usable samples, null below three of them.

    ``samples`` has chars and natural_ms.
    """
    usable = samples.filter((F.col("natural_ms") >= 400) & (F.col("chars") >= 4))
    rated = usable.withColumn("rate", F.col("chars") * 1000.0 / F.col("natural_ms"))
    med = exact_median(rated.select(*keys, *ids, "rate"), keys, "rate", ids)
    known = samples.select(*keys).distinct().join(med, list(keys), "left")
    enough = (F.col("samples") >= 3) & (F.col("median") > 0)
    return known.select(
        *keys,
        F.coalesce("samples", F.lit(0).cast("long")).alias("samples"),
        F.when(enough, F.col("median")).alias("cps"),
    )


def storage_rollup(files: DataFrame, categories: dict[str, str]) -> DataFrame:
    """Bytes and files per category by path prefix; ``other`` holds what no category claims."""
    name = F.lit("other")
    for category, prefix in reversed(list(categories.items())):
        name = F.when(F.startswith(F.col("path"), F.lit(prefix)), category).otherwise(name)
    return files.groupBy(name.alias("category")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files")
    )


def pass_rate(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total, passed, failed and pass rate. No transcript or a failed judge is a failed case.

    ``cases`` has transcript, judge_score and judge_error.
    """
    judged = F.col("transcript").isNotNull() & F.col("judge_error").isNull()
    ok = judged & F.coalesce(F.col("judge_passed"), F.lit(False))
    out = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("passed"))
    rate = F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(F.lit(0.0))
    return out.withColumn("failed", F.col("total") - F.col("passed")).withColumn("pass_rate", F.round(rate, 4))


def status_counts(plan: DataFrame) -> DataFrame:
    """Segments per job and status, and whether the job needs its video retimed."""
    per = plan.groupBy("job_id", "status").agg(
        F.count(F.lit(1)).alias("segments"), F.max(F.col("video_ratio") > 1.0 + 1e-6).alias("retimed")
    )
    return per
