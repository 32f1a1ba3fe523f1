"""Equi, semi and anti joins of the history, dictionary, glossary and job tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cuewright.operators.timeline import top_per_group


def join_labels(samples: DataFrame, labels: DataFrame, on: Sequence[str], seen: Observation | None = None, strict: bool = False) -> DataFrame:
    """Samples with their label; ``label_state`` is ``missing`` where there is none.

    ``seen`` counts samples and ``missing`` labels while the result is used, without a second pass. With
    ``strict`` the first sample without a label fails the job and is named.
    """
    joined = samples.join(labels.withColumn("_has", F.lit(True)), list(on), "left")
    missing = F.col("_has").isNull()
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in on])
    otherwise = F.raise_error(F.concat(F.lit("no label for "), name)).cast("string") if strict else F.lit("missing")
    out = joined.withColumn("label_state", F.when(missing, otherwise).otherwise("ok"))
    if seen is not None:
        out = out.observe(seen, F.count(F.lit(1)).alias("samples"), F.count_if(missing).alias("missing"))
    return out.drop("_has")


def overlay_texts(segs: DataFrame, texts: DataFrame) -> DataFrame:
    """Text of one language laid over the segments: by id, else by index, blank ignored."""
    by_id = texts.select("job_id", F.col("key").alias("_kid"), F.col("new_text").alias("_tid"))
    by_ix = texts.select("job_id", F.col("key").alias("_kix"), F.col("new_text").alias("_tix"))
    keyed = segs.withColumn("_kid", F.col("seg_no").cast("string")).withColumn("_kix", F.col("idx").cast("string"))
    joined = keyed.join(by_id, ["job_id", "_kid"], "left").join(by_ix, ["job_id", "_kix"], "left")
    chosen = F.coalesce("_tid", "_tix")
    return joined.withColumn("out_text", F.when(F.trim(chosen) != "", chosen).otherwise(F.col("text")))


def stale_segments(current: DataFrame, stored: DataFrame, on: Sequence[str]) -> DataFrame:
    """``state`` is fresh where the stored fingerprint equals the current one, else stale; rows without id are left out."""
    prior = stored.select(*on, F.col("fingerprint").alias("_old"))
    current = current.dropna(subset=list(on))
    state = F.when(F.col("_old") == F.col("fingerprint"), "fresh").otherwise("stale")
    return current.join(prior, list(on), "left").withColumn("state", state).drop("_old")


def language_prefix(language: Column) -> Column:
    """Two-letter lower-case prefix; null for empty and ``auto``."""
    tidy = F.lower(F.trim(language))
    return F.when((tidy != "") & (tidy != "auto"), F.left(tidy, F.lit(2)))


def _scoped_entries(entries: DataFrame, requests: Sequence[str]) -> DataFrame:
    """Enabled entries repeated for each requested language their scope covers."""
    wanted = F.array(*[F.lit(r) for r in requests])
    scope = F.coalesce(F.nullif(F.trim("language"), F.lit("")), F.lit("*"))
    rows = entries.filter((F.col("enabled") != 0) & (F.trim("term") != ""))
    rows = rows.withColumn("scope", scope).withColumn("request", F.explode(wanted))
    covers = (F.col("scope") == "*") | (F.lower(F.left("scope", F.lit(2))) == language_prefix(F.col("request")))
    return rows.filter(covers)


def dictionary_for(entries: DataFrame, requests: Sequence[str]) -> DataFrame:
    """Respellings in force per requested language: language rows beat global, newest beats older."""
    kind = F.lower(F.trim(F.coalesce("type", F.lit("respelling"))))
    rows = _scoped_entries(entries, requests).filter(kind == "respelling")
    rank = F.struct((F.col("scope") != "*").alias("own"), "created_at", "id")
    return rows.groupBy("request", F.trim("term").alias("term")).agg(
        F.max_by(F.coalesce("replacement", F.lit("")), rank).alias("replacement")
    )


def dictionary_inert(entries: DataFrame, requests: Sequence[str]) -> DataFrame:
    """Enabled matching entries in a notation that does not substitute text."""
    kind = F.lower(F.trim(F.coalesce("type", F.lit("respelling"))))
    rows = _scoped_entries(entries, requests).withColumn("kind", kind)
    return rows.filter(F.col("kind") != "respelling").select("request", "id", F.trim("term").alias("term"), "kind")


def profile_usage(projects: DataFrame, profile_totals: DataFrame) -> DataFrame:
    """Segments per (profile, project) from the project JSON, with the profile's take total.

    ``projects`` has project_id and state_json; unreadable JSON counts as empty.
    """
    shape = "struct<segments: array<struct<profile_id: string>>>"
    used = (
        projects.select("project_id", F.explode(F.from_json("state_json", shape)["segments"]).alias("s"))
        .filter(F.col("s.profile_id").isNotNull())
        .groupBy(F.col("s.profile_id").alias("profile_id"), "project_id")
        .agg(F.count(F.lit(1)).alias("segment_count"))
    )
    return used.join(profile_totals, "profile_id", "left")


def referencing_jobs(jobs: DataFrame, pattern: str) -> DataFrame:
    """(target, holder) where a job's JSON mentions another job's folder.

    Paths are extracted from the text once and joined by equality, instead of testing every
    pair of jobs with ``contains``.
    """
    found = jobs.select(
        F.col("job_id").alias("holder"),
        F.explode(F.array_distinct(F.regexp_extract_all("job_data", F.lit(pattern), F.lit(1)))).alias("target"),
    )
    own = jobs.select(F.col("job_id").cast("string").alias("target"))
    pairs = found.filter(F.col("target") != F.col("holder").cast("string"))
    return pairs.join(own, "target", "left_semi")


def cache_hits(jobs: DataFrame, tries: int = 5) -> DataFrame:
    """First usable of the newest ``tries`` other jobs with the same content hash.

    Every hash keeps only its newest ``tries`` + 1 jobs, enough to leave out the asking job,
    so a hash shared by most jobs does not pair them with one another.
    """
    keyed = jobs.filter(F.coalesce("content_hash", F.lit("")) != "")
    newest = top_per_group(keyed, ["content_hash"], [F.desc("created_at"), F.desc("job_id")], tries + 1)
    offers = newest.groupBy("content_hash").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("job_id").alias("other"), "usable"))).alias("offers")
    )
    asked = keyed.join(offers, "content_hash")
    others = F.slice(F.filter("offers", lambda o: o["other"] != F.col("job_id")), 1, tries)
    good = F.filter(others, lambda o: o["usable"])
    return asked.select("job_id", "content_hash", F.get(good, F.lit(0))["other"].alias("cached_job"))


def job_library(jobs: DataFrame, events: DataFrame, types: Sequence[str], limit: int) -> DataFrame:
    """Finished jobs of the given types with their newest parseable ``done`` event.

    Events of other jobs and those that cannot be ``done`` are left out before any JSON is read.
    """
    shape = "struct<type: string, output: string, title: string, duration_s: string, chapters: string>"
    jobs = jobs.filter((F.col("status") == "done") & F.col("type").isin(*types))
    done = (
        events.filter(F.contains("payload", F.lit('"done"')))
        .join(jobs.select("job_id"), "job_id", "left_semi")
        .withColumn("d", F.from_json("payload", shape))
        .groupBy("job_id")
        .agg(F.max_by("d", F.when(F.col("d.type") == "done", F.col("seq"))).alias("d"))
        .filter(F.coalesce("d.output", F.lit("")) != "")
    )
    title = F.coalesce(F.nullif(F.col("d.title"), F.lit("")), F.get_json_object("meta_json", "$.title"))
    return (
        jobs.join(done, "job_id")
        .select(
            "job_id",
            "type",
            F.col("d.output").alias("output"),
            title.alias("title"),
            F.bround(F.coalesce(F.expr("try_cast(d.duration_s as double)"), F.lit(0.0)), 2).alias("duration_s"),
            F.coalesce(F.expr("try_cast(d.chapters as bigint)"), F.lit(0).cast("long")).alias("chapters"),
            "created_at",
        )
        .orderBy(F.desc("created_at"), F.desc("job_id"))
        .limit(limit)
    )


def resolve_voice(requests: DataFrame, bindings: DataFrame, default_profile: str | None) -> DataFrame:
    """Explicit profile, else the client's binding, else the default; ``source`` says which."""
    bound = bindings.filter(F.coalesce("bound_profile", F.lit("")) != "").select("client_id", "bound_profile")
    explicit = F.nullif(F.col("explicit_profile"), F.lit(""))
    fallback = F.lit(default_profile).cast("string")
    return requests.join(bound, "client_id", "left").select(
        *requests.columns,
        F.coalesce(explicit, "bound_profile", fallback).alias("profile_id"),
        F.when(explicit.isNotNull(), "explicit")
        .when(F.col("bound_profile").isNotNull(), "binding")
        .when(fallback.isNotNull(), "global")
        .otherwise("none")
        .alias("source"),
    )


def missing_keys(base: DataFrame, locales: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Base keys each locale lacks. ``locales`` has (lang, key)."""
    wanted = base.select(F.explode(F.array(*[F.lit(x) for x in languages])).alias("lang"), "key").distinct()
    return wanted.join(locales, ["lang", "key"], "left_anti")


def new_glossary_terms(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposed terms not present yet, first of repeated ones, without identical phrases.

    ``proposed`` has project_id, position, source, target.
    """
    tidy = proposed.withColumn("source", F.trim("source")).withColumn("target", F.trim("target"))
    same_phrase = (F.col("source") == F.col("target")) & (F.size(F.split("source", r"\s+")) > 1)
    usable = tidy.filter((F.col("source") != "") & (F.col("target") != "") & ~same_phrase)
    first = usable.groupBy("project_id", F.lower("source").alias("key")).agg(
        F.min_by(F.struct("source", "target"), "position").alias("t")
    )
    known = existing.select("project_id", F.lower("source").alias("key"))
    return first.join(known, ["project_id", "key"], "left_anti").select("project_id", "t.source", "t.target")


def unreferenced_files(deleted: DataFrame, surviving: DataFrame) -> DataFrame:
    """Files of deleted rows that no surviving row points to."""
    gone = deleted.filter(F.coalesce("audio_path", F.lit("")) != "").select("audio_path").distinct()
    return gone.join(surviving.select("audio_path"), "audio_path", "left_anti")


def purge_finished(tasks: DataFrame, attempts: DataFrame, terminal: Sequence[str], cutoff: Column, limit: int | None = None):
    """(doomed tasks, their attempts, surviving tasks): terminal tasks finished before the cutoff."""
    doomed = tasks.filter(F.col("state").isin(*terminal) & (F.col("finished_at") < cutoff))
    if limit is not None:
        doomed = doomed.orderBy("finished_at", "task_id").limit(limit)
    ids = doomed.select("task_id")
    return doomed, attempts.join(ids, "task_id", "left_semi"), tasks.join(ids, "task_id", "left_anti")


def merge_glossary(user: DataFrame, auto: DataFrame) -> DataFrame:
    """User terms as they are, then automatic terms no user term covers, one per source."""
    def clean(df):
        rows = df.withColumn("source", F.trim("source")).withColumn("target", F.trim("target"))
        return rows.filter((F.col("source") != "") & (F.col("target") != ""))

    mine, theirs = clean(user), clean(auto)
    first = theirs.groupBy("project_id", F.lower("source").alias("key")).agg(
        F.min_by(F.struct("source", "target"), "position").alias("t")
    )
    known = mine.select("project_id", F.lower("source").alias("key"))
    extra = first.join(known, ["project_id", "key"], "left_anti").select(
        "project_id", "t.source", "t.target", F.lit("auto").alias("origin")
    )
    return mine.select("project_id", "source", "target", F.lit("user").alias("origin")).unionByName(extra)


def merge_catalogs(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Catalogues in order of preference; the first that has an id keeps it."""
    tagged = None
    for order, (name, df) in enumerate(parts):
        part = df.withColumn("origin", F.lit(name)).withColumn("_order", F.lit(order))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    columns = [c for c in tagged.columns if c not in ("id", "_order")]
    kept = tagged.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct("_order", *columns)).alias("r"))
    return kept.select("id", "r.*")


def upsert_history(stored: DataFrame, incoming: DataFrame, guarded: Sequence[str]) -> DataFrame:
    """Upsert by ``id``: incoming wins, except that empty guarded values keep the stored ones."""
    s, i = stored.alias("s"), incoming.alias("i")
    out = []
    for c in stored.columns:
        old, new = F.col(f"s.{c}"), F.col(f"i.{c}")
        if c == "id":
            out.append(F.coalesce(new, old).alias(c))
        elif c in guarded:
            out.append(F.coalesce(F.nullif(new, F.lit("")), old, new).alias(c))
        else:
            out.append(F.when(F.col("i.id").isNotNull(), new).otherwise(old).alias(c))
    return s.join(i, F.col("s.id") == F.col("i.id"), "full_outer").select(*out)

