"""File sources: manifests, test lists, configs, language maps, subtitles, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEST_LIST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "text", "ref_audio", "ref_text", "language_id", "language_name")]
    + [T.StructField(n, T.DoubleType()) for n in ("duration", "speed")]
    + [T.StructField("instruct", T.StringType())]
)
MANIFEST = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "audio_path", "text", "language_id")])
WHITE = " \t\r\n\f\v"
CONFIG = "map<string, array<struct<language_id: string, manifest_path: array<string>, repeat: int>>>"
STAMP = r"(\d{1,2}):([0-5]?\d):([0-5]?\d)[,.](\d{1,3})"
TIMING = rf"(?m)^[^\S\n]*{STAMP}[^\S\n]*-->[^\S\n]*{STAMP}.*$"


def _json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows with a last column ``extras``, raw bad lines). Blank lines are skipped.

    A good line is one JSON object and nothing after it. Fields are cast one by one, so a number in
    quotes counts and an unreadable value is null; fields outside the schema go to ``extras``, a map
    of texts.
    """
    lines = spark.read.text(path).withColumn("value", F.btrim("value", F.lit(WHITE))).filter(F.col("value") != "")
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    is_object = F.col("value").startswith("{") & F.col("value").endswith("}") & F.col("v").isNotNull()
    fields = [F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields]
    known = [F.lit(f.name) for f in schema.fields]
    extras = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: ~k.isin(*known))
    good = parsed.filter(is_object).select(*fields, extras.alias("extras"))
    return good, parsed.filter(~is_object).select("value")


def test_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation samples with nine fixed fields, and the malformed lines."""
    return _json_lines(spark, path, TEST_LIST)


def manifest(spark: SparkSession, path: str, extras: T.StructType | None = None) -> DataFrame:
    """Training manifest; rows without audio_path are left out, unknown fields kept in ``extras``."""
    schema = T.StructType([*MANIFEST.fields, *(extras.fields if extras else [])])
    good, _ = _json_lines(spark, path, schema)
    return good.filter(F.coalesce("audio_path", F.lit("")) != "")


def shard_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``data.lst`` lines of four fields; any other number of fields fails the job."""
    lines = spark.read.text(path).select(F.btrim("value", F.lit(WHITE)).alias("v")).filter(F.col("v") != "")
    parts = lines.select("v", F.split("v", r"\s+").alias("p"))
    wrong = F.raise_error(F.concat(F.lit("shard manifest line needs four fields: "), F.col("v")))
    checked = parts.withColumn("p", F.when(F.size("p") == 4, F.col("p")).otherwise(wrong.cast("array<string>")))
    return checked.select(
        F.col("p")[0].alias("tar_path"),
        F.col("p")[1].alias("label_path"),
        F.col("p")[2].cast("int").alias("num_items"),
        F.col("p")[3].cast("double").alias("num_seconds"),
    )


def data_config(spark: SparkSession, path: str) -> DataFrame:
    """Config file to (split, language_id, manifest_path, copy_no) rows, repeats expanded."""
    text = spark.read.text(path, wholetext=True)
    groups = text.select(F.explode(F.from_json("value", CONFIG)).alias("split", "entries"))
    entries = groups.select("split", F.explode("entries").alias("e"))
    paths = entries.select("split", "e.language_id", "e.repeat", F.explode("e.manifest_path").alias("manifest_path"))
    times = F.coalesce("repeat", F.lit(1))
    copies = F.when(times >= 1, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return paths.select("split", "language_id", "manifest_path", F.explode(copies).alias("copy_no"))


def _counted(rows: DataFrame, good: Column, seen: Observation | None, rejected: str) -> DataFrame:
    """Rows that are ``good``; ``seen`` counts them and the others while they flow."""
    marked = rows.withColumn("_good", F.coalesce(good, F.lit(False)))
    if seen is not None:
        marked = marked.observe(seen, F.count_if("_good").alias("kept"), F.count_if(~F.col("_good")).alias(rejected))
    return marked.filter("_good").drop("_good")


def training_csv(spark: SparkSession, path: str, seen: Observation | None = None) -> DataFrame:
    """CSV of audio_path and transcription, quotes and blanks trimmed, incomplete rows left out.

    Fails when no usable row remains. ``seen`` counts ``kept`` and ``rejected`` rows while the result is used.
    """
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    audio = F.trim(F.btrim(F.trim("audio_path"), F.lit("'\"")))
    out = rows.select(audio.alias("audio_path"), F.trim("transcription").alias("text"))
    usable = (F.col("audio_path") != "") & (F.col("text") != "")
    if out.filter(usable).limit(1).count() == 0:
        raise ValueError(f"no usable rows in {path}")
    return _counted(out, usable, seen, "rejected")


def language_map(spark: SparkSession, path: str) -> DataFrame:
    schema = "language_id string, language_name string, iso_639_3_id string, train_data_duration double"
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of every file below ``path``; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def events_since(events: DataFrame, job_id, after_seq: int, limit: int | None = None) -> DataFrame:
    rows = events.filter((F.col("job_id") == job_id) & (F.col("seq") > after_seq)).orderBy("seq")
    return rows if limit is None else rows.limit(limit)


def _stamp_ms(h: Column, m: Column, s: Column, ms: Column) -> Column:
    whole = (h.cast("long") * 60 + m.cast("long")) * 60 + s.cast("long")
    return whole * 1000 + F.rpad(ms, 3, "0").cast("long")


def parse_srt(docs: DataFrame, text: str, seen: Observation | None = None) -> DataFrame:
    """Cues of SRT documents, malformed ones left out; one row per cue.

    ``seen`` counts ``kept`` cues and those ``skipped`` for an empty text or a span that does not go forward.

    Bodies run from one timing line to the next; the index of the following cue at the end of
    a body is taken off.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "^﻿+", ""), "\r\n?", "\n")
    rows = docs.withColumn("_t", clean)
    heads = F.regexp_extract_all("_t", F.lit(TIMING), F.lit(0))
    bodies = F.slice(F.split("_t", TIMING, -1), F.lit(2), F.greatest(F.size(F.split("_t", TIMING, -1)) - 1, F.lit(0)))
    keep = [c for c in docs.columns if c != text]
    cues = rows.select(*keep, F.posexplode(F.arrays_zip(heads.alias("head"), bodies.alias("body"))).alias("pos", "c"))
    part = [F.regexp_extract("c.head", TIMING, i) for i in range(1, 9)]
    body = F.regexp_replace(F.regexp_replace("c.body", "^\n+", ""), "\n+$", "")
    body = F.regexp_replace(body, r"(?U)(?:(?:^|\n)[^\S\n]*\d+[^\S\n]*)+$", "")
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parsed = cues.select(
        *keep,
        (F.col("pos") + 1).cast("long").alias("cue_no"),
        _stamp_ms(*part[:4]).alias("start_ms"),
        _stamp_ms(*part[4:]).alias("end_ms"),
        F.array_join(lines, "\n").alias("cue_text"),
    )
    return _counted(parsed, (F.col("end_ms") > F.col("start_ms")) & (F.col("cue_text") != ""), seen, "skipped")


def stored_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Every table below ``root``, a folder each. Columns that later parts added are null in earlier ones."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(base) if s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
    return {name: spark.read.option("mergeSchema", True).parquet(f"{root}/{name}") for name in sorted(names)}
