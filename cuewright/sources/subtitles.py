"""Subtitle text: SRT and VTT cues, karaoke events, and their files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.lists import let
from cuewright.session import ship_package

SLICE_CUES = 50_000

ASS_HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: 1920
PlayResY: 1080
WrapStyle: 0
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, Bold, Alignment, MarginL, MarginR, MarginV
Style: Default,Arial,64,&H0000E7FF,&H00FFFFFF,0,2,96,96,48

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def _two(value: Column) -> Column:
    text = value.cast("string")
    return F.when(F.length(text) < 2, F.concat(F.lit("0"), text)).otherwise(text)


def clock(ms: Column, mark: str) -> Column:
    """``HH:MM:SS`` + mark + ``mmm``."""
    parts = [_two(F.floor(ms / 3_600_000)), _two(F.floor(ms / 60_000) % 60), _two(F.floor(ms / 1000) % 60)]
    return F.concat(F.concat_ws(":", *parts), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def cue_body(text: Column, original: Column | None = None) -> Column:
    """Translated line, with the original in italics below it where it differs."""
    shown = F.trim(F.coalesce(text, F.lit("")))
    if original is None:
        return shown
    source = F.trim(F.coalesce(original, F.lit("")))
    single = F.when(shown != "", shown).otherwise(source)
    dual = F.concat(shown, F.lit("\n<i>"), source, F.lit("</i>"))
    return F.when((source == "") | (source == shown), single).otherwise(dual)


def cue_blocks(cues: DataFrame, mark: str, original: str | None = None) -> DataFrame:
    """One text block per cue (job_id, cue_no, block), ready to be written in cue order."""
    body = cue_body(F.col("text"), F.col(original) if original else None)
    span = F.concat(clock(F.col("start_ms"), mark), F.lit(" --> "), clock(F.col("end_ms"), mark))
    block = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), span, F.lit("\n"), body, F.lit("\n"))
    return cues.select("job_id", "cue_no", block.alias("block"))


def vtt_blocks(cues: DataFrame, original: str | None = None) -> DataFrame:
    """VTT blocks; block 0 of a job is the header."""
    head = cues.select("job_id").distinct()
    head = head.select("job_id", F.lit(0).cast("long").alias("cue_no"), F.lit("WEBVTT\n").alias("block"))
    return head.unionByName(cue_blocks(cues, ".", original))


def ass_clock(ms: Column) -> Column:
    cs = F.greatest(F.bround(ms / 10).cast("long"), F.lit(0))
    h, m, s = F.floor(cs / 360_000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60
    return F.concat(F.concat_ws(":", h.cast("string"), _two(m), _two(s)), F.lit("."), _two(cs % 100))


def ass_escape(text: Column) -> Column:
    """Braces and line breaks as literal text of an event."""
    braces = F.replace(F.replace(text, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    return F.regexp_replace(braces, "\r\n|\r|\n", r"\\\\N")


def _centis(ms: Column) -> Column:
    return F.greatest(F.bround(ms / 10).cast("long"), F.lit(1)).cast("string")


def even_split(text: Column, start: Column, end: Column) -> Column:
    """Tokens of the text spread evenly over the span as (text, start, end) structs."""
    tidy = F.trim(F.regexp_replace(text, r"\s+", " "))
    tokens = F.filter(F.split(tidy, " "), lambda t: t != "")

    def spread(held: Column) -> Column:
        def word(t: Column, i: Column) -> Column:
            begin, finish = held["from"] + i * held["step"], held["from"] + (i + 1) * held["step"]
            return F.struct(t.alias("text"), begin.alias("start"), finish.alias("end"))

        return F.transform(held["tokens"], word)

    span = F.greatest(end - start, F.lit(0))
    sized = let(F.struct(tokens.alias("tokens"), start.alias("from"), span.alias("span")), lambda t: F.struct(
        t["tokens"].alias("tokens"), t["from"].alias("from"), (t["span"] / F.size(t["tokens"])).alias("step")
    ))
    return let(sized, spread)


def scale_words(words: Column, old: tuple[Column, Column], new: tuple[Column, Column]) -> Column:
    """Word times moved linearly from one span to another (three decimals); null if either is empty."""
    ratio = (new[1] - new[0]) / (old[1] - old[0])

    def move(t: Column) -> Column:
        return F.bround(new[0] + (t - old[0]) * ratio, 3)

    moved = F.transform(
        words, lambda w: F.struct(w["text"].alias("text"), move(w["start"]).alias("start"), move(w["end"]).alias("end"))
    )
    return F.when((old[1] > old[0]) & (new[1] > new[0]), moved)


def karaoke_events(cues: DataFrame) -> DataFrame:
    """One karaoke event line per cue with text. ``words`` (ms) is used where given, else an even split.

    A word's sweep lasts until the next one starts, the last one's until the cue ends.
    """
    tidy = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = cues.withColumn("_text", tidy).filter(F.col("_text") != "")
    rows = rows.withColumn("_s", F.col("start_ms").cast("double")).withColumn(
        "_e", F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).otherwise(F.col("start_ms") + 100).cast("double")
    )
    split = even_split(F.col("_text"), F.col("_s"), F.col("_e"))
    words = F.coalesce(F.col("words"), split) if "words" in cues.columns else split
    rows = rows.withColumn("_w", words)
    # Starts never run backwards nor leave the cue. Most are in order, and then one look at each is enough.
    inside = F.transform("_w", lambda w: F.least(F.greatest(w["start"], F.col("_s")), F.col("_e")))
    rows = rows.withColumn("_in", inside)
    in_order = F.forall(F.zip_with(F.slice("_in", 1, F.greatest(F.size("_in") - 1, F.lit(0))), F.slice("_in", 2, F.size("_in")), lambda a, b: a <= b), lambda ok: ok)
    upto = F.transform("_in", lambda x, i: F.array_max(F.slice("_in", 1, i + 1)))
    rows = rows.withColumn("_st", F.when(in_order, F.col("_in")).otherwise(upto)).withColumn("_n", F.size("_w"))

    def tag(w: Column, i: Column) -> Column:
        until = F.coalesce(F.get("_st", i + 1), F.col("_e"))
        gap = F.when(i + 1 < F.col("_n"), " ").otherwise("")
        return F.concat(F.lit("{\\kf"), _centis(until - F.get("_st", i)), F.lit("}"), ass_escape(w["text"]), gap)

    lead = F.get("_st", F.lit(0)) - F.col("_s")
    intro = F.when(lead > 5, F.concat(F.lit("{\\k"), _centis(lead), F.lit("}"))).otherwise("")
    line = F.concat(
        F.lit("Dialogue: 0,"),
        ass_clock(F.col("_s")),
        F.lit(","),
        ass_clock(F.col("_e")),
        F.lit(",Default,,0,0,0,,"),
        intro,
        F.array_join(F.transform("_w", tag), ""),
    )
    return rows.select("job_id", "cue_no", line.alias("event"))


def _located(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path, local or remote, and the path in it."""
    path = path.rstrip("/")
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pa_fs.FileSystem.from_uri(path)


INDEX = "job_id long, slice long, file string, offset long, bytes long"


def write_subtitles(blocks: DataFrame, path: str, body: str = "block") -> None:
    """Files of many jobs each, cues in order, with an index of where every job stands.

    Each task writes one file and keeps its place in ``index``; a job of more than ``SLICE_CUES`` cues is spread over
    several. The index names files of tasks that ended well and is written last, as a whole: what a failed or
    repeated task left behind is in no index; ``clean_subtitles`` removes it.
    """
    spark = blocks.sparkSession
    ship_package(spark)
    root, kind = path.rstrip("/"), blocks.schema["job_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = blocks.select("job_id", F.floor(F.col("cue_no") / SLICE_CUES).alias("slice"), "cue_no", F.concat(F.col(body), F.lit("\n")).alias("block"))
    ordered = slices.repartition(parts, "job_id", "slice").sortWithinPartitions("job_id", "slice", "cue_no")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _located(root)
        files.create_dir(base)
        name = f"part-{uuid.uuid4().hex}.txt"
        rows: list[list] = []
        at = 0
        out = None
        for batch in batches:
            for job, part, text in zip(*(batch.column(c).to_pylist() for c in ("job_id", "slice", "block"))):
                data = (text or "").encode()
                out = out or files.open_output_stream(f"{base}/{name}")
                out.write(data)
                if not rows or rows[-1][:2] != [job, part]:
                    rows.append([job, part, name, at, 0])
                rows[-1][4] += len(data)
                at += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["job_id", "slice", "file", "offset", "bytes"])

    schema = INDEX.replace("job_id long", f"job_id {kind}")
    index = ordered.mapInArrow(pack, schema)
    index.write.mode("overwrite").parquet(f"{root}/index")


def clean_subtitles(spark: SparkSession, path: str) -> int:
    """Remove files that the index does not name; how many there were."""
    files, base = _located(path)
    used = {r["file"] for r in spark.read.parquet(f"{path.rstrip('/')}/index").select("file").distinct().collect()}
    left = [f.path for f in files.get_file_info(pa_fs.FileSelector(base)) if f.base_name.startswith("part-") and f.base_name not in used]
    for name in left:
        files.delete_file(name)
    return len(left)


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """``job_id, content`` of the files that ``write_subtitles`` left, slices of a job in order."""
    ship_package(spark)
    root = path.rstrip("/")
    index = spark.read.parquet(f"{root}/index")
    kind = index.schema["job_id"].dataType.simpleString()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _located(root)
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            texts = []
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "bytes"))):
                if name not in opened:
                    for old in opened.values():
                        old.close()
                    opened = {name: files.open_input_file(f"{base}/{name}")}
                opened[name].seek(at)
                texts.append(opened[name].read(size).decode())
            yield pa.RecordBatch.from_arrays([batch.column("job_id"), batch.column("slice"), pa.array(texts, pa.string())], names=["job_id", "slice", "text"])

    texts = index.mapInArrow(fetch, f"job_id {kind}, slice long, text string")
    whole = texts.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("slice", "text"))).alias("parts"))
    return whole.select("job_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("content"))


def karaoke_blocks(cues: DataFrame) -> DataFrame:
    """Event lines of each job behind the file header, as ``job_id, cue_no, block``."""
    events = karaoke_events(cues).withColumnRenamed("event", "block")
    heads = events.select("job_id").distinct().select("job_id", F.lit(0).cast("long").alias("cue_no"), F.lit(ASS_HEADER.rstrip()).alias("block"))
    return events.unionByName(heads)
