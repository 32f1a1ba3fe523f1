"""JSON payloads and cache keys of jobs, chapters and transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.hashing import canonical, short_sha1

NONCE_MIX = 2654435761
SEED_SPACE = 2**31
DIGEST_BLOCK = 4096
SEGMENTS = "struct<segments: array<struct<id: string, start: double, end: double, text: string>>>"
RECOGNISED = (
    "struct<segments: array<struct<start: double, end: double, words: array<struct<word: string, text: string, start: double, end: double>>>>,"
    " chunks: array<struct<text: string, timestamp: array<double>>>>"
)


def explode_segments(jobs: DataFrame, payload: str) -> DataFrame:
    """Segments of each job's JSON; unreadable JSON gives none."""
    keep = [c for c in jobs.columns if c != payload]
    rows = jobs.select(*keep, F.posexplode(F.from_json(payload, SEGMENTS)["segments"]).alias("pos", "s"))
    return rows.select(*keep, F.col("pos").cast("long").alias("pos"), "s.*")


def nesting(json: Column) -> Column:
    """Deepest nesting of braces outside of strings."""
    braces = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', ""), r"[^{}]+", "")
    steps = F.transform(F.split(braces, ""), lambda c: F.when(c == "{", 1).when(c == "}", -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def walk(a: Column, step: Column) -> Column:
        return F.struct((a["now"] + step).alias("now"), F.greatest(a["most"], a["now"] + step).alias("most"))

    return F.aggregate(steps, start, walk, lambda a: a["most"])


def flatten_keys(df: DataFrame, payload: str) -> DataFrame:
    """Dotted path and value of every leaf of nested JSON objects.

    The levels of a document are opened inside its row; how many there are is asked of the data
    first, one number to the driver.
    """
    depth = max(1, df.agg(F.max(nesting(F.col(payload)))).first()[0] or 0)
    keep = [c for c in df.columns if c != payload]

    def opened(level: Column) -> Column:
        def children(e: Column) -> Column:
            def child(kv: Column) -> Column:
                path = F.when(e["path"] == "", kv["key"]).otherwise(F.concat_ws(".", e["path"], kv["key"]))
                return F.struct(path.alias("path"), kv["value"].alias("node"))

            entries = F.map_entries(F.from_json(e["node"], "map<string,string>"))
            return F.transform(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), child)

        return F.flatten(F.transform(level, children))

    def is_object(e: Column) -> Column:
        return F.coalesce(F.size(F.json_object_keys(e["node"])), F.lit(0)) > 0

    rows = df.withColumn("_l0", F.array(F.struct(F.lit("").alias("path"), F.col(payload).alias("node"))))
    for i in range(depth):
        rows = rows.withColumn(f"_o{i}", opened(F.col(f"_l{i}")))
        rows = rows.withColumn(f"_l{i + 1}", F.filter(f"_o{i}", is_object))
    leaves = F.concat(*[F.filter(f"_o{i}", lambda e: ~is_object(e)) for i in range(depth)])
    return rows.select(*keep, F.explode(leaves).alias("e")).select(*keep, "e.path", F.col("e.node").alias("value"))


def recognised_words(results: DataFrame, payload: str) -> DataFrame:
    """Words of a recogniser's JSON: word timings where there are any, else chunk timings spread evenly."""
    keep = [c for c in results.columns if c != payload]
    parsed = results.select(*keep, F.from_json(payload, RECOGNISED).alias("r"))

    def timed(s: Column) -> Column:
        def word(w: Column) -> Column:
            text = F.trim(F.coalesce(F.nullif(w["word"], F.lit("")), w["text"], F.lit("")))
            start = F.coalesce(w["start"], s["start"], F.lit(0.0))
            end = F.coalesce(w["end"], s["end"], start + 0.1)
            return F.struct(text.alias("text"), start.alias("start"), F.when(end <= start, start + 0.05).otherwise(end).alias("end"))

        return F.filter(F.transform(F.coalesce(s["words"], F.array()), word), lambda w: w["text"] != "")

    def spread(c: Column) -> Column:
        start = F.coalesce(F.get(c["timestamp"], F.lit(0)), F.lit(0.0))
        end = F.coalesce(F.nullif(F.get(c["timestamp"], F.lit(1)), F.lit(0.0)), start + 0.1)
        tokens = F.split(F.trim(F.regexp_replace(c["text"], r"\s+", " ")), " ")
        step = (end - start) / F.size(tokens)
        pieces = F.transform(
            tokens, lambda t, i: F.struct(t.alias("text"), (start + i * step).alias("start"), (start + (i + 1) * step).alias("end"))
        )
        return F.when((F.trim(c["text"]) != "") & (end > start), pieces).otherwise(F.slice(pieces, 1, 0))

    exact = F.flatten(F.transform(F.coalesce("r.segments", F.array()), timed))
    coarse = F.flatten(F.transform(F.coalesce("r.chunks", F.array()), spread))
    chosen = F.when(F.size(exact) > 0, exact).otherwise(coarse)
    rows = parsed.select(*keep, F.posexplode(chosen).alias("pos", "w"))
    return rows.select(*keep, F.col("pos").cast("long").alias("pos"), "w.*")


def _ordered_digest(df: DataFrame, by: Sequence[str], number: str, piece: str, digest, head: Column) -> DataFrame:
    """``digest`` of the pieces in order per key, as column ``d``.

    Pieces are joined in blocks of ``DIGEST_BLOCK`` consecutive numbers, and the digest of a key is
    the digest of its block digests, whatever its size; so no task ever holds all pieces of a key.
    """
    numbered = df.withColumn("_block", F.floor(F.col(number) / DIGEST_BLOCK))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(piece).alias("p"))))
    joined = F.concat(head, F.array_join(F.transform(pieces, lambda e: e["p"]), ""))
    blocks = numbered.groupBy(*by, "_block").agg(digest(joined).alias("_d"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_d"))), lambda e: e["_d"])
    return blocks.groupBy(*by).agg(digest(F.array_join(digests, "")).alias("d"))


def transcript_digest(segs: DataFrame) -> DataFrame:
    """Digest of a job's trimmed texts in order, each followed by NUL."""
    ended = segs.withColumn("_text", F.concat(F.trim(F.coalesce("text", F.lit(""))), F.lit("\0")))
    out = _ordered_digest(ended, ["job_id"], "seg_no", "_text", lambda c: F.sha2(c, 256), F.lit(""))
    return out.select("job_id", F.left("d", F.lit(16)).alias("digest"))


def segment_cache_key(text: Column, voice: Column, speed: Column, rate: int, engine: str, extra: str = "", nonce: Column | None = None) -> Column:
    """Key of one rendered segment; the nonce only joins when it is not zero."""
    fields = {
        "sr": F.lit(rate), "engine": F.lit(engine), "voice": voice, "text": text, "speed": speed.cast("double"), "extra": F.lit(extra)
    }
    body = canonical(fields)
    if nonce is not None:
        body = F.concat(body, F.when(nonce != 0, F.concat(F.lit("nonce="), nonce.cast("string"))).otherwise(""))
    return short_sha1(body, 20)


def chapter_cache_key(spans: DataFrame, by: Sequence[str], rate: int, engine: str) -> DataFrame:
    """Key of a chapter over its ordered spans (span_no, voice, text, pause_ms, speed)."""
    each = canonical({"voice": F.col("voice"), "text": F.col("text"), "pause": F.col("pause_ms"), "speed": F.col("speed").cast("double")})
    digests = spans.withColumn("_span", F.sha1(each))
    head = F.lit(f"sr={rate};engine={engine};")
    out = _ordered_digest(digests, by, "span_no", "_span", F.sha1, head)
    return out.select(*by, F.left("d", F.lit(20)).alias("cache_key"))


def segment_seed(base: Column, text: Column, nonce: Column) -> Column:
    """Repeatable 31-bit seed of a text; a nonce sets repeats of the text apart."""
    return F.pmod(base + F.crc32(F.encode(text, "UTF-8")) + nonce * NONCE_MIX, F.lit(SEED_SPACE))


def map_signature(voices: Column) -> Column:
    """JSON of a map with sorted keys, empty for an empty or missing map."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(voices)))
    return F.when(F.coalesce(F.size(F.map_keys(voices)), F.lit(0)) > 0, F.to_json(entries)).otherwise("")
