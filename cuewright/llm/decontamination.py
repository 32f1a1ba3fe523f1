"""Benchmark decontamination over a positional inverted index of the training texts.

A benchmark item is searched by its windows of 13 words. Document frequencies of all benchmark words
are counted over the corpus first; each window is then represented by its three rarest words, and
only postings of those words, (word, document, position), are stored. Postings are shifted by the
word's place in the item, so the words of a phrase agree in the shifted position: intersecting the
lists of a window, rarest first, leaves candidate starts, and starts of the rarest word that all
other lists come within ``slop`` places of are proximity matches. Candidates are confirmed word by word on the text. Only
DataFrame functions run here.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import KEY, keyed, real_id, stored
from cuewright.session import small_side

WINDOW = 13
RAREST = 3
SLOP = 3
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Words of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII."""
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(lower, GAPS), lambda w: w != "")


def item_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, item_id, words`` of the distinct items that have words; a null id reads as empty."""
    ident = F.coalesce(benchmark[id_col].cast("string"), F.lit(""))
    rows = benchmark.select(ident.alias("item_id"), terms(F.coalesce(benchmark[text_col], F.lit(""))).alias("words"))
    return rows.distinct().filter(F.size("words") > 0).withColumn("item", F.xxhash64("item_id", "words"))


def windows(items: DataFrame, frequency: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per window: ``item, item_id, s, phrase, picks``; ``picks`` are places of its rarest words.

    An item shorter than a window is one window. Windows with a word the corpus lacks are left out.
    """
    placed = items.select("item", F.posexplode("words").alias("q", "word")).join(frequency, "word", "left")
    counted = placed.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("q", F.coalesce("n", F.lit(0)).alias("n")))).alias("ranked"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    rows = items.join(counted, "item").select("item", "item_id", "words", "ranked", F.explode(starts).alias("s"))
    part = F.slice("ranked", F.col("s") + 1, size)
    by_rarity = F.sort_array(F.transform(part, lambda r: F.struct(r["n"].alias("n"), r["q"].alias("q"))))
    cut = rows.select("item", "item_id", "s", F.slice("words", F.col("s") + 1, size).alias("phrase"), by_rarity.alias("by_rarity"))
    picks = F.transform(F.slice("by_rarity", 1, RAREST), lambda r: r["q"])
    return cut.filter(F.col("by_rarity")[0]["n"] > 0).select("item", "item_id", "s", "phrase", picks.alias("picks"))


def within(starts: Column, others: Column, slop: int) -> Column:
    """Those of ``starts`` that have one of ``others`` at most ``slop`` away; linear in both lists."""
    reached = F.flatten(F.transform(others, lambda d: F.sequence(d - slop, d + slop)))
    return F.array_intersect(starts, reached)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    slop: int = SLOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    with_key: bool = False,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_near, matches, near, items, contaminated`` of every row of ``docs``.

    A word is hit when it lies in an occurrence of a benchmark window; ``items`` are the ids of the
    items with such a window, sorted as strings, ``matches`` their occurrences (item_id, start, length).
    ``n_near`` counts windows whose rarest words all occur within ``slop`` places of their order: the
    rarest word at some place, each other one at most ``slop`` from where that place puts it. ``near``
    lists such places that are no occurrence (item_id, start the rarest word implies, length).
    ``contaminated`` means that at least 1 word in 20 is hit. Null, empty and wordless texts have no
    words and no hits; items without words are never found; an empty benchmark finds nothing.
    Repeated documents each get their row, repeated items count once. ``with_key`` adds the row's
    ``key``, the hash of its text.
    """
    rows = keyed(docs, id_col, text_col)
    items = stored(item_words(benchmark, item_col, "text"), "items")
    split = rows.select(*KEY, terms(F.col("text")).alias("words"))
    wanted = small_side(items.select(F.explode("words").alias("word")).distinct())
    tokens = split.select(F.explode("words").alias("word"))
    frequency = tokens.join(wanted, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    queries = stored(windows(items, stored(frequency, "frequencies"), size), "windows")

    needed = queries.select("item", F.explode("picks").alias("q")).distinct()
    places = items.select("item", F.posexplode("words").alias("q", "word")).join(needed, ["item", "q"])
    places = stored(places, "places")
    distinct_words = small_side(places.select("word").distinct())
    occurrences = split.select(*KEY, F.posexplode("words").alias("pos", "word")).join(distinct_words, "word")
    postings = stored(occurrences.select("word", *KEY, "pos"), "postings")

    shifted = postings.join(small_side(places), "word").select(*KEY, "item", "q", (F.col("pos") - F.col("q")).alias("d"))
    lists = shifted.distinct().groupBy(*KEY, "item").agg(F.collect_list(F.struct("q", "d")).alias("p"), F.count_distinct("q").alias("n_q"))
    met = lists.join(small_side(queries), "item").filter(F.col("n_q") >= F.size("picks"))

    def starts_of(k: int) -> Column:
        return F.transform(F.filter("p", lambda e: e["q"] == F.get("picks", F.lit(k))), lambda e: e["d"])

    aligned = met.select(*KEY, "item_id", "s", "phrase", "picks", *[starts_of(k).alias(f"d{k}") for k in range(RAREST)])
    exact, near = F.col("d0"), F.col("d0")
    for k in range(1, RAREST):
        extra = F.size("picks") > k
        exact = F.when(extra, F.array_intersect(exact, F.col(f"d{k}"))).otherwise(exact)
        near = F.when(extra, within(near, F.col(f"d{k}"), slop)).otherwise(near)
    candidates = aligned.select(*KEY, "item_id", "s", "phrase", exact.alias("starts"), near.alias("near")).filter(F.size("near") > 0)
    listed = F.transform(
        "starts",
        lambda d: F.struct((d + F.col("s")).alias("start"), F.col("item_id").alias("item_id"), F.col("phrase").alias("phrase")),
    )
    apart = F.transform(
        F.array_except("near", "starts"),
        lambda d: F.struct(F.col("item_id").alias("item_id"), (d + F.col("s")).alias("start"), F.size("phrase").alias("length")),
    )
    per_doc = candidates.groupBy(*KEY).agg(
        F.flatten(F.collect_list(listed)).alias("found"), F.flatten(F.collect_list(apart)).alias("apart"), F.count(F.lit(1)).alias("n_near")
    )

    joined = rows.join(per_doc, KEY, "left").select(*KEY, "n_near", "found", "apart", terms(F.col("text")).alias("words"))

    def occurs(c: Column) -> Column:
        return (c["start"] >= 0) & (F.slice("words", F.greatest(c["start"], F.lit(0)) + 1, F.size(c["phrase"])) == c["phrase"])

    def places_of(found: Column) -> Column:
        placed = F.transform(found, lambda c: F.struct(c["item_id"].alias("item_id"), c["start"].alias("start"), F.size(c["phrase"]).alias("length")))
        return F.coalesce(placed, none)

    none = F.array().cast("array<struct<item_id:string,start:int,length:int>>")
    checked = joined.select(
        *KEY,
        F.size("words").cast("long").alias("n_words"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        places_of(F.filter("found", occurs)).alias("matches"),
        F.concat(F.coalesce("apart", none), places_of(F.filter("found", lambda c: ~occurs(c)))).alias("near"),
    )
    touched = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1))))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    out = checked.select("*", F.size(touched).cast("long").alias("n_hit"), names.alias("items"))
    flag = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select(real_id(), "n_words", "n_hit", "n_near", "matches", "near", "items", flag.alias("contaminated"), *["key"] * with_key)
