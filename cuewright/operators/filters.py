"""Filters, catalogue searches and value repairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.session import small_side

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, the folding of a LIKE that knows no other alphabet."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def duration_closed(df: DataFrame, low_ms: int, high_ms: int) -> DataFrame:
    return df.filter(F.col("duration_ms").between(low_ms, high_ms))


def duration_half_open(df: DataFrame, low_ms: int | None, high_ms: int | None) -> DataFrame:
    """Keep ``low <= duration < high``; a bound left out does not filter."""
    keep = F.lit(True)
    if low_ms is not None:
        keep = keep & (F.col("duration_ms") >= low_ms)
    if high_ms is not None:
        keep = keep & (F.col("duration_ms") < high_ms)
    return df.filter(keep)


def jobs(df: DataFrame, status: str | None = None, project_id=None, limit: int = 50) -> DataFrame:
    """Newest jobs; status ``active`` means pending or running."""
    if status == "active":
        df = df.filter(F.col("status").isin("pending", "running"))
    elif status:
        df = df.filter(F.col("status") == status)
    if project_id is not None:
        df = df.filter(F.col("project_id") == project_id)
    return df.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def gallery(df: DataFrame, category: str | None, text: str | None) -> DataFrame:
    """Newest first; the text may stand in the name, the character or the description."""
    if category:
        df = df.filter(F.col("category") == category)
    if text:
        needle = ascii_lower(F.lit(text))
        hit = F.lit(False)
        for c in ("name", "character", "description"):
            hit = hit | F.contains(ascii_lower(F.coalesce(F.col(c), F.lit(""))), needle)
        df = df.filter(hit)
    return df.orderBy(F.desc("created_at"), "id")


def _faceted(df: DataFrame, q: str | None, fields: Sequence[str], wanted: Mapping[str, object]) -> DataFrame:
    needle = (q or "").strip().lower()
    if needle:
        hit = F.lit(False)
        for c in fields:
            hit = hit | F.contains(F.lower(F.col(c)), F.lit(needle))
        df = df.filter(hit)
    for path, value in wanted.items():
        if value is not None and value != "":
            df = df.filter(F.col(path) == F.lit(value))
    return df


def facets(df, q=None, wanted=None, order=("id",), offset=0, limit=None) -> DataFrame:
    out = _faceted(df, q, ["name", "instruct"], wanted or {}).orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def catalog_page(df, q=None, wanted=None, order=("id",), offset=0, limit=60) -> DataFrame:
    """One page with the number of all matching rows in ``total``."""
    kept = _faceted(df, q, ["name"], wanted or {})
    total = kept.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    page = kept.orderBy(*order).offset(offset).limit(limit).withColumn("_one", F.lit(1))
    return page.join(total, "_one").drop("_one")


def allowed_properties(props: Column, allowed: Sequence[str], longest: int) -> Column:
    keys = F.array(*[F.lit(k) for k in allowed])
    return F.map_filter(props, lambda k, v: F.array_contains(keys, k) & (v.isNull() | (F.length(v) <= longest)))


def resolve_languages(df: DataFrame, column: str, dim: DataFrame) -> DataFrame:
    """Adds ``iso_code``: registered tag or alias, its base, name, else a 2-3 letter prefix.

    ``dim`` is the language table (code, name and, if given, ``aliases``: an array of native names, other codes
    and spellings), broadcast where its size allows. A key that several languages share goes to the first code.
    """
    dim = small_side(dim)
    plain = F.lower(F.trim(F.col(column)))
    key = F.replace(plain, F.lit("_"), F.lit("-"))
    base = F.split_part(key, F.lit("-"), F.lit(1))
    rows = df.withColumn("_plain", plain).withColumn("_key", key).withColumn("_base", base)
    other = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in dim.columns else F.array().cast("array<string>")
    spelled = dim.select("code", F.explode(F.concat(F.array("code"), other)).alias("k")).select("code", F.lower(F.trim("k")).alias("k"))
    keys = small_side(spelled.filter("k <> ''").groupBy("k").agg(F.min("code").alias("code")))
    names = small_side(dim.groupBy(F.lower(F.trim("name")).alias("_plain")).agg(F.min("code").alias("_by_name")))
    whole = keys.select(F.col("k").alias("_key"), F.col("code").alias("_by_key"))
    start = keys.select(F.col("k").alias("_base"), F.col("code").alias("_by_base"))
    for side, on in ((whole, "_key"), (start, "_base"), (names, "_plain")):
        rows = rows.join(side, on, "left")
    prefix = F.when(F.col("_base").rlike("^[a-z]{2,3}$"), F.col("_base"))
    code = F.coalesce("_by_key", "_by_base", "_by_name", prefix)
    empty = F.col("_key").isNull() | F.col("_key").isin("", "auto")
    return rows.select(*df.columns, F.when(~empty, code).alias("iso_code"))


def first_per_category(tags: Column, categories: Sequence[Sequence[str]]) -> Column:
    """Valid tags in order of appearance, the first of each category, joined by commas."""
    tidy = F.transform(tags, lambda t: F.lower(F.trim(F.coalesce(t, F.lit("")))))

    def first(names: Sequence[str]) -> Column:
        return F.get(F.filter(tidy, lambda t: t.isin(*names)), F.lit(0))

    chosen = F.array_compact(F.array(*[first(names) for names in categories]))
    in_order = F.array_sort(F.transform(chosen, lambda t: F.struct(F.array_position(tidy, t).alias("at"), t.alias("tag"))))
    return F.array_join(F.transform(in_order, lambda e: e.tag), ", ")


def repair_tags(df: DataFrame, categories: Sequence[Sequence[str]]) -> DataFrame:
    """Rows whose instruct changes when reduced to valid tags, with the repaired value.

    Design rows left with nothing recover their tags from the JSON map in ``vd_states``.
    """
    stored = F.coalesce("instruct", F.lit(""))
    healed = first_per_category(F.split(F.trim(stored), r"\s*[,，]\s*"), categories)
    backup = first_per_category(F.map_values(F.from_json("vd_states", "map<string,string>")), categories)
    recovered = F.when((healed == "") & (F.col("kind") == "design"), F.coalesce(backup, F.lit(""))).otherwise(healed)
    return df.select("id", stored.alias("_old"), recovered.alias("instruct")).filter("_old <> instruct").drop("_old")


def or_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null and empty values of the columns read ``unknown``."""
    return df.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) for c in columns})
