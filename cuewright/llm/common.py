"""Row keys, written intermediate tables and word splitting shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.session import scratch_path, ship_package

NO_ID = (1 << 63) - 1
BLANKS = r"[\x20\x09-\x0D]+"
KEY = ["doc_id", "key"]


def text_key(text: Column) -> Column:
    """The hash of a text that tells apart rows that share an id; a null text reads as the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, text`` of every row and no other column, so that extra columns cannot clash.

    ``key`` is a hash of the text: rows that share an id, or have none, stay apart, while repeated
    rows agree in both columns and so share one result. A null id reads as ``NO_ID``, larger than
    any other; a null text reads as the empty text.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    ident = F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))
    return docs.select(ident.alias("doc_id"), text_key(docs[text_col]).alias("key"), text.alias("text"))


def real_id() -> Column:
    """The id as it was given: null where ``keyed`` put ``NO_ID``."""
    return F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")


def pieces(df: DataFrame, per_piece: int) -> int:
    """How many parts of about ``per_piece`` bytes the texts of ``df`` make; one number to the driver."""
    total = df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(8, -(-total // per_piece))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the cluster's shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words between blanks, tabs and line ends, unchanged."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")
