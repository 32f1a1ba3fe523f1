"""Word alignment counts and Unicode-aware normalisation, batch by batch in Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions import text as T

COUNTS = "substitutions long, deletions long, insertions long, wer double, word_num long, error string"


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a shortest alignment.

    Among equally short ones the path read from the end prefers a deletion, takes an insertion
    only where it saves an edit, and pairs words otherwise. Substitutions of that path are
    carried along row by row; deletions and insertions follow from the lengths.
    """
    shared = min(len(ref), len(hyp))
    head = next((i for i in range(shared) if ref[i] != hyp[i]), shared)
    tail = next((i for i in range(shared - head) if ref[-1 - i] != hyp[-1 - i]), shared - head)
    ref, hyp = ref[head : len(ref) - tail], hyp[head : len(hyp) - tail]
    counts = _paired_counts(ref, hyp)
    return counts or _aligned_counts(ref, hyp)


def _paired_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int] | None:
    """Counts of pairing words place by place, where no alignment matches more words than that; else none.

    Matches, at most the words the sides share, fix the counts: with M of them and I insertions there are
    ``len(ref) - M + I`` edits. Where the pairing has as many matches as words are shared and inserts
    no more than the lengths call for, every shortest alignment has its counts.
    """
    shared = sum((Counter(ref) & Counter(hyp)).values())
    if sum(a == b for a, b in zip(ref, hyp)) < shared:
        return None
    return min(len(ref), len(hyp)) - shared, max(len(ref) - len(hyp), 0), max(len(hyp) - len(ref), 0)


def _aligned_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """Counts along the path described above, a row of the table for each word of ``ref``."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(ref + hyp))}
    h = np.array([ids[w] for w in hyp], dtype=np.int64)
    steps = np.arange(len(hyp) + 1, dtype=np.int64)
    row, subs = steps.copy(), np.zeros_like(steps)
    for i, word in enumerate(ref, 1):
        differs = h != ids[word]
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + differs)
        best = np.minimum.accumulate(best - steps) + steps
        dropped = row + 1 == best
        inserted = np.concatenate(([False], ~dropped[1:] & (best[:-1] == row[:-1] - 1)))
        paired = np.concatenate((subs[:1], subs[:-1] + differs))
        source = np.maximum.accumulate(np.where(inserted, 0, steps))
        row, subs = best, np.where(dropped, subs, paired)[source]
    deletions = (int(row[-1]) - int(subs[-1]) + len(ref) - len(hyp)) // 2
    return int(subs[-1]), deletions, int(row[-1]) - int(subs[-1]) - deletions


# Fixed values of the multilingual normaliser; punctuation is taken by Unicode category.
DELETED = "​‌‎‏‪‬" + "".join(chr(c) for c in (*range(0x064B, 0x0653), 0x0656))
LANGUAGE_RULES = {
    "*": {"form": "NFKC"},
    "mon": {"form": "NFKC", "delete": "­"},
    "khk": {"form": "NFKC", "delete": "­"},
    "heb": {"form": "NFKC", "delete": "".join(chr(c) for c in range(0x05B0, 0x05D0))},
    "tha": {"form": "NFKC", "space": "‍"},
    "ara": {"form": "NFKC", "map": {"ٱ": "ا"}},
    "arb": {"form": "NFKC", "map": {"ٱ": "ا"}},
    "jav": {"form": "NFKC", "plain": True},
}
KEPT_MARKS = "'"
QUOTES = "’‘‛"


def multilingual_normalizer(iso: str, lower: bool = True, drop_numbers: bool = False, drop_brackets: bool = False) -> Callable[[str], str]:
    """Normaliser of one language: compatibility form, case, brackets, punctuation, marks, digits."""
    rules = {**LANGUAGE_RULES["*"], **LANGUAGE_RULES.get(iso, {})}
    swaps = rules.get("map", {})
    spaces, deleted = set(rules.get("space", "")), set(DELETED + rules.get("delete", ""))
    bracketed = re.compile(r"\([^)]*\)" if drop_brackets else r"\([^)]*\d[^)]*\)")
    apostrophe = re.compile(rf"(?<=\S)[{QUOTES}](?=\S)")

    def image(ch: str) -> str:
        if ch in deleted:
            return ""
        if ch in spaces or (unicodedata.category(ch)[0] == "P" and ch not in KEPT_MARKS):
            return " "
        return " " if ch in "<>" else ch

    table: dict[int, str] = {}

    def normalize(text: str) -> str:
        out = unicodedata.normalize(rules["form"], text)
        out = bracketed.sub(" ", out.lower() if lower else out)
        for entity in ("&lt;", "&gt;", "&nbsp"):
            out = out.replace(entity, "")
        out = apostrophe.sub("'", out)
        for old, new in swaps.items():
            out = out.replace(old, new)
        for ch in set(out):
            table.setdefault(ord(ch), image(ch))
        words = out.translate(table).split()
        if drop_numbers:
            words = [w for w in words if not all(unicodedata.category(c) in ("Nd", "Nl") for c in w)]
        out = " ".join(words)
        if rules.get("plain"):
            out = "".join(c for c in unicodedata.normalize("NFD", out) if unicodedata.category(c) != "Mn")
        return out

    return normalize


def normalize_multilingual(text: Column, iso: Column, **options) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series, codes: pd.Series) -> pd.Series:
        known: dict[str, Callable[[str], str]] = {}
        out = []
        for t, c in zip(texts, codes):
            if c not in known:
                known[c] = multilingual_normalizer(c or "*", **options)
            out.append(None if t is None else known[c](t))
        return pd.Series(out, dtype="object")

    return run(text, iso)


# Named column normalisers a row can ask for; each maps (text, language) to a column.
NORMALIZERS: dict[str, Callable[[Column, Column], Column]] = {
    "plain": lambda text, lang: T.strip(F.regexp_replace(F.lower(text), r"\s+", " ")),
    "alnum": lambda text, lang: T.norm_alnum(text),
    "cer": T.norm_cer,
    "cer_all": lambda text, lang: T.norm_cer_all(text),
}


def normalize_by_name(text: Column, lang: Column, name: Column) -> Column:
    """Apply the normaliser named in each row; an unknown name fails the job."""
    out = F.raise_error(F.concat(F.lit("no normaliser named "), name)).cast("string")
    for key, function in NORMALIZERS.items():
        out = F.when(name == key, function(text, lang)).otherwise(out)
    return out


def wer_counts(pairs: DataFrame, keep: list[str], truth: Column, hypo: Column) -> DataFrame:
    """``keep`` columns with S, D, I, wer and word count of each normalised pair.

    A pair that cannot be scored keeps its row with ``error`` set. An empty truth counts one
    word, as splitting it on a space gives one empty piece.

    Only the counts come back from Python, so an aggregation reads no texts beyond the UDF's input.
    """

    @F.pandas_udf(COUNTS)
    def score(truths: pd.Series, hypos: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([_scored(t, h) for t, h in zip(truths, hypos)], columns=[c.split()[0] for c in COUNTS.split(", ")])
        whole = ["substitutions", "deletions", "insertions", "word_num"]
        return out.astype({c: "Int64" for c in whole})

    texts = pairs.select(*keep, truth.alias("truth"), hypo.alias("hypo"))
    return texts.withColumn("_s", score("truth", "hypo")).select(*keep, "truth", "hypo", "_s.*")


def _scored(t: str, h: str) -> tuple:
    try:
        ref, hyp = t.split(), h.split()
        s, d, i = edit_counts(ref, hyp)
        return s, d, i, (s + d + i) / max(len(ref), 1), len(t.split(" ")), None
    except Exception as failure:
        return None, None, None, None, None, f"{type(failure).__name__}: {failure}"
