import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plain import sentence  # noqa: E402

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, kept string, words int, n int, bucket int, "
    "rep long, spans string, item string, tokens string, p string, t string"
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents with extra columns whose names the operators use themselves."""
        base = [(i, t, *(rest or (None, None)), len(t or "")) for i, t, *rest in rows]
        full = [(*r, "x", "y", 1, 2, 3, 4, "s", "i", "k", "p", "t") for r in base]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and blank texts, ties, repeated rows, near copies, passages, a long text."""
    a, b, c = sentence(1, 120), sentence(2, 90), sentence(3, 70)
    changed = " ".join(w if k != 60 else "changed" for k, w in enumerate(a.split()))
    return [
        (1, a, "en", "s1"),
        (2, a, "en", "s1"),
        (3, changed, "en", None),
        (4, b + " " + c, None, "s2"),
        (5, sentence(4, 30) + " " + c + " " + sentence(5, 30), "de", "s2"),
        (5, sentence(4, 30) + " " + c + " " + sentence(5, 30), "de", "s2"),
        (6, None, "en", "s1"),
        (7, "", None, None),
        (8, " \t\n ", "en", "s1"),
        (9, "one", "en", "s1"),
        (10, "One  ONE\tone", "en", "s1"),
        (11, "ab" * 400, "en", "s1"),
        (12, ("é ü " + sentence(6, 12) + "\n") * 40, "fr", "s1"),
        (13, sentence(7, 9000) + " " + b, "en", "s1"),
        (None, a, "en", "s1"),
        (None, None, None, None),
    ]
