"""Language codes, names and scripts used by the joins and normalisers."""

from __future__ import annotations

# ISO 639-1 code, ISO 639-3 code, English name.
LANGUAGES = [
    ("ar", "arb", "arabic"),
    ("bn", "ben", "bengali"),
    ("de", "deu", "german"),
    ("el", "ell", "greek"),
    ("en", "eng", "english"),
    ("es", "spa", "spanish"),
    ("fr", "fra", "french"),
    ("hi", "hin", "hindi"),
    ("it", "ita", "italian"),
    ("ja", "jpn", "japanese"),
    ("ko", "kor", "korean"),
    ("ne", "npi", "nepali"),
    ("nl", "nld", "dutch"),
    ("pl", "pol", "polish"),
    ("pt", "por", "portuguese"),
    ("ru", "rus", "russian"),
    ("th", "tha", "thai"),
    ("tr", "tur", "turkish"),
    ("uk", "ukr", "ukrainian"),
    ("vi", "vie", "vietnamese"),
    ("yue", "yue", "cantonese"),
    ("zh", "cmn", "chinese"),
]


def rows_sql(rows: list[tuple], columns: str) -> str:
    """A VALUES table of fixed values for the checking SQL."""
    quoted = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {quoted}) AS dim({columns})"
