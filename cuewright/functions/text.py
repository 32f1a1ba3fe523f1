"""Text functions as column expressions: normalisers, filters, rewrites, redaction, classes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright.functions.lists import let

# Fixed values.
CJK = r"\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{3000}-\x{303f}"
ASCII_SYMBOLS = r"$+<=>^`|~"
SPACELESS = ("zh", "yue", "ja")
SPACED_BY_CHARACTER = ("ko", "th", "arb", "vi", "hi", "el")
SCRIPT_BLOCKS = {
    "hi": (0x0900, 0x097F),
    "ne": (0x0900, 0x097F),
    "ar": (0x0600, 0x06FF),
    "zh": (0x4E00, 0x9FFF),
    "zh-CN": (0x4E00, 0x9FFF),
    "ja": (0x3040, 0x30FF),
    "ko": (0xAC00, 0xD7AF),
    "th": (0x0E00, 0x0E7F),
    "ru": (0x0400, 0x04FF),
    "uk": (0x0400, 0x04FF),
}
ENTITIES = {
    "&nbsp;": " ",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&hellip;": "…",
    "&mdash;": "—",
    "&ndash;": "–",
}
UNSAFE_CONTROLS = (
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}\x{fffd}]"
)
END_MARKS = ";:,.!?…)]}\"'“”‘’；：，。！？、）】"
RANGE_MARKS = "~〜～"
RANGE_FORMS = {"ko": "$1에서 $2", "ja": "$1から$2", "zh": "$1到$2", "en": "$1 to $2"}
PAUSE_DEFAULT_MS, PAUSE_MAX_MS = 350, 10_000
REDACTED = "***REDACTED***"
TOKEN_SHAPES = [
    r"hf_[A-Za-z0-9]{30,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"gh[pousr]_[A-Za-z0-9]{30,}",
    r"sk-[A-Za-z0-9_\-]{20,}",
    r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{6,}",
    r"AIza[0-9A-Za-z_\-]{35}",
    r"xox[baprs]-[A-Za-z0-9\-]{10,}",
    r"AKIA[0-9A-Z]{16}",
    r"(?i)bearer\s+[A-Za-z0-9._\-]{16,}",
]
URL_SECRET = (
    r"(?i)((?:access[_-]?token|api[_-]?key|apikey|auth[_-]?token|token|secret|password|passwd|pwd)=)"
    r"([^&\s\"'#]{6,})"
)
HOME_SHAPES = [
    r"(?i)[A-Za-z]:/Users/[^/\s\"']+",
    r"(?i)/Users/[^/\s\"']+",
    r"(?i)/home/[^/\s\"']+",
    r"(?i)[A-Za-z]:\\Users\\[^\\\s\"']+",
]
ERROR_RULES = [
    ("GPU_OOM", ["cuda out of memory", "mps backend out of memory", "hip out of memory", "out of memory on device"]),
    ("PYANNOTE_LICENSE_REQUIRED", []),  # needs both a model marker and an access marker
    ("HF_AUTH_FAILED", ["401 client error", "403 client error", "gatedrepoerror", "repository not found", "invalid user token", "huggingface_hub.errors"]),
    ("DISK_FULL", ["no space left on device", "errno 28", "disk quota exceeded"]),
    ("FFMPEG_MISSING", ["ffmpeg not found", "ffmpeg is not installed", "no such file or directory: 'ffmpeg'"]),
    ("NETWORK_ERROR", ["connection refused", "connection reset", "connection aborted", "couldn't connect to", "could not connect to", "max retries exceeded", "timed out", "timeout", "name or service not known", "temporary failure in name resolution", "ssl", "proxyerror"]),
]
LICENSE_MODEL, LICENSE_MARKS = "pyannote", ["401", "403", "gated", "access", "token"]
ANSI = r"\x1B(?:\][^\x07\x1B]*(?:\x07|\x1B\\)|[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
DIRECTION_HINTS = {
    "urgent": ("energy", "urgent"),
    "urgency": ("energy", "urgent"),
    "rushed": ("pace", "rushed"),
    "quick": ("pace", "quick"),
    "fast": ("pace", "quick"),
    "slow": ("pace", "slow"),
    "surprised": ("emotion", "surprised"),
    "shocked": ("emotion", "surprised"),
    "angry": ("emotion", "angry"),
    "sad": ("emotion", "sad"),
    "happy": ("emotion", "happy"),
    "warm": ("emotion", "warm"),
    "cold": ("emotion", "cold"),
    "hopeful": ("emotion", "hopeful"),
    "whisper": ("intimacy", "whispered"),
    "whispered": ("intimacy", "whispered"),
    "intimate": ("intimacy", "intimate"),
    "announcing": ("intimacy", "announcing"),
    "announcer": ("intimacy", "announcing"),
    "casual": ("formality", "casual"),
    "formal": ("formality", "formal"),
    "calm": ("energy", "calm"),
    "energetic": ("energy", "energetic"),
}
DIRECTION_ORDER = ["emotion", "energy", "pace", "intimacy", "formality"]
CHAPTER_LINE = r"(?i)^(?:chapter|part|book|prologue|epilogue|section)\b"
CHAPTER_LINE_MAX = 60
LINE_CHARS, LOOP_RUN, LOOP_UNIT = 42, 6, 60
LOOP_ROWS = 128
# Abbreviation, expansion, guard: "cap" before a capitalised word, "digit" before a number.
ABBREVIATIONS = {
    "en": [
        ("Dr.", "Doctor", "cap"), ("Mr.", "Mister", "cap"), ("Mrs.", "Missus", "cap"), ("Prof.", "Professor", "cap"),
        ("St.", "Saint", "cap"), ("Mt.", "Mount", "cap"), ("Jr.", "Junior", None), ("Sr.", "Senior", None),
        ("vs.", "versus", None), ("etc.", "et cetera", None), ("e.g.", "for example", None), ("i.e.", "that is", None),
        ("approx.", "approximately", None), ("No.", "number", "digit"),
    ],
    "de": [
        ("Dr.", "Doktor", "cap"), ("Prof.", "Professor", "cap"), ("Nr.", "Nummer", "digit"), ("z.B.", "zum Beispiel", None),
        ("z. B.", "zum Beispiel", None), ("d.h.", "das heißt", None), ("d. h.", "das heißt", None),
        ("usw.", "und so weiter", None), ("bzw.", "beziehungsweise", None), ("ca.", "circa", None),
    ],
    "es": [
        ("Sr.", "Señor", "cap"), ("Sra.", "Señora", "cap"), ("Srta.", "Señorita", "cap"), ("Dr.", "Doctor", "cap"),
        ("Dra.", "Doctora", "cap"), ("Ud.", "usted", None), ("Uds.", "ustedes", None), ("etc.", "etcétera", None),
        ("núm.", "número", "digit"),
    ],
    "fr": [
        ("Mme", "Madame", "cap"), ("Mmes", "Mesdames", "cap"), ("Mlle", "Mademoiselle", "cap"),
        ("Mlles", "Mesdemoiselles", "cap"), ("etc.", "et cetera", None), ("n°", "numéro", "digit"), ("N°", "Numéro", "digit"),
    ],
}
GUARDS = {None: "", "cap": r"(?=\s+[A-ZÀ-ÖØ-Þ])", "digit": r"(?=\s*\d)"}


def quote(text: str) -> str:
    """The text as a literal Java pattern."""
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|/&#~" else c for c in text)


def count_class(text: Column, members: str) -> Column:
    """Characters of a text in a character class, from the length lost when runs of them go."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{members}]+", ""))


def rewrite_matches(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace every match by an expression of it, in one left-to-right pass."""
    between = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rewrite)
    zipped = F.zip_with(between, matches, lambda b, m: F.concat(b, F.coalesce(m, F.lit(""))))
    return F.array_join(zipped, "")


def outside_brackets(text: Column, rewrite: Callable[[Column], Column]) -> Column:
    """Apply a rewrite outside ``[...]`` spans of at most 128 characters."""
    span = r"\[[^\]\[\n]{0,128}\]"
    plain = F.transform(F.split(text, span, -1), rewrite)
    spans = F.regexp_extract_all(text, F.lit(span), F.lit(0))
    return F.array_join(F.zip_with(plain, spans, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def spaced(text: Column) -> Column:
    """One space between all characters."""
    return F.array_join(F.split(text, ""), " ")


def norm_alnum(text: Column) -> Column:
    plain = F.lower(F.translate(text, "‘’", "''"))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-zA-Z0-9']", " "), r"\s+", " "))


def norm_strip_punct(text: Column, lang: Column) -> Column:
    """Punctuation other than the apostrophe removed; characters apart for zh, lower case for en."""
    bare = F.regexp_replace(text, rf"[\p{{P}}{quote(ASCII_SYMBOLS)}&&[^']]", "")
    bare = F.replace(bare, F.lit("  "), F.lit(" "))
    unknown = F.raise_error(F.concat(F.lit("no normaliser for language "), lang)).cast("string")
    return F.when(lang == "zh", spaced(bare)).when(lang == "en", F.lower(bare)).otherwise(unknown)


def norm_cer(text: Column, lang: Column) -> Column:
    """Character units for languages scored by characters, plain lower case for the others."""
    joined = spaced(F.replace(text, F.lit(" "), F.lit("")))
    barred = spaced(F.replace(text, F.lit(" "), F.lit("|")))
    units = F.when(lang.isin(*SPACELESS), joined).when(lang.isin(*SPACED_BY_CHARACTER), barred).otherwise(text)
    return F.trim(F.lower(units))


def norm_cer_all(text: Column) -> Column:
    """Spaces beside CJK characters removed, the rest as bars, characters apart."""
    tight = F.regexp_replace(text, rf"([{CJK}])\s+([{CJK}])", "$1$2")
    tight = F.regexp_replace(F.regexp_replace(tight, rf"([{CJK}])\s+", "$1"), rf"\s+([{CJK}])", "$1")
    tidy = F.trim(F.regexp_replace(tight, r"\s+", " "))
    return spaced(F.replace(tidy, F.lit(" "), F.lit("|")))


def safety_filters(text: Column) -> Column:
    """Control characters, entities, punctuation floods and blank floods taken out."""
    out = F.regexp_replace(text, UNSAFE_CONTROLS, "")
    alternatives = "|".join(quote(e) for e in ENTITIES)
    decode = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    out = rewrite_matches(
        out, rf"(?:{alternatives}|&amp;(?![a-zA-Z#]))", lambda m: F.coalesce(F.try_element_at(decode, m), F.lit("&"))
    )
    out = F.regexp_replace(out, r"([!?.,;:~_*#=-])\1{3,}", "$1$1$1")
    out = F.regexp_replace(out, r"(?U)[^\S\n]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    """Trim all white space, line breaks included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def expand_abbreviations(text: Column, lang: Column) -> Column:
    """Known abbreviations of the row's language written out; case matters."""
    out = text
    for code, entries in ABBREVIATIONS.items():
        known = {k for k, _, _ in entries}
        initial = [
            (k[0].upper() + k[1:], v[0].upper() + v[1:], g)
            for k, v, g in entries
            if k[0].islower() and k[0].upper() + k[1:] not in known
        ]
        here = text
        for key, expansion, guard in sorted([*entries, *initial], key=lambda e: -len(e[0])):
            edge = r"(?!\w)" if key[-1].isalnum() else ""
            here = F.regexp_replace(here, rf"(?U)(?<![\w.]){quote(key)}{edge}{GUARDS[guard]}", expansion)
        out = F.when(lang == code, here).otherwise(out)
    return out


def number_ranges(text: Column, lang: Column) -> Column:
    """``3~5`` spoken in languages with a known form; chains of tildes are left alone."""
    end = r"([+-]?(?:\d{1,6}(?:\.\d{1,6})?|\.\d{1,6}))"
    edge = rf"\d.,A-Za-z+{RANGE_MARKS}-"
    pattern = (
        rf"(?<![{edge}])(?<![{RANGE_MARKS}]\s{{1,20}}){end}\s*[{RANGE_MARKS}]\s*{end}(?![{edge}])(?!\s+[{RANGE_MARKS}])"
    )
    out = text
    for code, form in RANGE_FORMS.items():
        out = F.when(lang == code, F.regexp_replace(text, pattern, form)).otherwise(out)
    return out


def apply_lexicon(text: Column, lexicon: Mapping[str, str]) -> Column:
    """Whole-word, case-insensitive respelling; the longest key wins and nothing is rescanned."""
    clean = {k.strip(): v or "" for k, v in lexicon.items() if k and k.strip()}
    if not clean:
        return text

    def alternative(key: str) -> str:
        left = r"\b" if key[0].isalnum() or key[0] == "_" else ""
        right = r"\b" if key[-1].isalnum() or key[-1] == "_" else ""
        return left + quote(key) + right

    keys = sorted(clean, key=len, reverse=True)
    pattern = "(?iU)(?:" + "|".join(alternative(k) for k in keys) + ")"
    spelled = F.create_map(*[F.lit(x) for k in {k.lower(): k for k in reversed(keys)}.values() for x in (k.lower(), clean[k])])
    return rewrite_matches(text, pattern, lambda m: F.coalesce(F.try_element_at(spelled, F.lower(m)), m))


def inline_overrides(text: Column) -> Column:
    """``[[term|spoken]]`` and ``[[spoken]]`` to the spoken part."""
    return F.regexp_replace(text, r"\[\[(?=[^\]]{0,256}\]\])(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")


def script_ratio(text: Column, lang: Column) -> Column:
    """Share of letters in the language's script block; 1 without a block or letters."""
    letters = count_class(text, r"\p{L}")
    out = F.lit(1.0)
    for code, (lo, hi) in SCRIPT_BLOCKS.items():
        inside = count_class(text, rf"\x{{{lo:04x}}}-\x{{{hi:04x}}}&&\p{{L}}")
        out = F.when(lang == code, inside / letters).otherwise(out)
    return F.when(letters == 0, F.lit(1.0)).otherwise(out)


def registered_script_ratio(text: Column, lang: Column) -> Column:
    """As ``script_ratio`` with marks counted; null without a block or letters."""
    letters = count_class(text, r"\p{L}\p{Mn}\p{Mc}")
    out = F.lit(None).cast("double")
    for code, (lo, hi) in SCRIPT_BLOCKS.items():
        inside = count_class(text, rf"\x{{{lo:04x}}}-\x{{{hi:04x}}}&&[\p{{L}}\p{{Mn}}\p{{Mc}}]")
        out = F.when(lang == code, inside / letters).otherwise(out)
    return F.when(letters > 0, out)


def guess_language(text: Column) -> Column:
    """Language by script, first match of kana, Hangul, Han, Cyrillic, Arabic."""
    return (
        F.when(text.rlike(r"[\x{3040}-\x{30ff}]"), "ja")
        .when(text.rlike(r"[\x{ac00}-\x{d7a3}\x{1100}-\x{11ff}]"), "ko")
        .when(text.rlike(r"[\x{4e00}-\x{9fff}]"), "zh")
        .when(text.rlike(r"[\x{0400}-\x{04ff}]"), "ru")
        .when(text.rlike(r"[\x{0600}-\x{06ff}]"), "ar")
    )


def _overlap_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def echoes(candidate: Column, critique: Column) -> Column:
    """The candidate is the critique: equal, contained, most of it, or over 0.8 of the words shared."""
    c, k = _overlap_form(candidate), _overlap_form(critique)
    ct, kt = F.array_distinct(F.split(c, " ")), F.array_distinct(F.split(k, " "))
    shared = F.size(F.array_intersect(ct, kt)) / F.size(F.array_union(ct, kt))
    most = F.contains(k, c) & (F.length(c) >= 0.6 * F.length(k))
    return (c != "") & (k != "") & ((c == k) | F.contains(c, k) | most | (shared > 0.8))


def refine_check(reference: Column, candidate: Column, lang: Column, critique: Column | None = None,
                 lowest: float = 0.4, highest: float = 2.5) -> Column:
    """Reason a rewritten line is refused, null when it is fine."""
    cand, ref = F.trim(F.coalesce(candidate, F.lit(""))), F.trim(F.coalesce(reference, F.lit("")))
    n, m = F.length(cand), F.length(ref)
    ratio = n / m
    tag = (
        F.when(cand == "", "empty")
        .when(script_ratio(cand, lang) < 0.5, F.concat(F.lit("wrong-script:"), lang))
        .when((m > 0) & (m < 20) & (n > m + 120), "length-abs")
        .when((m >= 20) & ~ratio.between(lowest, highest), "length-ratio")
    )
    if critique is None:
        return tag
    return F.coalesce(tag, F.when((critique != "") & echoes(cand, critique), "critique-echo"))


def add_punctuation(text: Column) -> Column:
    tidy = F.trim(text)
    stop = F.when(tidy.rlike(r"[\x{4e00}-\x{9fff}]"), "。").otherwise(".")
    closed = F.contains(F.lit(END_MARKS), F.right(tidy, F.lit(1)))
    return F.when((tidy == "") | closed, tidy).otherwise(F.concat(tidy, stop))


def polish(text: Column) -> Column:
    """Blanks squeezed, first Latin letter capital, a stop at the end unless already closed."""

    def capital(tidy: Column) -> Column:
        first = F.left(tidy, F.lit(1))
        latin = first.rlike(r"^[a-zß-öø-ÿ\x{100}-\x{24f}]$") & (F.lower(first) == first) & (F.length(F.upper(first)) == 1)
        return F.when(latin, F.concat(F.upper(first), F.substr(tidy, F.lit(2)))).otherwise(tidy)

    def close(tidy: Column) -> Column:
        # Only the end matters: the last mark before any closing quotes and brackets.
        mark = F.regexp_extract(tidy, r"([^\"'”’»›)\]}」』）】])[\"'”’»›)\]}」』）】]*$", 1)
        return F.when((tidy == "") | mark.rlike("^[.!?…。！？।॥]$"), tidy).otherwise(let(undangled(tidy), stopped))

    def undangled(tidy: Column) -> Column:
        dangling = F.right(tidy, F.lit(1)).isin(*",;:、，；：")
        return F.when(dangling, F.rtrim(F.left(tidy, F.length(tidy) - 1))).otherwise(tidy)

    def stopped(tidy: Column) -> Column:
        last = F.right(tidy, F.lit(1))
        stop = (
            F.when(last.rlike(r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}]"), "。")
            .when(last.rlike(r"[\x{0900}-\x{097f}]"), "।")
            .otherwise(".")
        )
        return F.when(tidy == "", "").otherwise(F.concat(tidy, stop))

    return let(let(strip(F.regexp_replace(text, r"[ \t]{2,}", " ")), capital), close)


PAUSE = r"(?i)\[\s*pause(?>\s+(\d+(?:\.\d+)?)\s*(ms|s)?)?\s*\]"


def pause_ms(marker: Column) -> Column:
    """Milliseconds of one pause marker, capped."""
    number, unit = F.regexp_extract(marker, PAUSE, 1), F.lower(F.regexp_extract(marker, PAUSE, 2))
    value = number.cast("double") * F.when(unit == "s", 1000.0).otherwise(1.0)
    return F.when(number == "", PAUSE_DEFAULT_MS).otherwise(F.least(F.bround(value).cast("long"), F.lit(PAUSE_MAX_MS))).cast("long")


def pause_spans(text: Column) -> Column:
    """(span, pause after it) structs in order; markers with nothing between them add up.

    Neighbouring markers are first joined into one match, so every match is one pause.
    """
    run = f"(?:{PAUSE})+"
    spans = F.split(text, run, -1)
    marks = F.regexp_extract_all(text, F.lit(run), F.lit(0))

    def total(mark: Column) -> Column:
        each = F.regexp_extract_all(mark, F.lit(PAUSE), F.lit(0))
        summed = F.aggregate(each, F.lit(0).cast("long"), lambda a, m: F.least(a + pause_ms(m), F.lit(PAUSE_MAX_MS).cast("long")))
        return summed

    pairs = F.zip_with(
        spans, marks, lambda s, m: F.struct(s.alias("span"), F.coalesce(total(m), F.lit(0).cast("long")).alias("pause_ms"))
    )
    last_empty = (F.size(marks) > 0) & (F.element_at(spans, -1) == "")
    return F.when(last_empty, F.slice(pairs, F.lit(1), F.size(marks))).otherwise(pairs)


def chapterize(text: Column) -> Column:
    """Short lines that open with a chapter word become headings, unless the text has headings."""

    def mark(line: Column) -> Column:
        tidy = F.trim(line)
        short = (tidy != "") & (F.length(tidy) <= CHAPTER_LINE_MAX) & tidy.rlike(CHAPTER_LINE)
        return F.when(short, F.concat(F.lit("# "), tidy)).otherwise(line)

    lines = F.array_join(F.transform(F.split(text, "\n"), mark), "\n")
    return F.when(text.rlike(r"(?m)^[ \t]*#[ \t]+\S"), text).otherwise(lines)


def scrub(text: Column) -> Column:
    """Credentials, secret URL values and home folders out of a text."""
    out = F.coalesce(text, F.lit(""))
    for shape in TOKEN_SHAPES:
        out = F.regexp_replace(out, shape, REDACTED)
    out = F.regexp_replace(out, URL_SECRET, "$1" + REDACTED)
    for shape in HOME_SHAPES:
        out = F.regexp_replace(out, shape, "~")
    return out


def classify_error(blob: Column) -> Column:
    """First error class one of whose needles occurs, else UNKNOWN."""
    low = F.lower(blob)

    def any_of(needles: Sequence[str]) -> Column:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(low, F.lit(needle))
        return hit

    out = F.lit("UNKNOWN")
    for name, needles in reversed(ERROR_RULES):
        hit = any_of(needles) if needles else F.contains(low, F.lit(LICENSE_MODEL)) & any_of(LICENSE_MARKS)
        out = F.when(hit, name).otherwise(out)
    return out


def coarse_stage(route: Column) -> Column:
    """First path part of a route after an optional ``api``, at most 40 characters."""
    path = F.split_part(F.coalesce(route, F.lit("")), F.lit("?"), F.lit(1))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    rest = F.when(F.get(parts, F.lit(0)) == "api", F.slice(parts, 2, 1)).otherwise(F.slice(parts, 1, 1))
    return F.left(F.coalesce(F.get(rest, F.lit(0)), F.lit("")), F.lit(40))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def strip_banner(text: Column) -> Column:
    """A media tool's version banner and its indented lines out of captured output.

    Text that is nothing but a banner stays.
    """
    block = r"(?mi)^[ \t]*ff(?:mpeg|probe)\s+version\s.*(?:\n(?:[ \t]*$|[ \t]+(?:built with|configuration:|lib[a-z]+\s+\d).*))*\n?"
    rest = strip(F.regexp_replace(text, block, ""))
    return F.when(rest == "", strip(text)).otherwise(rest)


def direction_tokens(text: Column) -> Column:
    """Distinct ``dimension:value`` tokens of the hint words a description contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [
        F.when(low.rlike(rf"(?U)\b{word}\b"), f"{dimension}:{value}")
        for dim in DIRECTION_ORDER
        for word, (dimension, value) in DIRECTION_HINTS.items()
        if dimension == dim
    ]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def rate_bias(tokens: Column) -> Column:
    def has(*names: str) -> Column:
        return F.arrays_overlap(tokens, F.array(*[F.lit(n) for n in names]))

    return (
        F.when(has("energy:urgent", "energy:frantic", "pace:rushed", "pace:quick"), 1.1)
        .when(has("energy:calm", "energy:relaxed", "pace:slow"), 0.92)
        .otherwise(1.0)
    )


def direction_prompt(tokens: Column) -> Column:
    return F.array_join(F.array_distinct(F.transform(tokens, lambda t: F.split_part(t, F.lit(":"), F.lit(2)))), ", ")


PLACEHOLDER, TAG = r"\{\{[a-zA-Z0-9_]+\}\}", r"</?[0-9]+>"


def mask_placeholders(text: Column) -> Column:
    """(masked, vars, tags): placeholders and numbered tags replaced by indexed marks."""
    found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    tags = F.regexp_extract_all(text, F.lit(TAG), F.lit(0))

    def swap(body: Column, items: Column, mark: str) -> Column:
        numbered = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.aggregate(
            numbered, body, lambda acc, e: F.replace(acc, e["x"], F.concat(F.lit(f"__{mark}_"), e["i"].cast("string"), F.lit("__")))
        )

    return F.struct(swap(swap(text, found, "V"), tags, "T").alias("masked"), found.alias("vars"), tags.alias("tags"))


def unmask_placeholders(text: Column, found: Column, tags: Column) -> Column:
    """Marks, also with blanks a translator put into them, back to the originals."""

    def restore(body: Column, items: Column, mark: str) -> Column:
        spot = rf"__\s*{mark}\s*_\s*\d+\s*__"
        return rewrite_matches(
            body,
            spot,
            lambda m: F.coalesce(F.get(items, F.regexp_extract(m, r"(\d+)", 1).cast("int")), m),
        )

    return restore(restore(text, found, "V"), tags, "T")


def token_drift(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of word tokens over the reference length, on the JVM.

    Each distinct token of the pair becomes one code point, so that the built-in character
    distance counts tokens. Texts without words are compared by character.
    """

    def tokens(text: Column) -> Column:
        low = F.trim(F.lower(F.coalesce(text, F.lit(""))))
        words = F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0))
        letters = F.filter(F.split(F.replace(low, F.lit(" "), F.lit("")), ""), lambda c: c != "")
        return F.when(F.size(words) > 0, words).otherwise(letters)

    def score(p: Column) -> Column:
        n, m = F.size(p["r"]), F.size(p["h"])
        return F.when((n == 0) & (m == 0), 0.0).when(n == 0, 1.0).otherwise(let(coded(p), distance) / n)

    def coded(p: Column) -> Column:
        vocabulary = F.array_distinct(F.concat(p["r"], p["h"]))
        return let(F.struct(p["r"].alias("r"), p["h"].alias("h"), vocabulary.alias("v")), lambda b: F.struct(
            b["r"].alias("r"), b["h"].alias("h"), F.map_from_arrays(b["v"], F.transform(b["v"], code_point)).alias("c")
        ))

    def code_point(_: Column, i: Column) -> Column:
        # From U+10000 on, clear of the surrogate range.
        return F.decode(F.unhex(F.lpad(F.hex((i + 0x10000).cast("long")), 8, "0")), "UTF-32")

    def distance(b: Column) -> Column:
        def line(tokens_: Column) -> Column:
            return F.array_join(F.transform(tokens_, lambda t: F.element_at(b["c"], t)), "")

        return F.levenshtein(line(b["r"]), line(b["h"]))

    return let(F.struct(tokens(reference).alias("r"), tokens(hypothesis).alias("h")), score)


HIDDEN = r"(?is)<(script|style|head)\b.*?</(script|style|head)\s*>"
HEADING = r"(?is)<(title|h1|h2)\b[^>]*>(.*?)</(title|h1|h2)\s*>"
BREAKING = r"(?is)<(p|br|div|h1|h2|h3|li|tr)\b[^>]*>"
PAGE_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def page_text(html: Column) -> list[Column]:
    """Title and visible text of a page, as columns ``title`` and ``body``.

    The first heading outside the head is the title and leaves the text; scripts, styles and the head
    are dropped, block tags break lines, and at most one blank line stands in a row.
    """
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    title = F.btrim(F.regexp_replace(F.regexp_extract(shown, HEADING, 2), r"(?s)<[^>]*>", ""), F.lit("\n "))
    heading = F.regexp_substr(shown, F.lit(HEADING))
    at = F.position(heading, shown)
    around = F.concat(F.substring(shown, F.lit(1), at - 1), F.lit("<br>"), F.substring(shown, at + F.length(heading), F.length(shown)))
    rest = F.when(heading.isNull(), shown).otherwise(around)
    body = F.regexp_replace(F.regexp_replace(rest, BREAKING, "\n"), r"(?s)<[^>]*>", "")
    body = F.regexp_replace(F.regexp_replace(body, r"[ \t\r]*\n[ \t\r]*", "\n"), r"\n{3,}", "\n\n")
    out = {"title": title, "body": F.btrim(body, F.lit("\n\t\r "))}
    for entity, char in PAGE_ENTITIES.items():
        out = {name: F.replace(column, F.lit(entity), F.lit(char)) for name, column in out.items()}
    return [column.alias(name) for name, column in out.items()]


def tokens(text: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas inside name it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def wrapped(text: Column, width: int = LINE_CHARS) -> Column:
    """A caption as at most two lines: the longest run of words that fits ``width``, and all others.

    One line where everything fits, or where the first word alone is too long. Null has no lines.
    """
    line = F.array_join(tokens(text), " ")
    first = F.regexp_extract(line, rf"^.{{1,{width}}}(?= |$)", 0)
    rest = F.ltrim(F.substr(line, F.length(first) + 1))
    return F.coalesce(F.filter(F.array(first, rest), lambda x: x != ""), F.array().cast("array<string>"))


def without_loops(text: Column, run: int = LOOP_RUN, unit: int = LOOP_UNIT) -> Column:
    """Recogniser loops taken out: ``run`` or more equal tokens, then any 2 to ``unit`` characters as often in a row.

    Tokens are equal without case and punctuation; a token of punctuation only equals none. A text of
    fewer tokens keeps its blanks unless a loop of characters is cut. Null stays null. The pattern tries
    every length at every character; for tables, put the two steps below in selects of their own.
    """
    loop = rf"(?s)(.{{2,{unit}}}?)\1{{{run - 1},}}"

    def uncut(t: Column) -> Column:
        return bound(F.regexp_replace(t, loop, ""), lambda cut: F.when(cut == t, t).otherwise(F.array_join(tokens(cut), " ")))

    return bound(without_token_loops(text, run), uncut)


def without_token_loops(text: Column, run: int = LOOP_RUN) -> Column:
    """The first step of ``without_loops``."""

    def key(word: Column) -> Column:
        return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}_]", ""))

    def begins(keys: Column) -> Column:
        changed = F.transform(keys, lambda k, i: F.when((i == 0) | (k == "") | (k != F.get(keys, i - 1)), i))
        return F.filter(changed, lambda i: i.isNotNull())

    def kept(words: Column, starts: Column) -> Column:
        runs = F.transform(starts, lambda b, i: F.struct((b + 1).alias("at"), (F.coalesce(F.get(starts, i + 1), F.size(words)) - b).alias("n")))
        parts = F.transform(F.filter(runs, lambda r: r["n"] < run), lambda r: F.slice(words, r["at"], r["n"]))
        return F.array_join(F.flatten(parts), " ")

    def cleared(words: Column) -> Column:
        found = bound(F.transform(words, key), lambda keys: bound(begins(keys), lambda starts: kept(words, starts)))
        return F.when(F.size(words) >= run, found)

    return F.coalesce(bound(tokens(text), cleared), text)


def without_character_loops(text: Column, run: int = LOOP_RUN, unit: int = LOOP_UNIT) -> Column:
    """The second step of ``without_loops``, in an Arrow UDF; ``text`` must be a column without nested lambdas."""

    @F.arrow_udf("string")
    def uncut(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(texts), LOOP_ROWS):
            some = texts.slice(at, LOOP_ROWS).to_pylist()
            parts.append(pa.array([None if t is None else cut_loops(t, run, unit) for t in some], pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.coalesce(F.btrim(F.regexp_replace(uncut(text), r"(?U)\s+", " "), F.lit(" ")), text)


def cut_loops(text: str, run: int, unit: int) -> str | None:
    """``text`` without its loops of 2 to ``unit`` characters; none where it has no loop.

    As ``(.{2,unit}?)\\1{run-1,}`` finds them: from the left, the shortest unit first. A loop of ``unit``
    characters is a stretch equal to itself so many further on; one in ``unit`` of its places tells most texts apart.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    found = []
    for size in range(2, min(unit, len(codes) // run) + 1):
        some = codes[:-size:size] == codes[size::size]
        ahead = some[: len(some) - run + 2]
        for i in range(1, run - 1):
            ahead = ahead & some[i : len(some) - run + 2 + i]
        if not ahead.any():
            continue
        edges = np.flatnonzero(np.concatenate(([True], codes[:-size] != codes[size:], [True])))
        long = np.flatnonzero(np.diff(edges) > (run - 1) * size)
        found += [(int(edges[i]), size, int(edges[i + 1]) - 1) for i in long]
    heapify(found)
    kept, at = [], 0
    while found:
        begin, size, end = heappop(found)
        if begin >= at:
            kept.append(text[at:begin])
            at = begin + size * (1 + (end - begin) // size)
        if end - at >= (run - 1) * size:
            heappush(found, (at, size, end))
    return "".join([*kept, text[at:]]) if at else None
