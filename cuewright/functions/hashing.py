"""Fingerprints: equal inputs give equal digests, whatever the column order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

EFFECT_PRESET_DEFAULT = "broadcast"
FIT_DEFAULTS = {
    "timing_strategy": "smart_fit",
    "max_audio_only_rate": 1.2,
    "audio_rate_cap": 1.5,
    "video_slow_cap": 2.0,
    "gap_guard_s": 0.05,
    "allow_video_retime": True,
}


def canonical(fields: Mapping[str, Column]) -> Column:
    """Sorted ``name=length:value`` pieces; null counts as the empty string."""
    pieces = []
    for name in sorted(fields):
        value = F.coalesce(fields[name].cast("string"), F.lit(""))
        pieces += [F.lit(f"{name}="), F.length(value).cast("string"), F.lit(":"), value, F.lit(";")]
    return F.concat(*pieces)


def canonical_sql(fields: Mapping[str, str]) -> str:
    pieces = []
    for name in sorted(fields):
        value = f"COALESCE(CAST({fields[name]} AS VARCHAR), '')"
        pieces.append(f"'{name}=' || CAST(LENGTH({value}) AS VARCHAR) || ':' || {value} || ';'")
    return " || ".join(pieces)


def short_sha1(text: Column, digits: int = 16) -> Column:
    return F.left(F.sha1(text), F.lit(digits))


def segment_fingerprint(fields: Mapping[str, Column], track_lang: Column | None = None, voice_match: Column | None = None) -> Column:
    """Digest of the inputs that change a segment's audio.

    A missing effect preset means the default one; track language and a non-default voice
    matching mode join the payload only when given.
    """
    names = ("text", "target_lang", "profile_id", "instruct", "speed", "direction")
    payload = {n: fields.get(n, F.lit(None)) for n in names}
    if "speed" in fields:
        payload["speed"] = fields["speed"].cast("double")
    preset = F.nullif(fields.get("effect_preset", F.lit(None)).cast("string"), F.lit(""))
    payload["effect_preset"] = F.coalesce(preset, F.lit(EFFECT_PRESET_DEFAULT))
    body = canonical(payload)
    if track_lang is not None:
        body = F.concat(body, F.coalesce(F.concat(F.lit("track_lang="), F.nullif(track_lang, F.lit(""))), F.lit("")))
    if voice_match is not None:
        mode = F.nullif(F.nullif(voice_match, F.lit("")), F.lit("per_line"))
        body = F.concat(body, F.coalesce(F.concat(F.lit("voice_match="), mode), F.lit("")))
    return short_sha1(body)


def fit_fingerprint(params: Mapping[str, Column]) -> Column:
    """Digest of the fit settings; settings left out take their defaults."""
    payload = {
        name: F.coalesce(params[name], F.lit(default)) if name in params else F.lit(default)
        for name, default in FIT_DEFAULTS.items()
    }
    return short_sha1(canonical(payload))
