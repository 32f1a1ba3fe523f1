"""Failure reasons to named classes: an ordered table of markers, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. A class holds when one of its cases does; a case holds when each of its parts does;
# a part is a marker, a pattern (behind "~"), or a tuple of which one is enough. First class wins.
WRITE_REFUSED = (
    "errno 22", "invalid argument", "errno 13", "permission denied", "errno 28", "no space left", "errno 2",
    "no such file or directory", "unable to open for writing", "unable to rename file",
)
DOWNLOADING = ("unable to download video", "unable to open for writing", "unable to rename file", "yt_dlp", "yt-dlp")
UNREACHED = (
    "couldn't connect to", "could not connect to", "connection error", "connection refused", "connection reset",
    "connection aborted", "max retries exceeded", "failed to establish a new connection", "name or service not known",
    "temporary failure in name resolution", "nodename nor servname provided", "getaddrinfo failed", "timed out",
    "an error happened while trying to locate the file on the hub", "we cannot find the requested files",
    "peer closed connection", "incomplete message body", "incompleteread", "incomplete read", "connection broken",
    "response ended prematurely",
)
HUB = (
    "huggingface", "hf_hub", "hf-hub", "load the files", "cached files", "the requested files", "locate the file on the hub",
    "snapshot_download",
)
MIRROR, PACKAGE = "HF_MIRROR_UNREACHABLE", "BROKEN_VENV"
FAILURES = (
    ("GPU_OOM", [
        "cuda out of memory", "cuda error: out of memory", "cuda_error_out_of_memory", "mps backend out of memory",
        "hip out of memory", "out of memory on device",
    ]),
    ("PKG_RESOURCES_MISSING", ["pkg_resources"]),
    ("GATEKEEPER_QUARANTINE", ["quarantine", "is damaged", "gatekeeper"]),
    ("APPIMAGE_WEBKIT_WHITESCREEN", ["webkit", "white screen", "dmabuf", "appimage"]),
    ("POCKETTTS_GATED_WEIGHTS", [
        [("gated", "share your contact", "access agreement", "access conditions"), ("pocket", "kyutai")],
    ]),
    ("PYANNOTE_LICENSE_REQUIRED", ["pyannote", ["gated", "model"], "accept the"]),
    ("COMPUTE_TYPE_UNSUPPORTED", ["compute type", "efficient float16"]),
    ("VIDEO_DOWNLOAD_OS_ERROR", [[WRITE_REFUSED, DOWNLOADING]]),
    ("MEDIA_TOOL_MISSING", [[("no such file or directory", "[winerror 2]"), ("'ffprobe'", '"ffprobe"', "'ffmpeg'", '"ffmpeg"')]]),
    ("WINDOWS_PAGING_FILE_TOO_SMALL", [["1455", ("winerror", "os error")], "paging file is too small"]),
    ("OS_INVALID_ARGUMENT", ["errno 22"]),
    ("MODEL_CACHE_CORRUPT", [
        "does not appear to have a file named", ["error no file named", "found in directory"],
        "error while deserializing header", "headertoolarge", "metadataincompletebuffer", "invalidheaderdeserialization",
        "deserializing header", "invalid load key", ["unexpected end of file", ("safetensors", "pytorch_model", "checkpoint")],
        ["failed to load", "checkpoint", "corrupt"], ["config file", "not a valid json file"], "broken file link",
        ["the tts model cache for", "is incomplete", ("could not be auto-repaired", "weights missing")],
    ]),
    ("MODEL_DOWNLOAD_INTERRUPTED", [["client has been closed", ("import", "transformers", "autofeatureextractor")]]),
    ("TRANSFORMERS_IMPORT", [
        "could not import module", "autofeatureextractor", [("no such file", "errno 2"), "transformers", "site-packages"],
    ]),
    ("SOCKS_PROXY_SUPPORT_MISSING", ["socks proxy", "socksio"]),
    ("TLS_CONNECTION_DROPPED", [["ssl", ("unexpected_eof_while_reading", "eof occurred in violation of protocol")]]),
    ("SSL_HANDSHAKE_FAILURE", [
        ["ssl", ("handshake", "certificate verify failed", "sslv3_alert", "sslcertverificationerror")],
    ]),
    ("HF_AUTH_FAILED", [
        [("huggingface", "hf_token", "unauthorized"), ("token", "auth", r"~(?<![\w.-])401(?![\w-])(?!\.\d)")],
    ]),
    (MIRROR, []),
    ("UNSUPPORTED_VIDEO_URL", ["unsupported url", "no video formats", "is not a valid url"]),
    ("VIDEO_DOWNLOAD_BOT_CHECK", [["not a bot", ("sign in", "cookies")]]),
    ("VIDEO_DRM_PROTECTED", ["drm protected", "drm-protected"]),
    ("VIDEO_DOWNLOAD_NETWORK", [
        "broken pipe", "connection reset", "unable to download video", "remote end closed", "timed out",
        "the page needs to be reloaded",
    ]),
    ("WINDOWS_APP_CONTROL_BLOCKED", ["[winerror 4551]", "[winerror 1260]", "application control policy"]),
    ("WINDOWS_UNTRUSTED_MOUNT", ["[winerror 448]", "untrusted mount point"]),
    ("INPUT_TOO_SHORT", ["kernel size can't be greater than actual input size", "calculated padded input size per channel"]),
    ("CLONE_REFERENCE_MISSING", ["no conditionals available", ["audio_prompt", "conds.safetensors"]]),
    ("AUDIO_IO_FAILED", ["libsndfile", "writing the audio file failed"]),
    (PACKAGE, ["no module named 'encodings'"]),
)


def failure_class(reason: Column, own_package: str = "cuewright", mirror: str = "") -> Column:
    """The first class of ``FAILURES`` that a reason meets, else the empty string; null reads as empty.

    ``own_package`` is the package whose missing import means a broken installation; the class of an
    unreachable model mirror exists only where ``mirror``, its address, is given.
    """
    low = F.lower(F.coalesce(reason, F.lit("")))

    def part(markers: str | tuple[str, ...]) -> Column:
        each = (markers,) if isinstance(markers, str) else markers
        return reduce(Column.__or__, (low.rlike(m[1:]) if m.startswith("~") else F.contains(low, F.lit(m)) for m in each))

    def case(parts: str | list) -> Column:
        return reduce(Column.__and__, map(part, [parts] if isinstance(parts, str) else parts))

    host = mirror.lower().split("//")[-1].split("/")[0]
    settings = {MIRROR: [[UNREACHED, (host, *HUB)]] if host else [], PACKAGE: [f"no module named '{own_package}'"]}
    out = F.lit("")
    for name, cases in reversed(FAILURES):
        known = [*cases, *settings.get(name, [])]
        if known:
            out = F.when(reduce(Column.__or__, map(case, known)), name).otherwise(out)
    return out
