"""Scalar column functions (F1-F17).  All are built-in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values that must equal the service's --------------------------
# Queue names.
EMAIL_QUEUE = "email.queue"
PROCESS_QUEUE = "process.queue"
SAVE_QUEUE = "video.save.queue"
SAVE_RETRY_QUEUE = "save.retry.queue"
DEAD_SUFFIX = ".dead"
# Content type -> file extension (anything else -> '').
CONTENT_TYPE_EXT = {"video/mp4": "mp4", "video/quicktime": "mov", "video/x-matroska": "mkv",
                    "video/webm": "webm", "video/avi": "avi"}
# Conversion defaults and filter templates.
DEFAULT_FPS = 10
DEFAULT_WIDTH = 480
LOOP_ON, LOOP_OFF = "0", "-1"
PALETTE_FILTER = "fps=%d,scale=%d:-1:flags=lanczos,palettegen"
GIF_FILTER = "fps=%d,scale=%d:-1:flags=lanczos[x];[x][1:v]paletteuse"
# Mail kinds: message name -> (template, subject, link path or None).
MAIL_ROUTES = {
    "signup": ("verification", "Verify your email", "/auth/verify?token="),
    "resend-verify": ("verification", "Verify your email", "/auth/verify?token="),
    "forgot-password": ("reset", "Reset Password", "/auth/reset?token="),
    "reset-password": ("notice", "Reset Password", None),
}
MAIL_BASE_URL = "http://127.0.0.1:8080"
BEARER_PREFIX = "Bearer "
RATE_KEY_PREFIX = "rate_limit:ip:"
SPECIAL_CHARS = "!@#$%^&*"
# --------------------------------------------------------------------------

# UUID forms accepted by the service's parser: plain, braced, urn-prefixed, 32 hex.
_HEX = "[0-9a-fA-F]"
_UUID = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"
UUID_PATTERN = f"({_UUID}|\\{{{_UUID}\\}}|urn:uuid:{_UUID}|{_HEX}{{32}})"


# F1
def token_hash(c: Column) -> Column:
    """SHA-256 hex of a token."""
    return F.sha2(c.cast("string"), 256)


# F3
def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^{UUID_PATTERN}\\z"), F.lit(False))


def uuid_text(seed: Column) -> Column:
    """A deterministic UUID-shaped text from any value (md5 in 8-4-4-4-12)."""
    h = F.md5(seed.cast("string"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


# F4
def file_ext(name: Column) -> Column:
    """Extension of the last path element, dot included ('' when none)."""
    return F.regexp_extract(name, r"(\.[^./]*)$", 1)


def storage_key(user_id: Column, random_id: Column, filename: Column) -> Column:
    """user id + random id + extension of the uploaded file name."""
    return F.concat(user_id.cast("string"), random_id.cast("string"), file_ext(filename))


# F5
def content_type_ext(content_type: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in CONTENT_TYPE_EXT.items() for x in kv])
    return F.coalesce(F.element_at(m, content_type), F.lit(""))


# F6 - F8
def default_fps(fps: Column) -> Column:
    return F.when(fps == 0, F.lit(DEFAULT_FPS)).otherwise(fps)


def default_width(width: Column) -> Column:
    return F.when(width == 0, F.lit(DEFAULT_WIDTH)).otherwise(width)


def loop_flag(loop: Column) -> Column:
    return F.when(loop, F.lit(LOOP_ON)).otherwise(F.lit(LOOP_OFF))


def fixed2(x: Column) -> Column:
    """``%.2f`` of a float32 as C/Go print it.

    Ties go to even on the exact binary value, and a negative value keeps its
    sign even when it rounds to zero (``-0.00``), which ``bround`` alone loses.
    """
    d = x.cast("float").cast("double")
    neg = F.when(d == 0, d.cast("string").startswith("-")).otherwise(d < 0)  # text only for +-0
    # after bround the value has two decimals exactly, so a decimal(38,2)
    # cast prints it without another rounding (and much faster than a Formatter)
    body = F.bround(F.abs(d), 2).cast("decimal(38,2)").cast("string")
    return F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")), body)


def _fill(template: str, fps: Column, width: Column) -> Column:
    """``template % (fps, width)`` as a concat (the template has two ``%d``)."""
    a, b, c = template.split("%d")
    return F.concat(F.lit(a), fps.cast("string"), F.lit(b), width.cast("string"), F.lit(c))


def palette_filter(fps: Column, width: Column) -> Column:
    return _fill(PALETTE_FILTER, fps, width)


def gif_filter(fps: Column, width: Column) -> Column:
    return _fill(GIF_FILTER, fps, width)


# F9 / F10
def client_ip(remote_addr: Column) -> Column:
    """Text before the first ':' ('[::1]:80' gives '[' as in the service)."""
    return F.substring_index(remote_addr, ":", 1)


def rate_limit_key(remote_addr: Column) -> Column:
    return F.concat(F.lit(RATE_KEY_PREFIX), client_ip(remote_addr))


def bearer_token(header: Column) -> Column:
    """Token after 'Bearer ', null when the header is missing or another scheme."""
    ok = header.isNotNull() & (header != "") & header.startswith(BEARER_PREFIX)
    return F.when(ok, F.substring(header, len(BEARER_PREFIX) + 1, 1 << 30))


# F11
_INT = r"^[+]?[0-9]+\z"


def range_parse(header: Column, total: Column) -> Column:
    """Byte-range header -> struct(start, end, length, code).

    '' is the whole object (200; an empty object gives 0..-1).  Otherwise
    'bytes=<start>-[<end>]' with exactly one '-': start required, end
    defaults to and is clamped to total-1; numbers are ``[+]digits`` within
    64 bits; start > end, a second '-', a list or another unit -> 416.
    """
    m = F.regexp_extract(header, r"^bytes=([^-]*)-([^-]*)\z", 0) != ""
    p1 = F.regexp_extract(header, r"^bytes=([^-]*)-([^-]*)\z", 1)
    p2 = F.regexp_extract(header, r"^bytes=([^-]*)-([^-]*)\z", 2)
    start = F.when(p1.rlike(_INT), p1.try_cast("bigint"))
    end_raw = F.when(p2 == "", total - 1).when(p2.rlike(_INT), p2.try_cast("bigint"))
    end = F.least(end_raw, total - 1)
    ok = m & start.isNotNull() & end_raw.isNotNull() & (start <= end)
    whole = header == ""
    code = F.when(whole, 200).when(ok, 206).otherwise(416)
    s = F.when(whole, F.lit(0).cast("bigint")).when(ok, start)
    e = F.when(whole, total - 1).when(ok, end)
    return F.struct(s.alias("start"), e.alias("end"), (e - s + 1).alias("length"), code.alias("code"))


# F12
def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def url_path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def url_query_param(url: Column, key: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))


def url_path_value(url: Column, position: int) -> Column:
    """The ``position``-th segment of the path (from 1); null if there are fewer or it is empty."""
    part = F.get(F.filter(F.split(url_path(url), "/"), lambda s: s != ""), position - 1)
    return part


# F2
def random_uuid() -> Column:
    """A fresh random (version 4) UUID per row; differs from run to run, so checked queries use ``uuid_text``."""
    return F.uuid()


# F13
def dead_letter_queue(queue: Column) -> Column:
    return F.concat(queue, F.lit(DEAD_SUFFIX))


# F14
def retry_count(deaths: Column) -> Column:
    """First death entry's count; 0 when the header is absent or empty."""
    return F.coalesce(F.get(deaths, 0)["count"].cast("long"), F.lit(0).cast("long"))


# F16
def remaining_ms(expires_at: Column, now: Column) -> Column:
    from .timecols import epoch_ms
    return epoch_ms(expires_at) - epoch_ms(now)


# F17
def mail_fields(name: Column, token: Column, base_url: str = MAIL_BASE_URL) -> Column:
    """struct(template, subject, link) for a mail message name (nulls when unknown)."""
    tpl, subj, link = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (t, s, path) in MAIL_ROUTES.items():
        hit = name == n
        tpl = F.when(hit, F.lit(t)).otherwise(tpl)
        subj = F.when(hit, F.lit(s)).otherwise(subj)
        if path is not None:
            link = F.when(hit, F.concat(F.lit(base_url + path), token)).otherwise(link)
    return F.struct(tpl.alias("template"), subj.alias("subject"), link.alias("link"))
