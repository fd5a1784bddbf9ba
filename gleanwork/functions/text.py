"""Strings: slugs, timestamps, rates, log fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column, max_len: int = 32) -> Column:
    """Lower case, other runs to one hyphen, none at the ends, `image` if empty, then cut."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.substring(F.coalesce(F.nullif(bare, F.lit("")), F.lit("image")), 1, max_len)


def is_ascii(text: Column) -> Column:
    return F.char_length(text) == F.octet_length(text)


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def compact_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def rate_text(part: Column, whole: Column) -> Column:
    """A percentage with one decimal, half up, exact in integers; `0.0%` of nothing."""
    scaled = part.cast("long") * 2000 + whole.cast("long")
    tenths = F.when(whole > 0, (scaled - F.pmod(scaled, whole.cast("long") * 2)) / (whole.cast("long") * 2)).cast("long")
    return F.when(whole > 0, F.concat(((tenths - F.pmod(tenths, F.lit(10))) / 10).cast("long").cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("%"))).otherwise("0.0%")


def base64_line(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def data_uri(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), base64_line(data))


def error_reason(line: Column) -> Column:
    """What follows the first `error=` of a log line; empty without one."""
    return F.regexp_extract(line, "error=(.+)$", 1)


def join_flags(flags: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(flags, ","), F.lit("")), F.lit("none"))


def strip_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")
