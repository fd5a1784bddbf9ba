"""Content types, magic bytes and the checks of a fetched payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of content types. Others get .jpg.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/svg+xml": ".svg", "application/octet-stream": ".bin"}

# Magic bytes in hex, as LIKE patterns, and their content types.
MAGIC = {"FFD8%": "image/jpeg", "89504E47%": "image/png", "47494638%": "image/gif", "52494646________57454250%": "image/webp"}

# Reasons of rejection, in the order in which they are tested.
REASONS = ("status", "too large (declared)", "too small (declared)", "unsupported content-type", "truncated", "too large", "too small", "html")


def content_type_norm(content_type: Column) -> Column:
    """What stands before the first semicolon, trimmed, in lower case; null is empty."""
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))


def mime_to_ext(content_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, content_type_norm(content_type)), F.lit(".jpg"))


def sniff_mime(data: Column) -> Column:
    """The content type by magic bytes; image/jpeg if none fits."""
    head, out = F.hex(F.substring(data, 1, 12)), None
    for pattern, mime in MAGIC.items():
        out = F.when(head.like(pattern), mime) if out is None else out.when(head.like(pattern), mime)
    return out.otherwise("image/jpeg")


def looks_like_html(data: Column, within: int = 1024) -> Column:
    """Whether the first byte after ASCII white space is `<`. Only a value that is blank `within` so many bytes is read further."""
    head = F.hex(F.substring(data, 1, within))
    blank = head.rlike("^(20|09|0A|0B|0C|0D)*$") & (F.octet_length(data) > within)
    rest = F.ltrim(F.decode(data.cast("binary"), "ISO-8859-1"), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(blank, rest.startswith("<")).otherwise(head.rlike("^(20|09|0A|0B|0C|0D)*3C"))


def declared_length(content_length: Column) -> Column:
    """The number, if the header is digits alone; else null."""
    return F.when(content_length.rlike("^[0-9]+$"), content_length.try_cast("long"))


def reject_reason(status: Column, content_type: Column, content_length: Column, data: Column, min_bytes: int, max_bytes: int, content_types: tuple[str, ...], tolerant: bool = False) -> Column:
    """The first failing check by name, or null. A missing payload fails as `status`. `tolerant`: see short_of_declared()."""
    declared, size, mime = declared_length(content_length), F.octet_length(data), content_type_norm(content_type)
    checks = [
        ~F.coalesce(status == 200, F.lit(False)) | data.isNull(),
        declared > max_bytes,
        declared < min_bytes,
        ~((mime == "") | mime.isin(*content_types)),
        short_of_declared(declared, size) if tolerant else size != declared,
        size > max_bytes,
        size < min_bytes,
        looks_like_html(data),
    ]
    out = F.when(checks[0], REASONS[0])
    for check, reason in zip(checks[1:], REASONS[1:], strict=True):
        out = out.when(check, reason)
    return out


def short_of_declared(declared: Column, size: Column, share: float = 0.10, most: int = 64 << 10) -> Column:
    """The tolerant form of the length check: short by over a tenth, or by over 64 KiB."""
    return (declared - size > declared * share) | (declared - size > most)
