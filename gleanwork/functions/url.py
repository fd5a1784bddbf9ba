"""Parts of URLs by regular expressions, which never fail on odd URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    """The path without query, fragment, and parameters of the last segment."""
    bare = F.regexp_replace(url, r"[?#][\s\S]*$", "")
    path = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    return F.regexp_replace(path, r";[^/]*$", "")


def url_name(url: Column) -> Column:
    """The last segment; slashes at the end don't count."""
    return F.regexp_extract(url_path(url), r"([^/]*)/*$", 1)


def url_ext(url: Column) -> Column:
    """The lower-case suffix with its dot, or an empty string; `.jpg` alone has none."""
    return F.lower(F.regexp_extract(url_path(url), r"[^/](\.[^./]+)/*$", 1))


def url_stem(url: Column) -> Column:
    """The last segment without its suffix, else the host, else `image`."""
    name = url_name(url)
    stem = F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1), F.lit("")), name)
    return F.coalesce(F.nullif(stem, F.lit("")), F.nullif(url_host(url), F.lit("")), F.lit("image"))


def url_looks_like_thumbnail(url: Column) -> Column:
    """URLs of small renditions: thumb, preview, avatar or icon in the path, or a size of up to three digits."""
    return F.lower(url).rlike(r"[/_.\-](thumbs?|thumbnail|preview|avatar|icons?)[/_.\-]|[?&](w|h|width|height|size)=[0-9]{1,3}(&|$)")
