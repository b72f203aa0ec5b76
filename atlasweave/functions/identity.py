"""Stable keys and parts of URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(url: Column, patterns: list[tuple[str, str]], fallback: list[Column]) -> Column:
    """A row's key from its source URL (the prefix and first group of the first pattern that fits), else h and ten hex digits of the SHA-1 of the fallback columns, lower-cased and joined by a bar."""
    joined = F.lower(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in fallback]))
    out = F.concat(F.lit("h"), F.substring(F.sha1(joined), 1, 10))
    for prefix, pattern in reversed(patterns):
        out = F.when(url.rlike(pattern), F.concat(F.lit(prefix), F.regexp_extract(url, pattern, 1))).otherwise(out)
    return out


def host(url: Column) -> Column:
    """The lower-cased host without www, or null."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def useful_url(url: Column) -> Column:
    """A web page, not an interface or a data file."""
    return F.coalesce(url.rlike("^https?://") & ~url.contains("/api/") & ~F.lower(url).rlike(r"\.json($|[?#])"), F.lit(False))


def safe_url(url: Column) -> Column:
    """The URL if its scheme is one that a page may link to, else null."""
    return F.when(url.rlike("(?i)^(https?|mailto|tel):"), url)


def maps_url(lat: Column, lng: Column) -> Column:
    return F.format_string("https://www.google.com/maps/search/?api=1&query=%.6f,%.6f", lat, lng)
