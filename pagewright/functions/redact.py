"""Secrets in free text and in headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as patterns of browsers know it.
S = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# The four patterns, applied in this order, and what replaces them.
PATTERNS = (
    (rf"(?i)(authorization{S}*[:=]{S}*)(?:Bearer{S}+[A-Za-z0-9._~+/-]+=*|Basic{S}+[A-Za-z0-9+/]+=*)", "$1REDACTED"),
    (rf"(?i)Bearer{S}+[A-Za-z0-9._~+/-]+=*", "Bearer REDACTED"),
    (rf"(?i)Basic{S}+[A-Za-z0-9+/]+=*", "Basic REDACTED"),
    (
        rf"(?i)([\"']?(?:password|passwd|pwd|token|secret|api[-_]?key|authorization|cookie|session|credential)[\"']?{S}*[:=]{S}*)"
        r"(\"[^\"]*\"|'[^']*'|[^\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff},;}]+)",
        "$1REDACTED",
    ),
)

# Headers that may be stored.
SAFE_HEADERS = (
    "accept accept-ranges access-control-allow-credentials access-control-allow-origin cache-control content-encoding content-language "
    "content-length content-range content-type etag expires if-modified-since if-none-match last-modified range vary"
).split()


def text(value: Column) -> Column:
    for pattern, by in PATTERNS:
        value = F.regexp_replace(value, pattern, by)
    return value


def headers(values: Column) -> Column:
    """The safe headers of a map, names in lower case, values redacted."""
    lower = F.transform_keys(values, lambda k, _: F.lower(k))
    return F.transform_values(F.map_filter(lower, lambda k, _: k.isin(SAFE_HEADERS)), lambda _, v: text(v))
