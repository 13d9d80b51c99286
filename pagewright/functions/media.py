"""Alternatives of one image, and volatile queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Query names that only choose a rendition of an image, and names that only defeat caches.
RENDITION = ["dpr", "h", "height", "quality", "w", "width"]
BUSTERS = ["cache", "cachebust", "cachebuster", "cb", "t", "timestamp", "ts", "v", "ver", "version"]
TIMESTAMP = r"^([A-Za-z][A-Za-z0-9_-]{0,63}[_-])?[0-9]{11,}$"
# Values that leave a rendition as it is.
NEUTRAL_CROPS = ["center", "centre"]


def pairs(url: Column) -> Column:
    """The query's name=value texts, in order."""
    return F.filter(F.split(F.regexp_replace(urls.search(url), r"^\?", ""), "&"), lambda p: p != "")


def name(pair: Column) -> Column:
    return F.lower(F.regexp_extract(pair, "^([^=]*)", 1))


def value(pair: Column) -> Column:
    return F.regexp_extract(pair, "^[^=]*=?(.*)$", 1)


def rendition_identity(url: Column) -> Column:
    """The URL without what only chooses a rendition; its other parameters stay in order."""
    kept = F.filter(pairs(url), lambda p: ~name(p).isin(RENDITION) & ~((name(p) == "crop") & F.lower(F.trim(value(p))).isin(NEUTRAL_CROPS)))
    return F.concat(urls.origin(url), urls.path(url), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def parameter(url: Column, *names: str) -> Column:
    """The largest of the named parameters that starts as a positive number; null for none."""
    found = F.filter(pairs(url), lambda p: name(p).isin(list(names)))
    numbers = F.transform(found, lambda p: F.regexp_extract(F.trim(value(p)), r"^([+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"))
    return F.array_max(F.filter(numbers, lambda n: n > 0))


def width(url: Column) -> Column:
    return parameter(url, "w", "width") * F.coalesce(parameter(url, "dpr"), F.lit(1.0))


def rendition(url: Column) -> Column:
    """``{identity, width, height, pixels, largest, quality, transformed}`` of an image's URL; sizes are zero where it names none."""
    dpr = F.coalesce(parameter(url, "dpr"), F.lit(1.0))
    w, h = (F.coalesce(parameter(url, *n), F.lit(0.0)) * dpr for n in (("w", "width"), ("h", "height")))
    changed = F.exists(pairs(url), lambda p: name(p).isin(RENDITION) | ((name(p) == "crop") & F.lower(F.trim(value(p))).isin(NEUTRAL_CROPS)))

    def made(x: Column) -> Column:
        largest = F.greatest(x["w"], x["h"])
        pixels = F.when((x["w"] > 0) & (x["h"] > 0), x["w"] * x["h"]).otherwise(largest * largest)
        return F.struct(
            rendition_identity(url).alias("identity"), x["w"].alias("width"), x["h"].alias("height"), pixels.alias("pixels"), largest.alias("largest"),
            F.coalesce(parameter(url, "quality"), F.lit(0.0)).alias("quality"), changed.alias("transformed"),
        )

    return urls.let(F.struct(w.alias("w"), h.alias("h")), made)


def volatile_key(url: Column) -> Column:
    """Equal for URLs that differ in a time stamp's digits only; null if nothing in the query is one or a name in it is sensitive."""
    shown = F.transform(pairs(url), lambda p: F.when(value(p).rlike(TIMESTAMP), F.concat(name(p), F.lit("="), F.regexp_extract(value(p), TIMESTAMP, 1), F.lit("<timestamp>"))).otherwise(p))
    volatile = F.exists(pairs(url), lambda p: value(p).rlike(TIMESTAMP))
    key = F.concat_ws("|", urls.origin(url), urls.path(url), F.array_join(F.array_sort(shown), "&"))
    return F.when(volatile & ~urls.has_sensitive_query(url), key)


def is_cache_like(url: Column) -> Column:
    """Whether all of a query is time stamps or names that only defeat caches."""
    return (F.size(pairs(url)) > 0) & F.forall(pairs(url), lambda p: value(p).rlike(TIMESTAMP) | (name(p).isin(BUSTERS) & value(p).rlike(r"^[A-Za-z0-9._-]*$")))


def byte_range(header: Column, size: Column) -> Column:
    """``{start, end}`` of a single byte range of a body, clamped to it; null if it can't be met."""
    first, last = (F.regexp_extract(F.trim(header), r"^bytes=([0-9]*)-([0-9]*)$", k) for k in (1, 2))
    start = F.when(first != "", first.try_cast("long")).when(last != "", F.greatest(F.lit(0), size - last.try_cast("long")))
    end = F.when((first != "") & (last != ""), F.least(size - 1, last.try_cast("long"))).otherwise(size - 1)
    fits = F.trim(header).rlike(r"^bytes=([0-9]+-[0-9]*|-[0-9]+)$") & (start <= end) & (start < size) & ~((first == "") & (last.try_cast("long") == 0))
    return F.when(fits, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))


def retry_delay(url: Column, attempt: Column, delay: int = 250) -> Column:
    """Milliseconds before a retry: doubled each time, with a jitter that the URL and the attempt fix."""
    most = min(250, delay)
    jitter = F.conv(F.substring(F.sha2(F.concat(url, F.lit("\0"), attempt.cast("string")), 256), 1, 4), 16, 10).cast("long") % most + 1
    return (F.lit(delay) * F.pow(F.lit(2), attempt - 1)).cast("long") + jitter
