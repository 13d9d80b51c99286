"""HTTP cache rules on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def directives(cache_control: Column) -> Column:
    """Cache-Control as a map: names in lower case, values without quotes, empty for a flag; of duplicates the last counts."""
    parts = F.filter(F.transform(F.split(F.coalesce(cache_control, F.lit("")), ","), lambda p: F.trim(p)), lambda p: ~p.rlike("^(=|$)"))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            F.lower(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)), '^"(.*)"$', "$1").alias("v")
        ),
    )
    names = F.transform(pairs, lambda x: x["k"])
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), x["k"]))
    return F.map_from_entries(last)


def has(cache_control: Column, *names: str) -> Column:
    return F.arrays_overlap(F.map_keys(directives(cache_control)), F.array(*[F.lit(n) for n in names]))


def max_age(cache_control: Column) -> Column:
    value = F.try_element_at(directives(cache_control), F.lit("max-age"))
    return F.when(value.rlike("^[0-9]{1,15}$"), value.try_cast("long"))


def cacheable(status: Column, cache_control: Column, vary: Column, sets_cookie: Column) -> Column:
    varies = F.filter(F.transform(F.split(F.coalesce(vary, F.lit("")), ","), lambda v: F.lower(F.trim(v))), lambda v: ~v.isin("", "accept-encoding"))
    return F.coalesce(status == 200, F.lit(False)) & ~F.coalesce(sets_cookie, F.lit(False)) & ~has(cache_control, "no-store", "private") & (F.size(varies) == 0)


def fresh_until(now: Column, cache_control: Column, date: Column, age: Column, expires: Column) -> Column:
    """When a stored response stops being fresh: by max-age less the larger of the apparent and the stated age, else by Expires; null for neither."""
    apparent = F.coalesce(F.greatest(F.lit(0), F.unix_millis(now) - F.unix_millis(date)), F.lit(0))
    stated = F.coalesce(F.when(age.rlike("^[0-9]{1,12}$"), age.try_cast("long")), F.lit(0)) * 1000
    left = F.greatest(F.lit(0), max_age(cache_control) * 1000 - F.greatest(apparent, stated))
    return F.when(max_age(cache_control).isNotNull(), F.timestamp_millis(F.unix_millis(now) + left)).otherwise(expires)


def revalidate_always(cache_control: Column, fresh: Column) -> Column:
    return has(cache_control, "no-cache", "must-revalidate", "proxy-revalidate") | (F.coalesce(max_age(cache_control), F.lit(-1)) == 0) | fresh.isNull()
