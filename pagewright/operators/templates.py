"""Templates of URLs and lists of files, matched with the URLs that were observed.

Neither is compared with every URL. A URL's tails meet templates by the segments that a template fixes, and files by the tail itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .rollups import strict_winner
from .work import small

#: A placeholder, and what it may stand for (no slash, so segments of a template and of a URL go together).
PLACEHOLDER, TOKEN = r"\{[A-Za-z][A-Za-z0-9_]*\}", r"[A-Za-z0-9_.\-]{1,64}"


def compiled(templates: DataFrame) -> DataFrame:
    """``templates(template, ...)`` with ``names`` (placeholders in the order of their first use), ``pattern`` (a group for each name; where it comes again, what it stood for the first time), ``kind`` and ``segments``.

    kind tells what the template is set against: absolute, host (``//``), root (``/``) or relative; its query counts if it has one. Templates without a placeholder or with white space are left out.
    """
    pieces = F.regexp_extract_all("template", F.lit(rf"{PLACEHOLDER}|\{{|[^{{]+"), 0)
    rows = templates.where(F.col("template").rlike(PLACEHOLDER) & ~F.col("template").rlike(r"\s")).withColumn("_p", urls.once(pieces))
    rows = rows.withColumn("_n", urls.once(F.array_distinct(F.filter("_p", lambda p: p.rlike(f"^{PLACEHOLDER}$")))))

    def part(p: Column, i: Column) -> Column:
        again = F.concat(F.lit("(?:\\"), F.array_position("_n", p).cast("string"), F.lit(")"))
        named = F.when(F.array_position("_p", p) == i + 1, F.lit(f"({TOKEN}?)")).otherwise(again)
        return F.when(p.rlike(f"^{PLACEHOLDER}$"), named).otherwise(F.concat(F.lit(r"\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))

    kind = F.when(F.col("template").rlike("(?i)^https?://"), "absolute").when(F.startswith("template", F.lit("//")), "host").when(F.startswith("template", F.lit("/")), "root").otherwise("relative")
    pattern = F.concat(F.lit("^"), F.array_join(F.transform("_p", part), ""), F.lit("$"))
    segments = F.split(F.regexp_replace("template", r"\?.*$", ""), "/", -1)
    return rows.select(*templates.columns, F.transform("_n", lambda n: F.regexp_replace(n, r"[{}]", "")).alias("names"), pattern.alias("pattern"), kind.alias("kind"), segments.alias("segments"))


def tails(observed: DataFrame) -> DataFrame:
    """``(url, kind, base, tail, search)`` of ``observed(url)``: the whole URL, what follows its scheme, its path, and each run of segments that ends its path, with the URL that comes before."""
    one = observed.select(F.col("url")).distinct().withColumn("_u", urls.once(urls.parts(F.col("url"))))
    u = urls.Parts(F.col("_u"))
    one = one.where(u["web"]).select("url", urls.once(urls.origin(u)).alias("o"), u["path"].alias("p"), urls.search(u).alias("search"))
    names = F.split(F.regexp_replace("p", "^/+", ""), "/", -1)
    last = F.size("names") - F.when(F.element_at("names", -1) == "", 2).otherwise(1)
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.struct(F.lit("relative").alias("kind"), F.concat("o", F.lit("/"), F.array_join(F.slice("names", F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")).alias("base"), F.array_join(F.slice("names", i + 1, F.size("names")), "/").alias("tail")),
    )
    top = F.concat("o", F.lit("/"))
    whole = F.array(*[
        F.struct(F.lit(kind).alias("kind"), top.alias("base"), tail.alias("tail"))
        for kind, tail in (("absolute", F.concat("o", "p")), ("host", F.regexp_replace(F.concat("o", "p"), "^[a-z]+:", "")), ("root", F.col("p")))
    ])
    return one.withColumn("names", urls.once(names)).select("url", "search", F.inline(F.concat(whole, runs))).select("url", "kind", "base", "tail", "search")


def matches(templates: DataFrame, observed: DataFrame) -> DataFrame:
    """``(template, url, base, bound)``: each observed URL that a template fits, the URL that the template is relative to, and the map of what its placeholders stand for.

    A name that comes twice stands for the same both times. A template is looked up by its number of segments and those that it fixes: a tail of a URL asks once for each form of template (which
    segments are fixed) of its length. Only a template that fixes no segment meets all tails of its length.
    """
    known = compiled(templates.select("template").distinct())
    fixed = F.filter(F.sequence(F.lit(1), F.size("segments")), lambda i: ~F.element_at("segments", i).contains("{"))
    known = known.withColumn("form", urls.once(F.struct("kind", F.size("segments").alias("n"), fixed.alias("at"))))
    known = known.withColumn("key", F.array_join(F.transform("form.at", lambda i: F.element_at("segments", i)), "/"))
    forms = known.select("form").distinct().select("form", F.col("form.kind").alias("kind"), F.col("form.n").alias("n"))
    asked = tails(observed).withColumn("s", urls.once(F.split("tail", "/", -1)))
    asked = asked.join(small(forms), (asked["kind"] == forms["kind"]) & (F.size("s") == forms["n"])).drop(forms["kind"], "n")
    asked = asked.select("url", "base", "tail", "search", "form", F.array_join(F.transform("form.at", lambda i: F.element_at("s", i)), "/").alias("key"))
    found = asked.join(known.select("template", "names", "pattern", "form", "key"), ["form", "key"])
    text = F.concat("tail", F.when(F.contains("template", F.lit("?")), F.col("search")).otherwise(""))
    found = found.withColumn("text", text).where(F.rlike("text", F.col("pattern")))
    values = F.expr("transform(names, (n, i) -> regexp_extract(text, pattern, i + 1))")
    return found.select("template", "url", "base", F.map_from_arrays("names", values).alias("bound"))


def inventory_bases(records: DataFrame, observed: DataFrame, least: int = 2) -> DataFrame:
    """``(inventory, base, n)``: the URL below which most of a list's files were observed. ``records(inventory, file)``, ``observed(url)``.

    A file counts once for a base. The base must have ``least`` files, and more than any other. Files are met by equal tails of paths; null and empty ones count for nothing.
    """
    files = records.select("inventory", F.regexp_replace("file", r"^(?:\./|/)+", "").alias("tail")).where("tail <> ''").distinct()
    ends = tails(observed).where("kind = 'relative'").select("base", "tail").distinct()
    support = files.join(ends, "tail").select("inventory", "base", "tail").distinct()
    return strict_winner(support, "inventory", "base").where(F.col("n") >= least).select("inventory", "base", "n")


def inventory_references(records: DataFrame, observed: DataFrame, least: int = 2) -> DataFrame:
    """``(inventory, url)``: every file of a list with a base, as a URL below it; URLs whose query has a sensitive name are left out."""
    bases = inventory_bases(records, observed, least)
    rows = records.join(bases, "inventory").select("inventory", urls.once(urls.parts(urls.joined(F.col("file"), F.col("base")))).alias("u"))
    u = urls.Parts(F.col("u"))
    return rows.where(u["web"] & ~urls.has_sensitive_query(u)).select("inventory", urls.canonical(u).alias("url")).distinct()
