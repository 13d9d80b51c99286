"""Links of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, kinds, types, urls

#: Start tags of links outside comments, scripts and styles, with their attributes.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAG = r"(?is)<(?:a|area)\s[^>]*>"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, entities of markup decoded; null if the tag lacks it."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.when(tag.rlike(pattern), value)


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, href, target, same_origin, local_path)`` for each link of each page, in no order; repeated links stay.

    target is the canonical URL, null for what is none; local_path is where a mirror of the page would keep it. Pages without html have no rows.
    """
    visible = F.regexp_replace("html", HIDDEN, "")
    tags = pages.select("page_id", "url", F.explode(urls.once(F.regexp_extract_all(visible, F.lit(TAG), 0))).alias("tag"))
    hrefs = tags.select("page_id", "url", urls.once(attribute(F.col("tag"), "href")).alias("href")).where("href is not null")
    # A page's URL and a reference with its folder are each taken apart once.
    based = hrefs.withColumn("_base", urls.once(urls.parts(F.col("url"))))
    base = urls.Parts(F.col("_base"))
    put = based.withColumn("_to", urls.once(urls.parts(urls.joined(F.col("href"), base)))).withColumn("_origin", urls.once(urls.origin(base)))
    target = urls.Parts(F.col("_to"))
    return put.select(
        "page_id", "url", "href", urls.canonical(target).alias("target"), (urls.origin(target) == F.col("_origin")).alias("same_origin"),
        urls.once(urls.local_path(target, F.col("_origin"))).alias("local_path"),
    )


def without_collisions(paths: DataFrame, place: str, url: str) -> DataFrame:
    """``paths`` with ``unique_path``: of distinct URLs whose paths differ in case at most, the first by URL keeps it, the n-th gets ``~u-n``."""
    distinct = paths.select(F.col(place).alias("_p"), F.col(url).alias("_u")).distinct()
    n = F.row_number().over(Window.partitionBy(F.lower("_p")).orderBy("_u"))
    ext = urls.extension(F.col("_p"))
    stem = F.substring("_p", F.lit(1), F.length("_p") - F.length(ext))
    named = distinct.withColumn("unique_path", F.when(n == 1, F.col("_p")).otherwise(F.concat(stem, F.lit("~u-"), n.cast("string"), ext)))
    return paths.join(named, (paths[place] == named["_p"]) & (paths[url] == named["_u"])).drop("_p", "_u")


def navigation_links(pages: DataFrame) -> DataFrame:
    """``(page_id, target)``: the pages that a page leads to, each once.

    Links of the same origin without a download, a relation external or nofollow, or a sensitive name in the query, to a path without extension or of a page. The fragment doesn't count.
    """
    visible = F.regexp_replace("html", HIDDEN, "")
    tags = pages.withColumn("_base", urls.once(urls.parts(F.col("url")))).select("page_id", "_base", F.explode(urls.once(F.regexp_extract_all(visible, F.lit(TAG), 0))).alias("tag"))
    relation = F.split(F.lower(F.coalesce(attribute(F.col("tag"), "rel"), F.lit(""))), r"[\t\n\f\r ]+")
    follows = ~F.arrays_overlap(relation, F.array(F.lit("external"), F.lit("nofollow"))) & ~F.col("tag").rlike(r"(?is)\sdownload(?=[\s=>/])")
    base = urls.Parts(F.col("_base"))
    hrefs = tags.where(follows).select("page_id", "_base", urls.once(attribute(F.col("tag"), "href")).alias("href")).where("href is not null")
    put = hrefs.withColumn("_to", urls.once(urls.parts(urls.joined(F.col("href"), base))))
    to = urls.Parts(F.col("_to"))
    leads = to["web"] & (urls.origin(to) == urls.origin(base)) & ~urls.has_sensitive_query(to) & types.extension(to["path"]).isin("", ".htm", ".html")
    return put.where(leads).select("page_id", urls.canonical(to).alias("target")).distinct()


def meta_refresh(pages: DataFrame) -> DataFrame:
    """``(page_id, seconds, target)`` of the pages that a meta element sends elsewhere."""
    tag = F.regexp_extract(F.regexp_replace("html", HIDDEN, ""), r"(?is)<meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh\b)[^>]*>", 0)
    content = attribute(tag, "content")
    ref = F.regexp_extract(content, r"(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?(?:\"([^\"]*)\"|'([^']*)'|(.*))$", 0)
    given = F.regexp_replace(F.regexp_replace(ref, r"(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?", ""), r"^[\"']|[\"']\s*$", "")
    rows = pages.select("page_id", "url", content.alias("c"), given.alias("ref")).where("c is not null and ref <> ''")
    return rows.select("page_id", F.regexp_extract("c", r"^\s*([0-9]+)", 1).try_cast("long").alias("seconds"), urls.resolve(F.col("ref"), F.col("url")).alias("target"))


def rewritten(files: DataFrame, known: DataFrame, pattern: str) -> DataFrame:
    """``files(file, url, local_path, text)`` with the references that ``pattern`` finds replaced by relative ones where ``known(target, to)`` has their canonical URL; ``n_local``, ``n_other``.

    pattern has three groups: what stands before a reference, the reference, and what stands after it. Files are cut at the references, which are looked up all together, and put together again in order.
    """
    cut = F.arrays_zip(F.split("text", pattern, -1).alias("plain"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("found"))
    rows = files.select("file", "url", "local_path", F.posexplode(urls.once(cut)).alias("at", "p")).select("file", "url", "local_path", "at", F.coalesce("p.plain", F.lit("")).alias("plain"), "p.found")
    group = lambda n: F.regexp_extract("found", pattern, n)
    entity = lambda c: F.replace(c, F.lit("&amp;"), F.lit("&"))
    rows = rows.withColumn("target", urls.once(F.when(F.col("found").isNotNull(), urls.resolve(entity(group(2)), F.col("url")))))
    rows = rows.join(known.select("target", "to"), "target", "left")
    mark = F.regexp_extract(group(2), "(#.*)$", 1)
    local = F.concat(group(1), kinds.relative_reference(F.col("local_path"), F.col("to"), F.lit("url")), mark, group(3))
    piece = F.concat("plain", F.when(F.col("to").isNotNull(), local).otherwise(F.coalesce("found", F.lit(""))))
    done = rows.groupBy("file", "url", "local_path").agg(
        F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))).alias("pieces"), F.count("to").alias("n_local"), F.count_if(F.col("found").isNotNull() & F.col("to").isNull()).alias("n_other")
    )
    return done.select("file", "url", "local_path", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"), "n_local", "n_other")


#: References of pages and of style sheets for :func:`rewritten`.
HTML_REFERENCE = r"(?i)(\s(?:href|src|poster)=\")([^\"]*)(\")"
CSS_REFERENCE = r"(?i)((?:url\(\s*|@import\s+)[\"']?)([^\"'()\s;]+)([\"']?\s*\)?)"


def inert(html: Column) -> Column:
    """A page whose base has no address, whose elements have no integrity, whose images of nothing have a source that loads, and whose tracking scripts do nothing."""
    text = F.regexp_replace(html, r"(?i)(<base\b[^>]*\shref=)(\"[^\"]*\"|'[^']*')", '$1""')
    text = F.regexp_replace(text, r"(?i)(<(?:script|link)\b[^>]*?)\sintegrity=(?:\"[^\"]*\"|'[^']*')", "$1")
    text = F.regexp_replace(text, r"(?i)(<img\b[^>]*?\ssrc=)([\"'])\s*about:blank\s*\2", "$1$2data:,$2")
    pieces = F.arrays_zip(F.split(text, SCRIPT, -1).alias("plain"), F.regexp_extract_all(text, F.lit(SCRIPT), 0).alias("script"))

    def kept(p: Column) -> Column:
        start, body = F.regexp_extract(p["script"], SCRIPT, 1), F.regexp_extract(p["script"], SCRIPT, 2)
        source = attribute(start, "src")
        tracks = F.when(source.isNotNull(), classify.is_nonessential(source)).otherwise(classify.is_tracking_snippet(body))
        return F.concat(F.coalesce(p["plain"], F.lit("")), F.when(p["script"].isNull(), "").when(tracks, F.lit(f"<script {DISABLED}=\"tracking\"></script>")).otherwise(p["script"]))

    return F.array_join(F.transform(pieces, kept), "")


def actions_disabled(html: Column) -> Column:
    """A page whose forms lead nowhere, but for those to a place in it."""
    return F.regexp_replace(html, r"(?i)(<form\b[^>]*?\saction=)(?:\"(?![\"#])[^\"]*\"|'(?!['#])[^']*')", f'$1"#" {DISABLED}-action="online"')


SCRIPT = r"(?is)(<script\b[^>]*>)(.*?)</script\s*>"
DISABLED = "data-disabled"
