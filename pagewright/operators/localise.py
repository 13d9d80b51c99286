"""Localisation of pages and style sheets: every reference to a known resource becomes one to its file in the mirror, and all other text stays as it is.

A text is cut by built-in functions into pieces, nested as the languages are: markup into tags, style elements and what holds no reference; tags into attributes;
style text into comments, strings and references. Only references leave the row to be looked up; the text itself is shuffled once, by its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds, urls
from .work import small, written

_QUOTED = r"\"[^\"]*+\"|'[^']*+'"
_TAG = rf"(?:[^\"'>]++|{_QUOTED})*+>"
#: What markup is cut at: comments, elements of plain text with all that they hold, and start tags.
MARKUP = rf"(?is)<!--.*?(?:-->|$)|<(?:script|textarea|title|xmp)\b{_TAG}.*?(?:</(?:script|textarea|title|xmp)\s*>|$)|<style\b{_TAG}.*?(?:</style\s*>|$)|<[a-z]{_TAG}"
ATTRIBUTE = rf"(?is)\s[a-z][a-z0-9:_\-]*+(?:\s*=\s*(?:{_QUOTED}|[^\s\"'>]++))?+"
#: What style text is cut at: comments, imports by a string, url() and other strings.
STYLE = r"(?is)/\*.*?(?:\*/|$)|@import\s+(?:\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+')|\burl\(\s*(?:\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'|[^\"'()\s]*+)\s*\)|\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'"
_OPENING, _CLOSING = r"(?is)^((?:@import\s+|url\(\s*)(?:\"|'|&quot;|&#39;)?)", r"(?is)((?:\"|'|&quot;|&#39;)?\s*\)?)$"
SRCSET = r"[^\s,]\S*(?:\s+[0-9.]+[wxh])*"
REFRESH = r"(?is)^(\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?[\"']?)([^\"']*)"
PIECE = "array<struct<before: string, raw: string, ref: string, style: string>>"

# Tags whose href names a resource or a page.
HREF_TAGS = ("a", "area", "image", "link", "use")


def _piece(before: Column, raw: Column | None = None, ref: Column | None = None, style: str | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(before.alias("before"), (none if raw is None else raw).alias("raw"), (none if ref is None else ref).alias("ref"), F.lit(style).cast("string").alias("style"))


def _cut(text: Column, pattern: str, make) -> Column:
    """The pieces of what a pattern finds, with the text between them."""

    def pieces(t: Column) -> Column:
        zipped = F.arrays_zip(F.split(t, pattern, -1).alias("plain"), F.regexp_extract_all(t, F.lit(pattern), 0).alias("found"))
        return F.flatten(F.transform(zipped, lambda p: F.when(p["found"].isNull(), F.array(_piece(p["plain"]))).otherwise(F.concat(F.array(_piece(p["plain"])), make(p["found"])))))

    return urls.let(text, pieces)


def _decoded(text: Column) -> Column:
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def style_pieces(text: Column, style: str) -> Column:
    """The pieces of style text."""

    def split(x: Column) -> Column:
        raw = F.substring(x["found"], F.length(x["opening"]) + 1, F.length(x["found"]) - F.length(x["opening"]) - F.length(x["closing"]))
        return urls.let(raw, lambda r: F.array(_piece(x["opening"], r, F.regexp_replace(F.regexp_replace(_decoded(r), r"(?s)\\\r?\n", ""), r"(?s)\\(.)", "$1"), style), _piece(x["closing"])))

    def made(found: Column) -> Column:
        ends = F.struct(found.alias("found"), F.regexp_extract(found, _OPENING, 1).alias("opening"), F.regexp_extract(found, _CLOSING, 1).alias("closing"))
        return F.when(found.rlike(r"(?i)^(?:@import|url\()"), urls.let(ends, split)).otherwise(F.array(_piece(found)))

    return _cut(text, STYLE, made)


def _attribute_pieces(tag: Column, name: Column, style: str) -> Column:
    refreshes = (name == "meta") & tag.rlike(r"(?is)\shttp-equiv\s*=\s*[\"']?\s*refresh\b")

    def candidate(c: Column) -> Column:
        split = lambda url: F.array(_piece(F.lit(""), url, _decoded(url), style), _piece(F.substring(c, F.length(url) + 1, F.length(c))))
        return urls.let(F.regexp_extract(c, r"(?s)^(\S*?),*(?:\s|$)", 1), split)

    def refreshed(raw: Column) -> Column:
        ends = F.struct(F.regexp_extract(raw, REFRESH, 1).alias("before"), F.regexp_extract(raw, REFRESH, 2).alias("to"))
        rest = lambda x: F.substring(raw, F.length(x["before"]) + F.length(x["to"]) + 1, F.length(raw))
        return urls.let(ends, lambda x: F.array(_piece(x["before"], x["to"], _decoded(x["to"]), style), _piece(rest(x))))

    def valued(x: Column) -> Column:
        """x: an attribute's text, its name, what stands before its value, and the quote after it."""
        called, raw = x["called"], F.substring(x["found"], F.length(x["opening"]) + 1, F.length(x["found"]) - F.length(x["opening"]) - F.length(x["closing"]))
        around = lambda inner: F.concat(F.array(_piece(x["opening"])), inner, F.array(_piece(x["closing"])))
        gone = ((called == "href") & (name == "base")) | ((called == "integrity") & name.isin("script", "link"))
        named = called.isin("src", "poster", "xlink:href") | ((called == "href") & name.isin(*HREF_TAGS)) | ((called == "data") & (name == "object"))
        return (
            F.when(gone, F.array().cast(PIECE)).when(named, around(urls.let(raw, lambda r: F.array(_piece(F.lit(""), r, F.trim(_decoded(r)), style)))))
            .when(called.isin("srcset", "imagesrcset"), around(_cut(raw, SRCSET, candidate))).when((called == "style") & raw.rlike(r"(?i)url\("), around(style_pieces(raw, "site-root-url")))
            .when((called == "content") & raw.rlike(REFRESH) & refreshes, around(urls.let(raw, refreshed))).otherwise(F.array(_piece(x["found"])))
        )

    def made(found: Column) -> Column:
        quote = lambda o: F.when(F.substring(o, -1, 1).isin('"', "'"), F.substring(o, -1, 1)).otherwise("")
        ends = lambda o: F.struct(found.alias("found"), F.lower(F.regexp_extract(found, r"(?s)^\s([^\s=]*)", 1)).alias("called"), o.alias("opening"), quote(o).alias("closing"))
        split = lambda o: F.when(o == "", F.array(_piece(found))).otherwise(urls.let(ends(o), valued))
        matters = found.rlike(r"(?i)^\s(?:src|href|poster|xlink:href|data|srcset|imagesrcset|style|content|integrity)\s*=")
        return F.when(matters, urls.let(F.regexp_extract(found, r"(?s)^(\s[^=]*=\s*[\"']?)", 1), split)).otherwise(F.array(_piece(found)))

    return _cut(tag, ATTRIBUTE, made)


def markup_pieces(html: Column, style: str = "url") -> Column:
    """The pieces of a page: references of attributes, image candidates, refreshes, and style text in attributes and elements. Addresses of bases and integrities are left out."""

    def parted(x: Column) -> Column:
        """x: what was found, its tag's name, its start tag and its end tag."""
        body = F.substring(x["found"], F.length(x["start"]) + 1, F.length(x["found"]) - F.length(x["start"]) - F.length(x["end"]))
        inner = F.when(x["name"] == "style", style_pieces(body, "site-root-url")).otherwise(F.array(_piece(body)))
        tag = F.when(x["start"].rlike(r"\s"), _attribute_pieces(x["start"], x["name"], style)).otherwise(F.array(_piece(x["start"])))
        return F.concat(tag, inner, F.array(_piece(x["end"])))

    def made(found: Column) -> Column:
        name = F.lower(F.regexp_extract(found, r"(?s)^<([A-Za-z][^\s/>]*)", 1))
        ends = F.struct(found.alias("found"), name.alias("name"), F.regexp_extract(found, rf"(?is)^(<[a-z]{_TAG})", 1).alias("start"), F.regexp_extract(found, r"(?is)(</[a-z]+\s*>)$", 1).alias("end"))
        plain = F.startswith(found, F.lit("<!")) | found.rlike(r"^<[A-Za-z0-9]+>$")
        return F.when(plain, F.array(_piece(found))).otherwise(urls.let(ends, parted))

    return _cut(html, MARKUP, made)


def base_of(html: Column, url: Column) -> Column:
    """The URL that a page's references are relative to: its first base's, or its own."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "")
    given = F.regexp_extract(plain, r"(?is)<base\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0)
    href = F.regexp_replace(given, r"(?is)^.*?\shref\s*=\s*[\"']?|[\"']$", "")
    return F.when(href != "", F.coalesce(urls.resolve(_decoded(href), url), url)).otherwise(url)


def cut(files: DataFrame) -> DataFrame:
    """``(file, base, local_path, text, pieces)`` of ``files(file, url, local_path, type, text)``; a type other than html and css, and a null one, has no references."""
    page = F.col("type") == "html"
    pieces = F.when(page, markup_pieces(F.col("text"))).when(F.col("type") == "css", style_pieces(F.col("text"), "file")).otherwise(F.array(_piece(F.col("text"))))
    return files.select("file", F.when(page, base_of(F.col("text"), F.col("url"))).otherwise(F.col("url")).alias("base"), "local_path", F.sha2("text", 256).alias("was"), urls.once(pieces).alias("pieces"))


def references(parts: DataFrame) -> DataFrame:
    """``(file, base, local_path, ref, target)``: each reference of a cut file once, with its canonical URL; those that are none (fragments, data:, mailto:) are left out."""
    asked = F.array_distinct(F.filter(F.col("pieces.ref"), lambda r: r.isNotNull() & (r != "") & ~r.startswith("#")))
    rows = parts.select("file", "base", "local_path", F.explode(asked).alias("ref"))
    return rows.withColumn("target", urls.once(urls.resolve(F.col("ref"), F.col("base")))).where("target is not null")


def localised(files: DataFrame, known: DataFrame) -> DataFrame:
    """``(file, text, size, sha256, changed, n_local, online)`` of ``files(file, url, local_path, type, text)``, by ``known(target, to)``: the files of canonical URLs, each URL once.

    size (bytes) and sha256 are the new text's; n_local counts the distinct references that were found, online lists the URLs of the others, sorted. Pages name files relatively, style text in pages from
    the site's root; fragments stay. file is a key of the rows. Null texts give rows of nulls. A target that many files name is no hot key: the targets asked for are made distinct before the lookup, and what is found is sent to the files'
    references by a broadcast where it is small, otherwise by a join whose large partitions Spark may split.
    """
    parts = written(cut(files), "cut")
    refs = references(parts)
    found = refs.select("target").distinct().join(known.select("target", "to"), "target")
    found = small(written(found, "found"))
    rows = refs.join(found, "target", "left")
    mark = F.regexp_extract("ref", "(?s)(#.*)$", 1)
    told = F.when(F.col("to").isNotNull(), F.struct("ref", F.struct(kinds.relative_reference(F.col("local_path"), F.col("to"), F.lit("url")).alias("url"), kinds.relative_reference(F.col("local_path"), F.col("to"), F.lit("site-root-url")).alias("root"), mark.alias("mark")).alias("v")))
    maps = rows.groupBy("file").agg(F.map_from_entries(F.collect_list(told)).alias("names"), F.count("to").alias("n_local"), F.array_sort(F.collect_set(F.when(F.col("to").isNull(), F.col("target")))).alias("online"))
    joined = parts.join(maps, "file", "left").withColumn("names", F.coalesce("names", F.create_map().cast("map<string, struct<url: string, root: string, mark: string>>")))

    def shown(p: Column) -> Column:
        to = F.try_element_at("names", p["ref"])
        mark = to["mark"]
        for char, entity in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;")):
            mark = F.replace(mark, F.lit(char), F.lit(entity))
        named = F.when(p["style"] == "file", F.concat(to["url"], to["mark"])).when(p["style"] == "url", F.concat(to["url"], mark)).otherwise(F.concat(to["root"], mark))
        return F.concat(p["before"], F.when(p["ref"].isNotNull() & to.isNotNull(), named).otherwise(F.coalesce(p["raw"], F.lit(""))))

    text = joined.select("file", "was", urls.once(F.array_join(F.transform("pieces", shown), "")).alias("text"), F.coalesce("n_local", F.lit(0)).alias("n_local"), F.coalesce("online", F.array().cast("array<string>")).alias("online"))
    digest = urls.once(F.sha2("text", 256))
    done = text.withColumn("sha256", digest)
    return done.select("file", "text", F.octet_length("text").cast("long").alias("size"), "sha256", (F.col("sha256") != F.col("was")).alias("changed"), "n_local", "online")


#: The order in which the files of a site are read, and so which of them may use what others have named.
STAGES = ("javascript", "json", "css", "html")


def discovered(files: DataFrame, known: DataFrame, recognise, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``(url, stage, first_file)``, what the files name beside what is known, and ``(file, reason)``, the files that were left out.

    ``files(file, url, local_path, type, text)`` are read in the stages of STAGES. ``recognise(stage, files, urls)`` gives the ``(file, target)`` that the files of a stage name; its last argument is the table of all URLs known by then (``url``): those of ``known``
    and of the stages before. So a name that only makes sense beside a known URL is found once that URL is. A URL belongs to the first stage that names it, and to the first file there. Files of ``most_bytes`` or more, of no type and without text
    are rows of the second table.
    """
    reason = F.when(F.col("text").isNull(), "no text").when(~F.coalesce(F.col("type").isin(*STAGES), F.lit(False)), "no type")
    if most_bytes is not None:
        reason = reason.when(F.octet_length("text") > most_bytes, "too large")
    judged = files.withColumn("reason", reason)
    seen = known.select("url").distinct()
    out = None
    for n, kind in enumerate(STAGES):
        named = recognise(kind, judged.where(F.col("reason").isNull() & (F.col("type") == kind)).drop("reason"), seen)
        new = named.where("target is not null").groupBy(F.col("target").alias("url")).agg(F.lit(n).alias("stage"), F.min("file").alias("first_file"))
        new = written(new.join(seen, "url", "left_anti"), "discovered")
        out = new if out is None else out.unionByName(new)
        seen = seen.unionByName(new.select("url"))
    return out, judged.where("reason is not null").select("file", "reason")
