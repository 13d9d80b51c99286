"""References inside HTML, CSS, JSON and image candidates, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .closure import kept
from .links import attribute

# Relations of link tags that fetch something; keys of JSON that hold assets.
RESOURCE_RELS = ["apple-touch-icon", "icon", "manifest", "mask-icon", "modulepreload", "preload", "stylesheet"]
ASSET_KEYS = (
    "asset assets audio audios buffer buffers file files font fonts image images manifest model models resource resources sound sounds source sources "
    "src texture textures uri video videos wasm worker workers"
).split()
MOST_DEPTH = 256
COMMENT, RAW = r"(?is)<!--.*?-->", r"(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>"
TAG = r"(?is)<[a-z][^\s/>]*\s[^>]*>"


def html_references(pages: DataFrame) -> DataFrame:
    """``(page_id, tag, attribute, value, fetched)`` of each reference of ``pages(page_id, html)``: src, poster, data, srcset and href of start tags outside comments, scripts and styles.

    fetched: the page loads it. An href is that in image and use, and in link for some relations. A quoted value may hold no ``>``.
    """
    visible = F.regexp_replace(F.regexp_replace("html", COMMENT, ""), RAW, "$1")
    tags = pages.select("page_id", F.explode(urls.once(F.regexp_extract_all(visible, F.lit(TAG), 0))).alias("t"))
    tags = tags.withColumn("tag", F.lower(F.regexp_extract("t", r"(?is)^<([a-z][^\s/>]*)", 1)))
    relation = F.split(F.lower(F.coalesce(attribute(F.col("t"), "rel"), F.lit(""))), r"[\t\n\f\r ]+")
    loads = F.col("tag").isin("image", "use") | ((F.col("tag") == "link") & F.arrays_overlap(relation, F.array(*[F.lit(r) for r in RESOURCE_RELS])))
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), attribute(F.col("t"), a).alias("value"), (loads if a == "href" else F.lit(True)).alias("fetched")) for a in ("src", "poster", "data", "srcset", "href")])
    found = tags.select("page_id", "tag", F.explode(F.filter(each, lambda r: r["value"].isNotNull())).alias("r"))
    return found.select("page_id", "tag", "r.*")


def json_assets(texts: DataFrame) -> DataFrame:
    """``(id, path, value)`` of each text below an asset key in ``texts(id, json)``, at most MOST_DEPTH deep; nothing of a text that is no JSON.

    A level at a time: the members of all objects and arrays become rows of the next one, which is written, so that plans stay short.
    """
    rows = texts.select("id", F.lit("$").alias("path"), F.lit(False).alias("asset"), F.try_parse_json("json").alias("v")).where("v is not null")
    out, session = [], texts.sparkSession
    for _ in range(MOST_DEPTH + 1):
        kind = F.schema_of_variant("v")
        found = kept(rows.where(F.col("asset") & (kind == "STRING")).select("id", "path", F.try_variant_get("v", "$", "string").alias("value")))
        out.append(found)
        inner = rows.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        members = session.sql("SELECT id, path, asset, m.pos, m.key, m.value AS v FROM {inner}, LATERAL variant_explode(v) AS m", inner=inner)
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        named = F.coalesce(F.lower("key").isin(ASSET_KEYS) | F.lower("key").endswith("url"), F.lit(False))
        rows = kept(members.select("id", F.concat("path", step).alias("path"), (F.col("asset") | named).alias("asset"), "v"))
        if rows.limit(1).count() == 0:
            break
    all_ = out[0]
    for found in out[1:]:
        all_ = all_.unionByName(found)
    return all_


def css_urls(text: Column) -> Column:
    """The url() and @import references of a style sheet, comments left out, in order of kind and place."""
    plain = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    quoted = F.regexp_extract_all(plain, F.lit(r"""(?i)url\(\s*(?:"([^"]*)"|'([^']*)'|([^"'()\s]+))\s*\)"""), 0)
    bare = F.transform(quoted, lambda u: F.regexp_replace(u, r"""(?i)^url\(\s*["']?|["']?\s*\)$""", ""))
    imports = F.regexp_extract_all(plain, F.lit(r"""(?i)@import\s+["']([^"']*)["']"""), 1)
    return F.concat(bare, imports)


def srcset_candidates(srcset: Column) -> Column:
    """``{url, w, x}`` of each candidate; a missing descriptor is 1x. Commas inside a URL belong to it unless white space follows."""
    parts = F.filter(F.transform(F.split(srcset, r",\s+|,$"), lambda p: F.trim(p)), lambda p: p != "")
    number = lambda p, unit: F.nullif(F.regexp_extract(p, rf"\s([0-9.]+){unit}$", 1), F.lit("")).try_cast("double")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.regexp_extract(p, r"^(\S+)", 1).alias("url"), number(p, "w").alias("w"),
            F.when(number(p, "w").isNull(), F.coalesce(number(p, "x"), F.lit(1.0))).alias("x"),
        ),
    )


def srcset_pick(srcset: Column) -> Column:
    """The candidate nearest to 1280 pixels wide, the smaller of equals; without widths that nearest to 1x, the first of equals."""
    found = srcset_candidates(srcset)
    wide = F.transform(F.filter(found, lambda c: c["w"].isNotNull()), lambda c: F.struct(F.abs(c["w"] - 1280).alias("d"), c["w"].alias("w"), c["url"].alias("url")))
    dense = F.transform(found, lambda c, i: F.struct(F.abs(c["x"] - 1).alias("d"), i.alias("i"), c["url"].alias("url")))
    return F.coalesce(F.array_min(wide)["url"], F.array_min(F.filter(dense, lambda c: c["d"].isNotNull()))["url"])
