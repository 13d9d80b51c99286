"""References of documents against the known resources: a cascade of lookups, each used only where those before it missed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import media, shapes, urls


def unique(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Of ``pairs``, the keys with one distinct value; keys with more are ambiguous and left out."""
    return pairs.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_most")).where(f"{value} = _most").drop("_most")


def suffixes(known: DataFrame) -> DataFrame:
    """``(origin, suffix, local_path)``: all endings of two segments or more of the known URLs' paths."""
    parts = F.filter(F.split(urls.path(F.col("url")), "/"), lambda p: p != "")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1))), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))
    rows = known.select(urls.origin(F.col("url")).alias("origin"), parts.alias("p"), "local_path").where("size(p) >= 2")
    return rows.select("origin", F.explode(ends).alias("suffix"), "local_path")


def resolved(refs: DataFrame, known: DataFrame) -> DataFrame:
    """``refs(ref, base)`` with target, local_path and ``how``: exact, path, suffix, unresolved (same origin), online (another) or ignored (no web URL).

    exact: the canonical URL is known. path: its path, without a query, belongs to one known resource of its origin. suffix: the reference's
    two last segments or more end one known path of its origin. A lookup with more than one answer has none. ``known`` is ``(url, local_path)``.
    """
    rows = refs.withColumn("target", urls.resolve(F.col("ref"), F.col("base"))).withColumn("_origin", urls.origin(F.col("target"))).withColumn("_path", urls.path(F.col("target")))
    exact = unique(known.select(urls.canonical(F.col("url")).alias("target"), F.col("local_path").alias("_exact")), "target", "_exact")
    by_path = known.select(F.concat(urls.origin(F.col("url")), urls.path(F.col("url"))).alias("_at"), F.col("local_path").alias("_by_path"))
    by_path = unique(by_path, "_at", "_by_path")
    by_end = suffixes(known).select(F.concat_ws("|", "origin", "suffix").alias("_end"), F.col("local_path").alias("_by_end"))
    by_end = unique(by_end, "_end", "_by_end")
    plain = F.regexp_replace("ref", "[?#].*$", "")
    rows = rows.withColumn("_at", F.when(urls.search(F.col("target")) == "", F.concat("_origin", "_path")))
    rows = rows.withColumn("_end", F.when(plain.rlike(r"^[^/.:][^/:]*/[^:]*[^/:]$"), F.concat_ws("|", "_origin", plain)))
    rows = rows.join(exact, "target", "left").join(by_path, "_at", "left").join(by_end, "_end", "left")
    how = (
        F.when(F.col("target").isNull(), "ignored").when(F.col("_exact").isNotNull(), "exact").when(F.col("_by_path").isNotNull(), "path")
        .when(F.col("_by_end").isNotNull(), "suffix").when(F.col("_origin") == urls.origin(F.col("base")), "unresolved").otherwise("online")
    )
    return rows.select(*refs.columns, "target", F.coalesce("_exact", "_by_path", "_by_end").alias("local_path"), how.alias("how"))


def with_renditions(rows: DataFrame, downloads: DataFrame) -> DataFrame:
    """``rows`` of :func:`resolved` where those that nothing is known for take another rendition of the same image; ``downloads`` is a plan's download map."""
    known = downloads.where("kind = 'rendition'").select(F.col("key").alias("_identity"), F.col("local_path").alias("_other"))
    missed = rows.withColumn("_identity", F.when(F.col("local_path").isNull() & F.col("target").isNotNull(), media.rendition_identity(F.col("target"))))
    found = missed.join(known, "_identity", "left")
    return found.select(*[c for c in rows.columns if c not in ("local_path", "how")], F.coalesce("local_path", "_other").alias("local_path"), F.when(F.col("_other").isNotNull(), "rendition").otherwise(F.col("how")).alias("how"))


def runtime_suffixes(known: DataFrame) -> DataFrame:
    """``(suffix, local_path)``: endings of known paths, of two segments or more, that name one file; of URLs without a query only."""
    plain = known.where(urls.search(F.col("url")) == "")
    return unique(suffixes(plain).select("suffix", "local_path"), "suffix", "local_path")


def volatile_aliases(known: DataFrame) -> DataFrame:
    """``(key, local_path)``: keys of URLs that differ in time stamps only, where they name one file."""
    keyed = known.select(media.volatile_key(F.col("url")).alias("key"), "local_path").where("key is not null")
    return unique(keyed, "key", "local_path")


def already_local(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``refs(ref, here)`` that name a file of the mirror as they stand: from the root, with or without the site folder, or from the folder of ``here``; ``files(local_path)``."""
    plain = F.regexp_replace("ref", "[?#].*$", "")
    folder = F.regexp_replace("here", "[^/]*$", "")
    names = F.array(F.regexp_replace(plain, "^/", "site/"), F.regexp_replace(plain, "^/(?=site/)", ""), urls.let(F.concat(F.lit("/"), folder, plain), lambda p: F.regexp_replace(urls.without_dots(p), "^/", "")))
    rows = refs.withColumn("_n", F.explode(F.array_distinct(names)))
    return rows.join(files.select(F.col("local_path").alias("_n")).distinct(), "_n", "left_semi").drop("_n").distinct()


def entry(resources: DataFrame, source: str) -> DataFrame:
    """``(local_path)``: the file of the source page, else the first downloaded page by ``seq``; without the site folder."""
    got = resources.where("status = 'downloaded' and local_path like 'site/%'").withColumn("_exact", F.col("canonical") == urls.canonical(F.lit(source)))
    page = F.col("_exact") | F.coalesce(F.lower("content_type").startswith("text/html"), F.lit(False))
    return got.where(page).agg(F.min_by("local_path", F.struct((~F.col("_exact")).alias("k"), "seq")).alias("p")).select(F.substring("p", 6, 1 << 20).alias("local_path"))


def cached(requests: DataFrame, entries: DataFrame, objects: DataFrame) -> DataFrame:
    """``requests(url)`` with the stored body's ``sha256``: entries are by the hash of the URL, and count if their object has the size that they say.

    ``entries(key, sha256, size, valid)``, ``objects(sha256, size)``.
    """
    good = entries.where("valid").select("key", "sha256", F.col("size").alias("_s"))
    kept = objects.select("sha256", F.col("size").alias("_s")).distinct()
    found = good.join(kept, ["sha256", "_s"]).select("key", "sha256")
    return requests.withColumn("key", F.sha2("url", 256)).join(found, "key", "left").select(*requests.columns, "sha256")


def attached_bodies(resources: DataFrame, bodies: DataFrame) -> DataFrame:
    """``resources(body_id, ...)`` with ``sha256`` of their bodies, and ``repeated`` for an id that more than one resource or body has: such an id attaches nothing."""
    asked = resources.where("body_id is not null").groupBy("body_id").agg(F.count("*").alias("_n"))
    held = bodies.groupBy("body_id").agg(F.count("*").alias("_m"), F.max("sha256").alias("_sha"))
    rows = resources.join(asked, "body_id", "left").join(held, "body_id", "left")
    twice = F.coalesce((F.col("_n") > 1) | (F.col("_m") > 1), F.lit(False))
    return rows.select(*resources.columns, F.when(~twice, F.col("_sha")).alias("sha256"), twice.alias("repeated"))


def known_references(refs: DataFrame, known: DataFrame, by_name: bool = False) -> DataFrame:
    """``refs(ref, base)`` with ``found``, ``how`` and ``search``: the one known URL that a bare reference of two segments or more means, whatever folder it is written in.

    suffix: the reference's path ends that of one known URL of the base's origin. name, with ``by_name``: no path does, and one known URL has the same file name. The queries must be equal; a reference whose query only defeats caches
    may also mean a known URL without one, and keeps its query, which ``search`` is then. Several answers are none; so is the URL that the reference names anyway. ``known(url)``. Lookups are by equality on all tails of the known
    paths, so a tail that many share costs rows only where it is asked for.
    """
    rows = refs.distinct().withColumn("_b", urls.once(urls.parts(F.col("base"))))
    base = urls.Parts(F.col("_b"))
    rows = rows.where(shapes.is_bare_path(F.trim("ref"))).withColumn("_o", urls.once(urls.origin(base)))
    rows = rows.withColumn("_r", urls.once(urls.parts(F.concat("_o", F.lit("/"), F.regexp_replace(F.trim("ref"), "#.*$", ""))))).withColumn("_own", urls.once(urls.resolve(F.col("ref"), F.col("base"))))
    ref = urls.Parts(F.col("_r"))
    path = F.regexp_replace(ref["path"], "^/+", "")
    rows = rows.where(ref["web"] & ~F.coalesce(urls.has_sensitive_query(F.col("_own")), F.lit(False)))
    rows = rows.select(*refs.columns, "_o", "_own", urls.once(path).alias("_path"), urls.once(urls.search(ref)).alias("_search"), F.when(media.is_cache_like(F.concat("_o", F.lit("/x"), urls.search(ref))), "").alias("_bare"))
    rows = rows.where(F.size(F.filter(F.split("_path", "/"), lambda s: s != "")) >= 2)
    searches = F.array_distinct(F.array_compact(F.array("_search", "_bare")))
    asked = rows.select(*refs.columns, "_o", "_own", "_path", F.col("_search").alias("_s"), F.explode(searches).alias("_q"))
    have = known.select(urls.canonical(F.col("url")).alias("found")).where("found is not null").distinct().withColumn("_k", urls.once(urls.parts(F.col("found"))))
    k = urls.Parts(F.col("_k"))
    have = have.select("found", urls.origin(k).alias("_o"), urls.search(k).alias("_q"), F.split(F.regexp_replace(k["path"], "^/+", ""), "/").alias("_p"))
    ends = have.select("found", "_o", "_q", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.array_join(F.slice("_p", i, F.size("_p")), "/"))).alias("_path"))
    hits = asked.join(ends, ["_o", "_q", "_path"]).select(*refs.columns, "_own", "found", F.lit("suffix").alias("how"), F.when(F.col("_q") != F.col("_s"), F.col("_s")).otherwise("").alias("search"))
    if by_name:
        names = have.select("found", "_o", "_q", F.element_at("_p", -1).alias("_name")).where("_name <> ''")
        more = asked.withColumn("_name", F.element_at(F.split("_path", "/"), -1)).join(names, ["_o", "_q", "_name"])
        hits = hits.unionByName(more.select(*refs.columns, "_own", "found", F.lit("name").alias("how"), F.when(F.col("_q") != F.col("_s"), F.col("_s")).otherwise("").alias("search")))
    counted = hits.groupBy(*refs.columns, "_own", F.col("how")).agg(F.count_distinct("found").alias("_n"), F.min(F.struct("found", "search")).alias("_f"))
    first = counted.groupBy(*refs.columns, "_own").agg(F.max(F.struct("how", "_n", "_f")).alias("_w"))  # suffix comes after name
    one = first.where((F.col("_w._n") == 1) & ~((F.col("_w._f.found") == F.coalesce("_own", F.lit(""))) & (F.col("_w._f.search") == "")))
    return one.select(*refs.columns, F.col("_w._f.found").alias("found"), "_w.how", F.col("_w._f.search").alias("search"))


def placed_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """``refs(ref, base)``, names that a manifest gives, with ``target``, ``place`` and ``mapped``: relative (to the file), root (of its origin) or kept (no reference).

    A name that begins with a slash is from the root; one with a scheme, two slashes or dots is relative; both need to look like an asset or to be known. Of a bare one the reading counts that is known, the relative one if both are. If neither is, it
    must look like an asset, and is from the root if it shares two leading segments or more with the file's own folder. ``known(url)``.
    """
    trimmed = F.trim("ref")
    rows = refs.distinct().withColumns({"_rel": urls.once(urls.resolve(trimmed, F.col("base"))), "_root": urls.once(urls.resolve(F.concat(F.lit("/"), F.regexp_replace(trimmed, "^/", "")), F.col("base")))})
    have = known.select(urls.canonical(F.col("url")).alias("_url")).where("_url is not null").distinct()
    rows = rows.join(have.select(F.col("_url").alias("_rel"), F.lit(True).alias("_has_rel")), "_rel", "left").join(have.select(F.col("_url").alias("_root"), F.lit(True).alias("_has_root")), "_root", "left")
    rel, root = F.coalesce("_has_rel", F.lit(False)), F.coalesce("_has_root", F.lit(False))
    asset = F.coalesce(shapes.is_asset(F.col("ref")), F.lit(False))
    named = lambda t: F.filter(F.split(t, "/"), lambda s: s != "")
    mine, folder = named(F.regexp_replace(trimmed, "[?#].*$", "")), named(F.regexp_replace(urls.path(F.col("base")), "[^/]*$", ""))
    shares = (F.size(mine) >= 2) & (F.size(folder) >= 2) & (F.slice(mine, 1, 2) == F.slice(folder, 1, 2))
    plain = trimmed.rlike(r"^(?:https?:)?//|^\.\.?/")
    place = (
        F.when(plain, F.when(asset | rel, "relative").otherwise("kept")).when(trimmed.startswith("/"), F.when(asset | rel, "root").otherwise("kept"))
        .when(rel, "relative").when(root, "root").when(~asset, "kept").when(shares, "root").otherwise("relative")
    )
    out = rows.withColumn("place", place)
    target = F.when((F.col("place") == "root") & ~trimmed.startswith("/"), F.col("_root")).when(F.col("place") != "kept", F.col("_rel"))
    mapped = F.when(F.col("place") == "root", F.when(trimmed.startswith("/"), rel).otherwise(root)).when(F.col("place") == "relative", rel).otherwise(False)
    return out.select(*refs.columns, target.alias("target"), "place", mapped.alias("mapped"))
