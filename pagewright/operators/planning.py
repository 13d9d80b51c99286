"""Download plans: evidence merged, candidates sorted into buckets, paths given out, renditions chosen, failures tried again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify, media, types, urls


def merged_evidence(rows: DataFrame) -> DataFrame:
    """``rows(url, seq, body, content_type, ...)``, whose URLs are canonical, with one row for each: what was seen of it, put together.

    The first row leads. The first with a body leads from there on, and so does the first with a type where none had one before; a field is the latest leader's that has it, then that of the others in order.
    """
    at = Window.partitionBy("url")
    first, body = F.min("seq").over(at), F.min(F.when(F.col("body").isNotNull(), F.col("seq"))).over(at)
    typed = F.min(F.when(F.col("content_type").isNotNull(), F.col("seq"))).over(at)
    leads = (F.col("seq") == first) | F.coalesce(F.col("seq") == body, F.lit(False)) | F.coalesce(F.col("seq") == typed, F.lit(False))
    ranked = rows.withColumn("_leads", leads).withColumn("_by", F.struct((~F.col("_leads")).cast("int").alias("k"), F.when(F.col("_leads"), -F.col("seq")).otherwise(F.col("seq")).alias("n")))
    fields = [c for c in rows.columns if c not in ("url", "seq")]
    out = ranked.groupBy("url").agg(F.min("seq").alias("seq"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_by"))).alias(c) for c in fields])
    return out.select(*rows.columns)


def bucketed(rows: DataFrame, source: Column) -> DataFrame:
    """``rows(url, resource_type, initiator, content_type, ...)`` with ``canonical``, ``bucket`` and ``place``; those of trackers and the like are left out.

    bucket: expandable (fetched first, brings more), required (a leaf that the page needs), rendered (pictures and media), rejected (no web URL). place orders a bucket: by priority, then URL, the source first.
    """
    own = rows.withColumn("canonical", urls.canonical(F.col("url")))
    own = own.where(F.col("canonical").isNull() | ~classify.is_nonessential(F.col("canonical")))
    priority = classify.priority(F.col("canonical"), F.col("resource_type"), F.col("initiator"), F.col("content_type"))
    bucket = F.when(F.col("canonical").isNull(), "rejected").when(priority == 0, "expandable").when(priority == 1, "required").otherwise("rendered")
    own = own.withColumn("_p", priority).withColumn("bucket", bucket)
    # Only the bucket's order is asked for; a bucket is one job's, which the resource limit bounds.
    order = Window.partitionBy("bucket").orderBy(F.col("canonical") != urls.canonical(source), "_p", "canonical", "url")
    return own.withColumn("place", F.row_number().over(order)).drop("_p")


def planned(rows: DataFrame, source_origin: Column) -> DataFrame:
    """``rows(seq, url, method, content_type)`` as a plan: ``(seq, url, canonical, status, local_path)``, a row for each distinct web URL and for each text that is none.

    Of rows with one canonical URL the first counts. Others than GET and texts that are no web URL are skipped; trackers and the like are left out. Two URLs whose paths differ in case at most get different ones, in order.
    """
    own = rows.withColumn("canonical", urls.once(urls.canonical(F.col("url"))))
    own = own.where(F.col("canonical").isNull() | ~classify.is_nonessential(F.col("canonical")))
    bad = own.where("canonical is null").select("seq", "url", F.col("url").alias("canonical"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("local_path"))
    first = own.where("canonical is not null").groupBy("canonical").agg(F.min_by(F.struct("seq", "url", "method", "content_type"), "seq").alias("r")).select("canonical", "r.*")
    gets = F.upper(F.coalesce("method", F.lit("GET"))) == "GET"
    skipped = first.where(~gets).select("seq", "url", "canonical", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("local_path"))
    paths = first.where(gets).withColumn("_p", urls.once(urls.local_path(F.col("canonical"), source_origin, types.extension_for(F.col("content_type")))))
    n = F.row_number().over(Window.partitionBy(F.lower("_p")).orderBy("seq", "canonical"))
    ext = urls.extension(F.col("_p"))
    numbered = F.concat(F.substring("_p", F.lit(1), F.length("_p") - F.length(ext)), F.lit("~u-"), n.cast("string"), ext)
    named = paths.select("seq", "url", "canonical", F.lit("pending").alias("status"), F.when(n == 1, F.col("_p")).otherwise(numbered).alias("local_path"))
    return bad.unionByName(skipped).unionByName(named)


def best_renditions(rows: DataFrame, width: float | None = None, height: float | None = None, scale: float = 1.0) -> DataFrame:
    """``rows(url, size)`` with one row for each image: its best rendition, for a viewport or, without one, the largest.

    For a viewport: one that names a size, one that fills it, the nearest in pixels; of equals the smallest that fills or the largest that doesn't. Then the untransformed image, more pixels, a larger side, quality, size, and the URL.
    """
    own = rows.withColumn("r", urls.once(media.rendition(F.col("url"))))
    w, h, largest, pixels = (F.col(f"r.{n}") for n in ("width", "height", "largest", "pixels"))
    keys = []
    if width is not None and height is not None:
        tw, th = width * scale, height * scale
        has = (w > 0) | (h > 0)
        fills = ((w <= 0) | (w >= tw)) & ((h <= 0) | (h >= th))
        distance = F.when((w > 0) & (h > 0), F.abs(pixels - tw * th)).otherwise(F.abs(largest - max(tw, th)))
        sign = F.when(fills, 1).otherwise(-1)
        keys = [F.desc("_has"), F.desc("_fills"), F.asc("_far"), F.asc("_pixels"), F.asc("_side")]
        own = own.select("*", has.alias("_has"), *[F.when(has, c).alias(n) for c, n in ((fills, "_fills"), (distance, "_far"), (sign * pixels, "_pixels"), (sign * largest, "_side"))])
    keys += [F.asc("r.transformed"), F.desc("r.pixels"), F.desc("r.largest"), F.desc("r.quality"), F.desc(F.coalesce("size", F.lit(0))), F.asc("url")]
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy("r.identity").orderBy(*keys)))
    return ranked.where("_n = 1").select(*rows.columns, F.col("r.identity").alias("identity"))


def download_map(resources: DataFrame) -> DataFrame:
    """``(key, kind, local_path)``: where the mirror has what a URL names.

    ``resources(canonical, final, status, local_path, content_type, size, sha256)``. kind url: the canonical and final URLs of what was downloaded; of those that differ in time stamps only and hold the same bytes, all name the
    file of the first. kind rendition: an image's identity, at its best rendition.
    """
    got = resources.where("status = 'downloaded' and local_path is not null")
    both = got.select(F.explode(F.array_distinct(F.filter(F.array("canonical", "final"), lambda u: u.isNotNull()))).alias("url"), "local_path", "content_type", "size", "sha256")
    named = both.withColumn("key", urls.once(urls.canonical(F.col("url")))).where("key is not null").dropDuplicates(["key"])
    named = named.withColumn("_same", urls.once(media.volatile_key(F.col("key"))))
    alike = named.where("_same is not null").groupBy("_same").agg(
        F.min_by("local_path", "key").alias("_first"), F.count_if(F.col("sha256").isNull()).alias("_unknown"), F.min("sha256").alias("_a"), F.max("sha256").alias("_b")
    )
    alike = alike.where("_unknown = 0 and _a = _b").select("_same", "_first")
    by_url = named.join(alike, "_same", "left").select("key", F.lit("url").alias("kind"), F.coalesce("_first", "local_path").alias("local_path"))
    pictures = F.coalesce(classify.media_type(F.col("content_type")).startswith("image/"), F.lit(False)) | types.extension(urls.path(F.col("key"))).isin([f".{e}" for e in classify.IMAGE])
    best = best_renditions(named.where(pictures).select(F.col("key").alias("url"), "size", "local_path"))
    return by_url.unionByName(best.select(F.col("identity").alias("key"), F.lit("rendition").alias("kind"), "local_path"))


def retry_inputs(failed: DataFrame, planned_sources: DataFrame, inputs: DataFrame) -> DataFrame:
    """``(url)`` to ask again: the planned sources of failed files, and the capture's inputs that are, redacted, a failed resource's URL.

    ``failed(local_path, url, canonical)``, ``planned_sources(local_path, url)``, ``inputs(url)``.
    """
    by_file = planned_sources.join(failed.select("local_path").distinct(), "local_path", "left_semi").select("url")
    hidden = failed.select(F.explode(F.array(urls.redacted(F.col("url")), urls.redacted(F.col("canonical")))).alias("_r")).distinct()
    by_url = inputs.withColumn("_r", urls.redacted(F.col("url"))).join(hidden, "_r", "left_semi").select("url")
    return by_file.union(by_url).distinct()


def retried(resources: DataFrame, again: DataFrame) -> DataFrame:
    """``resources`` (canonical, local_path, status, retryable, ...) with those replaced that ``again`` has by path, else by URL; ``recovered`` marks what was downloaded now.

    ``again`` has the same columns, one row for each resource tried.
    """
    columns = resources.columns
    new = again.select(F.struct(*columns).alias("_new"), F.col("canonical").alias("_url"), F.col("local_path").alias("_path"))
    by_path = new.where("_path is not null").select("_path", F.col("_new").alias("_by_path")).dropDuplicates(["_path"])
    by_url = new.select("_url", F.col("_new").alias("_by_url")).dropDuplicates(["_url"])
    joined = resources.join(by_path, resources["local_path"] == by_path["_path"], "left").join(by_url, resources["canonical"] == by_url["_url"], "left")
    new_row = F.coalesce("_by_path", "_by_url")
    recovered = F.coalesce((new_row["status"] == "downloaded") & new_row["local_path"].isNotNull(), F.lit(False))
    return joined.select(*[F.when(new_row.isNotNull(), new_row[c]).otherwise(resources[c]).alias(c) for c in columns], recovered.alias("recovered"))


def cache_commits(resources: DataFrame) -> DataFrame:
    """What a cache may keep: downloaded now, from the network, with nothing redacted, in a file."""
    return resources.where("status = 'downloaded' and body_source = 'network' and not coalesce(redacted, false) and local_path is not null")


def body_source(captured: Column, fresh: Column, etag: Column, last_modified: Column) -> Column:
    """Where a body comes from: captured, cache (fresh), revalidate (stored with something to ask by) or network. ``fresh`` is null for what is not stored."""
    asks = (F.coalesce(etag, F.lit("")) != "") | (F.coalesce(last_modified, F.lit("")) != "")
    return F.when(F.coalesce(captured, F.lit(False)), "captured").when(fresh, "cache").when(fresh.isNotNull() & asks, "revalidate").otherwise("network")
