"""Requests of a preview against the files of a mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .work import written

def target(path):
    """The file that a request's path names; null for one that leaves the root."""
    plain = F.regexp_replace(path, "^/+", "")
    named = F.when(plain == "", "index.html").when(plain.endswith("/"), F.concat(plain, F.lit("index.html"))).otherwise(plain)
    return F.when(~named.rlike(r"(^|/)\.\.?(/|$)|\\|\x00"), F.concat(F.lit("site/"), named))


def resolved(requests: DataFrame, files: DataFrame, aliases: DataFrame, unavailable: DataFrame) -> DataFrame:
    """``requests(path, accept, dest)`` with status and local_path: a file, else an alias, else 503 for what the mirror lacks, else the page for a navigation, else 404.

    ``files(local_path)``, ``aliases(route, local_path)`` of which a route with two paths counts for none, ``unavailable(route)``.
    """
    rows = requests.withColumn("_file", target(F.col("path")))
    own = files.select(F.col("local_path").alias("_own")).distinct()
    other = aliases.groupBy("route").agg(F.min("local_path").alias("_alias"), F.max("local_path").alias("_m")).where("_alias = _m").select("route", "_alias")
    gone = unavailable.select(F.col("route").alias("_gone")).distinct()
    rows = rows.join(own, rows["_file"] == own["_own"], "left").join(other, rows["path"] == other["route"], "left").join(gone, rows["path"] == gone["_gone"], "left")
    navigates = F.col("accept").contains("text/html") & F.col("dest").isin("document", "iframe") & ~F.col("path").rlike(r"\.[A-Za-z0-9]+$")
    status = (
        F.when(F.col("_file").isNull(), 400).when(F.col("_own").isNotNull() | F.col("_alias").isNotNull(), 200).when(F.col("_gone").isNotNull(), 503)
        .when(F.coalesce(navigates, F.lit(False)), 200).otherwise(404)
    )
    place = F.coalesce("_own", "_alias", F.when(F.col("_gone").isNull() & F.coalesce(navigates, F.lit(False)), "site/index.html"))
    return rows.select(*requests.columns, status.cast("long").alias("status"), F.when(F.col("_file").isNotNull(), place).alias("local_path"))


def admitted(rows: DataFrame, most_bytes: int, most_each: int | None = None) -> DataFrame:
    """``rows(job, seq, size)`` with ``admitted``: in order, each that still fits in what the job's admitted ones left of ``most_bytes``; an unknown size is none, one over ``most_each`` is out.

    One that doesn't fit is passed over and later smaller ones may be taken, so a running sum is not enough: a job's rows, whose number its resource limit
    bounds, are gone through in order by one task.
    """
    import pandas as pd

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part, used, out = part.sort_values("seq", kind="stable"), 0, []
        for size in part["size"].fillna(0).astype("int64"):
            fits = used + size <= most_bytes and (most_each is None or size <= most_each)
            used += size if fits else 0
            out.append(bool(fits))
        return pd.DataFrame({"job": part["job"], "seq": part["seq"], "admitted": out})

    own = rows.select("job", "seq", F.col("size").cast("long").alias("size"))
    found = own.groupBy("job").applyInPandas(fold, f"job {own.schema['job'].dataType.simpleString()}, seq {own.schema['seq'].dataType.simpleString()}, admitted boolean")
    return rows.join(found, ["job", "seq"])


MOST_MARKS = 4


def escaped_variants(path):
    """The spellings of a mirror's path by which a page may ask for it: each subset of its escape marks dropped; of more than MOST_MARKS marks, none or one of the first."""
    pieces = F.split(path, "~(?=[0-9a-fA-F]{2})", -1)
    n = F.size(pieces) - 1
    few = F.sequence(F.lit(0), F.pow(F.lit(2), F.least(n, F.lit(MOST_MARKS))).cast("int") - 1)
    masks = F.when(n <= MOST_MARKS, few).otherwise(F.array(*[F.lit(m) for m in (0, *(1 << i for i in range(MOST_MARKS)))]))
    dropped = lambda mask, i: (F.floor(mask / F.pow(F.lit(2), i - 1)) % 2) == 1
    spelled = lambda mask: F.array_join(F.transform(pieces, lambda p, i: F.when((i == 0) | dropped(mask, i), p).otherwise(F.concat(F.lit("~"), p))), "")
    return F.array_distinct(F.transform(masks, spelled))


def own_routes(local_path):
    """The routes of a file of the mirror's own origin; none for others."""
    inner = F.regexp_replace(local_path, "^site/", "")
    own = local_path.startswith("site/") & ~local_path.startswith("site/_external/") & (inner != "")
    return F.when(own, F.transform(escaped_variants(inner), lambda v: F.concat(F.lit("/"), v))).otherwise(F.array().cast("array<string>"))


def _rest(path):
    """A path without its first segment, if that has a dot and others follow; null otherwise."""
    names = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when((F.size(names) > 1) & F.get(names, F.lit(0)).contains("."), F.array_join(F.slice(names, F.lit(2), F.size(names)), "/"))


def _routed(resources: DataFrame, sources: DataFrame) -> DataFrame:
    """Each resource with the routes that its URL and its file give: ``own`` for the source's origin, ``local`` for its file there (the file's own spelling first), ``other`` for other origins."""
    start = sources.select("job", urls.once(urls.parts(F.col("url"))).alias("s"))
    s = urls.Parts(F.col("s"))
    start = start.select(F.col("job").alias("_job"), urls.once(urls.origin(s)).alias("origin"), F.nullif(F.regexp_replace(s["path"], "/+$", ""), F.lit("")).alias("prefix"))
    rows = resources.join(start, resources["job"] == start["_job"]).drop("_job").withColumn("_u", urls.once(urls.parts(F.col("url"))))
    u = urls.Parts(F.col("_u"))
    route = lambda path: F.concat(F.lit("/"), F.regexp_replace(path, "^/+", ""), urls.search(u))
    inner = F.regexp_extract("local_path", r"^site/_external/https?/[^/]+/(.+)$", 1)
    spelled = lambda p: F.transform(escaped_variants(p), lambda v: F.concat(F.lit("/"), v))
    none = F.array().cast("array<string>")
    outside = F.when(inner == "", none).otherwise(F.concat(spelled(inner), F.when(_rest(inner).isNotNull(), spelled(_rest(inner))).otherwise(none)))
    rows = rows.where(u["web"]).withColumn("same", urls.once(urls.origin(u) == F.col("origin")))
    rows = rows.select(*resources.columns, "prefix", "same", urls.once(route(u["path"])).alias("route"), urls.once(F.when(_rest(u["path"]).isNotNull(), route(_rest(u["path"])))).alias("shorter"), F.coalesce(own_routes(F.col("local_path")), none).alias("local"), F.coalesce(outside, none).alias("outside"))
    return rows.withColumn("other", F.array_compact(F.concat(F.array("route", "shorter"), "outside")))


def _unique(candidates: DataFrame) -> DataFrame:
    """``(job, route, path, n)`` of ``(job, route, path)``: how many files a route has, and one of them."""
    return candidates.groupBy("job", "route").agg(F.min("path").alias("path"), F.count_distinct("path").alias("n"))


def aliases(resources: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``(job, route, path, kind)``, the routes beside the mirror's own paths by which its files are served, and ``(job, kind, n)``, how many routes were dropped since several files claim them.

    ``resources(job, seq, url, local_path, status, html)``, ``sources(job, url)``. Only downloaded files count; ``path`` is below ``site/``. Kinds, of which an earlier one wins a route:
    page (pages of the source's origin by their URLs, the first by seq), external (other origins' files by their paths there, with and without a leading segment with a dot; none that the source's origin has), spelling (other spellings of escaped names),
    prefixed (files asked for below the source page's path; none that the source's origin has). All but pages need one file. Routes are joined by job and route, so no job is one task's work.
    """
    rows = written(_routed(resources, sources), "routed")
    served = rows.where((F.col("status") == "downloaded") & F.startswith("local_path", F.lit("site/"))).withColumn("path", F.regexp_replace("local_path", "^site/", ""))
    known = rows.where("same").select("job", F.explode(F.concat(F.array("route"), "local")).alias("route")).distinct()
    page = served.where("same and html").groupBy("job", "route").agg(F.min_by("path", F.struct("seq", "path")).alias("path"))
    external = _unique(served.where("not same and not html").select("job", F.explode("other").alias("route"), "path"))
    files = served.where("same and not html")
    spelling = _unique(files.select("job", F.explode(F.slice("local", F.lit(2), F.greatest(F.size("local"), F.lit(1)))).alias("route"), "path"))
    free = external.where("n = 1").join(known, ["job", "route"], "left_anti").join(page, ["job", "route"], "left_anti").select("job", "route", "path")
    below = _unique(files.select("job", F.explode(F.concat(F.array("route"), "local")).alias("route"), "path").unionByName(free))
    start = sources.select("job", F.nullif(F.regexp_replace(urls.path(F.col("url")), "/+$", ""), F.lit("")).alias("prefix")).where("prefix is not null")
    bare = F.regexp_replace("route", r"\?.*$", "")
    below = below.join(start, "job").where((bare != F.col("prefix")) & ~F.startswith(bare, F.concat("prefix", F.lit("/"))))
    prefixed = below.select("job", F.concat("prefix", "route").alias("route"), "path", "n").join(known, ["job", "route"], "left_anti")
    ranked = [page.withColumn("n", F.lit(1)), free.withColumn("n", F.lit(1)), spelling, prefixed]
    all_ = None
    for k, (kind, df) in enumerate(zip(("page", "external", "spelling", "prefixed"), ranked, strict=True)):
        df = df.where("n = 1").select("job", "route", F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), "path").alias("c"))
        all_ = df if all_ is None else all_.unionByName(df)
    found = all_.groupBy("job", "route").agg(F.min("c").alias("c")).select("job", "route", "c.path", "c.kind")
    lost = None
    for kind, df in (("external", external), ("spelling", spelling), ("prefixed", prefixed)):
        df = df.where("n > 1").groupBy("job").agg(F.count("*").alias("n")).select("job", F.lit(kind).alias("kind"), "n")
        lost = df if lost is None else lost.unionByName(df)
    return found, lost


def unavailable_routes(resources: DataFrame, sources: DataFrame) -> DataFrame:
    """``(job, route)``: routes of resources that failed, were skipped or are pending, unless a downloaded one serves them and none of the source's origin is missing there; each also below the source page's path."""
    rows = _routed(resources, sources)
    routes_ = F.concat(F.when(F.col("same"), F.concat(F.array("route"), "local")).otherwise(F.col("other")))
    each = rows.select("job", "prefix", "same", "status", F.startswith("local_path", F.lit("site/")).alias("kept"), F.explode(F.array_distinct(routes_)).alias("route"))
    have = (F.col("status") == "downloaded") & F.coalesce("kept", F.lit(False))
    lacks = F.col("status").isin("failed", "skipped", "pending")
    told = each.groupBy("job", "prefix", "route").agg(F.bool_or(have).alias("have"), F.bool_or(lacks).alias("lacks"), F.bool_or(lacks & F.col("same")).alias("own"))
    gone = told.where("lacks and (not have or own)")
    bare = F.regexp_replace("route", r"\?.*$", "")
    outside = F.col("prefix").isNotNull() & (bare != F.col("prefix")) & ~F.startswith(bare, F.concat("prefix", F.lit("/")))
    return gone.select("job", F.explode(F.when(outside, F.array(F.col("route"), F.concat("prefix", "route"))).otherwise(F.array("route"))).alias("route")).distinct()
