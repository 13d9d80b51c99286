"""Which captured bodies may be used again, and which resources may be asked for without evidence of a response."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import classify, kinds, types, urls

# Resource types whose bodies may be used again, and those asked for although they are incomplete.
OWN_TYPES = ["Document", "Font", "Image", "Manifest", "Media", "Other", "Script", "Stylesheet", "TextTrack"]
PUBLIC_TYPES = ["Font", "Image", "Manifest", "Media", "Other", "Script", "Stylesheet", "TextTrack"]
INCOMPLETE_TYPES = ["Fetch", "Font", "Image", "Manifest", "Media", "Other", "Script", "Stylesheet", "TextTrack", "XHR"]
LONG_LIVED = ["WebSocket", "EventSource", "Ping"]
# Extensions and media types of static files, and segments of paths that are none.
STATIC_EXTENSIONS = (
    ".aac .avif .basis .bin .bmp .cjs .css .dds .drc .eot .exr .frag .flac .gif .glb .gltf .glsl .hdr .ico .jpeg .jpg .js .json .ktx .ktx2 .m4a .m4v .map .mjs .mp3 .mp4 .ogg .otf .png .riv "
    ".srt .svg .ttf .txt .vert .vtt .wav .webm .webmanifest .webp .wasm .wgsl .woff .woff2 .xml"
).split()
STATIC_TYPES = [
    "application/javascript", "application/json", "application/octet-stream", "application/wasm", "model/gltf-binary", "model/gltf+json", "text/css", "text/javascript",
]
API_SEGMENTS = ["api", "auth", "graphql", "session", "token"]
# Resource types by extension; other static files are fetched.
TYPE_EXTENSIONS = {
    "Script": [".cjs", ".js", ".mjs"],
    "Stylesheet": [".css"],
    "Font": [".eot", ".otf", ".ttf", ".woff", ".woff2"],
    "Image": [".avif", ".bmp", ".gif", ".ico", ".jpeg", ".jpg", ".png", ".svg", ".webp"],
    "Media": [".aac", ".flac", ".m4a", ".m4v", ".mp3", ".mp4", ".ogg", ".wav", ".webm"],
    "TextTrack": [".srt", ".vtt"],
    "Manifest": [".webmanifest"],
}


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _listed(header: Column, names: list[str], values: bool = True) -> Column:
    """Whether a header that lists names, with or without values, has one of them."""
    parts = F.transform(F.split(F.lower(F.coalesce(header, F.lit(""))), r"[,\r\n]+"), lambda p: F.trim(F.regexp_extract(F.trim(p), "^([^=]*)", 1)) if values else F.trim(p))
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def is_private(cache_control: Column) -> Column:
    return _listed(cache_control, ["private", "no-store"])


def is_public(cache_control: Column) -> Column:
    return _listed(cache_control, ["public", "immutable", "max-age", "s-maxage"])


def varies_by_credential(vary: Column) -> Column:
    return _listed(vary, ["*", "cookie", "authorization"], values=False)


def header(headers: Column, name: str) -> Column:
    """A header of a map by its name in any case."""
    return F.try_element_at(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(1))


def request_privacy(headers: Column, cookies: Column) -> Column:
    """``{has_cookie, has_authorization}`` of what a request really sent; cookies are structs with ``blocked``, the reasons why one was not sent."""
    sent = F.exists(F.coalesce(cookies, F.array().cast("array<struct<blocked:array<string>>>")), lambda c: F.coalesce(F.size(c["blocked"]), F.lit(0)) <= 0)
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    has = lambda n: _yes(F.array_contains(names, n))
    return F.struct((has("cookie") | _yes(sent)).alias("has_cookie"), has("authorization").alias("has_authorization"))


def response_privacy(headers: Column, blocked: Column, exempted: Column) -> Column:
    """``{has_set_cookie, private_or_no_store, varies_by_credential, cookie_policy_affected}`` of what a response really carried; the last two arguments count cookies."""
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    return F.struct(
        _yes(F.array_contains(names, "set-cookie")).alias("has_set_cookie"), is_private(header(headers, "cache-control")).alias("private_or_no_store"),
        varies_by_credential(header(headers, "vary")).alias("varies_by_credential"), (_yes(blocked > 0) | _yes(exempted > 0)).alias("cookie_policy_affected"),
    )


def has_static_extension(u: urls.Parts) -> Column:
    return types.extension(u["path"]).isin(STATIC_EXTENSIONS)


def _asks_api(u: urls.Parts) -> Column:
    return F.exists(F.split(u["path"], "/"), lambda p: F.lower(urls.decoded(p)).isin(API_SEGMENTS))


def static_resource_type(url: Column) -> Column:
    """What a static file would have been requested as, by its name; null for what is no plain static file."""
    def of(u: urls.Parts) -> Column:
        ext = types.extension(u["path"])
        kind = reduce(lambda rest, kv: F.when(ext.isin(kv[1]), kv[0]).otherwise(rest), reversed(TYPE_EXTENSIONS.items()), F.lit("Fetch"))
        plain = u["web"] & ~classify.is_nonessential(u) & ~urls.has_sensitive_query(u) & ~_asks_api(u) & has_static_extension(u)
        return F.when(plain, kind)

    return urls._of(url, of)


def is_historical_candidate(c) -> Column:
    """``c(name)`` gives columns of a resource. One that only the page's timing mentions, and whose name says what it is."""
    return _yes(
        (c("state") == "discovered") & (F.upper(c("method")) == "GET") & (c("initiator") == "performance") & (F.coalesce(F.size(F.map_keys(c("request_headers"))), F.lit(0)) <= 0)
        & (c("redirect_index") == 0) & (static_resource_type(c("url")) == c("resource_type"))
    )


def is_incomplete_candidate(c, source_origin: Column) -> Column:
    """A static file of the page's origin that was asked for and never finished, with evidence that nothing private was in it."""
    p = c("privacy")
    unsafe = ~_yes(p["request_extra"]) | reduce(lambda a, b: a | b, [_yes(p[n]) for n in ("has_authorization", "has_set_cookie", "private_or_no_store", "varies_by_credential", "cookie_policy_affected", "ambiguous")])
    status = F.coalesce(c("status"), p["status"])

    def of(u: urls.Parts) -> Column:
        return (
            (c("state") == "discovered") & (F.upper(c("method")) == "GET") & u["web"] & (urls.origin(u) == source_origin) & (c("redirect_index") == 0) & ~classify.is_nonessential(u)
            & ~urls.has_sensitive_query(u) & ~_asks_api(u) & ~unsafe & (status.isNull() | status.between(200, 299)) & c("resource_type").isin(INCOMPLETE_TYPES) & has_static_extension(u)
        )

    return _yes(urls._of(c("url"), of))


def scope(c, source_origin: Column) -> Column:
    """same_origin or public_cross_origin for a body that may be used again, else null.

    Across origins only a public https body counts: with complete evidence, or caching and CORS open to all, and with nothing that speaks of a person.
    """
    p, headers, status = c("privacy"), c("response_headers"), c("status")
    get = lambda n: header(headers, n)

    def of(u: urls.Parts) -> Column:
        kind = F.coalesce(F.regexp_extract(F.coalesce(get("content-type"), c("mime_type"), F.lit("")), "^([^;]*)", 1), F.lit(""))
        kind = F.lower(F.trim(kind))
        media = reduce(lambda a, b: a | b, [kind.startswith(x) for x in ("font/", "image/", "audio/", "video/")])
        static = ~F.exists(F.split(F.lower(u["path"]), "/"), lambda s: s.isin(API_SEGMENTS)) & is_public(get("cache-control")) & (has_static_extension(u) | kind.isin(STATIC_TYPES) | media)
        public = _yes(c("resource_type").isin(PUBLIC_TYPES)) | (_yes(c("resource_type") == "Fetch") & static)
        usable = (F.upper(c("method")) == "GET") & u["web"] & ~classify.is_nonessential(u) & ~_yes(c("resource_type").isin(LONG_LIVED)) & _yes(status.between(200, 203))
        complete = _yes(p["request_extra"]) & _yes(p["response_extra"]) & _yes(p["status"] == status)
        open_ = is_public(get("cache-control")) & kinds.allows_any_origin(get("access-control-allow-origin"), get("access-control-allow-credentials"), source_origin)
        told = reduce(lambda a, b: a | b, [_yes(p[n]) for n in ("has_cookie", "has_authorization", "has_set_cookie", "private_or_no_store", "varies_by_credential", "cookie_policy_affected", "ambiguous")])
        unsafe = _yes(c("has_set_cookie")) | is_private(get("cache-control")) | varies_by_credential(get("vary")) | told | (_yes(p["response_extra"]) & ~_yes(p["status"] == status))
        cached = reduce(lambda a, b: a | b, [_yes(c(n)) for n in ("from_disk_cache", "from_prefetch_cache", "from_service_worker")])
        across = public & (c("redirect_index") == 0) & (u["scheme"] == "https") & ~urls.has_sensitive_query(u) & ~cached & (complete | open_) & ~unsafe
        return F.when(usable & (urls.origin(u) == source_origin), F.when(_yes(c("resource_type").isin(OWN_TYPES)), "same_origin")).when(usable & across, "public_cross_origin")

    return urls._of(c("url"), of)
