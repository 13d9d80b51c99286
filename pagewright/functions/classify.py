"""Classes of URLs and of resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

# Hosts and paths of trackers, telemetry, embeds and translation.
TRACKING_DOMAINS = ["doubleclick.net", "google-analytics.com", "googletagmanager.com"]
TELEMETRY_PATHS = ["/.well-known/dux"]
TELEMETRY_PREFIXES = ["/cdn/wpm/", "/web-pixels"]
TELEMETRY_ROUTES = [
    ("connect.facebook.net", "/en_us/fbevents.js"),
    ("consent.trustarc.com", "/analytics"),
    ("img.en25.com", "/i/elqcfg.min.js"),
    ("sc-static.net", "/scevent.min.js"),
    ("tr.snapchat.com", "/cm/i"),
    ("www.google.com", "/g/collect"),
    ("www.facebook.com", "/tr"),
    ("www.facebook.com", "/tr/"),
]
EMBED_HOSTS = [
    "connect.facebook.net", "platform.twitter.com", "platform.x.com", "syndication.twitter.com", "syndication.x.com",
    "static.xx.fbcdn.net", "staticxx.facebook.com", "apis.google.com", "developers.google.com",
]
EMBED_PREFIXES = [
    ("www.facebook.com", "/plugins/"),
    ("www.facebook.com", "/v2.0/plugins/"),
    ("www.facebook.com", "/data/manifest/"),
    ("m.facebook.com", "/plugins/"),
    ("m.facebook.com", "/v2.0/plugins/"),
    ("m.facebook.com", "/data/manifest/"),
    ("accounts.google.com", "/o/oauth2/postmessagerelay"),
]
TRANSLATION_PREFIXES = [
    ("translate.googleapis.com", "/_/translate_http/"),
    ("translate.googleapis.com", "/translate_a/element"),
    ("translate.googleapis.com", "/translate_static/"),
    ("translate.google.com", "/_/translate_http/"),
    ("translate.google.com", "/translate_a/element"),
    ("translate.google.com", "/translate_static/"),
    ("www.gstatic.com", "/_/translate_http/"),
]

# Extensions by what fetching them costs or brings.
LEAF = "basis bin csv dds drc glb hdr ktx ktx2 otf riv ttf wasm woff woff2".split()
AUDIO = "aac flac m4a mp3 oga ogg opus wav".split()
VIDEO = "m4v mov mp4 ogv webm".split()
IMAGE = "avif bmp gif ico jpeg jpg png svg tif tiff webp".split()
EXPANDABLE = "cjs css gltf hdr htm html js json mjs webmanifest xml".split()
TEXT_TYPES = (
    "text/html application/xhtml+xml text/css application/javascript application/ecmascript text/javascript text/ecmascript "
    "application/json application/manifest+json model/gltf+json"
).split()

#: Column of conditions joined by or.
any_of = lambda conditions: reduce(lambda a, b: a | b, conditions)


def _host(url: Column | urls.Parts) -> Column:
    return urls._of(url, lambda u: F.when(u["scheme"].isin("http", "https"), F.regexp_replace(u["host"], r"\.$", "")))


def _path(url: Column) -> Column:
    return F.lower(urls.path(url))


def is_tracking(url: Column) -> Column:
    return F.coalesce(any_of([(_host(url) == d) | _host(url).endswith("." + d) for d in TRACKING_DOMAINS]), F.lit(False))


def is_telemetry(url: Column) -> Column:
    path = _path(url)
    routes = any_of([(_host(url) == h) & (path == p) for h, p in TELEMETRY_ROUTES])
    found = path.isin(TELEMETRY_PATHS) | any_of([path.startswith(p) for p in TELEMETRY_PREFIXES]) | routes
    return F.coalesce(_host(url).isNotNull() & found, F.lit(False))


def is_embed(url: Column) -> Column:
    path = _path(url)
    prefixed = any_of([(_host(url) == h) & path.startswith(p) for h, p in EMBED_PREFIXES])
    relay = (_host(url) == "ssl.gstatic.com") & path.startswith("/accounts/o/") & path.endswith("postmessagerelay.js")
    return F.coalesce(_host(url).isin(EMBED_HOSTS) | prefixed | relay, F.lit(False))


def is_translation(url: Column) -> Column:
    path = _path(url)
    beacon = (path == "/gen204") & _host(url).isin("www.google.com", "translate.google.com", "translate.googleapis.com")
    beacon &= F.lower(urls.search(url)).rlike("[?&]client=te_lib(&|$)")
    return F.coalesce(any_of([(_host(url) == h) & path.startswith(p) for h, p in TRANSLATION_PREFIXES]) | beacon, F.lit(False))


def is_nonessential(url: Column | urls.Parts) -> Column:
    return urls._of(url, lambda u: is_tracking(u) | is_telemetry(u) | is_embed(u) | is_translation(u))


def media_type(content_type: Column) -> Column:
    """Lower case without parameters; null for none."""
    plain = F.lower(F.trim(F.regexp_extract(content_type, "^([^;]*)", 1)))
    return F.when(plain != "", plain)


def file_extension(url: Column) -> Column:
    """Of the last path segment, lower case, without the dot."""
    return F.lower(F.regexp_extract(urls.path(url), r"[^/]\.([^./]*)$", 1))


def rewrite_type(content_type: Column, path: Column) -> Column:
    """html, css, json or javascript if the text of such a resource can be rewritten; the type decides, then the extension."""
    t, ext = media_type(content_type), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    by_type = (
        F.when(t.isin("text/html", "application/xhtml+xml"), "html").when(t == "text/css", "css")
        .when(t.isin("application/json", "text/json") | t.endswith("+json"), "json")
        .when(t.isin("application/javascript", "text/javascript", "application/x-javascript", "application/ecmascript", "text/ecmascript"), "javascript")
    )
    by_name = F.when(ext.isin("html", "htm", "xhtml"), "html").when(ext == "css", "css").when(ext.isin("json", "webmanifest", "gltf"), "json").when(ext.isin("js", "mjs", "cjs"), "javascript")
    return F.coalesce(by_type, by_name)


def priority(url: Column, resource_type: Column, initiator: Column, content_type: Column) -> Column:
    """0 expandable, 1 required leaf, 2 audio, 3 video, 4 image; the order of the tests matters."""
    kind, by, t, ext = F.lower(F.trim(resource_type)), F.lower(F.trim(initiator)), media_type(content_type), file_extension(url)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(kind == "font") | yes(t.startswith("font/")) | yes(t.isin("application/wasm", "model/gltf-binary")) | ext.isin(LEAF), 1)
        .when(yes(kind.isin("audio", "texttrack")) | yes(t.startswith("audio/")) | ext.isin(AUDIO), 2)
        .when(yes(kind.isin("media", "video")) | yes(t.startswith("video/")) | ext.isin(VIDEO), 3)
        .when(yes(kind == "image") | yes(t.startswith("image/")), 4)
        .when(yes(kind.isin("document", "script", "stylesheet", "xhr", "fetch", "manifest")) | yes(by.isin("parser", "script")) | yes(t.isin(TEXT_TYPES)) | yes(t.endswith("+json")), 0)
        .when(ext.isin(EXPANDABLE), 0)
        .when(ext.isin(IMAGE), 4)
        .otherwise(0)
    )


# What marks a tracker's script that stands on its own, and one within a page.
RUM_PATH, RUM_SIGNS = "/cdn-cgi/rum", ["sendBeacon", "PerformanceObserver", "cf-beacon"]
TAG_RUNTIME = r"^\s*// Copyright \d{4} Google Inc\. All rights reserved\.\s*\(function\(\)\s*\{\s*var data\s*=\s*\{\s*\"resource\""
TAG_SIGNS = ["gtmOnSuccess", "www.googletagmanager.com", "google-analytics.com"]
SNIPPETS = [r"\bGoogleAnalyticsObject\b", r"(?i)google-analytics\.com/analytics\.js", r"(?i)googletagmanager\.com/gtag/js"]
MOST_SNIPPET = 10_000


def is_tracking_script(source: Column) -> Column:
    """Whether a script file is a tracker's and nothing else."""
    rum = source.contains(RUM_PATH) & any_of([source.contains(x) for x in RUM_SIGNS])
    tag = F.substring(source, 1, 512).rlike(TAG_RUNTIME) & reduce(lambda a, b: a & b, [source.contains(x) for x in TAG_SIGNS])
    return F.coalesce(rum | tag, F.lit(False))


def is_tracking_snippet(source: Column) -> Column:
    """Whether a page's own script only starts a tracker."""
    return F.coalesce((F.length(source) <= MOST_SNIPPET) & any_of([source.rlike(p) for p in SNIPPETS]), F.lit(False))
