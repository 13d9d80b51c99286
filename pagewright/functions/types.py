"""Media types, extensions and what a resource ought to be; the answers of a preview for what it lacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import classify, kinds

# Media types by extension, and extensions by media type.
TYPE_OF_EXTENSION = {
    ".avif": "image/avif", ".bin": "application/octet-stream", ".css": "text/css; charset=utf-8", ".dds": "image/vnd-ms.dds", ".eot": "application/vnd.ms-fontobject",
    ".gif": "image/gif", ".glb": "model/gltf-binary", ".gltf": "model/gltf+json", ".hdr": "image/vnd.radiance", ".html": "text/html; charset=utf-8", ".ico": "image/x-icon",
    ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".js": "application/javascript; charset=utf-8", ".json": "application/json; charset=utf-8", ".ktx": "image/ktx", ".ktx2": "image/ktx2",
    ".m4a": "audio/mp4", ".mjs": "application/javascript; charset=utf-8", ".mp3": "audio/mpeg", ".mp4": "video/mp4", ".ogg": "audio/ogg", ".otf": "font/otf", ".pdf": "application/pdf",
    ".png": "image/png", ".svg": "image/svg+xml", ".srt": "application/x-subrip; charset=utf-8", ".ttf": "font/ttf", ".txt": "text/plain; charset=utf-8", ".vtt": "text/vtt; charset=utf-8",
    ".wasm": "application/wasm", ".wav": "audio/wav", ".webm": "video/webm", ".webp": "image/webp", ".woff": "font/woff", ".woff2": "font/woff2", ".xml": "application/xml; charset=utf-8",
}
EXTENSION_OF_TYPE = {
    "application/javascript": ".js", "application/json": ".json", "application/pdf": ".pdf", "application/srt": ".srt", "application/wasm": ".wasm", "application/x-srt": ".srt",
    "application/x-subrip": ".srt", "application/xml": ".xml", "audio/mp4": ".m4a", "audio/mpeg": ".mp3", "audio/ogg": ".ogg", "audio/wav": ".wav", "font/otf": ".otf", "font/ttf": ".ttf",
    "font/woff": ".woff", "font/woff2": ".woff2", "image/avif": ".avif", "image/gif": ".gif", "image/jpeg": ".jpg", "image/ktx": ".ktx", "image/ktx2": ".ktx2", "image/png": ".png",
    "image/svg+xml": ".svg", "image/vnd-ms.dds": ".dds", "image/vnd.radiance": ".hdr", "image/webp": ".webp", "model/gltf+json": ".gltf", "model/gltf-binary": ".glb", "text/css": ".css",
    "text/html": ".html", "text/javascript": ".js", "text/plain": ".txt", "text/vtt": ".vtt", "video/mp4": ".mp4", "video/webm": ".webm",
}
# Kinds by extension.
KIND_EXTENSIONS = {
    "script": [".cjs", ".js", ".mjs"],
    "stylesheet": [".css"],
    "structured": [".gltf", ".json", ".map", ".webmanifest", ".xml"],
    "document": [".html", ".htm"],
    "image": [".avif", ".bmp", ".dds", ".gif", ".hdr", ".ico", ".jpeg", ".jpg", ".ktx", ".ktx2", ".png", ".svg", ".webp"],
    "font": [".eot", ".otf", ".ttf", ".woff", ".woff2"],
    "media": [".aac", ".flac", ".m4a", ".m4v", ".mov", ".mp3", ".mp4", ".oga", ".ogg", ".ogv", ".opus", ".wav", ".webm"],
    "wasm": [".wasm"],
    "model": [".glb"],
    "binary": [".basis", ".bin", ".csv", ".dae", ".drc", ".fbx", ".pack", ".pdf", ".pvr", ".riv", ".zip"],
    "text": [".frag", ".glsl", ".srt", ".txt", ".vert", ".vtt"],
}
STRONG_BINARY = [".pack", ".pdf", ".zip"]
KIND_OF_RESOURCE_TYPE = {
    "font": "font", "image": "image", "media": "media", "texttrack": "text", "manifest": "structured", "script": "script", "worker": "script", "stylesheet": "stylesheet",
}
# Extensions that no page has, and images that a blank one stands in for.
NOT_DOCUMENTS = (
    ".3ds .aac .avif .basis .bin .bmp .cjs .css .csv .dae .dds .drc .eot .exr .fbx .flac .frag .gif .glb .gltf .glsl .gz .hdr .ico .jpeg .jpg .js .json .ktx .ktx2 .m4a .m4v .map .mjs "
    ".mov .mp3 .mp4 .oga .ogg .ogv .opus .otf .png .pvr .riv .srt .svg .ttf .txt .vert .vtt .wasm .wav .webm .webmanifest .webp .woff .woff2 .xml .zip"
).split()
BLANKED_IMAGES = [".avif", ".bmp", ".gif", ".ico", ".jpeg", ".jpg", ".png", ".svg", ".webp"]
NOT_HTML_TYPES = ["font", "image", "manifest", "media", "script", "stylesheet", "texttrack", "worker", "xhr", "fetch"]


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def extension(path: Column) -> Column:
    """Of the last segment, in lower case with its dot; empty for none."""
    return F.lower(F.regexp_extract(path, r"(?s)[^/](\.[^./]*)$", 1))


def extension_for(content_type: Column) -> Column:
    """The extension that a media type asks for, or null."""
    return _looked_up(EXTENSION_OF_TYPE, classify.media_type(content_type))


def type_for(path: Column, known: Column) -> Column:
    """``known`` if there is one, else the type of the path's extension, else that of plain bytes."""
    return F.coalesce(F.when(known != "", known), _looked_up(TYPE_OF_EXTENSION, extension(path)), F.lit("application/octet-stream"))


def kind_by_path(path: Column) -> Column:
    table = {e: kind for kind, extensions in KIND_EXTENSIONS.items() for e in extensions}
    return F.coalesce(_looked_up(table, extension(path)), F.lit("unknown"))


def strong_kind_by_path(path: Column) -> Column:
    """The kind by extension; null for none and for containers whose content may be anything."""
    kind = kind_by_path(path)
    return F.when((kind != "unknown") & ((kind != "binary") | extension(path).isin(STRONG_BINARY)), kind)


def expected_kind(resource_type: Column, path: Column, content_type: Column) -> Column:
    """What a resource ought to be. A document gives way to stronger evidence, since every navigation is called one."""
    asked, strong, by_type = F.lower(F.trim(resource_type)), strong_kind_by_path(path), kinds.by_content_type(content_type)
    document = F.when(strong != "document", strong).when(~by_type.isin("unknown", "document"), by_type).otherwise("document")
    fallback = F.coalesce(strong, F.when(by_type != "unknown", by_type), kind_by_path(path))
    return F.when(asked == "document", document).otherwise(F.coalesce(_looked_up(KIND_OF_RESOURCE_TYPE, asked), fallback))


def preferred_type(expected: Column, path: Column, expected_type: Column, declared: Column) -> Column:
    """The declared type, unless it says less than what was expected."""
    kind = kinds.by_content_type(declared)
    vague = (kind == "unknown") | ((kind == "text") & expected.isin(kinds.TEXT_LIKE))
    return F.when(vague, F.coalesce(expected_type, type_for(path, F.lit(None).cast("string")))).otherwise(F.coalesce(declared, type_for(path, F.lit(None).cast("string"))))


def body_verdict(expected: Column, declared: Column, body: Column) -> Column:
    """ok, html (a page in place of another kind: worth a retry) or mismatch (a declared kind that does not fit)."""
    other = ~expected.isin("document", "unknown")
    return F.when(other & kinds.starts_with_html(body), "html").when(other & ~kinds.is_compatible(expected, kinds.by_content_type(declared)), "mismatch").otherwise("ok")


def falls_back_to_page(method: Column, accept: Column, destination: Column, path: Column) -> Column:
    """Whether a request for a path that no file has is a navigation, which the page answers."""
    where = F.lower(F.trim(F.coalesce(destination, F.lit(""))))
    asks = F.coalesce(F.lower(accept).contains("text/html"), F.lit(False))
    return method.isin("GET", "HEAD") & asks & where.isin("", "document", "iframe") & ~extension(F.regexp_replace(path, "[?#].*$", "")).isin(NOT_DOCUMENTS)


def asks_for_data(accept: Column, destination: Column) -> Column:
    """Whether a script asks, and not the browser for an element."""
    where, wanted = F.lower(F.trim(F.coalesce(destination, F.lit("")))), F.lower(F.coalesce(accept, F.lit("")))
    return F.when(where != "", where == "empty").otherwise(wanted.contains("application/json") | wanted.contains("text/json"))


def answers_empty(accept: Column, destination: Column, path: Column) -> Column:
    """Whether empty data may stand in for a missing resource that a script asks for."""
    return asks_for_data(accept, destination) & extension(F.regexp_replace(path, "[?#].*$", "")).isin("", ".js", ".json", ".map", ".webmanifest")


def neutral_answer(method: Column, accept: Column, destination: Column, path: Column) -> Column:
    """What stands in for an unavailable resource: page, data, script, style, subrip, webvtt, image or nothing (status 204)."""
    ext = extension(F.regexp_replace(path, "[?#].*$", ""))
    return (
        F.when(falls_back_to_page(method, accept, destination, path), "page").when(answers_empty(accept, destination, path), "data")
        .when(ext.isin(".js", ".mjs", ".cjs"), "script").when(ext == ".css", "style").when(ext.isin(".json", ".map", ".webmanifest"), "data")
        .when(ext == ".srt", "subrip").when(ext == ".vtt", "webvtt").when(ext.isin(BLANKED_IMAGES), "image").otherwise("nothing")
    )


def is_html(resource_type: Column, content_type: Column, path: Column) -> Column:
    """Whether a resource is a page, by its type where that is not another kind's, else by its media type or extension."""
    ext = extension(path)
    other = F.coalesce(F.lower(F.trim(resource_type)).isin(NOT_HTML_TYPES), F.lit(False)) | ext.isin(NOT_DOCUMENTS)
    page = F.coalesce(classify.media_type(content_type).isin("text/html", "application/xhtml+xml"), F.lit(False)) | ext.isin(".html", ".htm")
    return ~other & page
