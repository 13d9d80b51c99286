"""What a text in a document looks like: a reference, a static asset, a path; and where a page may lead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import types, urls

# Extensions of static assets.
ASSETS = (
    ".3ds .aac .avif .basis .bin .bmp .cjs .css .csv .dae .dds .drc .eot .exr .fbx .flac .frag .fs .gif .glb .gltf .glsl .gz .hdr .htm .html .ico .icon .jpeg .jpg .js .json .ktx .ktx2 .m4a "
    ".m4v .map .mjs .mov .mp3 .mp4 .mtl .obj .oga .ogg .ogv .opus .otf .pdf .ply .png .pvr .riv .shader .srt .stl .svg .tar .tif .tiff .ttf .txt .vert .vs .vtt .wasm .wav .webm .webmanifest "
    ".webp .woff .woff2 .xml .zip"
).split()
#: A base that no reference leaves.
NOWHERE = "https://nowhere.invalid/"
BLANK = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def is_asset(text: Column, spaces: bool = False) -> Column:
    """Whether a text, resolved, names a file with a known extension and something before it; with ``spaces`` blanks may stand in it raw."""
    t = _trimmed(text)
    odd = F.translate(t, " ", "").rlike(BLANK) | (F.lit(not spaces) & t.contains(" "))

    def named(u: urls.Parts) -> Column:
        return u["web"] & types.extension(u["path"]).isin(ASSETS)

    found = urls._of(urls.joined(t, F.lit(NOWHERE)), named)
    return F.coalesce((t != "") & ~odd & found, F.lit(False))


def has_url_shape(text: Column) -> Column:
    """Whether a text is written as a reference: by how it begins, or as one word with a slash in it."""
    t = _trimmed(text)
    begins = F.lower(t).rlike(r"^(https?://|//|/|\./|\.\./)")
    return (t != "") & ~t.startswith("#") & (begins | (~t.rlike(BLANK) & t.contains("/")))


def is_bare_path(text: Column) -> Column:
    return ~_trimmed(text).rlike(r"^(https?://|//|/|\./|\.\./)")


def path_aliases(url: Column) -> Column:
    """Names by which a static asset may be meant: its path, and its file name at the root."""
    def named(u: urls.Parts) -> Column:
        file = F.regexp_extract(u["path"], "([^/]*)$", 1)
        return F.when((file != "") & types.extension(u["path"]).isin(ASSETS), F.array_distinct(F.array(u["path"], F.concat(F.lit("/"), file)))).otherwise(F.array().cast("array<string>"))

    return urls._of(url, named)


def scope(url: Column | urls.Parts) -> Column:
    """The path below which a page's navigation stays: its folder, or itself if it has no extension; null for the whole origin."""
    def of(u: urls.Parts) -> Column:
        p = u["path"]
        folder = F.regexp_replace(p, "/[^/]*$", "")
        found = F.when(p.endswith("/") | (types.extension(p) != ""), folder).otherwise(p)
        return F.when(~found.isin("", "/"), found)

    return urls._of(url, of)


def is_in_scope(url: Column, source: Column) -> Column:
    """Whether a page may be crawled from ``source``: same origin, at or below its scope."""
    def within(u: urls.Parts) -> Column:
        def of(s: urls.Parts) -> Column:
            below = urls.let(F.struct(scope(s).alias("s")), lambda x: x["s"].isNull() | (u["path"] == x["s"]) | u["path"].startswith(F.concat(x["s"], F.lit("/"))))
            return (urls.origin(u) == urls.origin(s)) & below

        return urls._of(source, of)

    return F.coalesce(urls._of(url, within), F.lit(False))


def route(text: Column) -> Column:
    """The path and query of a preview's route, leading slashes as one; null for one that leaves the root or names another host."""
    t = F.regexp_replace(_trimmed(text), "^/+", "/")

    def of(u: urls.Parts) -> Column:
        plain = urls.decoded(u["path"])
        bad = plain.rlike(r"\\|\x00|(^|/)\.\.?(/|$)") | (u["fragment"] != "") | (urls.origin(u) != "https://nowhere.invalid") | ~u["web"]
        return F.when(~bad, F.concat(u["path"], urls.search(u)))

    hashed = F.when(t.contains("#"), F.lit(None).cast("string")).otherwise(t)
    return F.when(hashed.isNotNull(), urls._of(urls.joined(hashed, F.lit(NOWHERE)), of))
