"""Texts for reports: escapes, sizes, and names that give nothing away."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import redact, urls

MOST_FINGERPRINTED, MOST_SHOWN = 65536, 2000


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hex of UTF-8 text; the key is at most 64 bytes."""
    raw = key.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in raw) for x in (0x36, 0x5C))
    digest = F.sha2(F.concat(F.lit(inner), F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def fingerprint(text: Column, key: str) -> Column:
    """32 hex digits that tell equal texts from others, and nothing else: of the length and the first 65,536 characters, under a key."""
    return F.substring(_hmac(key, F.concat(F.length(text).cast("string"), F.lit("\0"), F.substring(text, 1, MOST_FINGERPRINTED))), 1, 32)


def anonymous_url(url: Column, key: str) -> Column:
    """A URL with fingerprints for its origin and for the rest; the fingerprint alone of what is none."""
    def of(u: urls.Parts) -> Column:
        rest = F.concat(u["path"], urls.search(u), u["fragment"])
        return F.when(u["host"] != "", F.concat(u["scheme"], F.lit("://origin-"), fingerprint(F.concat(u["scheme"], F.lit("://"), u["host"]), key), F.lit(".invalid/path-"), fingerprint(rest, key))).otherwise(fingerprint(url, key))

    return urls._of(url, of)


def shown(text: Column) -> Column:
    """A text fit for a report: on one line, without secrets, of at most 2,000 characters."""
    plain = F.trim(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), redact.S + "+", " "))
    return urls.let(redact.text(plain), lambda t: F.when(F.length(t) > MOST_SHOWN, F.concat(F.substring(t, 1, MOST_SHOWN), F.lit("..."))).otherwise(t))


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def html_escaped(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def css_escaped(text: Column, quote: str = '"') -> Column:
    """Fit to stand between quotes in a style sheet."""
    return _replaced(text, [("\\", "\\\\"), (quote, "\\" + quote), ("\r\n", "\\a "), ("\n", "\\a "), ("\r", "\\a ")])


def script_json_escaped(text: Column) -> Column:
    """JSON fit to stand in a script element."""
    return _replaced(text, [("<", "\\u003c"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")])


def size_shown(n: Column) -> Column:
    """Bytes as B, KB, MB or GB; one decimal below ten of the unit, none for bytes."""
    def unit(i: int) -> Column:
        v = n / 1024**i
        return F.concat(F.when((v >= 10) | F.lit(i == 0), F.format_string("%.0f", v.cast("double"))).otherwise(F.format_string("%.1f", v.cast("double"))), F.lit(" " + "B KB MB GB".split()[i]))

    return F.when(n.isNull() | (n <= 0), "0 B").when(n < 1024, unit(0)).when(n < 1024**2, unit(1)).when(n < 1024**3, unit(2)).otherwise(unit(3))


def elapsed_shown(ms: Column) -> Column:
    """Milliseconds as minutes and seconds."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def is_base64(text: Column, most_bytes: int = 512 * 1024) -> Column:
    """Whether a text is base64 in its one canonical spelling, of at most ``most_bytes``."""
    spelled = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.coalesce(spelled & (F.length(raw) <= most_bytes) & (F.replace(F.replace(F.base64(raw), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")) == text), F.lit(False))


def safe_part(text: Column, fallback: str) -> Column:
    """A part of a file name: what is not safe becomes a dash, none at the ends, at most 64 characters. Letters with marks are not taken apart."""
    plain = F.substring(F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", ""), 1, 64)
    return F.when(F.coalesce(plain, F.lit("")) == "", fallback).otherwise(plain)


def output_folder(url: Column, job: Column, at: Column) -> Column:
    """host-time-job: the folder of a job's output; ``at`` is a time in UTC."""
    stamp = F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
    return F.concat_ws("-", safe_part(urls.host(url), "site"), stamp, F.substring(safe_part(job, "job"), 1, 12))


# Compressed texture families by the names of their extensions.
TEXTURE_FAMILIES = {
    "webgl_compressed_texture_astc": "astc",
    "webkit_webgl_compressed_texture_astc": "astc",
    "webgl_compressed_texture_atc": "atc",
    "ext_texture_compression_bptc": "bptc",
    "webgl_compressed_texture_etc": "etc",
    "webgl_compressed_texture_es3_0": "etc",
    "webgl_compressed_texture_etc1": "etc1",
    "webgl_compressed_texture_pvrtc": "pvrtc",
    "webkit_webgl_compressed_texture_pvrtc": "pvrtc",
    "ext_texture_compression_rgtc": "rgtc",
    "webgl_compressed_texture_s3tc": "s3tc",
    "webkit_webgl_compressed_texture_s3tc": "s3tc",
    "moz_webgl_compressed_texture_s3tc": "s3tc",
    "webgl_compressed_texture_s3tc_srgb": "s3tc-srgb",
}


def texture_families(extensions: Column) -> Column:
    """The families of the first 128 names, of at most 128 characters each; distinct and sorted."""
    table = F.create_map(*[F.lit(x) for kv in TEXTURE_FAMILIES.items() for x in kv])
    named = F.transform(F.filter(F.slice(extensions, 1, 128), lambda e: F.length(e) <= 128), lambda e: F.try_element_at(table, F.lower(F.trim(e))))
    return F.array_sort(F.array_distinct(F.filter(named, lambda f: f.isNotNull())))
