"""Queries of types, shapes, texts and reuse rules: golden rows worked out by hand, and some over the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards, kinds, reuse, shapes, texts, types, urls
from .fixtures import Literal
from .queries import golden, pages, query

golden("extension_types", Literal("path string, known string, result string", (
    ("site/a.MJS", None, "application/javascript; charset=utf-8"), ("site/a", None, "application/octet-stream"), ("x/y.svg", None, "image/svg+xml"), ("x/y.svg", "text/plain", "text/plain"), ("x/.css", None, "application/octet-stream"), ("a.b/c", None, "application/octet-stream"),
)), "result", lambda c: types.type_for(c("path"), c("known")))

golden("type_extensions", Literal("content_type string, result string", (
    ("Text/HTML; charset=utf-8", ".html"), ("image/jpeg", ".jpg"), ("image/tiff", None), (None, None), ("  application/json ", ".json"), ("", None), ("text/javascript", ".js"),
)), "result", lambda c: types.extension_for(c("content_type")))

golden("path_kinds", Literal("path string, result string", (
    ("a/b.js", "script"), ("a/b.glb", "model"), ("a/b.pdf", "binary"), ("a/b.bin", None), ("a/b", None), ("a/b.GLSL", "text"), ("a/b.ico", "image"), ("a/b.map", "structured"), ("a/b.htm", "document"),
)), "result", lambda c: types.strong_kind_by_path(c("path")))

golden("expected_kinds", Literal("resource_type string, path string, content_type string, result string", (
    ("Document", "a/b.pdf", "text/html", "binary"), ("Document", "a/b", "text/html", "document"), ("document", "a/b", "image/png", "image"), ("Worker", "a/b", None, "script"), ("XHR", "a/b.json", "text/plain", "structured"),
    (None, "a/b.bin", "model/gltf-binary", "model"), (None, "a/b.bin", None, "binary"), ("Other", "a/b", None, "unknown"), ("TextTrack", "a/b.js", None, "text"), ("Manifest", "a/b", None, "structured"),
)), "result", lambda c: types.expected_kind(c("resource_type"), c("path"), c("content_type")))

golden("preferred_types", Literal("expected string, path string, expected_type string, declared string, result string", (
    ("image", "a.png", None, "application/octet-stream", "image/png"), ("script", "a.js", "text/javascript", "text/plain", "text/javascript"), ("image", "a.png", "image/webp", "image/gif", "image/gif"),
    ("unknown", "a", None, None, "application/octet-stream"), ("font", "a.woff", None, "text/plain", "text/plain"),
)), "result", lambda c: types.preferred_type(c("expected"), c("path"), c("expected_type"), c("declared")))

golden("body_verdicts", Literal("expected string, declared string, body string, result string", (
    ("script", "text/javascript", "<!DOCTYPE html><p>", "html"), ("script", "image/png", "x", "mismatch"), ("script", "text/plain", "x = 1", "ok"), ("document", "image/png", "<html>", "ok"), ("unknown", "text/css", "<html>", "ok"),
    ("image", "application/x-thing", "GIF", "ok"), ("font", "text/css", "a{}", "mismatch"),
)), "result", lambda c: types.body_verdict(c("expected"), c("declared"), c("body")))

golden("page_fallbacks", Literal("method string, accept string, destination string, path string, result boolean", (
    ("GET", "text/html,*/*", "document", "/a/b", True), ("GET", "text/html", None, "/a/b.js?x", False), ("POST", "text/html", "document", "/a", False), ("HEAD", "TEXT/HTML", " iframe", "/a.page", True),
    ("GET", "*/*", "document", "/a", False), ("GET", "text/html", "image", "/a", False), ("GET", None, None, "/a", False),
)), "result", lambda c: types.falls_back_to_page(c("method"), c("accept"), c("destination"), c("path")))

golden("neutral_answers", Literal("method string, accept string, destination string, path string, result string", (
    ("GET", "text/html", "document", "/a", "page"), ("GET", "*/*", "empty", "/api/x", "data"), ("GET", "application/json", None, "/x.json", "data"), ("GET", "*/*", "script", "/x.mjs", "script"), ("GET", "*/*", "style", "/x.css", "style"),
    ("GET", "*/*", "track", "/x.vtt", "webvtt"), ("GET", "*/*", "image", "/x.PNG?v=1", "image"), ("GET", "*/*", "video", "/x.mp4", "nothing"), ("GET", "*/*", "empty", "/x.css", "style"), ("GET", "*/*", "manifest", "/m.webmanifest", "data"),
)), "result", lambda c: types.neutral_answer(c("method"), c("accept"), c("destination"), c("path")))

golden("html_resources", Literal("resource_type string, content_type string, path string, result boolean", (
    ("Document", "text/html", "/a", True), ("Image", "text/html", "/a", False), (None, None, "/a/b.html", True), (None, "text/html", "/a.js", False), (None, None, "/a", False), ("Other", "application/xhtml+xml; x", "/a", True),
)), "result", lambda c: types.is_html(c("resource_type"), c("content_type"), c("path")))

golden("asset_shapes", Literal("value string, spaces boolean, result boolean", (
    ("img/a.png", False, True), ("img/my a.png", False, False), ("img/my a.png", True, True), (".png", False, False), ("a.page", False, False), ("data:image/png;base64,x", False, False), ("https://e.com/x.GLB?v=2", False, True),
    ("  /a/b.js ", False, True), ("a\tb.js", True, False), ("", False, False), ("/a/b", False, False), ("mailto:a@e.js", False, False),
)), "result", lambda c: F.when(c("spaces"), shapes.is_asset(c("value"), spaces=True)).otherwise(shapes.is_asset(c("value"))))

golden("url_shapes", Literal("value string, result string", (
    ("HTTP://e.com", "url"), ("./a", "url"), ("a/b", "url bare"), ("a b/c", "bare"), ("#top", "bare"), ("word", "bare"), ("//cdn", "url"), ("", "bare"), ("../x", "url"),
)), "result", lambda c: F.concat_ws(" ", F.when(shapes.has_url_shape(c("value")), "url"), F.when(shapes.is_bare_path(F.lower(c("value"))), "bare")))

golden("path_alias_keys", Literal("url string, result string", (
    ("https://e.com/a/b/logo.png?x=1", "/a/b/logo.png /logo.png"), ("https://e.com/logo.png", "/logo.png"), ("https://e.com/a/b", ""), ("https://e.com/a/", ""),
)), "result", lambda c: F.array_join(shapes.path_aliases(c("url")), " "))

golden("crawl_scope", Literal("source string, url string, result boolean", (
    ("https://e.com/docs/index.html", "https://e.com/docs/a", True), ("https://e.com/docs/index.html", "https://e.com/blog", False), ("https://e.com/docs", "https://e.com/docs", True), ("https://e.com/docs", "https://e.com/docs2", False),
    ("https://e.com/", "https://e.com/x", True), ("https://e.com/", "https://f.com/x", False), ("https://e.com/docs/", "https://e.com/docs", True), ("https://e.com/page.html", "https://e.com/z", True),
)), "result", lambda c: shapes.is_in_scope(c("url"), c("source")))

golden("preview_routes", Literal("value string, result string", (
    ("//a/b?x=1", "/a/b?x=1"), ("/a/%2e%2e/b", "/b"), ("/a/..%2fb", None), ("https://e.com/a", None), ("/a#b", None), ("a/b", "/a/b"), ("/a%5cb", None),
)), "result", lambda c: shapes.route(c("value")))

golden("fingerprints", Literal("value string, result string", (
    ("", "6b277641c38404a2bfe41f333909b4eb"), ("hello", "63509ba027866858141ab1e6219b2bcb"),
)), "result", lambda c: texts.fingerprint(c("value"), "key"))

golden("shown_texts", Literal("value string, result string", (
    ("  two\n lines\t here ", "two lines here"), ("password = x y", "password = REDACTED y"), ("a" * 2001, "a" * 2000 + "..."), ("", ""),
)), "result", lambda c: texts.shown(c("value")))

golden("escapes", Literal("value string, html string, css string, result string", (
    ("<a href=\"x\">&'", "&lt;a href=&quot;x&quot;&gt;&amp;&#39;", "<a href=\\\"x\\\">&'", "\\u003ca href=\"x\">&'"), ("a\\b", "a\\b", "a\\\\b", "a\\b"),
)), "result", lambda c: F.when((texts.html_escaped(c("value")) == c("html")) & (texts.css_escaped(c("value")) == c("css")), texts.script_json_escaped(c("value"))))

golden("sizes_shown", Literal("n long, ms long, result string", (
    (0, 0, "0 B 0:00"), (1023, 61000, "1023 B 1:01"), (1536, 59999, "1.5 KB 0:59"), (10485760, 3600000, "10 MB 60:00"), (5368709120, -5, "5.0 GB 0:00"), (None, 1000, "0 B 0:01"),
)), "result", lambda c: F.concat_ws(" ", texts.size_shown(c("n")), texts.elapsed_shown(c("ms"))))

golden("base64_texts", Literal("value string, result boolean", (
    ("aGVsbG8=", True), ("aGVsbG8", False), ("aGVsbG9=", False), ("", True), ("a-b_", False), ("aGVs\nbG8=", False), (None, False),
)), "result", lambda c: texts.is_base64(c("value")))

golden("output_folders", Literal("url string, job string, made timestamp, result string", (
    ("https://www.e.com:8443/a", "job_1234567890abc", "2026-01-02 03:04:05", "www.e.com-20260102T030405Z-job_12345678"), ("x", "//", "2026-01-02 03:04:05", "site-20260102T030405Z-job"),
)), "result", lambda c: texts.output_folder(c("url"), c("job"), c("made")))

golden("texture_families", Literal("names string, result string", (
    ("WEBGL_compressed_texture_s3tc WEBKIT_WEBGL_compressed_texture_s3tc EXT_texture_compression_bptc OES_x", "bptc s3tc"), ("", ""), ("webgl_compressed_texture_etc1 WEBGL_compressed_texture_etc", "etc etc1"),
)), "result", lambda c: F.array_join(texts.texture_families(F.split(c("names"), " ")), " "))

golden("cache_predicates", Literal("cache_control string, vary string, result string", (
    ("private, max-age=1", None, "private public"), ("Public", "Accept, Cookie", "public varies"), ("no-cache", "*", "varies"), (None, None, ""), ("max-age=5\r\nno-store", "accept", "private public"), ("xprivate", "cookies", ""),
)), "result", lambda c: F.concat_ws(" ", F.when(reuse.is_private(c("cache_control")), "private"), F.when(reuse.is_public(c("cache_control")), "public"), F.when(reuse.varies_by_credential(c("vary")), "varies")))

golden("static_types", Literal("url string, result string", (
    ("https://e.com/a.js", "Script"), ("https://e.com/a/api/x.js", None), ("https://e.com/a%70i/x.js", None), ("https://e.com/apis/x.js", "Script"), ("https://e.com/a.bin?token=1", None), ("https://e.com/a.bin?v=1", "Fetch"), ("https://e.com/a.html", None),
    ("https://www.google-analytics.com/a.js", None), ("https://e.com/x.webmanifest", "Manifest"), ("https://e.com/x.vtt", "TextTrack"), ("ftp://e.com/x.js", None), ("https://e.com/.js", None),
)), "result", lambda c: reuse.static_resource_type(c("url")))

_PRIVACY = "request_extra response_extra has_cookie has_authorization has_set_cookie private_or_no_store varies_by_credential cookie_policy_affected ambiguous".split()
_BODY = {  # a public script of another origin; the rows say what differs
    "url": "https://cdn.net/a.js", "method": "GET", "resource_type": "Script", "status": 200, "redirect_index": 0, "mime_type": "text/javascript", "cache_control": None, "acao": None, "state": "discovered",
    "initiator": "parser", "p_status": 200, "cached": False, **dict.fromkeys(_PRIVACY, False), "request_extra": True, "response_extra": True,
}
_BODIES = [
    ({}, "public_cross_origin", False, False), ({"url": "https://e.com/a.js"}, "same_origin", False, True), ({"url": "https://e.com/a", "resource_type": "XHR"}, None, False, False), ({"status": 304, "p_status": 304}, None, False, False),
    ({"has_cookie": True}, None, False, False), ({"request_extra": False}, None, False, False), ({"request_extra": False, "cache_control": "public", "acao": "*"}, "public_cross_origin", False, False), ({"url": "http://cdn.net/a.js"}, None, False, False),
    ({"cached": True}, None, False, False), ({"redirect_index": 1}, None, False, False), ({"resource_type": "Fetch", "cache_control": "max-age=9"}, "public_cross_origin", False, False), ({"resource_type": "Fetch"}, None, False, False),
    ({"initiator": "performance"}, "public_cross_origin", True, False), ({"initiator": "performance", "resource_type": "Image"}, "public_cross_origin", False, False), ({"url": "https://e.com/a.js", "p_status": 500, "status": None}, None, False, False),
    ({"url": "https://e.com/a.js", "status": None, "p_status": None}, None, False, True), ({"url": "https://e.com/a.js", "has_set_cookie": True}, "same_origin", False, False), ({"method": "POST"}, None, False, False), ({"p_status": 206}, None, False, False),
]
_KINDS = {"status": "long", "p_status": "long", "redirect_index": "long", "cached": "boolean", **dict.fromkeys(_PRIVACY, "boolean")}
_REUSE = Literal(
    "row long, " + ", ".join(f"{k} {_KINDS.get(k, 'string')}" for k in _BODY) + ", scope string, historical boolean, incomplete boolean",
    tuple((i, *({**_BODY, **d}[k] for k in _BODY), *rest) for i, (d, *rest) in enumerate(_BODIES)),
)


@query("body_reuse", f"SELECT row, scope, historical, incomplete FROM {_REUSE.sql()} t")
def body_reuse(spark, _):
    rows = _REUSE.frame(spark)
    headers = F.map_from_entries(F.filter(F.array(F.struct(F.lit("Cache-Control").alias("k"), F.col("cache_control").alias("v")), F.struct(F.lit("access-control-allow-origin").alias("k"), F.col("acao").alias("v"))), lambda x: x["v"].isNotNull()))
    made = {
        "privacy": F.struct(*_PRIVACY, F.col("p_status").alias("status")), "response_headers": headers, "request_headers": F.create_map().cast("map<string,string>"), "has_set_cookie": F.lit(False),
        "from_disk_cache": F.col("cached"), "from_prefetch_cache": F.lit(False), "from_service_worker": F.lit(None).cast("boolean"),
    }
    c, own = (lambda n: made.get(n, F.col(n))), F.lit("https://e.com")
    return rows.select("row", reuse.scope(c, own).alias("scope"), reuse.is_historical_candidate(c).alias("historical"), reuse.is_incomplete_candidate(c, own).alias("incomplete"))


@query("request_evidence", """SELECT * FROM (VALUES (1::BIGINT, true, false, true, false, true, false), (2, false, true, false, true, false, true), (3, true, false, false, false, false, false)) t(row, has_cookie, has_authorization, has_set_cookie, private_or_no_store, varies_by_credential, cookie_policy_affected)""")
def request_evidence(spark, _):
    rows = spark.createDataFrame([
        (1, {"Cookie": "a"}, None, {"Set-Cookie": "b", "VARY": "Cookie"}, 0, 0), (2, {"AUTHORIZATION": "x"}, [(["blocked"],)], {"cache-control": "no-store"}, 1, 0), (3, {}, [(["x"],), ([],)], {"accept": "*"}, None, None),
    ], "row long, headers map<string,string>, cookies array<struct<blocked:array<string>>>, response map<string,string>, blocked int, exempted int")
    q, r = reuse.request_privacy(F.col("headers"), F.col("cookies")), reuse.response_privacy(F.col("response"), F.col("blocked"), F.col("exempted"))
    return rows.select("row", q.alias("q"), r.alias("r")).select("row", "q.*", "r.*")


@query("page_scopes", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS origin, CASE WHEN regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) END AS path FROM pages),
s AS (SELECT *, CASE WHEN path LIKE '%/' OR regexp_matches(path, '[^/]\.[^./]*$') THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS scope FROM p)
SELECT page_id, CASE WHEN scope IN ('', '/') THEN NULL ELSE scope END AS scope FROM s""".replace("\\\\", "\\"))
def page_scopes(spark, d):
    return pages(spark, d).select("page_id", shapes.scope(F.col("url")).alias("scope"))


@query("page_kinds", """SELECT page_id, 'document' AS kind, regexp_matches(substr(html, 1, 8192), '(?is)^\\s*(?:<!--.{0,512}?-->\\s*)*<(?:!doctype\\s+html|html|head|body)\\b') AS is_page FROM pages""".replace("\\\\", "\\"))
def page_kinds(spark, d):
    return pages(spark, d).select("page_id", types.expected_kind(F.lit("Document"), urls.path(F.col("url")), F.lit("text/html")).alias("kind"), kinds.starts_with_html(F.col("html")).alias("is_page"))


_GUARD = {"jobId": guards.Field("string", r"^[a-z0-9-]{1,64}$"), "count": guards.Field("long", least=0, most=1500), "deep": guards.Field("boolean", required=False)}
golden("guarded_messages", Literal("json string, result string", (
    ('{"jobId":"a-1","count":3}', ""), ('{"jobId":"a-1","count":3,"deep":true}', ""), ('{"jobId":"A","count":1501,"x":1}', "invalid:count invalid:jobId unknown:x"), ('{"deep":"yes"}', "invalid:deep missing:count missing:jobId"), ("[1]", "not_an_object"), ("no json", "not_an_object"), (None, "not_an_object"),
    ('{"jobId":1,"count":"3"}', "invalid:count invalid:jobId"), ('{"jobId":"a","count":1.5}', "invalid:count"),
)), "result", lambda c: F.array_join(guards.problems(c("json"), _GUARD), " "))

golden("guarded_actions", Literal("json string, result string", (
    ('[{"id":"a","type":"click","selector":"#x"},{"id":"b","type":"wait","ms":5}]', ""), ('[{"id":"a","type":"click"},{"id":"a","type":"fly"}]', "repeated_id unknown_type missing_field"), ("{}", "not_a_list"), ("[]", ""),
    ("[" + ",".join('{"id":"%d","type":"scroll","y":1}' % k for k in range(33)) + "]", "too_many"),
)), "result", lambda c: F.array_join(guards.action_list_problems(c("json")), " "))
