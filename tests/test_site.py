"""Sites: localisation, discovery, templates, inventories, routes, closures and crawls against plain Python and by hand."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.operators import closure, localise, routes, templates

PAGE = """<!DOCTYPE html><base target=x><!-- <a href="/k.png"> --><html><head><link rel=stylesheet href="/k.css" integrity="sha"><style>p{background:url( "/k.png" )} /* url(/k.png) */ q{content:"url(/k.png)"} @import 'k.css'; @import url(/k.css);</style><script src='/k.js'>var a="<a href='/k.png'>"</script></head>
<body style="background:url(&quot;/k.png&quot;)"><img src=/k.png srcset="/k.png 1x, /n.png 2x,/k.css" alt="src=/k.png"><a title='x href="/k.png"' href="/k.png#a&amp;b">t</a><a href="#x">u</a><meta http-equiv=refresh content="5; url=/k.css"><textarea><img src="/k.png"></textarea><p data=/k.png><a href>"""
WANTED = """<!DOCTYPE html><base target=x><!-- <a href="/k.png"> --><html><head><link rel=stylesheet href="../k.css"><style>p{background:url( "/k.png" )} /* url(/k.png) */ q{content:"url(/k.png)"} @import 'k.css'; @import url(/k.css);</style><script src='../k.js'>var a="<a href='/k.png'>"</script></head>
<body style="background:url(&quot;/k.png&quot;)"><img src=../k.png srcset="../k.png 1x, /n.png 2x,../k.css" alt="src=/k.png"><a title='x href="/k.png"' href="../k.png#a&amp;b">t</a><a href="#x">u</a><meta http-equiv=refresh content="5; url=../k.css"><textarea><img src="/k.png"></textarea><p data=/k.png><a href>"""
SHEET = """@import "k.css"; a{b:url(../k.png)} /* url(/k.png) */ c{d:"url(/k.png)"; e:url('/n.png#z'); f:url(/k.png#a&b)}"""
KNOWN = [("https://e.com/k.png", "site/k.png"), ("https://e.com/k.css", "site/k.css"), ("https://e.com/k.js", "site/k.js"), ("https://e.com/c/k.css", "site/c/k.css")]


@pytest.fixture(scope="module")
def files(spark):
    based = '<base href="https://e.com/c/"><a href="k.css">x</a>'
    rows = [
        (1, "https://e.com/d/p", "site/d/p.html", "html", PAGE), (2, "https://e.com/c/a.css", "site/c/a.css", "css", SHEET), (3, "https://e.com/x", "site/x", None, "<a href=/k.png>"), (4, "https://e.com/y", "site/y", "html", None),
        (5, "https://e.com/z", "site/z.html", "html", ""), (6, "https://e.com/b/q", "site/b/q.html", "html", based), (7, "https://e.com/l", "site/l.html", "html", '<a href="/k.png">' * 4000),
    ]
    return spark.createDataFrame(rows, "file int, url string, local_path string, type string, text string").repartition(3)


def test_localised(spark, files):
    known = spark.createDataFrame(KNOWN, "target string, to string")
    found = {r["file"]: r for r in localise.localised(files, known).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5, 6, 7]
    assert found[1]["text"] == WANTED and found[1]["online"] == ["https://e.com/d/k.css", "https://e.com/n.png"]
    assert found[2]["text"] == SHEET.replace("url(/k.png#a&b)", "url(../k.png#a&b)") and found[2]["n_local"] == 3
    assert found[3]["text"] == "<a href=/k.png>" and not found[3]["changed"]
    assert found[4]["text"] is None and found[4]["sha256"] is None and found[5]["text"] == "" and found[5]["size"] == 0
    assert found[6]["text"] == '<base><a href="../c/k.css">x</a>'
    assert found[7]["text"] == '<a href="k.png">' * 4000
    for r in found.values():
        if r["text"] is not None:
            assert r["size"] == len(r["text"].encode()) and r["sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert localise.localised(files.where("file < 0"), known).count() == 0
    assert not any(r["changed"] for r in localise.localised(files.where("file in (1, 3, 5)").withColumn("text", F.replace("text", F.lit(' integrity="sha"'), F.lit(""))), known.where("false")).collect())


def test_discovered(spark):
    """A file's text is the URL that must be known and the one that it then names."""
    rows = [
        ("a", "javascript", "seed>n1"), ("b", "json", "n1>n2"), ("c", "css", "n2>n3"), ("c2", "css", "n4>n5"), ("d", "html", "n3>n4"), ("e", "html", "n3>n4"), ("e2", "html", "n4>n6"), ("e3", "html", "n1>seed"), ("f", "odd", "seed>x"), ("g", "css", None), ("h", "css", "seed>" + "y" * 50),
    ]
    files = spark.createDataFrame(rows, "file string, type string, text string").withColumns({"url": F.lit("u"), "local_path": F.lit("x")})

    def named(stage, part, known):
        split = part.select("file", F.split_part("text", F.lit(">"), F.lit(1)).alias("url"), F.split_part("text", F.lit(">"), F.lit(2)).alias("target"))
        return split.join(known, "url").select("file", "target")

    found, left = localise.discovered(files, spark.createDataFrame([("seed",), ("seed",)], "url string"), named, most_bytes=20)
    assert sorted(map(tuple, found.collect())) == [("n1", 0, "a"), ("n2", 1, "b"), ("n3", 2, "c"), ("n4", 3, "d")]
    assert sorted(map(tuple, left.collect())) == [("f", "no type"), ("g", "no text"), ("h", "too large")]


# --- templates -----------------------------------------------------------------------------------------------------------

TEMPLATES = ["/{a}/{b}.png", "/x/{a}-{b}-{a}.png", "{a}/y.png", "img/{n}.png?v={v}", "https://e.com/{a}/z", "//{host}/x/{a}.png", "/{a}.{a}", "plain.png", "/{a}/{b c}", None, "/{a}/q{b}", "{a}"]
OBSERVED = ["https://e.com/x/1-2-1.png", "https://e.com/x/1-2-3.png", "https://e.com/x/1-1-1-1-1.png", "https://e.com/d/img/7.png?v=3", "https://e.com/d/img/7.png", "https://f.net/q/y.png", "https://e.com/w/z", "https://e.com/a.a", "https://e.com/a.b", "https://e.com/", "mailto:x", None, "https://e.com/x/é.png", "https://e.com/a.a.a.a", "https://e.com/x/1-2-1.png"]


def brute(template, url):
    """All bases and bindings, by trying each tail."""
    if not template or re.search(r"\s", template) or not re.search(r"\{[A-Za-z]\w*\}", template):
        return
    names, pattern = [], ""
    for piece in re.findall(r"\{[A-Za-z][A-Za-z0-9_]*\}|\{|[^{]+", template):
        if re.fullmatch(r"\{[A-Za-z][A-Za-z0-9_]*\}", piece):
            pattern += f"(?:\\{names.index(piece) + 1})" if piece in names else r"([A-Za-z0-9_.\-]{1,64}?)"
            names += [] if piece in names else [piece]
        else:
            pattern += re.escape(piece)
    o, path, search = re.fullmatch(r"(https?://[^/]+)([^?]*)(.*)", url).groups()
    path = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path)
    if template.startswith("http"):
        tails = [(f"{o}/", o + path)]
    elif template.startswith("//"):
        tails = [(f"{o}/", o.split(":", 1)[1] + path)]
    elif template.startswith("/"):
        tails = [(f"{o}/", path)]
    else:
        inner = path.lstrip("/")
        starts = [0] + [i + 1 for i, c in enumerate(inner) if c == "/" and i + 1 < len(inner)]
        tails = [(f"{o}/{inner[:s]}", inner[s:]) for s in starts]
    for base, tail in tails:
        m = re.fullmatch(pattern, tail + (search if "?" in template else ""))
        if m:
            yield base, dict(zip([n[1:-1] for n in names], m.groups(), strict=True))


def test_templates(spark):
    t, o = spark.createDataFrame([(x,) for x in TEMPLATES], "template string"), spark.createDataFrame([(x,) for x in OBSERVED], "url string")
    found = sorted((r["template"], r["url"], r["base"], sorted(r["bound"].items())) for r in templates.matches(t, o).collect())
    want = sorted((x, u, base, sorted(bound.items())) for x in TEMPLATES for u in {u for u in OBSERVED if u and u.startswith("http")} for base, bound in brute(x, u))
    assert found == want and len(want) > 12
    assert templates.matches(t, o.where("false")).count() == 0 and templates.matches(t.where("false"), o).count() == 0


def test_inventories(spark):
    observed = spark.createDataFrame([("https://e.com/a/x.bin",), ("https://e.com/a/y.bin?q=1",), ("https://e.com/b/x.bin",), ("https://e.com/b/z.bin",), ("https://e.com/d/e/f.bin",), ("https://e.com/d/g.bin",)], "url string")
    records = [(1, "x.bin"), (1, "y.bin"), (1, "w.bin"), (1, "x.bin"), (2, "x.bin"), (3, "x.bin"), (3, "y.bin"), (3, "z.bin"), (4, "./e/f.bin"), (4, "g.bin"), (4, "h.bin?token=1"), (5, None), (5, "")]
    records = spark.createDataFrame(records, "inventory int, file string")
    assert sorted(map(tuple, templates.inventory_bases(records, observed).collect())) == [(1, "https://e.com/a/", 2), (4, "https://e.com/d/", 2)]
    assert sorted(map(tuple, templates.inventory_references(records, observed).collect())) == [(1, f"https://e.com/a/{x}.bin") for x in "wxy"] + [(4, "https://e.com/d/e/f.bin"), (4, "https://e.com/d/g.bin")]


# --- routes --------------------------------------------------------------------------------------------------------------


def test_aliases(spark):
    rows = [
        ("j", 1, "https://e.com/app/", "site/app/index.html", "downloaded", True), ("j", 2, "https://e.com/app/", "site/other.html", "downloaded", True),
        ("j", 3, "https://cdn.net/lib.js", "site/_external/https/cdn.net/lib.js", "downloaded", False), ("j", 4, "https://b.net/lib.js", "site/_external/https/b.net/lib.js", "downloaded", False),
        ("j", 5, "https://s.net/my.bucket/a.png?x", "site/_external/https/s.net/my.bucket/a~q-1.png", "downloaded", False), ("j", 6, "https://e.com/i/a~b.png", "site/i/a~7eb.png", "downloaded", False),
        ("j", 7, "https://e.com/app/in.js", "site/app/in.js", "downloaded", False), ("j", 8, "https://e.com/gone.js", "site/gone.js", "failed", False), ("j", 9, "https://d.net/gone.js", "site/_external/https/d.net/gone.js", "downloaded", False),
        ("j", 10, "data:x", None, "downloaded", False), ("j", 11, None, None, "failed", None), ("k", 1, "https://e.com/app/in.js", "site/_external/https/e.com/app/in.js", "pending", False),
    ]
    resources = spark.createDataFrame(rows, "job string, seq long, url string, local_path string, status string, html boolean")
    sources = spark.createDataFrame([("j", "https://e.com/app/"), ("k", "https://k.org/")], "job string, url string")
    found, lost = routes.aliases(resources, sources)
    got = {(r["job"], r["route"]): (r["path"], r["kind"]) for r in found.collect()}
    assert got[("j", "/app/")] == ("app/index.html", "page")
    assert ("j", "/lib.js") not in got and ("j", "/gone.js") not in got  # two files; a route of the source's own
    assert got[("j", "/my.bucket/a.png?x")][1] == got[("j", "/a.png?x")][1] == "external"
    assert got[("j", "/i/a7eb.png")] == ("i/a~7eb.png", "spelling")
    assert got[("j", "/app/i/a~b.png")] == ("i/a~7eb.png", "prefixed") and ("j", "/app/app/in.js") not in got
    assert {tuple(r) for r in lost.collect()} == {("j", "external", 1)}
    gone = {tuple(r) for r in routes.unavailable_routes(resources, sources).collect()}
    assert gone == {("j", "/gone.js"), ("j", "/app/gone.js"), ("k", "/app/in.js")}


# --- closures and crawls -------------------------------------------------------------------------------------------------


def test_bounded_closure(spark):
    rng = random.Random(4)
    edges = {(f"n{rng.randrange(30):02}", f"n{rng.randrange(40):02}", False) for _ in range(60)} | {(f"n{rng.randrange(30):02}", f"i{rng.randrange(30):02}", True) for _ in range(50)} | {("n00", None, False), (None, "n01", False)}
    frame = spark.createDataFrame(list(edges), "from_url string, to_url string, leaf boolean")
    seeds = spark.createDataFrame([("n00",), ("n01",), ("n00",), (None,)], "url string")
    for rounds, most in ((3, None), (10, None), (3, 12), (2, 4), (0, 1), (4, 30)):
        seen, leaves, new, over = {}, {}, {"n00", "n01"}, 0
        new = set(sorted(new)[:most])
        seen.update(dict.fromkeys(new, 0))
        for n in range(1, rounds + 1):
            found = {}
            for a, b, leaf in edges:
                if a in new and b is not None and b not in seen:
                    found[b] = found.get(b, True) and leaf
            for u in (u for u, leaf in found.items() if leaf):
                leaves.setdefault(u, n)
            inner = sorted(u for u, leaf in found.items() if not leaf)
            kept = inner if most is None else inner[: max(most - len(seen), 0)]
            over += len(inner) - len(kept)
            new = set(kept)
            seen.update(dict.fromkeys(kept, n))
            if not new:
                break
        late = {b for a, b, leaf in edges if a in new and b is not None and not leaf and b not in seen} if n == rounds or rounds == 0 else set()
        order = sorted((n, u) for u, n in leaves.items() if u not in seen)
        taken = order if most is None else order[: max(most - len(seen), 0)]
        want = [(u, n, False) for u, n in seen.items()] + [(u, n, True) for n, u in taken]
        got, left = closure.bounded_closure(seeds, frame, rounds, most)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        if rounds:
            assert dict(map(tuple, left.collect())) == {"limit": over, "deferred": len(order) - len(taken), "rounds": len(late)}


def test_crawl(spark):
    rng = random.Random(9)
    place = lambda: rng.choice([f"https://{h}/{rng.randrange(40):02}" for h in ("a.com", "b.com")])
    links = [(place(), place()) for _ in range(160)] + [(f"https://{h}/", place()) for h in ("a.com", "b.com") for _ in range(4)] + [("https://a.com/", None), (None, "https://a.com/01")]
    frame, sources = spark.createDataFrame(links, "from_url string, to_url string"), [("x", "https://a.com/"), ("y", "https://b.com/"), ("z", "https://none.com/")]
    for pages, width in ((5, 1), (9, 4), (100, 3), (0, 2)):
        want, told = [], {}
        for job, source in sources:
            seen, shut, queue, n = {source}, set(), [], 0
            at = source
            while at is not None:
                for a, b in links:
                    if a == at and b is not None and a != b:
                        if not b.startswith(source):
                            shut.add(b)
                        elif b not in seen:
                            seen.add(b)
                            queue.append(b)
                queue.sort()
                at = queue.pop(0) if queue and n < pages else None
                if at is not None:
                    n += 1
                    want.append((job, at, n))
            told[job] = (len(queue), len(shut))
        visited, rest = closure.crawl(spark.createDataFrame(sources, "job string, url string"), frame, pages, width)
        assert sorted(map(tuple, visited.collect())) == sorted(want)
        assert {r["job"]: (r["n_waiting"], r["n_excluded"]) for r in rest.collect()} == told
