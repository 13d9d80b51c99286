"""URL functions on columns, for http and https URLs, in the manner of browsers.

Spark's parse_url keeps case and empty paths, so it is not used. A URL is taken apart once, into a struct (:func:`parts`); every function takes a URL or
a :class:`Parts` of such a struct, so that a table with a column of parts is read without parsing anything again. Raw characters of paths and queries are percent-encoded, backslashes are slashes, ports above 65535
make no URL. Not covered: host names outside ASCII, which give null, and addresses in odd notations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import redact

URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]{2}([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: Around a URL, control characters and blanks don't count; inside it, tabs and line ends don't.
AROUND, WITHIN = r"^[\x00-\x20]+|[\x00-\x20]+$", r"[\t\n\r]"
#: Characters that are percent-encoded in a path, and in a query.
RAW_PATH, RAW_QUERY = r"[\x00-\x20\"<>`{}^\x7f]|[^\x00-\x7f]", r"[\x00-\x20\"<>'\x7f]|[^\x00-\x7f]"

# Query names that carry secrets, and endings of such names.
SENSITIVE_NAMES = (
    "accesskey accesstoken apikey auth authorization bearer clientsecret code codeverifier credential idtoken jwt key password passwd pwd "
    "refreshtoken secret session sessionid sid sig signature token"
).split()
SENSITIVE_ENDINGS = "(token|secret|password|signature|credential)$"

# File names that Windows reserves.
RESERVED = ["aux", "clock$", *(f"com{i}" for i in range(1, 10)), "con", *(f"lpt{i}" for i in range(1, 10)), "nul", "prn"]


def once(value: Column) -> Column:
    """``value``, computed once for each row where it stands: the optimizer copies no such expression into those that use it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _encoded(text: Column, raw: str) -> Column:
    spelled = lambda c: F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1")
    each = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), lambda c: F.when(c.rlike(raw), spelled(c)).otherwise(c))
    return F.when(text.rlike(raw), F.array_join(each, "")).otherwise(text)


def parts(url: Column) -> Column:
    """The struct of a URL: scheme and host in lower case, port (empty for the scheme's own), user, path without dot segments, query with its mark, fragment, web; null for null."""

    def taken(u: Column) -> Column:
        part = lambda n: F.coalesce(F.regexp_extract(u, URL, n), F.lit(""))
        return let(
            F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("at"), part(3).alias("path"), part(4).alias("query"), part(5).alias("fragment")),
            lambda x: let(F.struct(x.alias("x"), F.regexp_replace(x["at"], "^.*@", "").alias("place")), placed),
        )

    def placed(y: Column) -> Column:
        x = y["x"]
        given = F.regexp_replace(F.regexp_extract(y["place"], ":([0-9]+)$", 1), "^0+(?=[0-9])", "")
        own = F.when(x["scheme"] == "https", "443").otherwise("80")
        host = F.lower(F.regexp_extract(y["place"], r"^([^:\x00-\x20<>^|%\x7f-\x{10ffff}]*)(?::[0-9]*)?$", 1))
        user = F.when(x["at"].contains("@"), F.regexp_extract(x["at"], "^(.*)@", 1))
        web = x["scheme"].isin("http", "https") & (host != "") & user.isNull() & (F.coalesce(given.try_cast("int"), F.lit(80)) <= 65535)
        slashed = F.when(x["scheme"].isin("http", "https"), F.translate(x["path"], "\\", "/")).otherwise(x["path"])
        return F.struct(
            x["scheme"].alias("scheme"), host.alias("host"), F.when(given == own, "").otherwise(given).alias("port"), user.alias("user"),
            without_dots(_encoded(slashed, RAW_PATH)).alias("path"), _encoded(x["query"], RAW_QUERY).alias("query"), x["fragment"].alias("fragment"), F.coalesce(web, F.lit(False)).alias("web"),
        )

    return let(F.regexp_replace(F.regexp_replace(url, AROUND, ""), WITHIN, ""), taken)


class Parts:
    """A column of :func:`parts`; takes the place of a URL in the functions here."""

    def __init__(self, struct: Column):
        self.struct = struct

    def __getitem__(self, name: str) -> Column:
        return self.struct[name]


def _of(url: Column | Parts, body) -> Column:
    """``body`` of the URL's parts, which are made once."""
    return body(url) if isinstance(url, Parts) else let(parts(url), lambda s: body(Parts(s)))


def scheme(url: Column | Parts) -> Column:
    return _of(url, lambda u: u["scheme"])


def host(url: Column | Parts) -> Column:
    return _of(url, lambda u: u["host"])


def port(url: Column | Parts) -> Column:
    """The port if it is not the scheme's own, else an empty text."""
    return _of(url, lambda u: u["port"])


def has_credentials(url: Column | Parts) -> Column:
    return _of(url, lambda u: u["user"].isNotNull())


def is_web(url: Column | Parts) -> Column:
    """An http or https URL with a host and without credentials."""
    return F.coalesce(_of(url, lambda u: u["web"]), F.lit(False))


def _origin(u: Parts) -> Column:
    return F.concat(u["scheme"], F.lit("://"), u["host"], F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(""))


def origin(url: Column | Parts) -> Column:
    return _of(url, lambda u: F.when(u["web"], _origin(u)))


def without_dots(path: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments applied."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, p: F.when(F.lower(p).isin("..", ".%2e", "%2e.", "%2e%2e"), F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(F.lower(p).isin(".", "%2e"), out).otherwise(F.array_append(out, p)),
    )
    ends_open = F.lower(F.element_at(parts, -1)).isin(".", "..", "%2e", ".%2e", "%2e.", "%2e%2e")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(ends_open & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def path(url: Column | Parts) -> Column:
    return _of(url, lambda u: u["path"])


def search(url: Column | Parts) -> Column:
    """The query with its question mark; a lone question mark is none."""
    return _of(url, lambda u: F.when(u["query"] == "?", "").otherwise(u["query"]))


def fragment(url: Column | Parts) -> Column:
    return _of(url, lambda u: u["fragment"])


def canonical(url: Column | Parts) -> Column:
    """Lower-case scheme and host, no default port, no dot segments, no fragment; null for anything that is no web URL."""
    return _of(url, lambda u: F.when(u["web"], F.concat(_origin(u), u["path"], u["query"])))


def joined(ref: Column, base: Column | Parts) -> Column:
    """A reference put together with its base, without its fragment and not yet canonical."""

    def put(b: Parts) -> Column:
        def made(r: Column) -> Column:
            return (
                F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), r)
                .when(r.rlike(r"^[/\\]{2}"), F.concat(b["scheme"], F.lit(":"), r))
                .when(r.rlike(r"^[/\\]"), F.concat(_origin(b), r))
                .when(r == "", F.concat(_origin(b), b["path"], b["query"]))
                .when(r.startswith("?"), F.concat(_origin(b), b["path"], r))
                .otherwise(F.concat(_origin(b), F.regexp_replace(b["path"], "[^/]*$", ""), r))
            )

        return let(F.regexp_replace(F.regexp_replace(ref, AROUND, ""), "(?s)#.*$", ""), made)

    return _of(base, put)


def resolve(ref: Column, base: Column | Parts) -> Column:
    """A reference against a base, canonical; null for what is no web URL, such as mailto: or data:."""
    return canonical(joined(ref, base))


def decoded(text: Column) -> Column:
    """Percent-decoded; a text with broken escapes stays as it is. A plus sign is a plus sign."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def query_names(url: Column | Parts) -> Column:
    pairs = F.filter(F.split(F.regexp_replace(search(url), r"^\?", ""), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: decoded(F.replace(F.regexp_extract(p, "^([^=]*)", 1), F.lit("+"), F.lit(" "))))


def is_sensitive_name(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return plain.isin(SENSITIVE_NAMES) | plain.rlike(SENSITIVE_ENDINGS)


def has_sensitive_query(url: Column | Parts) -> Column:
    return F.exists(query_names(url), is_sensitive_name)


def redacted(url: Column) -> Column:
    """Credentials and the values of sensitive names are REDACTED, in the query and in the fragment; fragment routes stay. What is no URL is redacted as a text.

    A query with no sensitive name stays as it is. In one that has some, their second and later values are dropped. Values that stay are not encoded anew.
    """
    return let(parts(url), lambda s: F.when((s["scheme"] != "") & (s["host"] != ""), _redacted(Parts(s))).otherwise(redact.text(url)))


def _redacted(u: Parts) -> Column:
    pairs = F.split(F.regexp_replace(search(u), r"^\?", ""), "&")
    name = lambda p: decoded(F.replace(F.regexp_extract(p, "^([^=]*)", 1), F.lit("+"), F.lit(" ")))
    kept = F.filter(pairs, lambda p, i: ~is_sensitive_name(name(p)) | (F.array_position(F.transform(pairs, name), name(p)) == i + 1))
    shown = F.transform(kept, lambda p: F.when(is_sensitive_name(name(p)), F.concat(F.regexp_extract(p, "^([^=]*)", 1), F.lit("=REDACTED"))).otherwise(p))
    query = F.when(search(u) == "", "").when(has_sensitive_query(u), F.concat(F.lit("?"), F.array_join(shown, "&"))).otherwise(search(u))
    pieces = F.regexp_extract_all(u["fragment"], F.lit("(?s)[#?&;][^#?&;]*"), 0)
    hidden = F.transform(
        pieces,
        lambda p: F.when(p.rlike("^[#?&;][^=]+=") & is_sensitive_name(decoded(F.regexp_extract(p, "^[#?&;]([^=]*)=", 1))), F.concat(F.regexp_extract(p, "^([^=]*=)", 1), F.lit("REDACTED"))).otherwise(p),
    )
    user = F.when(u["user"].rlike("^[^:]+:.+"), "REDACTED:REDACTED@").when(u["user"].rlike("^[^:]+:?$"), "REDACTED@").otherwise("")
    with_port = F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise("")
    return F.concat(u["scheme"], F.lit("://"), user, u["host"], with_port, u["path"], query, F.array_join(hidden, ""))


def _digest(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def escaped_segment(segment: Column) -> Column:
    """A path segment as a file name that is safe everywhere and decodes to one segment only."""

    def spelled(c: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(F.hex(F.encode(c, "utf-8"))), "(..)", "~$1"), "~0([0-9a-f])", "~$1")

    def escaped(d: Column) -> Column:
        tail = F.length(d) - F.length(F.element_at(F.split(d, r"[/\\\\]", -1), -1))
        plain = lambda c, i: c.rlike(r"^[A-Za-z0-9_\-]$") | ((c == ".") & (i >= tail))
        return F.array_join(F.transform(F.regexp_extract_all(d, F.lit("(?s)."), 0), lambda c, i: F.when(plain(c, i), c).otherwise(spelled(c))), "")

    def named(d: Column) -> Column:
        special = lambda x: F.when(x.isin("", ".", ".."), F.concat(F.lit("_segment-"), _digest(d, 8))).otherwise(x)
        reserved = lambda x: F.when(F.lower(F.regexp_extract(x, r"^([^.]*)", 1)).isin(RESERVED), F.concat(F.lit("~r-"), x)).otherwise(x)
        stem = lambda x: F.substring(x, F.lit(1), F.greatest(F.lit(1), 80 - F.length(extension(x))))
        short = lambda x: F.when(F.length(x) > 100, F.concat(stem(x), F.lit("~"), _digest(d, 12), extension(x))).otherwise(x)
        return let(let(let(escaped(d), special), reserved), short)

    return let(decoded(segment), named)


def extension(name: Column) -> Column:
    """The last dot and what follows, if something precedes it; case kept."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)


def local_path(url: Column | Parts, source_origin: Column, type_extension: Column | None = None) -> Column:
    """The relative file path of a resource; ``type_extension`` is the one its content type asks for, null for none."""
    kind = type_extension if type_extension is not None else F.lit(None).cast("string")

    def file(u: Column) -> Column:
        """u: path, query, names, folder, extension to add."""
        wanted = F.coalesce(u["kind"], F.when(u["folder"], ".html"), F.lit(""))
        typed = lambda x: F.when(extension(x) == "", F.concat(x, wanted)).otherwise(x)
        stem = lambda x: F.substring(x, F.lit(1), F.length(x) - F.length(extension(x)))
        hashed = lambda x: F.when(u["query"] == "", x).otherwise(F.concat(stem(x), F.lit("~q-"), _digest(u["query"], 12), extension(x)))
        last = let(let(F.element_at(u["names"], -1), typed), hashed)
        return F.array_join(F.concat(u["top"], F.slice(u["names"], F.lit(1), F.size(u["names"]) - 1), F.array(last)), "/")

    def names(p: Column) -> Column:
        parts = F.transform(F.filter(F.split(p, "/"), lambda x: x != ""), lambda x: escaped_segment(x))
        return let(parts, lambda a: F.when(p.endswith("/") | (F.size(a) == 0), F.array_append(a, F.lit("index"))).otherwise(a))

    def placed(u: Parts) -> Column:
        place = F.concat(escaped_segment(u["host"]), F.when(u["port"] != "", F.concat(F.lit("~p-"), u["port"])).otherwise(""))
        top = F.when(_origin(u) == source_origin, F.array(F.lit("site"))).otherwise(F.array(F.lit("site"), F.lit("_external"), u["scheme"], place))
        query = F.when(search(u) == "", "").otherwise(search(_redacted(u)))
        known = F.struct(names(u["path"]).alias("names"), u["path"].endswith("/").alias("folder"), query.alias("query"), top.alias("top"), kind.alias("kind"))
        return F.when(u["web"], let(known, file))

    return _of(url, placed)


def is_inside_root(relative: Column) -> Column:
    """A relative path of safe names only."""
    names = F.split(relative, "/", -1)
    bad = lambda n: n.isin("", ".", "..") | n.rlike(r'[<>:"|?*\\\x00-\x1f]|[. ]$') | F.lower(F.regexp_extract(n, r"^([^.]*)", 1)).isin(RESERVED)
    return ~F.exists(names, bad)


def public_ipv4(address: Column) -> Column:
    """Whether a dotted IPv4 address is in none of the blocks that are private, local, reserved or for documentation; null if it is no address."""
    octets = F.transform(F.split(address, r"\."), lambda x: x.try_cast("int"))
    number = octets[0].cast("long") * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    inside = [number.between(low, high) for low, high in map(_block, BLOCKED_IPV4)]
    valid = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & ~F.exists(octets, lambda x: x > 255)
    any_ = inside[0]
    for x in inside[1:]:
        any_ = any_ | x
    return F.when(valid, ~any_)


# IPv4 blocks that a mirror must not ask.
BLOCKED_IPV4 = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 "
    "198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
).split()


def _block(cidr: str) -> tuple[int, int]:
    import ipaddress

    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)
