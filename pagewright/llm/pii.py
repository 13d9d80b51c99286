"""Personal data: keyed pseudonyms in the same format, by Feistel networks. DataFrame expressions only.

A value is changed by a keyed permutation of its own format, so that equal values stay equal across documents, different ones
stay different, and the result passes the same checks: a card number keeps its check digit right, an address its
octets below 256, a date its place in the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, once

ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
LABEL = r"(?i:\b(?:token|api[_-]?key|secret|password|passwd|pwd)\b)[\"']?[ \t]*[:=][ \t]*[\"']?"
SECRET = LABEL + r"[A-Za-z0-9+/_-]{8,}"
IP = r"\d{1,3}(?:\.\d{1,3}){3}"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4}|(?<!/)\d{1,2}/\d{1,2}/\d{4}(?!/)"
CARD = r"\d(?:[ -]?\d){12,18}"
#: A run of numbers with 13 digits or more, in which cards may stand beside other numbers; possessive, so that a long run needs no stack.
NUMBERS = r"\d++(?:-\d++)*+(?![\w-]|\.\d)"
RUN = rf"(?=\d(?:[ -]?\d){{12}}){NUMBERS}(?: {NUMBERS})*+"
OTHERS = rf"(?<![\w.+-])(?:{PHONE})(?![\w-])|(?<![\w.-])(?:{IP}|{SSN}|{DATE})(?![\w-])(?!\.\d)"
FOUND = rf"{EMAIL}|{SECRET}|{OTHERS}|(?<![\w.-]){RUN}(?![\w-])(?!\.\d)"
#: Sizes of the digit groups of a card, the usual ones first; a card of 16 digits comes before one whose last group is a code beside it.
GROUPS = (r"1[3-9]|4-4-4-4|4-6-[45]|4-3-3-3", r"4-4-4-4-[1-3]")


def _hash(key: str, tweak: str, i: int, half: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}\0{tweak}\0{i}\0"), half.cast("string")), 512)


def _moved(text: Column, stream: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character moved on within its alphabet by a byte of the stream; others stay."""

    def move(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for a in alphabets:
            at = F.instr(F.lit(a), c)
            out = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), move), "")


# A second parameter of a lambda would be the index that transform gives, so the round's number is bound by an outer one.
def feistel_text(text: Column, key: str, tweak: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """A permutation of the texts of one format: characters stay in their alphabets, those of none stay themselves."""

    def rounds(s: Column) -> Column:
        cut = F.floor(F.length(s) / 2).cast("int")
        halves = F.struct(F.substring(s, F.lit(1), cut).alias("l"), F.substring(s, cut + 1, F.length(s)).alias("r"))
        for i in range(0, ROUNDS, 2):
            halves = let(halves, (lambda i: lambda h: F.struct(_moved(h["l"], _hash(key, tweak, i, h["r"]), alphabets).alias("l"), h["r"].alias("r")))(i))
            halves = let(halves, (lambda i: lambda h: F.struct(h["l"].alias("l"), _moved(h["r"], _hash(key, tweak, i + 1, h["l"]), alphabets).alias("r")))(i))
        return let(halves, lambda h: F.concat(h["l"], h["r"]))

    return let(text, rounds)


def feistel_pair(a: Column, b: Column, m: int, n: int, key: str, tweak: str) -> Column:
    """A permutation of the pairs of a number below m and a number below n."""
    add = lambda x, h, size: F.pmod(x + F.conv(F.substring(h, 1, 14), 16, 10).cast("long"), F.lit(size).cast("long"))
    pair = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    for i in range(0, ROUNDS, 2):
        pair = let(pair, (lambda i: lambda p: F.struct(add(p["a"], _hash(key, tweak, i, p["b"]), m).alias("a"), p["b"].alias("b")))(i))
        pair = let(pair, (lambda i: lambda p: F.struct(p["a"].alias("a"), add(p["b"], _hash(key, tweak, i + 1, p["a"]), n).alias("b")))(i))
    return pair


def luhn(digits: Column) -> Column:
    """Sum of the digits by the Luhn rule; a valid number's is a multiple of ten."""
    at = lambda i: F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.when(i % 2 == 1, twice(at(i))).otherwise(at(i)))
    return F.aggregate(values, F.lit(0), lambda s, d: s + d)


def _filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order."""
    steps = F.aggregate(
        F.regexp_extract_all(shape, F.lit("(?s)."), 0),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substring(digits, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))
        ),
    )
    return steps["out"]


def _card(s: Column, key: str) -> Column:
    """The first digit and the check stay, the digits between are permuted."""

    def made(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), feistel_text(F.substring(d, F.lit(2), F.length(d) - 2), key, "card", (DIGITS,)))
        return let(body, lambda b: F.concat(b, F.pmod(10 - luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return let(F.regexp_replace(s, "[^0-9]", ""), lambda d: F.when(luhn(d) % 10 == 0, _filled(s, made(d))).otherwise(s))


def _ip(s: Column, key: str) -> Column:
    o = F.transform(F.split(s, r"\."), lambda x: x.cast("int"))
    valid = ~F.exists(o, lambda x: x > 255)
    pair = let(o, lambda x: feistel_pair(x[0] * 256 + x[1], x[2] * 256 + x[3], 65536, 65536, key, "ip"))
    out = let(pair, lambda p: F.concat_ws(".", *[(F.shiftright(p[k], n) % 256).cast("string") for k, n in (("a", 8), ("a", 0), ("b", 8), ("b", 0))]))
    return F.when(valid, out).otherwise(s)


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = (F.substring(s, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = feistel_pair(index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def shown(p: Column) -> Column:
        a = F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1)
        parts = ((a, 3), (F.floor(p["b"] / 9999) + 1, 2), (p["b"] % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(valid, let(pair, shown)).otherwise(s)


def _moved_day(day: Column, key: str) -> Column:
    """Days are permuted within blocks of 270 x 270 days counted from 1900-01-01."""
    start = F.lit("1900-01-01").cast("date")
    n = F.datediff(day, start)
    block = F.floor(n / 72900).cast("int")
    within = n - block * 72900
    return let(feistel_pair(F.floor(within / 270), within % 270, 270, 270, key, "date"), lambda p: F.date_add(start, (block * 72900 + p["a"] * 270 + p["b"]).cast("int")))


def _date(s: Column, key: str) -> Column:
    """Years 1701 to 2298 count as dates; a day has the same pseudonym in all formats, but for one.

    With slashes the month stands first, else the day. A date that is one only the other way round, with a day above 12, goes to the next
    such day of the permutation, so that its pseudonym reads the same way.
    """

    def valid(day: Column) -> Column:
        return day.isNotNull() & day.between(F.lit("1701-01-01").cast("date"), F.lit("2298-12-31").cast("date"))

    def turned(x: Column) -> Column:
        day = lambda d, m: F.concat_ws("-", x[2], F.lpad(x[m], 2, "0"), F.lpad(x[d], 2, "0")).try_cast("date")
        digits = lambda n, k: F.when(F.length(x[k]) == 2, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
        mark = F.substring(F.translate(s, DIGITS, ""), 1, 1)
        shown = lambda d, of: F.concat(digits(of[0](d), 0), mark, digits(of[1](d), 1), mark, F.lpad(F.year(d).cast("string"), 4, "0"))
        day_first, month_first = (day(0, 1), (F.dayofmonth, F.month)), (day(1, 0), (F.month, F.dayofmonth))

        def walked(d: Column) -> Column:
            state = lambda v, go: F.struct(v.alias("d"), go.alias("go"))
            step = lambda a, _: F.when(a["go"], let(_moved_day(a["d"], key), lambda v: state(v, F.dayofmonth(v) <= 12))).otherwise(a)
            return F.aggregate(F.sequence(F.lit(1), F.lit(200)), state(d, F.lit(True)), step)["d"]

        def read(usual, other) -> Column:
            as_usual = let(_moved_day(usual[0], key), lambda d: shown(d, usual[1]))
            return F.when(valid(usual[0]), as_usual).when(valid(other[0]), let(walked(other[0]), lambda d: shown(d, other[1]))).otherwise(s)

        return F.when(mark == "/", read(month_first, day_first)).otherwise(read(day_first, month_first))

    iso = s.try_cast("date")
    return F.when(s.rlike("^[0-9]{4}-"), F.when(valid(iso), _moved_day(iso, key).cast("string")).otherwise(s)).otherwise(let(F.split(s, "[./-]"), turned))


def _phone(s: Column, key: str) -> Column:
    head = F.regexp_extract(s, r"^(\+\d{1,3}?)(?=[ .(-]|\d{10}$)", 1)
    return F.concat(head, feistel_text(F.substring(s, F.length(head) + 1, F.length(s)), key, "phone", (DIGITS,)))


def _email(s: Column, key: str) -> Column:
    return F.concat(feistel_text(F.regexp_extract(s, "^([^@]*)", 1), key, "email"), F.regexp_extract(s, "(@.*)$", 1))


def _secret(s: Column, key: str) -> Column:
    label = F.regexp_extract(s, f"^({LABEL})", 1)

    def made(v: Column) -> Column:
        return F.when(v.rlike("^[0-9a-f]+$"), feistel_text(v, key, "hex", (HEX,))).otherwise(feistel_text(v, key, "secret"))

    return F.concat(label, let(F.substring(s, F.length(label) + 1, F.length(s)), made))


#: Kinds in the order in which a match is tried.
KINDS = {
    "email": (f"^{EMAIL}$", _email),
    "secret": (f"^{SECRET}$", _secret),
    "ip": (f"^{IP}$", _ip),
    "ssn": (f"^{SSN}$", _ssn),
    "date": (f"^(?:{DATE})$", _date),
    "phone": (f"^(?:{PHONE})$", _phone),
    "card": (f"^{CARD}$", _card),
}


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match of FOUND; a number that fails its check stays as it is."""
    cases = [(value.rlike(pattern), change(value, key)) for pattern, change in KINDS.values()]
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), value)


def _parts(run: Column) -> Column:
    """The parts of a run of numbers, in order: its cards, the other values in it, and what stands between.

    A card is a span of whole digit groups that has 13 to 19 digits and passes the check. From the left, the longest of the most usual grouping
    is taken, unless a more usual one starts within it.
    """

    def cut(x: Column) -> Column:
        groups, marks = x["groups"], x["marks"]
        size = F.size(groups)

        def span(i: Column, n: Column) -> Column:
            own = F.slice(groups, i + 1, n)
            shape = F.array_join(F.transform(own, lambda g: F.length(g).cast("string")), "-")
            rank = reduce(lambda rest, k: F.when(shape.rlike(f"^(?:{GROUPS[k]})$"), F.lit(k)).otherwise(rest), reversed(range(len(GROUPS))), F.lit(len(GROUPS)))
            return let(F.array_join(own, ""), lambda d: F.when(F.length(d).between(13, 19), F.when(luhn(d) % 10 == 0, F.struct(rank.alias("rank"), (-n).alias("less")))))

        best = F.transform(
            F.sequence(F.lit(0), size - 1), lambda i: F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(19), size - i)), lambda n: span(i, n)), lambda c: c.isNotNull()))
        )

        def chosen(best: Column) -> Column:
            state = lambda free, spans: F.struct(free.cast("int").alias("free"), spans.alias("spans"))
            none = F.array().cast("array<struct<at:int,n:int>>")

            def step(a: Column, i: Column) -> Column:
                c = F.get(best, i)
                beaten = F.exists(F.slice(best, i + 2, -c["less"] - 1), lambda o: F.coalesce(o["rank"] < c["rank"], F.lit(False)))
                taken = state(i - c["less"], F.concat(a["spans"], F.array(F.struct(i.alias("at"), (-c["less"]).alias("n")))))
                return F.when((i >= a["free"]) & c.isNotNull(), F.when(beaten, a).otherwise(taken)).otherwise(a)

            return F.aggregate(F.sequence(F.lit(0), size - 1), state(F.lit(0), none), step)["spans"]

        joined = lambda i, n: F.array_join(F.zip_with(F.slice(groups, i + 1, n), F.slice(marks, i + 2, n), lambda g, m: F.concat(g, m)), "")

        def pieces(spans: Column) -> Column:
            def piece(t: Column) -> Column:
                last, this = F.get(spans, t - 1), F.get(spans, t)
                begin, end = F.coalesce(last["at"] + last["n"], F.lit(0)), F.coalesce(this["at"], size)
                plain = F.concat(F.when(t > 0, F.get(marks, begin)).otherwise(""), joined(begin, end - begin))
                others = let(plain, lambda p: F.flatten(F.zip_with(F.split(p, OTHERS, -1), F.regexp_extract_all(p, F.lit(OTHERS), 0), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))
                card = F.concat(joined(this["at"], this["n"] - 1), F.get(groups, this["at"] + this["n"] - 1))
                return F.concat(others, F.when(this.isNotNull(), F.array(card)).otherwise(F.array().cast("array<string>")))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), piece))

        return let(let(best, chosen), pieces)

    return let(F.struct(F.regexp_extract_all(run, F.lit("[0-9]+"), 0).alias("groups"), F.split(run, "[0-9]+", -1).alias("marks")), cut)


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` changed and the columns ``n_<kind>``: values of each kind that were replaced.

    Null texts stay null with zero counts, texts without a find stay as they are. Each row is on its own; equal rows give equal
    results. Columns of the docs named like the counts are replaced, others are kept.
    """
    counts = [f"n_{k}" for k in KINDS]
    own = [c for c in docs.columns if c.lower() not in counts]
    body = docs[text]
    # The docs' own columns wait in a struct, so that none of their names meets one of those made here.
    row = docs.select(F.struct(*[docs[c].alias(c) for c in own]).alias("row"), body.alias("body"), once(F.when(body.rlike("[0-9@]") | body.rlike(LABEL), F.regexp_extract_all(body, F.lit(FOUND), 0))).alias("found"))
    parts = F.transform("found", lambda v: F.when(v.rlike("^[0-9][0-9 -]+$"), _parts(v)).otherwise(F.array(v)))
    row = row.withColumn("parts", once(parts))
    row = row.withColumn("changed", once(F.transform("parts", lambda p: F.transform(p, lambda v: F.struct(v.alias("old"), pseudonym(v, key).alias("new"))))))
    row = row.withColumn("new", F.transform("changed", lambda p: F.array_join(p["new"], "")))
    rest = F.split(F.col("body"), FOUND, -1)
    joined = F.array_join(F.flatten(F.zip_with(rest, F.col("new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = F.filter(F.flatten("changed"), lambda p: p["old"] != p["new"])
    row = row.select("row", F.when(F.size("found") > 0, joined).otherwise(F.col("body")).alias("body"), once(changed).alias("changed"))

    def counted(kind: str) -> Column:
        earlier = [p for k, (p, _) in KINDS.items() if list(KINDS).index(k) < list(KINDS).index(kind)]
        is_kind = lambda p: reduce(lambda c, e: c & ~p["old"].rlike(e), earlier, p["old"].rlike(KINDS[kind][0]))
        return F.coalesce(F.size(F.filter("changed", is_kind)), F.lit(0)).cast("long")

    return row.select(*[(F.col("body") if c == text else F.col("row")[c]).alias(c) for c in own], *[counted(k).alias(f"n_{k}") for k in KINDS])
