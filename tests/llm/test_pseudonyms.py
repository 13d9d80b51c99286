"""Pseudonyms of whole documents against a plain Python version of the finds, the Feistel networks and the counts."""

import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from pagewright.llm import lines, pii, queries

KEY = queries.KEY
RANK = [re.compile(f"(?:{g})$") for g in pii.GROUPS]


def digest(tweak, i, half):
    return hashlib.sha512(f"{KEY}\0{tweak}\0{i}\0{half}".encode()).hexdigest()


def text_moved(s, tweak, alphabets=(pii.DIGITS, pii.LOWER, pii.UPPER)):
    def moved(part, stream):
        out = ""
        for i, c in enumerate(part):
            by = int(stream[i % 64 * 2 : i % 64 * 2 + 2], 16)
            for a in alphabets:
                if c in a:
                    c = a[(a.index(c) + by) % len(a)]
                    break
            out += c
        return out

    left, right = s[: len(s) // 2], s[len(s) // 2 :]
    for i in range(0, pii.ROUNDS, 2):
        left = moved(left, digest(tweak, i, right))
        right = moved(right, digest(tweak, i + 1, left))
    return left + right


def pair_moved(a, b, m, n, tweak):
    for i in range(0, pii.ROUNDS, 2):
        a = (a + int(digest(tweak, i, b)[:14], 16)) % m
        b = (b + int(digest(tweak, i + 1, a)[:14], 16)) % n
    return a, b


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d)))


def card(s):
    d = re.sub("[^0-9]", "", s)
    if luhn(d) % 10:
        return s
    body = d[0] + text_moved(d[1:-1], "card", (pii.DIGITS,))
    new = iter(body + str(-luhn(body + "0") % 10))
    return "".join(next(new) if c.isdigit() else c for c in s)


def address(s):
    o = [int(x) for x in s.split(".")]
    if max(o) > 255:
        return s
    a, b = pair_moved(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{a >> 8}.{a % 256}.{b >> 8}.{b % 256}"


def security(s):
    area, group, serial = (int(x) for x in s.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return s
    a, b = pair_moved(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
    return f"{a + 1 + (a >= 665):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"


def day_moved(day):
    start = dt.date(1900, 1, 1)
    block, within = divmod((day - start).days, 72900)
    a, b = pair_moved(within // 270, within % 270, 270, 270, "date")
    return start + dt.timedelta(block * 72900 + a * 270 + b)


def day_of(y, m, d):
    try:
        day = dt.date(int(y), int(m), int(d))
    except ValueError:
        return None
    return day if dt.date(1701, 1, 1) <= day <= dt.date(2298, 12, 31) else None


def date(s):
    if re.match("[0-9]{4}-", s):
        day = day_of(*s.split("-"))
        return day_moved(day).isoformat() if day else s
    x, mark = re.split("[./-]", s), re.search("[./-]", s)[0]
    show = lambda n, k: f"{n:02}" if len(x[k]) == 2 else str(n)
    as_day_first, as_month_first = (lambda d: (d.day, d.month)), (lambda d: (d.month, d.day))
    ways = [(day_of(x[2], x[1], x[0]), as_day_first), (day_of(x[2], x[0], x[1]), as_month_first)]
    if mark == "/":
        ways.reverse()
    for k, (day, parts) in enumerate(ways):
        if day:
            new = day_moved(day)
            while k and new.day <= 12:
                new = day_moved(new)
            a, b = parts(new)
            return f"{show(a, 0)}{mark}{show(b, 1)}{mark}{new.year:04}"
    return s


def phone(s):
    head = re.match(r"(\+\d{1,3}?)(?=[ .(-]|\d{10}$)", s)
    head = head[1] if head else ""
    return head + text_moved(s[len(head) :], "phone", (pii.DIGITS,))


def email(s):
    at = s.index("@")
    return text_moved(s[:at], "email") + s[at:]


def secret(s):
    label = re.match(pii.LABEL, s)[0]
    v = s[len(label) :]
    return label + (text_moved(v, "hex", (pii.HEX,)) if re.fullmatch("[0-9a-f]+", v) else text_moved(v, "secret"))


CHANGE = {"email": email, "secret": secret, "ip": address, "ssn": security, "date": date, "phone": phone, "card": card}


def kind_of(v):
    return next((k for k, (p, _) in pii.KINDS.items() if re.search(p, v)), None)


def run_parts(run):
    """The cards of a run of numbers, and the other finds between them."""
    groups, marks = re.findall("[0-9]+", run), re.split("[0-9]+", run)
    best = []
    for i in range(len(groups)):
        spans = []
        for n in range(1, min(19, len(groups) - i) + 1):
            d = "".join(groups[i : i + n])
            if 13 <= len(d) <= 19 and luhn(d) % 10 == 0:
                shape = "-".join(str(len(g)) for g in groups[i : i + n])
                spans.append((next((k for k, p in enumerate(RANK) if p.match(shape)), len(RANK)), -n))
        best.append(min(spans, default=None))
    spans, free = [], 0
    for i, c in enumerate(best):
        if c and i >= free and not any(o and o[0] < c[0] for o in best[i + 1 : i - c[1]]):
            spans.append((i, -c[1]))
            free = i - c[1]
    out, end = [], 0
    for at, n in [*spans, (len(groups), 0)]:
        plain = (marks[end] if end else "") + "".join(g + m for g, m in zip(groups[end:at], marks[end + 1 : at + 1], strict=True))
        cut, found = re.split(f"(?:{pii.OTHERS})", plain), re.findall(f"(?:{pii.OTHERS})", plain)
        out += [x for a, b in zip(cut, [*found, ""], strict=True) for x in (a, b)]
        if n:
            out.append("".join(groups[k] + (marks[k + 1] if k < at + n - 1 else "") for k in range(at, at + n)))
        end = at + n
    return out


def expected(text):
    counts = dict.fromkeys(pii.KINDS, 0)
    if text is None:
        return text, *counts.values()

    def change(m):
        out = ""
        for v in run_parts(m[0]) if re.fullmatch("[0-9][0-9 -]+", m[0]) else [m[0]]:
            kind = kind_of(v)
            new = CHANGE[kind](v) if kind else v
            if new != v:
                counts[kind] += 1
            out += new
        return out

    return re.sub(pii.FOUND, change, text), *counts.values()


ODD = [
    None, "", "card 4539 1488 0343 6467 123 and 12 4539-1488-0343-6467, 4111111111111111 1984-02-29 3 555-123-4567", "31.12.1984 12/31/1984 31/12/1984 1/2/1999 30.2.1984 1500-01-01 29-2-2000", "a.b@c.de +49 30 1234567 (555) 123-4567",
    "password: Hunter2Hunter2 token=deadbeef00 api_key = \"AbC_12-xyz\"", "999.1.1.1 10.0.0.255 666-12-3456 123-45-6789 900-11-2222", "1 " * 3000, "4539148803436467" * 3, "x" * 200_000 + " 10.1.2.3",
]


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1 - k, t) for k, t in enumerate(ODD)]
    found = pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), KEY).collect()
    texts = dict(rows)
    assert len(found) == len(rows) and sum(sum(tuple(r)[2:]) for r in found) >= 40
    for r in found:
        assert tuple(r)[1:] == expected(texts[r["doc_id"]]), texts[r["doc_id"]][:300]


def test_own_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "host 10.1.2.3\nuser 7 here", "own")] * 2 + [(2, "user 8 here", "own")], "doc_id long, text string, a string")
    names = ["_found", "_parts", "_changed", "_new", "found", "parts", "changed", "new", "row", "body", "_key", "_lines", "_id", "key", "lines", "id", "of", "n_ip", "n_lines"]
    docs = docs.select("doc_id", "text", *[F.col("a").alias(n) for n in names])
    for made, lost in ((pii.pseudonymised(docs, KEY), "n_ip"), (lines.deduplicated(docs), "n_lines")):
        assert {"doc_id", "text", *names} <= set(made.columns) and len(made.columns) == len(set(made.columns))
        assert all(r[n] == "own" for r in made.collect() for n in names if n != lost)
