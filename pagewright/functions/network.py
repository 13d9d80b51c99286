"""What a download may ask, and when it asks again: addresses, local names, retryable failures and waits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kinds, urls

# Network failures that a retry may mend; endings of names that stay in a local network; the longest wait in milliseconds.
RETRY_CODES = ("EAI_AGAIN", "ECONNREFUSED", "ECONNRESET", "ENETDOWN", "ENETUNREACH", "EPIPE", "ETIMEDOUT")
LOCAL_NAMES = (".localhost", ".local", ".internal", ".home.arpa")
LONGEST_WAIT = 30_000
# Blocks of IPv6 addresses that a mirror must not ask, as patterns of the 32 digits.
BLOCKED_IPV6 = {"::/128": "0{32}", "::1/128": "0{31}1", "::ffff:0:0/96": "0{20}f{4}.*", "100::/64": "01000{12}.*", "2001:db8::/32": "20010db8.*", "fc00::/7": "f[cd].*", "fe80::/10": "fe[89ab].*", "ff00::/8": "ff.*"}


def ipv6_digits(address: Column) -> Column:
    """The 32 hex digits of an IPv6 address in any of its spellings; null if it is none."""
    a = F.lower(address)
    tail = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    dotted = F.regexp_extract(a, rf":({tail}(?:\.{tail}){{3}})$", 1)
    octets = F.transform(F.split(dotted, r"\."), lambda x: F.lpad(F.lower(F.hex(x.try_cast("long"))), 2, "0"))
    spelled = F.when(dotted == "", a).otherwise(
        urls.let(octets, lambda o: F.concat(F.substr(a, F.lit(1), F.length(a) - F.length(dotted)), F.concat(o[0], o[1]), F.lit(":"), F.concat(F.try_element_at(o, F.lit(3)), F.try_element_at(o, F.lit(4)))))
    )

    def filled(s: Column) -> Column:
        groups = lambda t: F.filter(F.split(t, ":", -1), lambda g: g != "")
        halves = F.split(s, "::", -1)
        left, right = groups(F.get(halves, 0)), groups(F.coalesce(F.get(halves, 1), F.lit("")))
        missing = 8 - F.size(left) - F.size(right)
        padded = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
        open_ = F.size(halves) == 2
        shape = s.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$") & s.contains(":")
        fits = F.when(open_, missing >= 1).otherwise(missing == 0)
        return F.when(shape & fits, F.concat(padded(left), F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0))), padded(right)))

    return urls.let(spelled, filled)


def is_public_address(address: Column) -> Column:
    """Whether an IPv4 or IPv6 address is in none of the blocks that are private, local, reserved, for documentation or for groups; null if it is no address."""
    blocked = lambda d: reduce(lambda x, p: x | d.rlike(f"^{p}$"), list(BLOCKED_IPV6.values())[1:], d.rlike(f"^{BLOCKED_IPV6['::/128']}$"))
    return F.when(address.contains(":"), urls.let(ipv6_digits(address), lambda d: F.when(d.isNotNull(), ~blocked(d)))).otherwise(urls.public_ipv4(address))


def is_local_name(host: Column) -> Column:
    """Whether a host's name stays in a local network."""
    h = F.lower(host)
    return reduce(lambda x, end: x | h.endswith(end), LOCAL_NAMES, h == "localhost")


def retry_after(value: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks to wait, LONGEST_WAIT at most: of seconds, or until a date of HTTP; null for neither."""
    seconds = F.regexp_extract(F.trim(value), r"^\+?([0-9]+)", 1)
    date = F.try_to_timestamp(F.regexp_extract(F.trim(value), r"^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.greatest(F.unix_millis(date) - F.unix_millis(now.cast("timestamp")), F.lit(0))
    asked = F.when(seconds != "", F.coalesce(F.expr("1L") * 1000 * seconds.try_cast("int"), F.lit(LONGEST_WAIT).cast("long"))).when(date.isNotNull(), until)
    return F.when(asked.isNotNull(), F.least(asked, F.lit(LONGEST_WAIT).cast("long")))


def retry_wait(url: Column, attempt: Column, asked: Column, delay: int = 250) -> Column:
    """Milliseconds before a retry: what was asked for, otherwise ``delay``, doubled at each attempt; with a jitter that the URL and the attempt fix, LONGEST_WAIT at most."""
    most = min(250, delay)
    jitter = F.conv(F.substring(F.sha2(F.concat(url, F.lit("\0"), attempt.cast("string")), 256), 1, 4), 16, 10).cast("long") % most + 1 if most > 0 else F.lit(0)
    return F.least(F.coalesce(asked, (F.lit(delay) * F.pow(F.lit(2), attempt - 1)).cast("long")) + jitter, F.lit(LONGEST_WAIT).cast("long"))


def is_retryable(status: Column, code: Column, timed_out: Column, mismatch: Column) -> Column:
    """Whether a failed download is worth another try. mismatch tells it for a body of the wrong kind and is null otherwise; a status decides before a time-out, and that before a network failure's code."""
    return F.coalesce(mismatch, F.when(status.isNotNull(), kinds.is_retryable_status(status)), F.when(F.coalesce(timed_out, F.lit(False)), True), code.isin(*RETRY_CODES), F.lit(False))


def longest_quiet_wait(window_ms: Column, initial: bool = True) -> Column:
    """How long to wait for a quiet network at most: six windows, within bounds for the first wait and for those after an action."""
    low, high = (3_000, 15_000) if initial else (1_000, 10_000)
    return F.least(F.lit(high), F.greatest(F.lit(low), window_ms * 6)).cast("long")
