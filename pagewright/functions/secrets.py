"""Secrets that give themselves away by their form, and what happens to files that hold them. The rules are this library's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of secrets.
RULES = {
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
    "cloud_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "code_host_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "payment_key": r"\bsk_live_[A-Za-z0-9]{16,}\b",
    "chat_token": r"\bxox[abprs]-[A-Za-z0-9-]{20,}\b",
    "url_credentials": r"(?i)\bhttps?://[^\s/:@\"']+:[^\s/@\"']+@[a-z0-9.-]+",
}
TOO_LARGE, MOST_SCANNED = "scan_limit_exceeded", 32 << 20


def findings(text: Column) -> Column:
    """Names of the rules that a text meets, in order; one too large to be read has that alone."""
    found = F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in RULES.items()]), lambda x: x.isNotNull())
    return F.when(F.octet_length(text) > MOST_SCANNED, F.array(F.lit(TOO_LARGE))).otherwise(F.coalesce(found, F.array().cast("array<string>")))


def hidden(text: Column) -> Column:
    """The text with what meets a rule replaced."""
    for pattern in RULES.values():
        text = F.regexp_replace(text, pattern, "REDACTED")
    return text


def decision(text: Column, is_script: Column) -> Column:
    """``{action, findings, size, sha256}``: keep, keep_unread (too large), redact (a script that is clean without its secrets, with its new size and hash) or quarantine (nothing of it is kept)."""
    found, clean = findings(text), hidden(text)
    action = (
        F.when(F.size(found) == 0, "keep").when(F.array_contains(found, TOO_LARGE), "keep_unread")
        .when(F.coalesce(is_script, F.lit(False)) & (clean != text) & (F.size(findings(clean)) == 0), "redact").otherwise("quarantine")
    )
    kept = F.when(action == "redact", clean).when(action != "quarantine", text)
    return F.struct(action.alias("action"), found.alias("findings"), F.octet_length(kept).cast("long").alias("size"), F.sha2(kept, 256).alias("sha256"))
