"""Line dedup with a log-template tree.

Lines are parsed to a fixed depth: token count, then the leading tokens, with tokens that hold digits as the variable field ``<*>``. In a leaf, lines that differ in few of
their places are lines of one template, whatever their order and whatever else is in the leaf:

- the places whose token other lines of the leaf have there too are fixed, the others variable; lines with the same fixed places, or the same but for one more variable place, have one template;
- lines that agree with the leaf's commonest tokens in SIMILAR of their places have one.

A template keeps SIMILAR of its places fixed. Each line is also a template of its own. Templates that recur across documents are dropped from all of them.

DataFrame expressions only. Documents are read twice and shuffled once, for the last step; their lines are parsed once. Lines and templates are compared by 96 bits of hashes of their tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, let, once, small, written

LEADING, SIMILAR, DOCUMENTS = 3, 0.8, 2


def _plain(line: Column) -> Column:
    """A line's tokens, one blank between them, those with a digit as the variable field; empty for a blank line."""
    tab = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))
    spaced = F.when(tab, F.translate(line, "\t\r", "  ")).otherwise(line)
    # A token is looked at from its start alone, and no character twice.
    masked = F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")).otherwise(spaced)
    trimmed = F.trim(masked)
    return F.when(F.contains(trimmed, F.lit("  ")), F.regexp_replace(trimmed, " ++", " ")).otherwise(trimmed)


def _key(*parts: Column) -> Column:
    """96 bits of hashes: few enough to shuffle, and no two of 10^12 lines are likely to share them."""
    return F.struct(F.xxhash64(*parts).alias("h"), F.hash(*parts).alias("g"))


def _parsed(rows: DataFrame) -> DataFrame:
    """Lines ``(id, key, line, leaf, exact, plain)`` of ``rows(id, key, text)``; line counts from 0, blank lines have no row."""
    lines = rows.select("id", "key", F.posexplode_outer(once(F.split("text", "\n", -1))).alias("line", "l")).select("id", "key", "line", once(_plain(F.col("l"))).alias("plain"))
    lines = lines.where("plain <> ''")
    many = F.octet_length("plain") - F.octet_length(F.replace("plain", F.lit(" "), F.lit(""))) + 1
    return lines.withColumn("leaf", _key(many, F.substring_index("plain", " ", LEADING))).withColumn("exact", _key(F.col("plain"), F.lit(1)))


def _merged(kept: DataFrame, similar: float) -> DataFrame:
    """``(exact, template)`` of the written ``kept(leaf, exact, plain)``, the distinct lines of leaves with several, which are deleted; written."""
    lines = kept.select("leaf", "exact", once(F.split("plain", " ")).alias("tokens"))

    # The leading tokens are those of all lines of a leaf: nothing to count there.
    n_tokens = F.size("tokens")
    rest = F.when(n_tokens > LEADING, F.slice("tokens", F.lit(LEADING + 1), n_tokens)).otherwise(F.array().cast("array<string>"))
    places = lines.select("leaf", "exact", n_tokens.cast("short").alias("of"), F.posexplode(rest).alias("place", "token"))
    votes = written(places.groupBy("leaf", "place", "token").agg(F.count("*").alias("n")), "votes")
    vote = _key("leaf", "place", "token")
    again = places.select("exact", "of", vote.alias("v")).join(votes.where("n > 1").select(vote.alias("v")), "v").groupBy("exact", "of").agg(
        (F.count("*") + F.least(F.lit(LEADING), F.first("of"))).alias("n"), F.bit_xor("v.h").alias("h"), F.bit_xor("v.g").alias("g"), F.collect_list("v").alias("parts")  # at most a line's tokens
    )
    none = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("g"))
    freed = F.when(F.col("n") - 1 >= similar * F.col("of"), F.concat(F.array(none), "parts")).otherwise(F.array(none))
    forms = again.where(F.col("n") >= similar * F.col("of")).select("exact", "h", "g", F.explode(freed).alias("p"))
    forms = forms.select("exact", _key(F.lit("form"), F.col("h").bitwiseXOR(F.col("p.h")), F.col("g").bitwiseXOR(F.col("p.g"))).alias("template"))
    shared = forms.groupBy("template").agg(F.min("exact.h").alias("a"), F.max("exact.h").alias("b")).where("a <> b").select("template")

    winner = votes.groupBy("leaf", "place").agg(F.max(F.struct("n", "token"))["token"].alias("token"))
    winner = winner.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda p: p["token"]).alias("agreed"))
    same = F.size(F.filter(F.zip_with(rest, "agreed", lambda a, b: a == b), lambda x: x)) + F.least(F.lit(LEADING), n_tokens)
    agreed = lines.join(winner, "leaf").where(same >= similar * F.size("tokens")).select("exact", _key("leaf", F.lit("agreed")).alias("template"))

    merged = written(agreed.union(forms.join(shared, "template").select("exact", "template")), "merged")
    dropped(kept.sparkSession, kept, votes)
    return merged


def _recurring(named: DataFrame, documents: int) -> DataFrame:
    """``(template)``: those of ``named(template, id, key)`` that ``documents`` documents or more have."""
    if documents == 2:  # two documents or more have different least and greatest hashes: no row for each document is shuffled
        own = named.select("template", F.xxhash64("id", "key").alias("d")).groupBy("template").agg(F.min("d").alias("a"), F.max("d").alias("b"))
        return own.where("a <> b").select("template")
    own = named.select("template", "id", "key").distinct().groupBy("template").agg(F.count("*").alias("n"))
    return own.where(F.col("n") >= documents).select("template")


def dropped_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", similar: float = SIMILAR, documents: int = DOCUMENTS) -> DataFrame:
    """``(id, key, lines)``: which lines of each document are dropped, by the hash ``key`` of its text."""
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))
    parsed = written(_parsed(rows), "parsed-lines")
    forked = parsed.groupBy("leaf").agg(F.min("exact.h").alias("a"), F.max("exact.h").alias("b")).where("a <> b").select("leaf")
    forked = small(written(forked, "forked"))
    kept = parsed.select("leaf", "exact", "plain").join(forked, "leaf").distinct()
    kept = written(kept, "forked-lines")
    # From here on lines go by their hashes: the words of all but the kept ones are not needed again.
    table = written(parsed.select("id", "key", "line", "exact"), "lines")
    dropped(docs.sparkSession, parsed)
    merged = _merged(kept, similar)
    merged = merged.groupBy("exact").agg(F.collect_set("template").alias("templates"))
    named = table.select("id", "key", "line", "exact").join(small(written(merged, "templates")), "exact", "left")
    named = named.select("id", "key", "line", F.explode(F.concat(F.array("exact"), F.coalesce("templates", F.array().cast("array<struct<h:bigint,g:int>>")))).alias("template"))
    often = small(written(_recurring(named, documents), "recurring"))
    return named.join(often, "template").groupBy("id", "key").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", similar: float = SIMILAR, documents: int = DOCUMENTS) -> DataFrame:
    """``docs`` with the recurring lines taken out of the text, and ``n_lines`` (lines with a token), ``n_dropped``.

    A template recurs if ``documents`` documents or more have a line of it; a document is an id with its text, so repeated rows count once and are cleaned alike.
    All lines of such a template are dropped, in every document. Null texts stay null with zero counts; texts that lose nothing stay as they are, and
    a text that loses all its lines is left with its blank ones. Columns n_lines and n_dropped are replaced, others kept.
    """
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    gone = written(dropped_lines(docs, id, text, similar, documents), "dropped-lines")
    gone = gone.hint("merge")  # as many rows as documents
    # The docs' own columns wait in a struct, so that none of their names meets one of those made here.
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in own]).alias("row"), docs[id].alias("of"), docs[text].alias("body"))
    joined = rows.join(gone, F.col("of").eqNullSafe(F.col("id")) & (F.xxhash64("body") == F.col("key")), "left").select("row", "body", "lines")
    lines = F.split("body", "\n", -1)
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("lines"))
    left = let(lines, lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    n = F.coalesce(F.regexp_count("body", F.lit(r"[^ \t\r\n][^\n]*+")), F.lit(0)).cast("long")
    n_dropped = F.when(F.col("body").isNull() | F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    new = F.when(n_dropped > 0, left).otherwise(F.col("body"))
    return joined.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in own], n.alias("n_lines"), n_dropped.alias("n_dropped"))
