"""Fill-in-the-middle: cuts a text at two unit boundaries and moves the middle to its end.

A unit is a run of ASCII letters or a single other character. A text is held as its maximal runs of letters and of other characters, each run with its first
character and the number of units before it: a cut after so many units is found by binary search of the run that holds it, and its character by arithmetic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and so many of these put the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20


def runs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each maximal run and the units before it; both end with the text's own length."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    starts = np.concatenate(([0], np.flatnonzero(letter[1:] != letter[:-1]) + 1, [len(points)])) if len(points) else np.zeros(1, np.int64)
    lengths = np.diff(starts)
    return starts, np.append(0, np.cumsum(np.where(letter[starts[:-1]], 1, lengths)))


def cut(starts: np.ndarray, units: np.ndarray, after: int) -> int:
    """The characters of the first ``after`` units. A run of letters is one unit, so only other runs are cut inside."""
    run = int(np.searchsorted(units, after, side="right")) - 1
    return int(starts[run] + after - units[run])


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def _places(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(text), 3), np.int64)
    for i, (t, a, b) in enumerate(zip(text, h1, h2, strict=True)):
        starts, units = runs(t)
        n = int(units[-1])
        out[i] = n, *sorted(cut(starts, units, h % (n + 1)) for h in (a, b))
    return pd.DataFrame(out, columns=["n", "first", "second"])


def transformed(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 1, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, out: str = "fim") -> DataFrame:
    """The rows with a struct ``out``: n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    The cuts and the form follow from the sha256 of seed and id alone, so rows of one id are treated alike, and rows with a null id as those of an empty one.
    Null texts count as empty. Empty texts and those that hold a mark stay plain, so :func:`restored` gives every text back. Texts of any length are cut as a
    whole. Other columns are kept, whatever their names; a column that is called ``out`` already is replaced. An empty table gives no rows.
    """
    whole, key = F.coalesce(F.col(text), F.lit("")), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(F.struct("*").alias("row"), whole.alias("whole"), _places(whole, h[0], h[1]).alias("cut"), (h[2] % 100).alias("keep"), (h[3] % 100).alias("turn"))
    marked = F.contains("whole", F.lit(PREFIX)) | F.contains("whole", F.lit(SUFFIX)) | F.contains("whole", F.lit(MIDDLE))
    form = F.when((F.col("whole") == "") | marked | (F.col("keep") >= changed), "plain").when(F.col("turn") < suffix_first, "spm").otherwise("psm")
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix, middle, suffix = F.substr("whole", F.lit(1), first), F.substr("whole", first + 1, second - first), F.substr("whole", second + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    named = rows.withColumn("form", form)
    moved = F.col("form") != "plain"
    made = F.struct(
        F.col("cut.n").alias("n"), "form", F.when(moved, F.col("cut.first")).alias("prefix_chars"), F.when(moved, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(moved, spm).otherwise(F.col("whole")).alias("output"),
    )
    return named.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != out], made.alias(out))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2)), F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
