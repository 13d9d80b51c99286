"""Perceptual difference of images that are tables of pixels; reading image files is left to what delivers the pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, MATCH, PARTIAL = 0.15, 0.02, 0.15
# Weights of red, green and blue in the three signals, of the signals in a difference, and the largest difference.
SIGNALS = {"y": (0.29889531, 0.58662247, 0.11448223), "i": (0.59597799, -0.27417610, -0.32180189), "q": (0.21147017, -0.52261711, 0.31114694)}
SHARES = {"y": 0.5053, "i": 0.299, "q": 0.1957}
LARGEST = 35215


def difference(a: Column, b: Column) -> Column:
    """Squared distance of two pixels ``{r, g, b, a}`` to the eye, each over white."""
    white = lambda p, c: 255 + (p[c] - 255) * p["a"] / 255
    apart = {c: white(a, c) - white(b, c) for c in "rgb"}
    signal = {k: sum((w * apart[c] for w, c in zip(ws, "rgb", strict=True)), F.lit(0.0)) for k, ws in SIGNALS.items()}
    return sum((share * signal[k] * signal[k] for k, share in SHARES.items()), F.lit(0.0))


def outcome(ratio: Column) -> Column:
    """The class of a share of differing pixels."""
    return F.when(ratio <= MATCH, "match").when(ratio <= PARTIAL, "partial").otherwise("mismatch")


def compared(actual: DataFrame, reference: DataFrame) -> DataFrame:
    """``(image, outcome, differing, total, ratio, similarity)`` of images in both or one of two tables ``(image, x, y, r, g, b, a)``.

    A pixel differs if its distance is over THRESHOLD of the largest. Images that don't have the same pixels are an error, with nulls. Pixels are joined and counted, so an image is no
    task's own.
    """
    pixel = lambda df, name: df.select("image", "x", "y", F.struct(*[F.col(c).cast("double").alias(c) for c in "rgba"]).alias(name))
    both = pixel(actual, "p").join(pixel(reference, "q"), ["image", "x", "y"], "full")
    differs = difference(F.col("p"), F.col("q")) > LARGEST * THRESHOLD * THRESHOLD
    counted = both.groupBy("image").agg(F.count_if(F.coalesce(differs, F.lit(False))).alias("n"), F.count("*").alias("of"), F.count_if(F.col("p").isNull() | F.col("q").isNull()).alias("odd"))
    good, ratio = F.col("odd") == 0, F.floor(F.col("n") / F.col("of") * 1e6 + 0.5) / 1e6
    shown = lambda c: F.when(good, c)
    return counted.select(
        "image", F.when(good, outcome(ratio)).otherwise("error").alias("outcome"), shown(F.col("n")).alias("differing"), shown(F.col("of")).alias("total"), shown(ratio).alias("ratio"),
        shown(F.floor((1 - ratio) * 1e6 + 0.5) / 1e6).alias("similarity"),
    )
