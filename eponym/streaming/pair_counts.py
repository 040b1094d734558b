"""Pair statistics over a stream of texts.

The reference is batch only; this is the incremental form of its first aggregation.
``count_pairs`` keeps running counts of neighbouring words, by event-time window when a
time column is named, so late rows are dropped after the watermark and state is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import neighbours, words_of


def count_pairs(texts: DataFrame, time: str | None = None, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """name, alt_name, frequency (and the window) of a streaming or static frame with a ``text`` column."""
    pairs = texts.withColumn("__p", F.explode(neighbours(words_of(F.col("text")))))
    keys = ["__p.name", "__p.alt_name"]
    if time is None:
        return pairs.groupBy(*keys).agg(F.count("*").alias("frequency"))
    return pairs.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("frequency"))
