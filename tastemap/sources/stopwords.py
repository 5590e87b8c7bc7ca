"""Stop-word file source: whitespace-separated words, one or more per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stopwords(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(word) rows from a text file; an empty path means no custom words."""
    if not path:
        return None
    lines = spark.read.text(path)
    return (lines.select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word"))
            .where(F.col("word") != "").distinct())


def default_plus_custom(custom=()) -> list[str]:
    """The default English stop words plus custom ones (the "defaults + file" rule)."""
    from tastemap.config import DEFAULT_STOP_WORDS
    return sorted(set(DEFAULT_STOP_WORDS) | set(custom))
