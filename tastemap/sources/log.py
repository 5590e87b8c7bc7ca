"""Behaviour-log source: text lines ``date,docId,docType,rowkey,type,userid``
(brackets stripped), parsed without failures: bad rows go to a quarantine
DataFrame with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.config import BEHAVIOUR_WEIGHTS
from tastemap.functions.scalar import behaviour_weight, parse_log_time, time_bucket

def read_log_text(spark: SparkSession, path) -> DataFrame:
    """One row per line (column ``value``); ``path`` may be a list of paths."""
    return spark.read.text(path)


def _split(lines: DataFrame, value_col: str) -> DataFrame:
    clean = F.regexp_replace(F.col(value_col), r"[\[\]]", "")
    return lines.select(F.split(clean, ",").alias("_p"))


def parse_log(lines: DataFrame, value_col: str = "value",
              weights: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse text lines into (good, quarantined).

    good: ts timestamp, doc_id string, doc_type string, rowkey string,
          behaviour int, user_id string, weight double, bucket string
    quarantined: line string, reason string
    """
    weights = weights or BEHAVIOUR_WEIGHTS
    p = F.col("_p")
    parsed = _split(lines, value_col).select(
        F.array_join(p, ",").alias("line"),
        F.size(p).alias("_n"),
        parse_log_time(F.get(p, 0)).alias("ts"),
        F.get(p, 1).alias("doc_id"),
        F.get(p, 2).alias("doc_type"),
        F.get(p, 3).alias("rowkey"),
        F.get(p, 4).try_cast("int").alias("behaviour"),
        F.get(p, 5).alias("user_id"),
    ).withColumn("weight", behaviour_weight("behaviour", weights))
    reason = (F.when(F.col("_n") < 6, F.lit("short_line"))
              .when(F.col("ts").isNull(), F.lit("bad_timestamp"))
              .when(F.col("weight").isNull(), F.lit("unknown_behaviour"))
              .when(F.col("user_id").isNull() | (F.col("user_id") == ""), F.lit("no_user"))
              .when(F.col("rowkey").isNull() | (F.col("rowkey") == ""), F.lit("no_rowkey")))
    tagged = parsed.withColumn("reason", reason)
    good = (tagged.where(F.col("reason").isNull())
            .select("ts", "doc_id", "doc_type", "rowkey", "behaviour", "user_id", "weight",
                    time_bucket("ts").alias("bucket")))
    bad = tagged.where(F.col("reason").isNotNull()).select("line", "reason")
    return good, bad
