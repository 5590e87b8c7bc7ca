"""Blend of content-based and collaborative-filtering lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quota_bound(n_content_max: int, ratio: float) -> int:
    """Largest quota a user with at most ``n_content_max`` content picks gets."""
    return max(1, int(n_content_max * ratio)) if n_content_max > 5 else 1


def blend_lists(content: DataFrame, cf: DataFrame, ratio: float,
                max_quota: int | None = None) -> DataFrame:
    """Content list first, then CF picks.

    content, cf: (user_id, doc_id, score).  Only users with at least one
    content pick appear.  CF quota = floor(n * ratio) when the user has more
    than 5 content picks, else 1.  Returns (user_id, doc_id, source, rk) with
    rk 1.. across the concatenated list (content by score desc, doc_id; CF by
    score desc, doc_id).
    """
    wc = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("doc_id"))
    c = (content.withColumn("_rk", F.row_number().over(wc))
         .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))))
    quota = (c.groupBy("user_id").agg(F.max("_n").alias("_n"))
             .withColumn("_q", F.when(F.col("_n") > 5, F.floor(F.col("_n") * F.lit(ratio)))
                         .otherwise(F.lit(1)).cast("int")))
    # Cut every CF list to the largest quota first: a literal top-k is planned
    # as a partial limit before the shuffle, so a user with a huge CF list is
    # never sorted whole in one task.  ``max_quota`` is any upper bound the
    # caller knows (e.g. from the number of new articles); without it the
    # exact maximum is computed (one scalar job).
    q_max = max_quota if max_quota is not None else (quota.agg(F.max("_q")).first()[0] or 1)
    f = (cf.withColumn("_rk", F.row_number().over(wc)).where(F.col("_rk") <= int(q_max))
         .join(quota, "user_id")
         .where(F.col("_rk") <= F.col("_q")))
    out_c = c.select("user_id", "doc_id", F.lit("content").alias("source"),
                     F.col("_rk").cast("int").alias("rk"))
    out_f = f.select("user_id", "doc_id", F.lit("cf").alias("source"),
                     (F.col("_rk") + F.col("_n")).cast("int").alias("rk"))
    return out_c.unionByName(out_f)
