"""Mapping of the provided test tables onto the recommender's inputs.

* ``events``      -> behaviour log.  event_type view/click/signup/purchase ->
  behaviour code 1/2/3/4; ``error`` has no code and is quarantined.
  The article of an event is ``100 * pmod(user_id, n_docs div 100) + k`` with
  ``k`` from the JSON ``props``; users in the same group share articles.
* ``documents``   -> news corpus: rowkey = doc_id, words = text, doc_type = source.
* ``embeddings``  -> topic vectors: the vector of article d is the embedding
  with ``vec_id = pmod(d, n_vectors)`` (a deterministic stand-in for LDA
  output in SQL-checked queries).
* ``benchmark``   -> newly published articles (item_id, text).

Table sizes (n_docs, n_vectors) enter as scalar subqueries, so nothing is
computed on the driver and the plan stays one Spark job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.functions.scalar import behaviour_weight, time_bucket
from tastemap.session import spread

EVENT_CODES = {"view": 1, "click": 2, "signup": 3, "purchase": 4}
SPLIT_TS = "2024-01-16"  # old / new halves for incremental-merge checks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _count(df: DataFrame):
    return df.select(F.count(F.lit(1))).scalar()


def behaviour_code(event_type) -> F.Column:
    c = F.col(event_type) if isinstance(event_type, str) else event_type
    expr = None
    for name, code in EVENT_CODES.items():
        expr = (F.when(c == name, F.lit(code)) if expr is None
                else expr.when(c == name, F.lit(code)))
    return expr


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with the derived article and behaviour code (NULL = unknown)."""
    docs = table(spark, sf_dir, "documents")
    groups = F.floor(_count(docs) / F.lit(100)).cast("long")
    # a small file is one split; spread it so parsing and pre-aggregation use
    # every core (no-op when the scan is already split finer, as on a cluster)
    ev = spread(table(spark, sf_dir, "events"))
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        (F.lit(100) * F.pmod(F.col("user_id"), groups) + k).alias("doc_id"),
        behaviour_code("event_type").alias("behaviour"),
    )


def behaviour_log(spark: SparkSession, sf_dir: str, weights: dict | None = None) -> DataFrame:
    """Usable log rows: (event_id, ts, user_id, doc_id, behaviour, weight, bucket)."""
    ev = events(spark, sf_dir)
    return (ev.where(F.col("behaviour").isNotNull() & F.col("ts").isNotNull()
                     & F.col("doc_id").isNotNull())
            .select("event_id", "ts", "user_id", "doc_id", "behaviour",
                    behaviour_weight("behaviour", weights).alias("weight"),
                    time_bucket("ts").alias("bucket")))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that cannot be used, with the reason (no failure, no silent drop)."""
    ev = events(spark, sf_dir)
    reason = (F.when(F.col("ts").isNull(), F.lit("bad_timestamp"))
              .when(F.col("behaviour").isNull(), F.lit("unknown_behaviour"))
              .when(F.col("doc_id").isNull(), F.lit("no_article")))
    return ev.select("event_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News corpus: (rowkey, words, doc_type)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("rowkey"), F.col("text").alias("words"),
        F.col("source").alias("doc_type"))


def new_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newly published articles: (doc_id, words)."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.col("text").alias("words"))


def topic_vectors(spark: SparkSession, sf_dir: str, key_col: str, keys: DataFrame) -> DataFrame:
    """Topic vector (array<double>) of each key in ``keys[key_col]``."""
    emb = table(spark, sf_dir, "embeddings")
    n_vec = _count(emb)
    vec = emb.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("topic"))
    return (keys.select(key_col).withColumn("vec_id", F.pmod(F.col(key_col), n_vec))
            .join(vec, "vec_id").drop("vec_id"))


def article_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, topic) for every corpus article."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return topic_vectors(spark, sf_dir, "doc_id", docs)


def new_article_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, topic) for every newly published article."""
    return topic_vectors(spark, sf_dir, "doc_id", new_articles(spark, sf_dir))


FAULTS = 7


def faulty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines with faults: by event id modulo ``FAULTS``, line 1 is cut short, 2
    has a bad time, 3 has no user and 4 no row key."""
    line = F.col("value")
    part = F.pmod("event_id", F.lit(FAULTS))
    broken = (F.when(part == 1, F.regexp_replace(line, "(,[^,]*){2}$", ""))
              .when(part == 2, F.regexp_replace(line, "^(\\[[0-9-]+) [0-9]+", "$1 25"))
              .when(part == 3, F.regexp_replace(line, "[^,]*$", "]"))
              .when(part == 4, F.regexp_replace(line, "[^,]*(,[^,]*,[^,]*)$", "$1")).otherwise(line))
    return log_lines(spark, sf_dir, ["event_id"]).select(broken.alias("value"))


def log_lines(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """The behaviour log as the original text format, one line per event:
    ``[date,docId,docType,rowkey,type,userid]``; error events keep their
    type name so that parsing quarantines them."""
    ev = events(spark, sf_dir)
    src = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc_type"))
    j = ev.join(src, "doc_id", "left")
    line = F.concat(
        F.lit("["), F.concat_ws(",",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.col("doc_id").cast("string"), F.coalesce(F.col("doc_type"), F.lit("")),
            F.col("doc_id").cast("string"),
            F.coalesce(F.col("behaviour").cast("string"), F.col("event_type")),
            F.col("user_id").cast("string")),
        F.lit("]"))
    return j.select(*(keep or []), line.alias("value"))
