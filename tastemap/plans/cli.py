"""Command line for the four jobs, with the original's command names.

    python -m tastemap create_lda_model  --news NEWS --base BASE [--size N]
    python -m tastemap update_user_model --log LOG  --news NEWS --base BASE
    python -m tastemap news_recommend    --news NEWS --base BASE --incoming DIR [--once]
                                         (or --kafka-servers HOSTS --kafka-topic TOPIC)
    python -m tastemap als_recommend     --base BASE

NEWS is a table (Parquet by default) with ``rowkey`` and ``words``; LOG is the
text behaviour log (``date,docId,docType,rowkey,type,userid`` per line, brackets
allowed); BASE is the shared folder that holds models, profiles and
recommendations; --incoming is a folder of text files with one new article
key per line, or a Kafka topic (message value = article key).  The session comes
from spark-submit; ``spark.checkpoint.dir`` should name a shared folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tastemap.config import DEFAULT_PARAMS
from tastemap.plans import jobs as J
from tastemap.session import ensure_checkpoint_dir
from tastemap.sources import log as L
from tastemap.sources import news as N


def _log(spark, path):
    """(parsed log with the article key (row key) as doc_id and the published id as
    article_id, quarantined lines with their reason)."""
    good, bad = L.parse_log(L.read_log_text(spark, path), weights=DEFAULT_PARAMS.behaviour_weights)
    return (good.select("ts", "user_id", F.col("rowkey").alias("doc_id"), F.col("doc_id").alias("article_id"),
                        "behaviour", "weight", "bucket"), bad)


def main(argv=None, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tastemap")
    ap.add_argument("command", choices=["create_lda_model", "update_user_model",
                                        "news_recommend", "als_recommend"])
    ap.add_argument("--news")
    ap.add_argument("--news-format", default="parquet")
    ap.add_argument("--log")
    ap.add_argument("--base", required=True)
    ap.add_argument("--size", type=int, default=0, help="corpus row limit (<= 0: all)")
    ap.add_argument("--incoming", help="folder of new-article key files")
    ap.add_argument("--kafka-servers", help="Kafka bootstrap servers (needs the connector)")
    ap.add_argument("--kafka-topic", help="Kafka topic of new-article keys")
    ap.add_argument("--once", action="store_true", help="process what is there, then stop")
    ap.add_argument("--batch-id", type=int, default=None,
                    help="replay this batch instead of appending the next one")
    a = ap.parse_args(argv)

    spark = spark or SparkSession.builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    params = DEFAULT_PARAMS
    paths = J.Paths(a.base)
    news = N.read_news(spark, a.news, a.news_format) if a.news else None

    if a.command == "create_lda_model":
        J.build_topic_model(spark, news, paths, params, limit=a.size or None)
    elif a.command == "update_user_model":
        log, bad = _log(spark, a.log)
        # malformed lines are kept, with the reason, next to the profiles
        bad.write.mode("append").parquet(f"{a.base}/quarantine")
        J.update_profiles(spark, log, news, paths, params=params)
    elif a.command == "news_recommend":
        if a.kafka_servers:
            from tastemap.streaming.recommend import kafka_source
            src = kafka_source(spark, a.kafka_servers, a.kafka_topic)
        else:
            src = spark.readStream.text(a.incoming)
        q = J.start_news_stream(spark, src, news, paths, params,
                                trigger={"availableNow": True} if a.once else None)
        q.awaitTermination()
    elif a.command == "als_recommend":
        J.recommend_cf(spark, paths, params, batch_id=a.batch_id)
    return 0
