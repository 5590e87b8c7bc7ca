"""New-article recommendation stream.

Source: any streaming DataFrame with the new article keys in column
``value`` (Kafka: ``selectExpr("CAST(value AS STRING) AS value")``; tests use
a text-file stream).  Each micro-batch is scored against the stored user
profiles with the exact cosine threshold join and appended to the sink as
partition (job, batch_id) (overwritten on replay, so a re-run batch adds
nothing).  The micro-batch is bounded by the trigger options
(``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``), which bounds the
indexed side of the join.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.config import DEFAULT_PARAMS, Params
from tastemap.operators.similarity import cosine_join, prepare_left
from tastemap.sources.store import append_batch


def kafka_source(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """New-article keys from a Kafka topic (message value = article key).
    Needs the Spark Kafka connector on the classpath."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().selectExpr("CAST(value AS STRING) AS value")


def topics_from_model(model, news: DataFrame):
    """Topic provider for new articles: look the texts up in ``news``
    (rowkey, words; '' when missing) and infer their topic mixtures."""
    from tastemap.operators.topics import infer
    from tastemap.sources.news import attach_words

    def provide(keys: DataFrame) -> DataFrame:
        texts = attach_words(keys.select("doc_id").distinct(), news)
        return infer(model, texts.select("doc_id", "words"))
    return provide


def score_new_articles(keys: DataFrame, profiles: DataFrame, article_topics,
                       params: Params = DEFAULT_PARAMS,
                       prepared: DataFrame | None = None) -> DataFrame:
    """keys (doc_id) -> (user_id, doc_id, sim) with sim > min_similarity.

    ``article_topics`` is a (doc_id, topic) table or a callable that turns
    the batch keys into one (e.g. ``topics_from_model``); ``prepared`` is the
    probe-ready profile side (``prepare_left``) when it is reused."""
    return score_vectors(batch_vectors(keys, article_topics), profiles, params, prepared)


def score_vectors(vectors: DataFrame, profiles: DataFrame, params: Params = DEFAULT_PARAMS,
                  prepared: DataFrame | None = None) -> DataFrame:
    """(doc_id, topic) of new articles -> (user_id, doc_id, sim)."""
    return cosine_join(profiles, vectors, ["user_id"], ["doc_id"], "topic", "topic",
                       params.min_similarity, prepared_left=prepared)


def batch_vectors(keys: DataFrame, article_topics) -> DataFrame:
    """(doc_id, topic) of the distinct keys of one batch."""
    keys = keys.select("doc_id").distinct()
    return (article_topics(keys) if callable(article_topics)
            else keys.join(article_topics, "doc_id"))


def profiles_for_bucket(profiles: DataFrame, bucket: str | None) -> DataFrame:
    """(user_id, topic) of one bucket.  ``bucket=None``: ``profiles`` has no
    bucket column (already one bucket); ``"current"``: the bucket of the time
    the micro-batch runs (``current_timestamp`` is fixed per query)."""
    from tastemap.functions.scalar import time_bucket
    if bucket is None:
        return profiles.select("user_id", "topic")
    want = time_bucket(F.current_timestamp()) if bucket == "current" else F.lit(bucket)
    return profiles.where(F.col("bucket") == want).select("user_id", "topic")


class LiveProfiles:
    """The profile side of the stream, read again for every micro-batch.

    ``read`` returns (version, profiles).  While the version and a fixed bucket
    stay the same, the normalised rows with their prefixes are kept cached
    (recomputed from lineage if an executor is lost); a new version replaces them."""

    def __init__(self, read, bucket: str | None, params: Params):
        self.read, self.bucket, self.params = read, bucket, params
        self.version, self.prepared = None, None

    def current(self) -> tuple[DataFrame, DataFrame | None]:
        from pyspark import StorageLevel
        version, table = self.read()
        profiles = profiles_for_bucket(table, self.bucket)
        if self.bucket == "current":
            return profiles, None
        if self.prepared is None or version != self.version:
            self.unpersist()
            self.prepared = prepare_left(profiles, ["user_id"], "topic", self.params.min_similarity).persist(
                StorageLevel.MEMORY_AND_DISK)
            self.version = version
        return profiles, self.prepared

    def unpersist(self) -> None:
        if self.prepared is not None:
            self.prepared.unpersist()
            self.prepared = None


def stream_job(spark: SparkSession, checkpoint: str) -> str:
    """The sink's job name of a stream: made from the id that Spark keeps in the
    checkpoint, so a restarted stream replays its own batches and a stream with a
    new checkpoint never overwrites an earlier one's."""
    text = "".join(r[0] for r in spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect())
    return "stream-" + json.loads(text)["id"][:8]


def start_recommend_stream(source: DataFrame, profiles, article_topics,
                           sink_path: str, checkpoint: str, params: Params = DEFAULT_PARAMS,
                           trigger: dict | None = None, key_type: str = "long",
                           bucket: str | None = None):
    """Start the stream; returns the StreamingQuery (caller owns it).

    ``profiles``: a table, or a callable that returns (version, table) and is asked
    in every micro-batch, so that profile updates take effect while the stream runs.
    ``bucket``: see ``profiles_for_bucket`` (the original always used the
    morning profile; ``"current"`` follows the clock)."""
    live = LiveProfiles(profiles if callable(profiles) else lambda: (0, profiles), bucket, params)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        keys = (batch.select(F.trim(F.col("value")).try_cast(key_type).alias("doc_id"))
                .where(F.col("doc_id").isNotNull()))
        # the batch's vectors (text lookup + inference) are used by the size
        # check and by the join: computed once, held for this batch only
        vecs = batch_vectors(keys, article_topics).persist()
        try:
            table, prepared = live.current()
            recs = score_vectors(vecs, table, params, prepared)
            append_batch(recs.withColumn("source", F.lit("content")), sink_path, batch_id,
                         job=stream_job(batch.sparkSession, checkpoint))
        finally:
            vecs.unpersist()

    w = (source.writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint)
         .queryName(f"recommend_{zlib.crc32(sink_path.encode())}"))
    w = w.trigger(**(trigger or {"processingTime": "10 seconds"}))
    q = w.start()
    # the caller owns the query: after q.stop(), q.live_profiles.unpersist()
    q.live_profiles = live
    return q


def run_file_stream_once(spark: SparkSession, sf_dir: str, params: Params = DEFAULT_PARAMS,
                         n_files: int = 3) -> DataFrame:
    """Test-data driver: the new-article ids (``benchmark``) are written as
    ``n_files`` text files, streamed one file per micro-batch until drained,
    and the sink is read back (de-duplicated)."""
    from tastemap.plans.catalogue import morning_profiles
    from tastemap.session import scratch_path
    from tastemap.sources import testdata as TD

    base = scratch_path(spark, "stream")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    # stored profiles: materialised once, as the profile job would have left them
    morning_profiles(spark, sf_dir).write.parquet(f"{base}/profiles")
    profiles = spark.read.parquet(f"{base}/profiles")
    arts = TD.new_articles(spark, sf_dir)
    (arts.select(F.col("doc_id").cast("string").alias("value"))
        .repartition(n_files).write.text(src))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(src)
    q = start_recommend_stream(stream, profiles,
                               TD.new_article_topics(spark, sf_dir), sink, ckpt, params,
                               trigger={"availableNow": True})
    q.awaitTermination()
    q.live_profiles.unpersist()
    from tastemap.sources.store import read_sink
    out = read_sink(spark, sink,
                    "user_id long, doc_id long, sim double, source string, job string, batch_id int")
    return out.dropDuplicates(["user_id", "doc_id"]).select("user_id", "doc_id", "sim")
