"""Stream = batch, and replaying a micro-batch adds nothing."""

from pyspark.sql import functions as F

from tastemap.plans.catalogue import content_scores
from tastemap.streaming.recommend import run_file_stream_once

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    stream = run_file_stream_once(spark, SF_SMALL)
    batch = content_scores(spark, SF_SMALL)
    a = {(r[0], r[1]): round(r[2], 9) for r in stream.collect()}
    b = {(r[0], r[1]): round(r[2], 9) for r in batch.collect()}
    assert a == b and len(a) > 0


def test_stream_with_topic_model_equals_batch(spark):
    from tastemap.config import Params
    from tastemap.operators import topics as TP
    from tastemap.session import scratch_path
    from tastemap.sources import testdata as TD
    from tastemap.streaming.recommend import (score_new_articles, start_recommend_stream,
                                              topics_from_model)
    p = Params(n_topics=4, vocab_multiplier=25, min_similarity=0.3)
    news = TD.news(spark, SF_SMALL)
    corpus = news.select(F.col("rowkey").alias("doc_id"), "words")
    model = TP.build_topic_model(corpus, p, max_iter=3)
    profiles = TP.infer(model, corpus.limit(30)).withColumnRenamed("doc_id", "user_id")
    provider = topics_from_model(model, news)
    base = scratch_path(spark, "stream-lda")
    keys = news.select(F.col("rowkey").cast("string").alias("value")).orderBy("value").limit(12)
    keys.repartition(2).write.text(f"{base}/in")
    src = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{base}/in")
    q = start_recommend_stream(src, profiles, provider, f"{base}/out", f"{base}/ckpt", p,
                               trigger={"availableNow": True})
    q.awaitTermination()
    got = {(r[0], r[1]) for r in spark.read.parquet(f"{base}/out").collect()}
    batch_keys = keys.select(F.col("value").cast("long").alias("doc_id"))
    exp = {(r[0], r[1]) for r in score_new_articles(batch_keys, profiles, provider, p).collect()}
    assert got == exp and len(got) > 0


def test_current_bucket_profiles(spark):
    import datetime
    from tastemap.config import BUCKETS
    from tastemap.streaming.recommend import profiles_for_bucket
    prof = spark.createDataFrame([(1, b[0], [float(i)]) for i, b in enumerate(BUCKETS)],
                                 "user_id long, bucket string, topic array<double>")

    def expected():
        h = datetime.datetime.now(datetime.timezone.utc).hour   # session zone is UTC
        return next(label for label, _s, end in BUCKETS if h <= int(end[:2]))
    before = expected()
    got = [r["topic"] for r in profiles_for_bucket(prof, "current").collect()]
    if expected() == before:
        i = [b[0] for b in BUCKETS].index(before)
        assert got == [[float(i)]]
    assert [r["topic"] for r in profiles_for_bucket(prof, "下午").collect()] == [[2.0]]


def test_restart_from_checkpoint_processes_only_new_input(spark):
    """A restarted stream (same checkpoint) skips what it already committed and
    picks up new files; the sink holds each batch once."""
    from tastemap.plans.catalogue import morning_profiles
    from tastemap.session import scratch_path
    from tastemap.sources import testdata as TD
    from tastemap.sources.store import RECS_SCHEMA, read_sink
    from tastemap.streaming.recommend import start_recommend_stream
    from tastemap.config import Params

    p = Params(min_similarity=0.0)
    base = scratch_path(spark, "stream-restart")
    profiles = morning_profiles(spark, SF_SMALL)
    topics = TD.new_article_topics(spark, SF_SMALL)
    ids = [r[0] for r in TD.new_articles(spark, SF_SMALL).select("doc_id").orderBy("doc_id").collect()]
    half = len(ids) // 2

    def write(name, part):
        spark.createDataFrame([(str(i),) for i in part], "value string").coalesce(1) \
            .write.text(f"{base}/in/{name}")

    def run():
        src = spark.readStream.option("recursiveFileLookup", "true").text(f"{base}/in")
        q = start_recommend_stream(src, profiles, topics, f"{base}/out", f"{base}/ckpt", p,
                                   trigger={"availableNow": True})
        q.awaitTermination()
        q.live_profiles.unpersist()
        return read_sink(spark, f"{base}/out", RECS_SCHEMA.replace("source string", "sim double, source string"))

    write("a", ids[:half])
    first = run()
    n_batches = first.select("batch_id").distinct().count()
    docs_first = {r[0] for r in first.select("doc_id").distinct().collect()}
    again = run()                                   # nothing new: nothing reprocessed
    assert again.count() == first.count()
    assert again.select("batch_id").distinct().count() == n_batches
    write("b", ids[half:])
    third = run()                                   # only the new file is processed
    new_batches = third.select("batch_id").distinct().count() - n_batches
    assert new_batches >= 1
    docs = {r[0] for r in third.select("doc_id").distinct().collect()}
    assert docs_first < docs and docs <= set(ids)


def test_profile_updates_reach_a_running_stream(spark):
    """Profiles are asked for in every micro-batch: a new version takes effect between two."""
    from pyspark.sql import functions as F
    from tastemap.config import Params
    from tastemap.session import scratch_path
    from tastemap.sources.store import RECS_SCHEMA, read_sink, read_latest, list_versions, write_version
    from tastemap.streaming.recommend import start_recommend_stream
    base = scratch_path(spark, "stream-live")
    profile = lambda user: spark.createDataFrame([(user, [1.0, 0.0])], "user_id long, topic array<double>")
    write_version(spark, profile(1), f"{base}/profiles")

    def read():
        n = list_versions(spark, f"{base}/profiles")[-1]
        if n == 0:      # the profile job runs right after the first micro-batch has read
            write_version(spark, profile(2), f"{base}/profiles")
            return 0, spark.read.parquet(f"{base}/profiles/v=0")
        return n, read_latest(spark, f"{base}/profiles")
    topics = spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.0, 0.2])], "doc_id long, topic array<double>")
    for i in (7, 8):
        spark.createDataFrame([(str(i),)], "value string").coalesce(1).write.mode("append").text(f"{base}/in")
    src = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{base}/in")
    q = start_recommend_stream(src, read, topics, f"{base}/out", f"{base}/ckpt", Params(min_similarity=0.0),
                               trigger={"availableNow": True})
    q.awaitTermination()
    q.live_profiles.unpersist()
    got = {r["batch_id"]: r["user_id"] for r in read_sink(spark, f"{base}/out", RECS_SCHEMA).collect()}
    assert got == {0: 1, 1: 2}
