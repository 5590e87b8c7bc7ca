"""Job-level run of P1, P2 (twice: merge), P4, P5 on the smallest tables."""

from pyspark.sql import functions as F

from tastemap.config import Params
from tastemap.plans import jobs as J
from tastemap.session import scratch_path
from tastemap.sources import testdata as TD
from tastemap.sources import store as ST

from conftest import SF_SMALL


def test_jobs_end_to_end(spark):
    p = Params(n_topics=4, vocab_multiplier=25, lda_iterations=3, als_iterations=2,
               min_similarity=0.0)
    paths = J.Paths(scratch_path(spark, "jobs-test"))
    news = TD.news(spark, SF_SMALL)
    model = J.build_topic_model(spark, news, paths, p)
    assert spark.read.parquet(paths.vocab).count() == len(model.vocab)
    from tastemap.operators.topics import read_vocabulary
    assert read_vocabulary(spark, paths.vocab) == model.vocab

    log = TD.behaviour_log(spark, SF_SMALL)
    split = F.lit(TD.SPLIT_TS).cast("timestamp_ntz")
    assert J.update_profiles(spark, log.where(F.col("ts") < split), news, paths, params=p) == (0, 0)
    assert J.update_profiles(spark, log.where(F.col("ts") >= split), news, paths, params=p) == (1, 1)
    topics = ST.read_latest(spark, paths.topics)
    total = {r["user_id"]: r["n"] for r in log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r["user_id"]: r["n"] for r in topics.groupBy("user_id").agg(F.sum("news_cnt").alias("n")).collect()}
    assert got == total  # counts merge exactly

    # P3: a file stream of new article keys through the stored model and profiles
    keys_dir = f"{paths.base}/incoming"
    news.select(F.col("rowkey").cast("string").alias("value")).limit(20).write.text(keys_dir)
    q = J.start_news_stream(spark, spark.readStream.text(keys_dir), news, paths, p,
                            trigger={"availableNow": True})
    q.awaitTermination()
    streamed = ST.read_recs(spark, paths.recs).where("source = 'content'").count()
    assert streamed > 0

    cf_recs = J.recommend_cf(spark, paths, p, batch_id=0).collect()
    assert cf_recs and all(r["rk"] <= p.cf_items for r in cf_recs)
    new_docs = TD.new_articles(spark, SF_SMALL)
    out = J.recommend_hybrid(spark, new_docs, news, paths, params=p, batch_id=0).collect()
    assert out
    assert {r["source"] for r in out} <= {"content", "cf"}
    raw = ST.read_sink(spark, paths.recs, ST.RECS_SCHEMA)
    # all three producers used batch 0 without overwriting each other
    jobs = {r["job"].split("-")[0] for r in raw.select("job").distinct().collect()}
    assert jobs == {"stream", "cf", "hybrid"}
    assert ST.read_recs(spark, paths.recs).count() > 0


def test_profile_update_with_bucketed_tables(spark):
    import uuid
    p = Params(min_similarity=0.0)
    paths = J.Paths(scratch_path(spark, "jobs-bucketed"), table_prefix=f"t{uuid.uuid4().hex[:6]}_",
                    n_buckets=4)
    news = TD.news(spark, SF_SMALL)
    log = TD.behaviour_log(spark, SF_SMALL)
    vecs = TD.article_topics(spark, SF_SMALL)
    split = F.lit(TD.SPLIT_TS).cast("timestamp_ntz")
    assert J.update_profiles(spark, log.where(F.col("ts") < split), news, paths, vecs, params=p,
                             train_cf=False) == (0, 0)
    assert J.update_profiles(spark, log.where(F.col("ts") >= split), news, paths, vecs, params=p,
                             train_cf=False) == (1, 1)
    t = ST.read_latest_table(spark, f"{paths.table_prefix}topics")
    assert t.groupBy().sum("news_cnt").first()[0] == log.count()


def test_articles_added_after_the_model_keep_their_terms(spark):
    p = Params(n_topics=2, vocab_multiplier=5, lda_iterations=2)
    paths = J.Paths(scratch_path(spark, "jobs-added"))
    schema = "rowkey long, words string"
    news = spark.createDataFrame([(i, f"common words w{i % 3} x") for i in range(6)], schema)
    J.build_topic_model(spark, news, paths, p)
    news = news.unionByName(spark.createDataFrame([(50, "common zebra quagga")], schema))
    log = spark.createDataFrame([(1, 50, 4, 0.3, "上午")],
                                "user_id long, doc_id long, behaviour int, weight double, bucket string")
    J.update_profiles(spark, log, news, paths, params=p, train_cf=False)
    terms = {r["term"] for r in J._read_state(spark, paths, "keywords").collect()}
    assert {"zebra", "quagga"} <= terms


def test_failed_update_changes_nothing(spark, monkeypatch):
    p = Params()
    paths = J.Paths(scratch_path(spark, "jobs-retry"))
    news, vecs = TD.news(spark, SF_SMALL), TD.article_topics(spark, SF_SMALL)
    log = TD.behaviour_log(spark, SF_SMALL)
    run = lambda: J.update_profiles(spark, log, news, paths, vecs, params=p, train_cf=False)
    monkeypatch.setattr(J.P, "initial_keywords", lambda *a: 1 / 0)
    try:
        run()
    except ZeroDivisionError:
        pass
    assert J._read_state(spark, paths, "topics") is None      # topics were written, not committed
    monkeypatch.undo()
    run()
    assert J._read_state(spark, paths, "topics").groupBy().sum("news_cnt").first()[0] == log.count()
