"""The four commands, run on inputs in the original formats (text log,
string row keys), built from the smallest test tables."""

from pyspark.sql import functions as F

from tastemap.plans import cli
from tastemap.plans import jobs as J
from tastemap.session import scratch_path
from tastemap.sources import store as ST
from tastemap.sources import testdata as TD

from conftest import SF_SMALL


def test_commands_end_to_end(spark):
    base = scratch_path(spark, "cli")
    # row keys in the original's style: text, not numbers ("n123")
    news = TD.news(spark, SF_SMALL).select(
        F.concat(F.lit("n"), F.col("rowkey").cast("string")).alias("rowkey"), "words")
    news.write.parquet(f"{base}/news")
    (TD.log_lines(spark, SF_SMALL)
     .select(F.regexp_replace("value", r"^(\[[^,]*,[^,]*,[^,]*,)", "$1n").alias("value"))
     .write.text(f"{base}/log"))
    (TD.new_articles(spark, SF_SMALL)
     .select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("value"))
     .write.text(f"{base}/incoming"))
    state = f"{base}/state"
    assert cli.main(["create_lda_model", "--news", f"{base}/news", "--base", state], spark) == 0
    assert cli.main(["update_user_model", "--log", f"{base}/log", "--news", f"{base}/news",
                     "--base", state], spark) == 0
    assert cli.main(["news_recommend", "--news", f"{base}/news", "--base", state,
                     "--incoming", f"{base}/incoming", "--once"], spark) == 0
    assert cli.main(["als_recommend", "--base", state], spark) == 0
    once = ST.read_recs(spark, f"{state}/recs").where("source = 'cf'").count()
    assert cli.main(["als_recommend", "--base", state], spark) == 0
    q = spark.read.parquet(f"{state}/quarantine")
    assert q.count() > 0 and {r[0] for r in q.select("reason").distinct().collect()} == {"unknown_behaviour"}
    paths = J.Paths(state)
    topics = ST.read_latest(spark, paths.topics)
    assert topics.count() > 0 and dict(topics.dtypes)["user_id"] == "string"
    raw = ST.read_sink(spark, paths.recs, ST.RECS_SCHEMA)
    jobs = {r["job"].split("-")[0] for r in raw.select("job").distinct().collect()}
    assert jobs == {"stream", "cf"}
    # the second run is a second batch, and reads with the stored (text) ids
    cf = raw.where("job = 'cf'")
    assert {r["batch_id"] for r in cf.select("batch_id").distinct().collect()} == {0, 1}
    assert ST.read_recs(spark, paths.recs).where("source = 'cf'").count() == once > 0
    # content picks carry the row key, CF picks the published article id of that key
    assert raw.where("source = 'content' AND doc_id NOT LIKE 'n%'").count() == 0
    assert cf.where("doc_id LIKE 'n%'").count() == 0
