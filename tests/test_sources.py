"""Behaviour-log parsing with quarantine, corpus helpers, stop words, store."""

from pyspark.sql import functions as F

from tastemap.sources import log as L
from tastemap.sources import news as N
from tastemap.sources import store as ST
from tastemap.sources.stopwords import read_stopwords
from tastemap.operators import text as T
from tastemap.sources import testdata as TD

from conftest import SF_SMALL


def test_parse_log_good_and_quarantine(spark):
    lines = spark.createDataFrame([
        ("[2016-05-20 18:59:59,d1,news,r1,1,u1]",),
        ("2016-05-20 07:00:00,d2,news,r2,4,u2",),
        ("2016-05-20 25:00:00,d3,news,r3,1,u3",),
        ("2016-05-20 07:00:00,d4,news,r4,9,u4",),
        ("2016-05-20,d5,news",),
        ("2016-05-20 07:00:00,d6,news,,2,u6",),
    ], "value string")
    good, bad = L.parse_log(lines)
    g = {r["rowkey"]: (r["bucket"], r["weight"], r["user_id"]) for r in good.collect()}
    assert g == {"r1": ("晚上", 0.2, "u1"), "r2": ("上午", 0.3, "u2")}
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["bad_timestamp", "no_rowkey", "short_line", "unknown_behaviour"]


def test_read_log_text_and_stopwords(spark, tmp_path):
    p = tmp_path / "log.txt"
    p.write_text("[2016-05-20 06:00:00,d1,news,r1,3,u1]\n")
    good, bad = L.parse_log(L.read_log_text(spark, str(p)))
    assert good.count() == 1 and bad.count() == 0
    sw = tmp_path / "stop.dic"
    sw.write_text("a\nthe  of\n\nand\n")
    words = read_stopwords(spark, str(sw))
    assert sorted(r["word"] for r in words.collect()) == ["a", "and", "of", "the"]
    assert read_stopwords(spark, "") is None
    docs = spark.createDataFrame([(1, "The cat of the hat")], "doc_id long, words string")
    toks = T.drop_stopwords(T.tokens(docs, tokenizer="gap"), words)
    assert sorted(r["term"] for r in toks.collect()) == ["cat", "hat"]


def test_scan_limit_and_attach_text(spark):
    news = spark.createDataFrame([(3, "ccc"), (1, "a"), (2, None)], "rowkey long, words string")
    assert [r["rowkey"] for r in N.scan(news, 2).collect()] == [1, 2]
    assert N.scan(news, 0).count() == 3
    log = spark.createDataFrame([(10, 1), (11, 2), (12, 9)], "event_id long, doc_id long")
    got = {r["event_id"]: r["n_chars"] for r in N.attach_text(log, news).collect()}
    assert got == {10: 1, 11: 0, 12: 0}
    w = {r["event_id"]: r["words"] for r in N.attach_words(log, news).collect()}
    assert w == {10: "a", 11: "", 12: ""}


def test_text_lines(spark):
    news = spark.createDataFrame([(1, "a\nb\n")], "rowkey long, words string")
    got = [(r["line_no"], r["line"]) for r in N.text_lines(news).orderBy("line_no").collect()]
    assert got == [(0, "a"), (1, "b"), (2, "")]


def test_versioned_store_and_idempotent_append(spark, tmp_path):
    base = str(tmp_path / "topics")
    df1 = spark.createDataFrame([(1, "x")], "user_id long, v string")
    df2 = spark.createDataFrame([(1, "y"), (2, "z")], "user_id long, v string")
    assert ST.read_latest(spark, base) is None
    assert ST.write_version(spark, df1, base) == 0
    assert ST.write_version(spark, df2, base) == 1
    assert ST.read_latest(spark, base).count() == 2
    recs = str(tmp_path / "recs")
    r = spark.createDataFrame([(1, 5, "content")], "user_id long, doc_id long, source string")
    ST.append_batch(r, recs, 0)
    ST.append_batch(r, recs, 0)
    ST.append_batch(r.withColumn("source", F.lit("cf")), recs, 1)
    assert spark.read.parquet(recs).count() == 2
    assert ST.read_recs(spark, recs).count() == 2
    # without an id a run adds to the earlier ones; an empty replay clears its batch
    other = spark.createDataFrame([("x", "n9", "cf")], "user_id string, doc_id string, source string")
    text = str(tmp_path / "text-recs")
    assert [ST.append_batch(other.withColumn("doc_id", F.lit(f"n{i}")), text, job="cf") for i in range(2)] == [0, 1]
    got = ST.read_recs(spark, text)
    assert got.count() == 2 and dict(got.dtypes)["user_id"] == "string"
    ST.append_batch(other.where("false"), text, 0, job="cf")
    assert [r["doc_id"] for r in ST.read_recs(spark, text).collect()] == ["n1"]


def test_queue_unread_and_mark_read(spark):
    arts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    seen = spark.createDataFrame([(2,)], "doc_id long")
    q = ST.queue_from(arts, seen, "news")
    assert sorted(r["doc_id"] for r in ST.queue_unread(q).collect()) == [1, 3, 4]
    done = spark.createDataFrame([(3, "news"), (4, "video")], "doc_id long, doc_type string")
    m = {r["doc_id"]: r["has_read"] for r in ST.mark_read(q, done).collect()}
    assert m == {1: False, 2: True, 3: True, 4: False}


def test_read_text_corpus_one_doc_per_line(spark, tmp_path):
    from tastemap.sources.news import read_text_corpus
    (tmp_path / "a.txt").write_text("x y\nx y\nz\n")
    (tmp_path / "b.txt").write_text("w\n")
    df = read_text_corpus(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    rows = df.collect()
    assert len(rows) == 4 and len({r["doc_id"] for r in rows}) == 4


def test_bucketed_profile_merge_shuffles_only_the_delta(spark):
    import uuid
    from tastemap.operators import profile as P
    name = "topics_" + uuid.uuid4().hex[:8]
    old = spark.createDataFrame([(u, "上午", [0.1 * u, 0.2], 3) for u in range(50)],
                                "user_id long, bucket string, topic array<double>, news_cnt long")
    assert ST.write_table_version(spark, old, name, ["user_id", "bucket"], 4) == 0
    stored = ST.read_latest_table(spark, name)
    delta = spark.createDataFrame([(1, "上午", [0.3, 0.1], 2), (77, "下午", [0.5, 0.5], 1)],
                                  "user_id long, bucket string, topic_sum array<double>, n long")
    merged = P.merge_topics(stored, delta)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    # exactly one exchange (the delta side); the bucketed table is read in place
    assert plan.count("Exchange hashpartitioning") == 1, plan
    got = {r["user_id"]: r["news_cnt"] for r in merged.collect()}
    assert got[1] == 5 and got[77] == 1 and len(got) == 51
    assert ST.write_table_version(spark, merged, name, ["user_id", "bucket"], 4) == 1
    assert ST.table_versions(spark, name) == [0, 1]


def test_failed_version_is_skipped(spark, tmp_path):
    base = str(tmp_path / "kw")
    df = spark.createDataFrame([(1, "x")], "user_id long, v string")
    assert ST.write_version(spark, df, base) == 0
    broken = tmp_path / "kw" / "v=1"
    broken.mkdir()
    (broken / "part-00000.parquet").write_bytes(b"partial")
    assert ST.list_versions(spark, base) == [0]            # readers ignore it
    assert ST.read_latest(spark, base).count() == 1
    assert ST.write_version(spark, df, base) == 2          # writers skip it
    assert ST.list_versions(spark, base) == [0, 2]


def test_empty_sinks_read_as_empty_tables(spark, tmp_path):
    assert ST.read_recs(spark, str(tmp_path / "never-written")).count() == 0
    empty = spark.createDataFrame([], "user_id long, doc_id long, source string")
    ST.append_batch(empty, str(tmp_path / "recs"), 0)
    assert ST.read_recs(spark, str(tmp_path / "recs")).count() == 0


def test_default_plus_custom_stop_words(spark):
    from tastemap.sources.stopwords import default_plus_custom
    words = default_plus_custom(["zzz"])
    assert "zzz" in words and "the" in words and len(words) > 100
    from pyspark.ml.feature import StopWordsRemover
    from tastemap.config import DEFAULT_STOP_WORDS
    assert DEFAULT_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_key_selection_moves_no_text(spark):
    news = TD.news(spark, SF_SMALL)
    keys = spark.createDataFrame([(3,), (5,), (10 ** 7,)], "doc_id long")
    found = N.select_keys(news, keys, "doc_id")
    assert sorted(r["rowkey"] for r in found.collect()) == [3, 5]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [In(doc_id" in plan.replace("rowkey", "doc_id")
    many = spark.range(5_000).withColumnRenamed("id", "doc_id")
    plan = N.select_keys(news, many, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    empty = N.select_keys(news, keys.where("false"), "doc_id")
    assert empty.count() == 0


def test_checkpoint_folder_is_needed_off_a_local_master():
    from types import SimpleNamespace
    from tastemap.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None))
    import pytest
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(fake)


def test_log_time_does_not_depend_on_the_session_zone(spark):
    from tastemap.functions.scalar import parse_log_time
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("2016-03-13 02:30:00",), ("2016-03-13 25:00:00",)], "s string")
        got = [str(r[0]) for r in df.select(parse_log_time("s")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == ["2016-03-13 02:30:00", "None"]


def test_cluster_conf_sizes_partitions():
    from tastemap.session import cluster_conf
    c = cluster_conf(100 * 10**12, executors=1000, executor_cores=4)
    assert int(c["spark.sql.shuffle.partitions"]) >= 100 * 10**12 // (256 * 1024 * 1024)
    assert cluster_conf(10**9)["spark.sql.shuffle.partitions"] == str(2 * 4000)


def test_queue_and_lookup_with_sample_values(spark):
    """The sample queue of the original (all unread), marking one entry read by
    (doc_id, doc_type), and a point lookup of row key news0001."""
    queue = spark.createDataFrame([
        ("asdf2f2f11", "1", "news0001", False), ("asdf2f2f12", "2", "news0002", False),
        ("asdf2f2f13", "1", "news0003", False), ("asdf2f2f14", "2", "news0004", False)],
        "doc_id string, doc_type string, rowkey string, has_read boolean")
    assert ST.queue_unread(queue).count() == 4
    done = spark.createDataFrame([("asdf2f2f11", "1"), ("asdf2f2f12", "1")], "doc_id string, doc_type string")
    marked = {r["rowkey"]: r["has_read"] for r in ST.mark_read(queue, done).collect()}
    assert marked == {"news0001": True, "news0002": False, "news0003": False, "news0004": False}
    news = spark.createDataFrame([("news0001", "w1 w2"), ("news0002", None)], "rowkey string, words string")
    log = spark.createDataFrame([(1, "news0001"), (2, "news0002"), (3, "news9999")], "event_id long, doc_id string")
    got = {r["event_id"]: r["words"] for r in N.attach_words(log, news).collect()}
    assert got == {1: "w1 w2", 2: "", 3: ""}


def test_many_whole_number_keys_select_texts_by_bitmaps(spark, monkeypatch):
    """Too many keys to broadcast one by one: bitmaps, so no text is shuffled; same rows."""
    from tastemap.sources import news as NS
    monkeypatch.setattr(NS, "IN_KEYS", 3)
    monkeypatch.setattr(NS, "BROADCAST_KEYS", 5)
    ids = [-40_000, -1, 0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 2 ** 40]
    news = spark.createDataFrame([(i, f"t{i}") for i in ids + ids[:2]] + [(None, "none")], "rowkey long, words string")
    keys = spark.createDataFrame([(i,) for i in ids[::2] + [99, 5]], "doc_id long")
    got = NS.select_keys(news, keys, "doc_id")
    assert got.columns == news.columns
    assert sorted(r.words for r in got.collect()) == sorted(f"t{i}" for i in ids + ids[:2] if i in ids[::2])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(NS, "BITMAPS", 1)
    assert sorted(map(tuple, NS.select_keys(news, keys, "doc_id").collect())) == sorted(map(tuple, got.collect()))
    text = news.where("rowkey IS NOT NULL").selectExpr("CAST(rowkey AS string) AS rowkey", "words")
    by_text = NS.select_keys(text, keys.selectExpr("CAST(doc_id AS string) AS doc_id"), "doc_id")
    assert sorted(r.words for r in by_text.collect()) == sorted(r.words for r in got.collect())
