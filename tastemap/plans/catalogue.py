"""One query per capability, each reading the provided tables (whole tables,
whole texts) and returning a DataFrame.  Floating results are rounded to 6
places so that the SQL oracle can compare them by hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.config import DEFAULT_PARAMS, MORNING, STOP_WORDS
from tastemap.operators import profile as P
from tastemap.operators import similarity as S
from tastemap.operators import text as T
from tastemap.operators.blend import blend_lists
from tastemap.sources import log as L
from tastemap.sources import news as N
from tastemap.sources import testdata as TD
from tastemap.session import materialise, spread

PARAMS = DEFAULT_PARAMS
R = 6  # rounding of floating results
SCAN_LIMIT = 100
WORD_TOPK = 20
TOP_TOPICS = 3
TOP_VECTORS = 5
TERM_COSINE = 0.5
KEYWORD_JACCARD = 0.08
NEIGHBOUR_COSINE = 0.3
LONG_DOC_CHARS = 5000


def _r(c, name=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, R)
    return col.alias(name or (c if isinstance(c, str) else "value"))


# -- shared building blocks --------------------------------------------------

def morning_profiles(spark, d) -> DataFrame:
    """(user_id, topic) morning topic profile of every user (whole log)."""
    log = TD.behaviour_log(spark, d)
    delta = P.topic_delta(log, TD.article_topics(spark, d))
    prof = P.topics_from_delta(delta)
    return prof.where(F.col("bucket") == PARAMS.profile_bucket).select("user_id", "topic")


def article_keywords(spark, d, keep_raw: bool = True) -> DataFrame:
    """Top keywords per corpus article (raw weights feed the profiles)."""
    return T.keywords(TD.news(spark, d).select(F.col("rowkey").alias("doc_id"), "words"),
                      PARAMS.keywords_per_doc, keep_raw=keep_raw)


def keyword_profile(spark, d, log=None) -> DataFrame:
    log = log if log is not None else TD.behaviour_log(spark, d)
    return P.keyword_delta(log, article_keywords(spark, d), PARAMS.keywords_per_update)


def new_keywords(spark, d) -> DataFrame:
    corpus = TD.news(spark, d).select(F.col("rowkey").alias("doc_id"), "words")
    return T.keywords_new_vs_corpus(TD.new_articles(spark, d), corpus, PARAMS.keywords_per_doc)


def content_scores(spark, d) -> DataFrame:
    return S.cosine_join(morning_profiles(spark, d), TD.new_article_topics(spark, d),
                         ["user_id"], ["doc_id"], "topic", "topic",
                         PARAMS.min_similarity)


# -- sources / scans ---------------------------------------------------------

def q_parse_log(spark, d):
    good, _bad = L.parse_log(TD.log_lines(spark, d))
    return good.select("ts", "doc_id", "doc_type", "rowkey", "behaviour", "user_id")


def q_quarantine(spark, d):
    return TD.quarantine(spark, d)


def q_parse_quarantine(spark, d):
    """The parser's own quarantine, on lines with every kind of fault."""
    _good, bad = L.parse_log(TD.faulty_lines(spark, d))
    return bad


def q_news_scan_limit(spark, d):
    return N.scan(TD.news(spark, d), limit=SCAN_LIMIT).select(
        "rowkey", F.length("words").alias("n_chars"))


def q_kv_scan_filter(spark, d):
    docs = TD.table(spark, d, "documents")
    return N.scan_where(docs, "n_chars", LONG_DOC_CHARS).select(
        F.col("doc_id").alias("rowkey"), "n_chars")


def q_text_lines(spark, d):
    return N.text_lines(TD.news(spark, d), "rowkey", "words").withColumnRenamed("rowkey", "doc_id")


def q_attach_text(spark, d):
    log = TD.behaviour_log(spark, d)
    return N.attach_text(log, TD.news(spark, d)).select(
        "event_id", F.col("doc_id").alias("rowkey"), "n_chars")


def q_attach_words(spark, d):
    """Texts by row key; every fifth event names a key that the corpus lacks."""
    key = lambda c: F.concat(F.lit("news"), F.lpad(c.cast("string"), 4, "0"))
    gone = F.when(F.pmod("event_id", F.lit(5)) == 0, F.lit("gone-")).otherwise(F.lit(""))
    log = TD.behaviour_log(spark, d).select("event_id", F.concat(gone, key(F.col("doc_id"))).alias("doc_id"))
    news = TD.news(spark, d).withColumn("rowkey", key(F.col("rowkey")))
    # keys are cut to four characters, so many texts can share one: each text is measured
    # and hashed beside its key, before it meets the events
    texts = N.attach_words(log.select("doc_id").distinct(), news).select(
        "doc_id", F.length("words").alias("n_chars"), F.md5(F.col("words").cast("binary")).alias("words_md5"))
    return log.join(texts, "doc_id").select("event_id", F.col("doc_id").alias("rowkey"), "n_chars", "words_md5")


def q_text_corpus(spark, d):
    """Text files, one document a line, read back as a corpus."""
    from tastemap.session import scratch_path
    path = scratch_path(spark, "text-corpus")
    (TD.news(spark, d).select(F.explode(F.split(F.coalesce("words", F.lit("")), "\n")).alias("value"))
     .write.text(path))
    return N.read_text_corpus(spark, path).groupBy("words").agg(F.count_distinct("doc_id").alias("n"))


def q_stopwords_antijoin(spark, d):
    """Stop words from a text file, removed by an anti join."""
    from tastemap.session import scratch_path
    from tastemap.sources.stopwords import read_stopwords
    path = scratch_path(spark, "stop-words")
    spark.createDataFrame([(" ".join(STOP_WORDS[i::5]),) for i in range(5)], "value string").write.text(path)
    news = TD.news(spark, d).select(F.col("rowkey").alias("doc_id"), "words")
    return T.term_freq(news, tokenizer="gap", stopwords=read_stopwords(spark, path))


# -- projections / filters / scalar -----------------------------------------

def q_time_bucket(spark, d):
    from tastemap.functions.scalar import time_bucket
    ev = TD.table(spark, d, "events").where(F.col("ts").isNotNull())
    return (ev.groupBy("user_id", time_bucket("ts").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def q_behaviour_weight(spark, d):
    return TD.behaviour_log(spark, d).select("event_id", F.col("behaviour").alias("code"), "weight")


def q_distinct_users(spark, d):
    return TD.behaviour_log(spark, d).select("user_id").distinct()


def q_user_events(spark, d):
    """Typed point lookup by user id (the operator itself): the events of the
    most active user (ties: smallest id), chosen by a scalar subquery."""
    log = TD.behaviour_log(spark, d)
    top = (log.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.asc("user_id")).limit(1).select("user_id"))
    return (log.where(F.col("user_id") == top.scalar())
            .select("event_id", "ts", "doc_id", "behaviour"))


# -- aggregations -------------------------------------------------------------

def q_ratings(spark, d):
    from tastemap.operators.cf import ratings
    return ratings(TD.behaviour_log(spark, d)).select("user_id", "doc_id", _r("rating"))


def q_item_dictionary(spark, d):
    from tastemap.operators.cf import item_dictionary
    good, _ = L.parse_log(TD.log_lines(spark, d))
    # a row key stands for ten article ids here; the dictionary keeps the last seen
    return item_dictionary(good.withColumn("rowkey", F.concat(F.lit("r"), F.expr("doc_id div 10"))))


def q_word_count_topk(spark, d):
    return T.word_count_topk(TD.news(spark, d), WORD_TOPK)


def _token_counts(spark, d, tokenizer):
    """The token list of each text: its length, its distinct tokens and its md5."""
    news = TD.news(spark, d).select(
        F.col("rowkey").alias("doc_id"), T.TOKENIZERS[tokenizer](F.col("words")).alias("t"))
    return news.where(F.size("t") > 0).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
        F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def q_token_regex_gap(spark, d):
    return _token_counts(spark, d, "gap")


def q_token_regex_match(spark, d):
    return _token_counts(spark, d, "match")


def _corpus(spark, d):
    return TD.news(spark, d).select(F.col("rowkey").alias("doc_id"), "words")


def q_vocabulary(spark, d):
    return T.vocabulary(_corpus(spark, d), PARAMS.vocab_size)


def q_jaccard_near(spark, d):
    """Morning profiles and new articles whose keywords overlap by at least ``KEYWORD_JACCARD``."""
    return S.jaccard_join(_morning_terms(spark, d), new_keywords(spark, d).select("doc_id", "term"),
                          ["user_id"], ["doc_id"], min_sim=KEYWORD_JACCARD).select(
        "user_id", "doc_id", "shared", _r("sim"))


def q_vocabulary_heavy(spark, d):
    """The same vocabulary by hashed counters and an exact count of what can be in it."""
    return T.frequent_terms(_corpus(spark, d), PARAMS.vocab_size)


def q_term_similarities(spark, d):
    """Vocabulary terms whose count vectors over all documents are alike."""
    from tastemap.operators.columns import column_similarities
    c = _corpus(spark, d)
    counts = T.count_vectors(c, T.vocabulary(c, PARAMS.vocab_size))
    return column_similarities(counts, "doc_id", "idx", "tf", TERM_COSINE).select("idx_a", "idx_b", _r("sim"))


def q_id_runs(spark, d):
    """Text ids indexed over three runs of the log: per run, how many ids there are, whether
    their indices are dense, and how many still have the index of the run before."""
    from tastemap.operators.cf import IdDictionary
    from tastemap.session import scratch_path
    log = TD.behaviour_log(spark, d).select(F.concat(F.lit("u"), "user_id").alias("user_id"),
                                            F.col("user_id").alias("event_user"))
    ids = IdDictionary(spark, scratch_path(spark, "ids"), "user_id", "user_idx")
    out, before = None, None
    for run in (1, 2, 3):
        after = ids.extend(log.where(F.pmod("event_user", F.lit(4)) < run))
        after = after.checkpoint(eager=True)
        kept = 0 if before is None else after.join(before, ["user_id", "user_idx"]).count()
        row = after.agg(F.lit(run).alias("run"), F.count(F.lit(1)).alias("n_ids"),
                        F.count_distinct("user_idx").alias("n_idx"), F.max("user_idx").alias("last"),
                        F.lit(kept).cast("long").alias("n_kept"))
        out, before = row if out is None else out.unionByName(row), after
    return out


def q_count_vectors(spark, d):
    c = _corpus(spark, d)
    return T.count_vectors(c, T.vocabulary(c, PARAMS.vocab_size))


def q_corpus_stats(spark, d):
    c = _corpus(spark, d)
    return T.corpus_stats(c, T.count_vectors(c, T.vocabulary(c, PARAMS.vocab_size)))


def q_tf(spark, d):
    return T.term_freq(_corpus(spark, d))


def _idf(spark, d):
    c = _corpus(spark, d)
    tf = T.term_freq(c)
    return c, tf, T.idf(tf, c.select(F.count(F.lit(1))).scalar())


def q_idf(spark, d):
    _c, _tf, idf = _idf(spark, d)
    return idf.select("term", "df", _r("idf"))


def q_tfidf(spark, d):
    _c, tf, idf = _idf(spark, d)
    return T.tfidf(tf, idf).select("doc_id", "term", _r("weight"))


def q_tfidf_range(spark, d):
    _c, tf, idf = _idf(spark, d)
    r = T.tfidf_range(T.tfidf(tf, idf))
    return r.select(_r("min_w"), _r("max_w"))


def q_keywords_self(spark, d):
    return article_keywords(spark, d, keep_raw=False)


def q_keywords_new_vs_corpus(spark, d):
    return new_keywords(spark, d)


def q_keywords_incremental(spark, d):
    """Keywords from stored document frequencies: half of the corpus is counted first,
    the articles added since are found and counted as a second delta."""
    from tastemap.session import scratch_path
    from tastemap.sources import store as ST
    path = scratch_path(spark, "doc-freq")
    c = _corpus(spark, d)
    ST.write_version(spark, T.doc_freq_delta(c.where("doc_id % 2 = 0")), path)
    ST.write_version(spark, T.doc_freq_delta(T.added_docs(c, ST.read_all(spark, path))), path)
    return T.keywords_with_df(c, ST.read_all(spark, path), PARAMS.keywords_per_doc)


def q_keywords_user_scope(spark, d):
    reads = TD.behaviour_log(spark, d).select("user_id", "doc_id")
    return T.keywords_user_scope(reads, _corpus(spark, d), PARAMS.keywords_per_doc)


# -- profiles -----------------------------------------------------------------

def q_topic_delta(spark, d):
    log = TD.behaviour_log(spark, d)
    return P.topic_delta_long(log, TD.article_topics(spark, d)).select(
        "user_id", "bucket", "k", _r("topic_sum"), "cnt")


def _halves(spark, d):
    log = TD.behaviour_log(spark, d)
    return log.where(F.col("ts") < F.lit(TD.SPLIT_TS).cast("timestamp_ntz")), \
        log.where(F.col("ts") >= F.lit(TD.SPLIT_TS).cast("timestamp_ntz"))


def q_topic_merge(spark, d):
    old_log, new_log = _halves(spark, d)
    vecs = TD.article_topics(spark, d)
    old = P.topics_from_delta(P.topic_delta(old_log, vecs))
    merged = P.merge_topics(old, P.topic_delta(new_log, vecs))
    return merged.select("user_id", "bucket", F.posexplode("topic").alias("k", "topic"),
                         F.col("news_cnt").alias("cnt")).select(
        "user_id", "bucket", "k", _r("topic"), "cnt")


def q_keyword_delta(spark, d):
    return keyword_profile(spark, d).select("user_id", "bucket", "term", _r("weight"))


def _keyword_merge(spark, d, existing, threshold):
    old_log, new_log = _halves(spark, d)
    kw = article_keywords(spark, d)
    old = P.initial_keywords(P.keyword_delta(old_log, kw, PARAMS.keywords_per_update))
    new = P.keyword_delta(new_log, kw, PARAMS.keywords_per_update)
    return P.merge_keywords(old, new, existing, threshold).select(
        "user_id", "bucket", "term", _r("weight"))


def q_keyword_merge_add(spark, d):
    return _keyword_merge(spark, d, "add", "median")


def q_keyword_merge_keep(spark, d):
    return _keyword_merge(spark, d, "keep", "max")


def _nested(spark, d):
    log = TD.behaviour_log(spark, d)
    topics = P.topics_from_delta(P.topic_delta(log, TD.article_topics(spark, d)))
    return P.to_nested(topics, keyword_profile(spark, d, log))


def q_profile_nested(spark, d):
    n = _nested(spark, d)
    return n.select(
        "user_id", F.size("interest").alias("n_buckets"),
        F.aggregate("interest", F.lit(0), lambda a, e: a + F.size(e["keywords"])).alias("n_keywords"),
        F.aggregate("interest", F.lit(0).cast("long"), lambda a, e: a + e["newsCnt"]).alias("news_cnt"))


def q_profile_contents(spark, d):
    """What the nested profiles hold: every bucket's keywords with their weights."""
    n = _nested(spark, d).select("user_id", F.explode("interest").alias("i"))
    return n.select("user_id", F.col("i.time").alias("bucket"), F.col("i.newsCnt").alias("news_cnt"),
                    F.explode_outer("i.keywords").alias("k")).select(
        "user_id", "bucket", "news_cnt", F.col("k.keyword").alias("term"), _r("k.weight", "weight"))


def q_profiles_saved(spark, d):
    """Nested profiles written and read back, for a bucket."""
    from tastemap.session import scratch_path
    from tastemap.sources.store import write_nested
    path = scratch_path(spark, "nested")
    write_nested(_nested(spark, d), path)
    u = P.users_for_bucket(spark.read.parquet(path), MORNING)
    return u.select("user_id", F.posexplode("topic").alias("k", "topic"),
                    F.size("keywords").alias("n_keywords")).select("user_id", "k", _r("topic"), "n_keywords")


def q_read_profiles(spark, d):
    """Stored topics and keywords looked up for known and unknown users."""
    log = TD.behaviour_log(spark, d)
    topics = P.topics_from_delta(P.topic_delta(log, TD.article_topics(spark, d)))
    ids = log.select("user_id").distinct()
    users = ids.unionByName(ids.select((F.col("user_id") + 1_000_000_000).alias("user_id")))
    t = P.read_topics(topics, users, MORNING)
    k = P.read_keywords(keyword_profile(spark, d, log), users, MORNING)
    return t.join(k, "user_id").select(
        "user_id", F.size("topic").alias("n_topics"), "news_cnt", F.size("keywords").alias("n_keywords"),
        F.round(F.aggregate(F.map_values("keywords"), F.lit(0.0), lambda a, x: a + x), R - 1).alias("weights"))


def q_profile_bucket(spark, d):
    u = P.users_for_bucket(_nested(spark, d), MORNING)
    return u.select("user_id", F.posexplode("topic").alias("k", "topic"),
                    F.size("keywords").alias("n_keywords")).select(
        "user_id", "k", _r("topic"), "n_keywords")


# -- similarity / recommendation --------------------------------------------

def q_cosine_pairs(spark, d):
    log = TD.behaviour_log(spark, d)
    pairs = log.select("user_id", "doc_id").distinct()
    prof = morning_profiles(spark, d)
    pairs = pairs.join(prof.select("user_id"), "user_id", "left_semi")
    sims = S.cosine_of_pairs(pairs, prof, TD.article_topics(spark, d),
                             ["user_id"], ["doc_id"], "topic", "topic")
    return sims.select("user_id", "doc_id", _r("sim"))


def _morning_terms(spark, d):
    return (keyword_profile(spark, d).where(F.col("bucket") == MORNING)
            .select("user_id", "term"))


def q_jaccard_pairs(spark, d):
    j = S.jaccard_join(_morning_terms(spark, d), new_keywords(spark, d).select("doc_id", "term"),
                       ["user_id"], ["doc_id"], salt_buckets=PARAMS.salt_buckets)
    return j.select("user_id", "doc_id", "shared", _r("sim"))


def q_score_single(spark, d):
    return content_scores(spark, d).select("user_id", "doc_id", _r("sim"))


def _hybrid(spark, d, threshold, sigma, beta, floor=0.0):
    # the join reads each of these several times, in several jobs, and they come from the
    # whole corpus and log: computed once
    profiles = materialise(morning_profiles(spark, d), "hybrid-profiles")
    terms = materialise(_morning_terms(spark, d), "hybrid-terms")
    new_terms = materialise(new_keywords(spark, d).select("doc_id", "term"), "hybrid-new-terms")
    h = S.hybrid_join(profiles, TD.new_article_topics(spark, d), terms, new_terms,
                      ["user_id"], ["doc_id"], "topic", "topic", threshold, sigma, beta,
                      salt_buckets=PARAMS.salt_buckets, checkpoint_pairs=True, keyword_floor=floor)
    return h.select("user_id", "doc_id", _r("sim_t"), _r("sim_k"), _r("score"))


def q_score_hybrid(spark, d):
    return _hybrid(spark, d, PARAMS.min_similarity, PARAMS.topic_weight, PARAMS.keyword_weight)


def q_score_hybrid_floor(spark, d):
    """The same rows with keyword pairs from prefixes of rare terms only."""
    return _hybrid(spark, d, PARAMS.min_similarity, PARAMS.topic_weight, PARAMS.keyword_weight, 0.1)


# weights under which no pair qualifies by its topics alone
KEYWORD_LED = (0.02, 0.01, 0.99)    # threshold, sigma, beta


def q_score_hybrid_keywords(spark, d):
    return _hybrid(spark, d, *KEYWORD_LED)


def cf_standin(spark, d):
    """Deterministic stand-in for CF picks in SQL-checked queries: the user's
    articles by rating (desc), ties by doc_id."""
    from tastemap.operators.cf import ratings
    return ratings(TD.behaviour_log(spark, d)).select(
        "user_id", "doc_id", F.round("rating", R).alias("score"))


def q_blend(spark, d):
    from tastemap.operators.blend import quota_bound
    content = content_scores(spark, d).select("user_id", "doc_id", F.round("sim", R).alias("score"))
    # a user's content picks are at most the number of new articles
    n_new = TD.new_articles(spark, d).count()
    return blend_lists(content, cf_standin(spark, d), PARAMS.cf_blend_ratio,
                       max_quota=quota_bound(n_new, PARAMS.cf_blend_ratio))


def q_top_topics(spark, d):
    from tastemap.operators.topics import top_topics
    emb = TD.table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("topic"))
    t = top_topics(emb, "vec_id", "topic", TOP_TOPICS)
    return t.select("vec_id", F.posexplode("topic").alias("k", "weight")).select(
        "vec_id", "k", _r("weight"))


def _queue(spark, d):
    """Queue of new articles; those with an id divisible by three have been read."""
    from tastemap.sources.store import queue_from
    arts = TD.new_articles(spark, d).select("doc_id")
    return queue_from(arts, arts.where(F.pmod("doc_id", F.lit(3)) == 0), "benchmark")


def q_queue_unread(spark, d):
    from tastemap.sources.store import queue_unread
    return queue_unread(_queue(spark, d))


def q_queue_mark_read(spark, d):
    from tastemap.sources.store import mark_read
    stored = TD.behaviour_log(spark, d).where(F.col("behaviour") == 4).select(
        "doc_id", F.lit("benchmark").alias("doc_type")).distinct()
    return mark_read(_queue(spark, d), stored)


def q_recs_append(spark, d):
    from tastemap.session import scratch_path
    from tastemap.sources.store import append_batch, read_recs
    path = scratch_path(spark, "recs")
    text = [F.col(c).cast("string").alias(c) for c in ("user_id", "doc_id")]
    # one batch of content recommendations, written twice (a replay): computed once
    content = (content_scores(spark, d)
               .select(*text, F.lit("content").alias("source")).checkpoint(eager=True))
    append_batch(content, path, 0, job="hybrid")
    append_batch(content, path, 0, job="hybrid")   # replay of batch 0 adds nothing
    halves = [cf_standin(spark, d).where(F.pmod("user_id", F.lit(2)) == i)
              .select(*text, F.lit("cf").alias("source")) for i in (0, 1)]
    for half in halves:                            # two runs: the second adds to the first
        append_batch(half, path, job="cf")
    recs = read_recs(spark, path)
    return recs.groupBy("user_id", "doc_id").agg(F.count(F.lit(1)).alias("n_sources"))


def q_queue_store_mark(spark, d):
    """The queue kept in a base-and-delta store: marking writes only the entries it names."""
    from tastemap.session import scratch_path
    from tastemap.sources.store import mark_read_stored, queue_store
    store = queue_store(spark, scratch_path(spark, "queue"))
    store.transact(lambda at: {"queue": _queue(spark, d)})
    done = TD.behaviour_log(spark, d).where(F.col("behaviour") == 4).select(
        "doc_id", F.lit("benchmark").alias("doc_type")).distinct()
    mark_read_stored(store, done)
    return store.read("queue")


# -- the jobs as users run them, on stored state -------------------------------

def _profile_job(spark, d):
    """P2 over both halves of the log; the paths of the state it leaves."""
    from tastemap.plans import jobs as J
    from tastemap.session import scratch_path
    paths = J.Paths(scratch_path(spark, "job"))
    for part in _halves(spark, d):
        J.update_profiles(spark, part, TD.news(spark, d), paths, TD.article_topics(spark, d), params=PARAMS,
                          train_cf=False)
    return paths


def _topic_rows(topics):
    return topics.select("user_id", "bucket", F.posexplode("topic").alias("k", "topic"),
                         F.col("news_cnt").alias("cnt")).select("user_id", "bucket", "k", _r("topic"), "cnt")


def q_job_topics(spark, d):
    from tastemap.plans import jobs as J
    return _topic_rows(J.profile_store(spark, _profile_job(spark, d)).read("topics"))


def q_job_keywords(spark, d):
    from tastemap.plans import jobs as J
    return J.profile_store(spark, _profile_job(spark, d)).read("keywords").select(
        "user_id", "bucket", "term", _r("weight"))


def q_store_compact(spark, d):
    """Topic profiles after a month-by-month series of updates, a replayed batch and a compaction."""
    from tastemap.session import scratch_path
    from tastemap.sources.delta_store import DeltaStore, Table
    base = scratch_path(spark, "store")
    store = DeltaStore(spark, base, {"topics": Table(f"{base}/topics", P.UB)})
    log, vecs = TD.behaviour_log(spark, d), TD.article_topics(spark, d)
    for i in (0, 1, 2, 2):
        delta = P.topic_delta(log.where(F.pmod("event_id", F.lit(3)) == i), vecs).checkpoint(eager=True)

        def change(at, delta=delta):
            old = store.read("topics", at, touched=delta)
            return {"topics": P.topics_from_delta(delta) if old is None else P.merge_topics(old, delta)}
        store.transact(change, ("log", i))
    store.compact()
    store.vacuum(keep=1)
    return _topic_rows(store.read("topics"))


def q_stream_profiles(spark, d):
    """P2 as a stream: the text log in three files, one a micro-batch, until drained."""
    from tastemap.plans import jobs as J
    from tastemap.session import scratch_path
    paths = J.Paths(scratch_path(spark, "profile-stream"))
    lines = TD.log_lines(spark, d).where(F.col("value").isNotNull())
    lines.repartition(3).write.text(f"{paths.base}/log")
    source = spark.readStream.option("maxFilesPerTrigger", 1).text(f"{paths.base}/log")
    J.start_profile_stream(spark, source, TD.news(spark, d), paths, TD.article_topics(spark, d), PARAMS,
                           {"availableNow": True}, "long", "long").awaitTermination()
    return _topic_rows(J.profile_store(spark, paths).read("topics"))


def q_job_vocabulary(spark, d):
    """P1: the vocabulary that the job stored beside its model."""
    from dataclasses import replace
    from tastemap.plans import jobs as J
    from tastemap.session import scratch_path
    paths = J.Paths(scratch_path(spark, "job-model"))
    J.build_topic_model(spark, TD.news(spark, d), paths, replace(PARAMS, lda_iterations=2))
    return spark.read.parquet(paths.vocab).select("idx", "term")


def q_job_cf(spark, d):
    """P2 with its CF model, then P4: how many picks the sink holds for every morning user."""
    from tastemap.plans import jobs as J
    from tastemap.session import scratch_path
    from tastemap.sources.store import RECS_SCHEMA, read_sink
    paths = J.Paths(scratch_path(spark, "job-cf"))
    J.update_profiles(spark, TD.behaviour_log(spark, d), TD.news(spark, d), paths, TD.article_topics(spark, d),
                      params=PARAMS)
    J.recommend_cf(spark, paths, PARAMS)
    return read_sink(spark, paths.recs, RECS_SCHEMA).groupBy("user_id").agg(
        F.count_distinct("doc_id").alias("n_items"), F.max("batch_id").alias("batch_id"))


# -- model-based: what must hold of any fitted model, after save and load -------

def _topic_model(spark, d, optimizer="em"):
    from tastemap.operators import topics as TP
    from tastemap.session import scratch_path
    path = scratch_path(spark, "lda")
    TP.build_topic_model(_corpus(spark, d), PARAMS, optimizer=optimizer).save(path)
    return TP.TopicModel.load(path)


def q_lda_topics(spark, d, optimizer="em"):
    """Per document: how many topics its mixture has, whether none is negative, and its
    sum (1, or 0 for a text without a vocabulary term)."""
    from tastemap.operators import topics as TP
    inferred = TP.infer(_topic_model(spark, d, optimizer), spread(_corpus(spark, d)))
    total = F.aggregate("topic", F.lit(0.0), lambda a, x: a + x)
    return inferred.select("doc_id", F.size("topic").alias("n_topics"),
                           F.forall("topic", lambda x: x >= 0).alias("valid"), F.round(total, R).alias("total"))


def q_lda_describe(spark, d):
    """Per topic: ten distinct vocabulary terms with falling positive weights."""
    from tastemap.operators import topics as TP
    model = _topic_model(spark, d)
    vocab = T.vocabulary(_corpus(spark, d), PARAMS.vocab_size).select("term", F.lit(1).alias("known"))
    terms = TP.describe(model, 10).join(vocab, "term", "left")
    return terms.groupBy("topic").agg(F.count_distinct("term").alias("n_terms"),
                                      F.count("known").alias("n_known"), F.min(F.col("weight") > 0).alias("positive"))


def q_lda_online(spark, d):
    return q_lda_topics(spark, d, optimizer="online")


def q_top_inner_product(spark, d):
    """The 5 topic vectors with the largest inner product for every morning profile."""
    from tastemap.operators.mips import top_items
    vec = TD.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    users = morning_profiles(spark, d).withColumnRenamed("topic", "features")
    top = top_items(users, vec, TOP_VECTORS, "user_id", "vec_id").rows
    return top.select("user_id", "vec_id", "rk", _r("score"))


def q_topic_neighbours(spark, d):
    """All topic vectors near each morning profile (dense right side: pruned by angles)."""
    vec = TD.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    near = S.cosine_join(morning_profiles(spark, d), vec, ["user_id"], ["vec_id"], "topic", "v", NEIGHBOUR_COSINE)
    return near.select("user_id", "vec_id", _r("sim"))


def q_cf_recommend(spark, d):
    """Per user: how many distinct items are recommended, how many of them are rated
    items with the id last seen for their key, and whether ranks run from 1."""
    from tastemap.operators import cf
    from tastemap.session import scratch_path
    log = TD.behaviour_log(spark, d).withColumn("article_id", F.concat(F.lit("a"), "doc_id"))
    path = scratch_path(spark, "cf")
    cf.train(log, PARAMS).save(path)
    ids = log.select("user_id").distinct()
    users = ids.unionByName(ids.select((F.col("user_id") + 1_000_000_000).alias("user_id")))  # half unknown
    recs = cf.recommend(cf.CFModel.load(spark, path), users, PARAMS.cf_items)
    known = log.select("doc_id", F.lit(1).alias("known")).distinct()
    return recs.join(known, "doc_id", "left").groupBy("user_id").agg(
        F.count_distinct("doc_id").alias("n_items"),
        F.count_if((F.col("known") == 1) & (F.col("article_id") == F.concat(F.lit("a"), "doc_id"))).alias("n_known"),
        F.max("rk").alias("last_rank"))


def q_cf_text_ids(spark, d):
    """ALS over text ids: the same counts as with numbers."""
    from tastemap.operators import cf
    log = TD.behaviour_log(spark, d).select(
        F.concat(F.lit("u"), "user_id").alias("user_id"), F.concat(F.lit("n"), "doc_id").alias("doc_id"), "weight")
    recs = cf.recommend(cf.train(log, PARAMS), log.select("user_id"), PARAMS.cf_items)
    return recs.join(log.select("doc_id").distinct(), "doc_id").groupBy("user_id").agg(
        F.count_distinct("doc_id").alias("n_items"), F.max("rk").alias("last_rank"))


def q_stream_recommend(spark, d):
    from tastemap.streaming.recommend import run_file_stream_once
    return run_file_stream_once(spark, d, PARAMS).select("user_id", "doc_id", _r("sim"))


# -- single-capability checks of scalar helpers --------------------------------

PAD_TO = 72


def q_in_zone(spark, d):
    from tastemap.config import BUCKETS
    from tastemap.functions.scalar import in_zone
    ev = TD.table(spark, d, "events").where(F.col("ts").isNotNull())
    _label, start, end = BUCKETS[1]
    return ev.select("event_id", in_zone("ts", start, end).alias("in_zone"))


def q_pad_vectors(spark, d):
    from tastemap.functions.scalar import pad
    emb = TD.table(spark, d, "embeddings").select(
        "vec_id", pad(F.col("embedding").cast("array<double>"), PAD_TO).alias("v"))
    return emb.select("vec_id", F.posexplode("v").alias("k", "x")).select("vec_id", "k", _r("x"))


def q_topic_unscale(spark, d):
    from tastemap.functions.scalar import unscale
    log = TD.behaviour_log(spark, d)
    prof = P.topics_from_delta(P.topic_delta(log, TD.article_topics(spark, d)))
    back = prof.select("user_id", "bucket", unscale("topic", "news_cnt").alias("s"))
    return back.select("user_id", "bucket", F.posexplode("s").alias("k", "topic_sum")).select(
        "user_id", "bucket", "k", _r("topic_sum"))


def q_user_dictionary(spark, d):
    from tastemap.operators.cf import dictionaries, ratings
    users, _items = dictionaries(ratings(TD.behaviour_log(spark, d)))
    return users


def q_user_dictionary_text(spark, d):
    """Dense indices of text ids: a bijection onto 0 .. n - 1."""
    from tastemap.operators.cf import dictionaries, ratings
    log = TD.behaviour_log(spark, d).withColumn("user_id", F.concat(F.lit("u"), "user_id"))
    users, _items = dictionaries(ratings(log))
    return users.agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("user_idx").alias("n_idx"),
                     F.min("user_idx").alias("lo"), F.max("user_idx").alias("hi"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_log": q_parse_log,
    "quarantine": q_quarantine,
    "parse_quarantine": q_parse_quarantine,
    "news_scan_limit": q_news_scan_limit,
    "kv_scan_filter": q_kv_scan_filter,
    "text_lines": q_text_lines,
    "text_corpus": q_text_corpus,
    "attach_text": q_attach_text,
    "attach_words": q_attach_words,
    "stopwords_antijoin": q_stopwords_antijoin,
    "time_bucket": q_time_bucket,
    "behaviour_weight": q_behaviour_weight,
    "distinct_users": q_distinct_users,
    "user_events": q_user_events,
    "ratings": q_ratings,
    "item_dictionary": q_item_dictionary,
    "word_count_topk": q_word_count_topk,
    "token_regex_gap": q_token_regex_gap,
    "token_regex_match": q_token_regex_match,
    "vocabulary": q_vocabulary,
    "count_vectors": q_count_vectors,
    "corpus_stats": q_corpus_stats,
    "tf": q_tf,
    "idf": q_idf,
    "tfidf": q_tfidf,
    "tfidf_range": q_tfidf_range,
    "keywords_self": q_keywords_self,
    "keywords_new_vs_corpus": q_keywords_new_vs_corpus,
    "keywords_incremental": q_keywords_incremental,
    "keywords_user_scope": q_keywords_user_scope,
    "topic_delta": q_topic_delta,
    "topic_merge": q_topic_merge,
    "keyword_delta": q_keyword_delta,
    "keyword_merge_add": q_keyword_merge_add,
    "keyword_merge_keep": q_keyword_merge_keep,
    "profile_nested": q_profile_nested,
    "profile_contents": q_profile_contents,
    "profiles_saved": q_profiles_saved,
    "profile_bucket": q_profile_bucket,
    "read_profiles": q_read_profiles,
    "cosine_pairs": q_cosine_pairs,
    "jaccard_pairs": q_jaccard_pairs,
    "score_single": q_score_single,
    "score_hybrid": q_score_hybrid,
    "score_hybrid_floor": q_score_hybrid_floor,
    "score_hybrid_keywords": q_score_hybrid_keywords,
    "blend": q_blend,
    "top_topics": q_top_topics,
    "queue_unread": q_queue_unread,
    "queue_mark_read": q_queue_mark_read,
    "recs_append": q_recs_append,
    "lda_topics": q_lda_topics,
    "lda_describe": q_lda_describe,
    "lda_online": q_lda_online,
    "jaccard_near": q_jaccard_near,
    "vocabulary_heavy": q_vocabulary_heavy,
    "term_similarities": q_term_similarities,
    "id_runs": q_id_runs,
    "queue_store_mark": q_queue_store_mark,
    "job_topics": q_job_topics,
    "job_keywords": q_job_keywords,
    "job_vocabulary": q_job_vocabulary,
    "job_cf": q_job_cf,
    "store_compact": q_store_compact,
    "stream_profiles": q_stream_profiles,
    "top_inner_product": q_top_inner_product,
    "topic_neighbours": q_topic_neighbours,
    "cf_recommend": q_cf_recommend,
    "cf_text_ids": q_cf_text_ids,
    "stream_recommend": q_stream_recommend,
    "in_zone": q_in_zone,
    "pad_vectors": q_pad_vectors,
    "topic_unscale": q_topic_unscale,
    "user_dictionary": q_user_dictionary,
    "user_dictionary_text": q_user_dictionary_text,
}
