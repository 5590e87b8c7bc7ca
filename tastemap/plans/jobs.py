"""The five jobs of the original system as compositions of the operators.

Every job reads tables, runs DataFrame plans and writes tables; nothing is
looped over per user or per article on the driver.  Profiles live in a
base-and-delta store (``sources.delta_store``; tables ``<base>/topics`` and
``<base>/keywords``, log ``<base>/profiles``): an update reads and writes only the
(user, bucket) entries its log touches.  The recommendation table is ``<base>/recs``,
partition ``batch_id``.

* P1 ``build_topic_model``   corpus -> vocabulary + LDA model (saved)
* P2 ``update_profiles``     log -> merged topic/keyword profiles (new versions) + CF model
* P3 ``start_news_stream``     stream of new-article keys -> recommendations
* P4 ``recommend_cf``        CF picks for every user with a profile
* P5 ``recommend_hybrid``    new articles scored by topics + keywords, blended with CF
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.config import DEFAULT_PARAMS, Params
from tastemap.operators import cf, profile as P, similarity as S, text as T, topics as TP
from tastemap.operators.blend import blend_lists, quota_bound
from tastemap.sources import news as N
from tastemap.sources import store as ST
from tastemap.sources.delta_store import DeltaStore, Table
from tastemap.session import ensure_checkpoint_dir, materialise, spread


@dataclass
class Paths:
    """Where a deployment keeps its state.  With ``n_buckets > 0`` the profile
    tables are versioned catalog tables bucketed by (user_id, bucket) under
    ``table_prefix``, so each merge shuffles only the new delta."""
    base: str
    table_prefix: str = ""
    n_buckets: int = 0

    @property
    def model(self): return f"{self.base}/lda"
    @property
    def vocab(self): return f"{self.base}/vocabulary"
    @property
    def topics(self): return f"{self.base}/topics"
    @property
    def keywords(self): return f"{self.base}/keywords"
    @property
    def cf(self): return f"{self.base}/cf"
    @property
    def ids(self): return f"{self.base}/ids"
    @property
    def doc_freq(self): return f"{self.base}/doc_freq"
    @property
    def profiles(self): return f"{self.base}/profiles"
    @property
    def recs(self): return f"{self.base}/recs"


UB = ["user_id", "bucket"]


def profile_store(spark: SparkSession, paths: Paths) -> DeltaStore:
    return DeltaStore(spark, paths.profiles, {"topics": Table(paths.topics, UB),
                                              "keywords": Table(paths.keywords, UB)})


def _committed(spark: SparkSession, paths: Paths) -> dict[str, int] | None:
    """The versions of the topic and keyword tables that belong together."""
    if paths.n_buckets == 0:
        version = profile_store(spark, paths).snapshot().version
        return None if version < 0 else {"topics": version, "keywords": version}
    last = ST.read_latest(spark, paths.profiles)
    return None if last is None else last.first().asDict()


def _read_state(spark: SparkSession, paths: Paths, kind: str) -> DataFrame | None:
    """The committed profile table, or None before the first update."""
    if paths.n_buckets == 0:
        return profile_store(spark, paths).read(kind)
    versions = _committed(spark, paths)
    if versions is None:
        return None
    return ST.read_table_version(spark, f"{paths.table_prefix}{kind}", versions[kind])


def _write_state(spark: SparkSession, df: DataFrame, paths: Paths, kind: str) -> int:
    return ST.write_table_version(spark, df, f"{paths.table_prefix}{kind}", UB, paths.n_buckets)


def _commit(spark: SparkSession, paths: Paths, versions: dict[str, int]) -> None:
    """Make both tables current at once (one small file): a run that fails before
    this leaves the profiles as they were, so its log can be given again."""
    row = spark.createDataFrame([(versions["topics"], versions["keywords"])], "topics int, keywords int")
    ST.write_version(spark, row.coalesce(1), paths.profiles)


def corpus_doc_freq(spark: SparkSession, news: DataFrame, paths: Paths) -> DataFrame:
    """The stored document-frequency deltas, after the articles that were added since
    have been counted (and stored as one more delta): they always cover the corpus."""
    corpus = spread(_corpus(news))
    new = T.added_docs(corpus, ST.read_all(spark, paths.doc_freq))
    if not new.isEmpty():
        ST.write_version(spark, T.doc_freq_delta(new), paths.doc_freq)
    stored = ST.read_all(spark, paths.doc_freq)
    return stored if stored is not None else T.doc_freq_delta(corpus)


def _corpus(news: DataFrame) -> DataFrame:
    return news.select(F.col("rowkey").alias("doc_id"), F.coalesce("words", F.lit("")).alias("words"))


def build_topic_model(spark: SparkSession, news: DataFrame, paths: Paths,
                      params: Params = DEFAULT_PARAMS, limit: int | None = None,
                      optimizer: str = "em") -> TP.TopicModel:
    """P1: (optionally limited) corpus -> vocabulary table + LDA model."""
    corpus = _corpus(N.scan(news, limit))
    model = TP.build_topic_model(corpus, params, optimizer=optimizer)
    model.save(paths.model)
    (spark.createDataFrame([(i, t) for i, t in enumerate(model.vocab)], "idx int, term string")
     .write.mode("overwrite").parquet(paths.vocab))
    # corpus document frequencies, so profile updates tokenise only what was read
    corpus_doc_freq(spark, news, paths)
    return model


def article_topics_from_model(model: TP.TopicModel, news: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(doc_id, topic) inferred for the given articles (text '' when missing)."""
    texts = N.attach_words(doc_ids.select("doc_id").distinct(), news)
    return TP.infer(model, texts.select("doc_id", "words"))


def update_profiles(spark: SparkSession, log: DataFrame, news: DataFrame, paths: Paths,
                    article_topics: DataFrame | None = None, model: TP.TopicModel | None = None,
                    params: Params = DEFAULT_PARAMS, train_cf: bool = True,
                    batch: tuple[str, int] | None = None) -> tuple[int, int]:
    """P2: merge the log into the stored profiles; returns the new versions.

    ``log``: (user_id, doc_id, behaviour, weight, bucket, ts), doc_id being the key
    of the article in the corpus; with ``article_id``, the published id of the article,
    the CF model keeps the last id seen for each key.  Topic vectors come from
    ``article_topics`` or are inferred with ``model``.  ``batch`` = (producer, number)
    makes the update exactly-once: a batch already merged adds nothing.
    """
    # the log feeds five aggregations: parse it once and keep the typed rows in
    # the shared checkpoint folder (also cuts the lineage before the merges)
    ensure_checkpoint_dir(spark)
    extra = [c for c in ("ts", "article_id") if c in log.columns]
    log = log.select("user_id", "doc_id", "behaviour", "weight", "bucket", *extra)
    log = materialise(log, "profile-log")
    width = None
    if article_topics is None:
        model = model or TP.TopicModel.load(paths.model)
        article_topics, width = article_topics_from_model(model, news, log), model.lda.getK()
    delta = P.topic_delta(log, article_topics, width)
    # article keywords: IDF over the whole corpus (the read articles are part of
    # it) from the stored frequencies; only the articles read here are tokenised
    read = N.select_keys(spread(_corpus(news)), log.where("doc_id IS NOT NULL").select("doc_id").distinct(),
                         "doc_id", "doc_id")
    kw = T.keywords_with_df(read, corpus_doc_freq(spark, news, paths), params.keywords_per_doc, keep_raw=True)
    new_kw = P.keyword_delta(log, kw, params.keywords_per_update)

    def merged(old_t: DataFrame | None, old_k: DataFrame | None) -> dict[str, DataFrame]:
        return {"topics": P.topics_from_delta(delta) if old_t is None else P.merge_topics(old_t, delta),
                "keywords": (P.initial_keywords(new_kw) if old_k is None else
                             P.merge_keywords(old_k, new_kw, params.keyword_existing, params.keyword_threshold))}

    if paths.n_buckets > 0:
        new = merged(_read_state(spark, paths, "topics"), _read_state(spark, paths, "keywords"))
        versions = {kind: _write_state(spark, new[kind], paths, kind) for kind in ("topics", "keywords")}
        _commit(spark, paths, versions)
    else:
        # read again for every attempt of the commit, and to find the touched entries
        delta, new_kw = materialise(delta, "profile-topics"), materialise(new_kw, "profile-keywords")
        store = profile_store(spark, paths)
        at = store.transact(lambda at: merged(store.read("topics", at, touched=delta),
                                              store.read("keywords", at, touched=new_kw)), batch)
        versions = {"topics": at.version, "keywords": at.version}
    if train_cf:
        cf.train(log, params, ids=paths.ids).save(paths.cf)
    return versions["topics"], versions["keywords"]


def start_profile_stream(spark: SparkSession, lines: DataFrame, news: DataFrame, paths: Paths,
                         article_topics: DataFrame | None = None, params: Params = DEFAULT_PARAMS,
                         trigger: dict | None = None, user_type: str = "string", key_type: str = "string"):
    """P2 as a stream: behaviour-log lines (streaming ``value`` column) are merged into the
    stored profiles one micro-batch at a time.  Each batch is committed together with its
    number under the id of the stream's checkpoint, so a batch that Spark replays after a
    crash is merged exactly once.  Unusable lines are left out (``sources.log`` says why).
    Users and row keys arrive as text and are cast to the given types.  Returns the
    StreamingQuery."""
    from tastemap.sources.log import parse_log
    from tastemap.streaming.recommend import stream_job

    checkpoint = f"{paths.base}/profile-checkpoint"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        good, _bad = parse_log(batch, weights=params.behaviour_weights)
        log = good.select(F.col("user_id").try_cast(user_type).alias("user_id"),
                          F.col("rowkey").try_cast(key_type).alias("doc_id"),
                          "behaviour", "weight", "bucket", "ts").where("user_id IS NOT NULL AND doc_id IS NOT NULL")
        update_profiles(batch.sparkSession, log, news, paths, article_topics, params=params, train_cf=False,
                        batch=(stream_job(batch.sparkSession, checkpoint), batch_id))

    w = lines.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def start_news_stream(spark: SparkSession, source: DataFrame, news: DataFrame, paths: Paths,
                      params: Params = DEFAULT_PARAMS, trigger: dict | None = None,
                      bucket: str | None = None):
    """P3: new-article keys (streaming ``value`` column) -> text lookup -> LDA
    inference -> exact cosine against the stored profiles -> ``paths.recs``.
    ``bucket`` defaults to ``params.profile_bucket``; ``"current"`` follows
    the clock.  Returns the StreamingQuery."""
    from tastemap.streaming.recommend import start_recommend_stream, topics_from_model

    def topics():
        """(version, profiles) as committed now: asked again in every micro-batch."""
        table = _read_state(spark, paths, "topics")
        if table is None:
            raise ValueError("no profiles yet: run update_user_model first")
        return _committed(spark, paths)["topics"], table.select("user_id", "bucket", "topic")
    provider = topics_from_model(TP.TopicModel.load(paths.model), news)
    key_type = news.schema["rowkey"].dataType.simpleString()  # keys arrive as text
    return start_recommend_stream(source, topics, provider, paths.recs,
                                  f"{paths.base}/stream-checkpoint", params, trigger,
                                  key_type=key_type, bucket=bucket or params.profile_bucket)


def recommend_cf(spark: SparkSession, paths: Paths, params: Params = DEFAULT_PARAMS,
                 batch_id: int | None = None) -> DataFrame:
    """P4: CF picks for every user with a profile in the recommendation bucket,
    appended with the articles' published ids.  ``batch_id`` only to replay a batch."""
    model = cf.CFModel.load(spark, paths.cf)
    users = (_read_state(spark, paths, "topics")
             .where(F.col("bucket") == params.profile_bucket).select("user_id"))
    recs = cf.recommend(model, users, params.cf_items)
    ST.append_batch(recs.select("user_id", F.col("article_id").alias("doc_id"), F.lit("cf").alias("source")),
                    paths.recs, batch_id, job="cf")
    return recs


def recommend_hybrid(spark: SparkSession, new_docs: DataFrame, news: DataFrame, paths: Paths,
                     new_topics: DataFrame | None = None, params: Params = DEFAULT_PARAMS,
                     batch_id: int | None = None, with_cf: bool = True) -> DataFrame:
    """P5: score new articles (doc_id, words) against the stored profiles by
    topic cosine and keyword Jaccard, keep score > threshold, blend with CF."""
    ensure_checkpoint_dir(spark)
    if new_topics is None:
        # inferred once (used by the size check and the join), kept as a checkpoint
        new_topics = TP.infer(TP.TopicModel.load(paths.model), new_docs).checkpoint(eager=True)
    b = params.profile_bucket
    prof = _read_state(spark, paths, "topics").where(F.col("bucket") == b).select("user_id", "topic")
    terms = _read_state(spark, paths, "keywords").where(F.col("bucket") == b).select("user_id", "term")
    # the corpus side comes from the stored frequencies: only new articles are tokenised
    new_kw = T.keywords_new_with_df(new_docs, corpus_doc_freq(spark, news, paths), params.keywords_per_doc)
    scored = S.hybrid_join(prof, new_topics, terms, new_kw.select("doc_id", "term"),
                           ["user_id"], ["doc_id"], "topic", "topic", params.min_similarity,
                           params.topic_weight, params.keyword_weight,
                           salt_buckets=params.salt_buckets, checkpoint_pairs=True,
                           keyword_floor=params.keyword_floor)
    # used for the quota bound and the blend: computed once (reliable checkpoint)
    content = scored.select("user_id", "doc_id", F.col("score")).checkpoint(eager=True)
    if with_cf:
        model = cf.CFModel.load(spark, paths.cf)
        # CF lists exactly as long as the largest quota any user can get
        # (quota = floor(n * ratio) for n > 5 content picks, else 1): one scalar
        n_max = content.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
        q_max = quota_bound(n_max, params.cf_blend_ratio)
        cf_recs = cf.recommend(model, content.select("user_id").distinct(),
                               q_max).select("user_id", F.col("article_id").alias("doc_id"), "score")
        out = blend_lists(content, cf_recs, params.cf_blend_ratio, max_quota=q_max)
    else:
        out = content.select("user_id", "doc_id", F.lit("content").alias("source"))
    ST.append_batch(out.select("user_id", "doc_id", "source"), paths.recs, batch_id, job="hybrid")
    return out
