"""User interest profiles per (user, time-of-day bucket).

Flat storage (one plan each, nothing per user on the driver):
* topics:   (user_id, bucket, topic array<double> [mean], news_cnt bigint)
* keywords: (user_id, bucket, term, weight)
Nested view for API parity: (user_id, interest array<struct<time, topic,
newsCnt, keywords array<struct<keyword, weight>>>>).

Update rules
* topics: ``topic = (new_sum + old_topic*old_cnt) / (old_cnt + n)``,
  ``cnt = old_cnt + n``; new_sum[k] = sum over new events of weight*topic(article)[k],
  n = number of new events (articles without a vector count too).  Buckets
  without new events are unchanged.  This is a mergeable sum/count, so merging
  two halves equals the profile of the whole log.
* keywords: candidate weight = max over events of tfidf(term, article) *
  weight(behaviour), article keywords being its top-k by TF-IDF; top-k
  candidates per bucket are merged: a stored term gets old+new ('add') or
  stays ('keep'); a new term is admitted iff its weight > threshold(stored
  weights): their median ('median', 0.0 when none) or, as originally coded,
  the largest weight when there are at least two stored terms, else 0.0 ('max').
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemap.functions.scalar import merge_mean

UB = ["user_id", "bucket"]


def topic_delta(log: DataFrame, article_topics: DataFrame, width: int | None = None) -> DataFrame:
    """(user_id, bucket, topic_sum array<double>, n bigint).

    The log is pre-aggregated per (user, bucket, article); the weighted vector sum is one
    map-side combined aggregate with a plain sum for every component, so a group travels as
    ``width`` numbers.  All vectors must have the same length, ``width`` (looked up if not given)."""
    pre = (log.groupBy("user_id", "bucket", "doc_id")
           .agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")))
    cnt = pre.groupBy(*UB).agg(F.sum("n").alias("n"))       # articles without a vector count too
    none = F.array().cast("array<double>")
    vec = article_topics.where(F.size("topic") > 0)
    if width is None:
        first = vec.select(F.size("topic")).first()
        width = first[0] if first else 0
    if not width:
        return cnt.select(*UB, none.alias("topic_sum"), "n")
    same = F.when(F.size("topic") == width, F.col("topic")).otherwise(
        F.raise_error(F.lit(f"topic vectors differ in length from {width}")))
    rows = pre.join(vec.select("doc_id", same.alias("_v")), "doc_id")
    parts = [f"_s{i}" for i in range(width)]
    sums = rows.groupBy(*UB).agg(*[F.sum(F.col("w") * F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0))).alias(c)
                                   for i, c in enumerate(parts)]).select(*UB, F.array(*parts).alias("topic_sum"))
    return cnt.join(sums, UB, "left").select(*UB, F.coalesce("topic_sum", none).alias("topic_sum"), "n")


def topic_delta_long(log: DataFrame, article_topics: DataFrame) -> DataFrame:
    """(user_id, bucket, k, topic_sum, cnt)."""
    return topic_delta(log, article_topics).select(
        *UB, F.posexplode("topic_sum").alias("k", "topic_sum"), F.col("n").alias("cnt"))


def topics_from_delta(delta: DataFrame) -> DataFrame:
    """A first profile (no stored state): mean = sum / n."""
    return delta.select(*UB, F.transform("topic_sum", lambda x: x / F.col("n")).alias("topic"),
                        F.col("n").alias("news_cnt"))


def merge_topics(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Full outer merge of stored topics with a delta (running mean)."""
    o = old.select(*UB, F.col("topic").alias("_ot"), F.col("news_cnt").alias("_oc"))
    d = delta.select(*UB, "topic_sum", "n")
    j = o.join(d, UB, "full_outer")
    has_new = F.coalesce(F.col("n"), F.lit(0)) > 0
    topic = F.when(has_new, merge_mean("topic_sum", "_ot", "_oc", "n")).otherwise(F.col("_ot"))
    cnt = F.coalesce("_oc", F.lit(0)) + F.coalesce("n", F.lit(0))
    return j.select(*UB, topic.alias("topic"), cnt.cast("long").alias("news_cnt"))


def read_topics(topics: DataFrame, users: DataFrame, bucket: str | None = None) -> DataFrame:
    """Stored topic vector and count of each requested (user[, bucket]);
    a missing entry reads as an empty vector and count 0 (no side effects)."""
    keys = ["user_id"] + (["bucket"] if "bucket" in users.columns else [])
    t = topics if bucket is None else topics.where(F.col("bucket") == bucket)
    return (users.join(t, keys, "left")
            .select(*users.columns,
                    F.coalesce("topic", F.array().cast("array<double>")).alias("topic"),
                    F.coalesce("news_cnt", F.lit(0)).cast("long").alias("news_cnt")))


def read_keywords(keywords: DataFrame, users: DataFrame, bucket: str | None = None) -> DataFrame:
    """Stored keyword -> weight map of each requested (user[, bucket]); a
    missing entry reads as an empty map (no side effects).  One map per
    profile entry, bounded by that profile's keyword list."""
    keys = ["user_id"] + (["bucket"] if "bucket" in users.columns else [])
    k = keywords if bucket is None else keywords.where(F.col("bucket") == bucket)
    maps = (k.groupBy(*keys)
            .agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("keywords")))
    return (users.join(maps, keys, "left")
            .select(*users.columns, F.coalesce("keywords", F.create_map().cast(
                "map<string,double>")).alias("keywords")))


def keyword_delta(log: DataFrame, article_keywords: DataFrame, top: int = 10) -> DataFrame:
    """(user_id, bucket, term, weight): top ``top`` candidates per bucket."""
    pre = log.groupBy("user_id", "bucket", "doc_id").agg(F.max("weight").alias("bw"))
    cand = (pre.join(article_keywords.select("doc_id", "term", "weight"), "doc_id")
            .groupBy(*UB, "term").agg(F.max(F.col("weight") * F.col("bw")).alias("weight")))
    w = Window.partitionBy(*UB).orderBy(F.desc("weight"), F.asc("term"))
    return (cand.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= top)
            .drop("_rk"))


def keyword_threshold(old: DataFrame, mode: str = "median") -> DataFrame:
    """(user_id, bucket, thr) admission threshold of stored keyword weights."""
    if mode == "median":
        agg = F.median("weight")
    elif mode == "max":
        agg = F.when(F.count(F.lit(1)) >= 2, F.max("weight")).otherwise(F.lit(0.0))
    else:
        raise ValueError(f"unknown threshold mode {mode!r}")
    return old.groupBy(*UB).agg(agg.cast("double").alias("thr"))


def merge_keywords(old: DataFrame, new: DataFrame, existing: str = "add",
                   threshold: str = "median") -> DataFrame:
    """Merge stored keywords with new top candidates (see module doc)."""
    if existing not in ("add", "keep"):
        raise ValueError(f"unknown mode {existing!r}")
    o = old.select(*UB, "term", F.col("weight").alias("_ow"))
    thr = keyword_threshold(old, threshold)
    n = (new.select(*UB, "term", F.col("weight").alias("_nw"))
         .join(thr, UB, "left"))
    j = o.join(n, UB + ["term"], "full_outer")
    both = F.col("_ow").isNotNull() & F.col("_nw").isNotNull()
    new_only = F.col("_ow").isNull()
    admit = F.col("_nw") > F.coalesce(F.col("thr"), F.lit(0.0))
    weight = (F.when(both, (F.col("_ow") + F.col("_nw")) if existing == "add" else F.col("_ow"))
              .when(new_only, F.when(admit, F.col("_nw")))
              .otherwise(F.col("_ow")))
    return j.select(*UB, "term", weight.alias("weight")).where(F.col("weight").isNotNull())


def initial_keywords(new: DataFrame) -> DataFrame:
    """Merge into an empty store: the threshold of no keywords is 0.0."""
    return new.where(F.col("weight") > 0).select(*UB, "term", "weight")


def to_nested(topics: DataFrame, keywords: DataFrame) -> DataFrame:
    """Nested per-user document.  Groups are bounded: at most 4 buckets per
    user and one keyword list per (user, bucket)."""
    kw = (keywords.groupBy(*UB)
          .agg(F.array_sort(F.collect_list(F.struct(F.col("term").alias("keyword"),
                                                     F.col("weight")))).alias("keywords")))
    t = topics.select(*UB, "topic", "news_cnt")
    j = t.join(kw, UB, "full_outer")
    entry = F.struct(F.col("bucket").alias("time"),
                     F.coalesce("topic", F.array().cast("array<double>")).alias("topic"),
                     F.coalesce("news_cnt", F.lit(0)).cast("long").alias("newsCnt"),
                     F.coalesce("keywords", F.array().cast(
                         "array<struct<keyword:string,weight:double>>")).alias("keywords"))
    return (j.groupBy("user_id")
            .agg(F.array_sort(F.collect_list(entry)).alias("interest")))


def nested_topics(nested: DataFrame) -> DataFrame:
    e = nested.select("user_id", F.explode("interest").alias("e"))
    return e.select("user_id", F.col("e.time").alias("bucket"), F.col("e.topic").alias("topic"),
                    F.col("e.newsCnt").alias("news_cnt"))


def nested_keywords(nested: DataFrame) -> DataFrame:
    e = nested.select("user_id", F.explode("interest").alias("e"))
    k = e.select("user_id", F.col("e.time").alias("bucket"), F.explode("e.keywords").alias("kw"))
    return k.select("user_id", "bucket", F.col("kw.keyword").alias("term"),
                    F.col("kw.weight").alias("weight"))


def users_for_bucket(nested: DataFrame, bucket: str) -> DataFrame:
    """(user_id, topic, keywords array<string>) of every user for one bucket."""
    e = nested.select("user_id", F.explode("interest").alias("e")).where(F.col("e.time") == bucket)
    return e.select("user_id", F.col("e.topic").alias("topic"),
                    F.transform("e.keywords", lambda k: k["keyword"]).alias("keywords"))
