"""Text operators in long form ``(doc_id, term, tf)``: exact terms, no hashing,
so no collisions and no positional joins.

TF-IDF follows the classic MLlib definition: ``tf * ln((m + 1) / (df + 1))``
with raw term counts, m = number of documents in scope (documents without any
token count too) and df over the same scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.config import DEFAULT_STOP_WORDS
from tastemap.functions.text import tokens_regex_gap, tokens_regex_match, tokens_ws
from tastemap.operators.terms import doc_freqs, frequency_bounds, term_counts, top_candidates
from tastemap.session import materialise, spread
from tastemap.sources.news import bit_of

TOKENIZERS = {"ws": tokens_ws, "gap": tokens_regex_gap, "match": tokens_regex_match}


def tokens(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "words",
           tokenizer: str = "ws", extra: list[str] | None = None) -> DataFrame:
    """(doc_col, term) one row per token occurrence (whole texts).

    The split tokenisers only drop empty strings; that test runs on the
    exploded rows (a codegen'd filter) rather than as a lambda per array."""
    keep = list(extra or [])
    text = F.coalesce(F.col(text_col), F.lit(""))
    if tokenizer == "ws":
        raw = F.split(text, " ")
    elif tokenizer == "gap":
        raw = F.split(F.lower(text), r"\s+")
    else:
        return docs.select(doc_col, *keep, F.explode(TOKENIZERS[tokenizer](F.col(text_col))).alias("term"))
    return (docs.select(doc_col, *keep, F.explode(raw).alias("term"))
            .where(F.col("term") != ""))


def drop_stopwords(toks: DataFrame, stopwords=None, term: str = "term") -> DataFrame:
    """Remove stop words (default: ``config.DEFAULT_STOP_WORDS``).  A Python list becomes an ``IN`` filter (no join);
    a DataFrame of words (column ``word``) becomes a left-anti join whose
    build side Spark sizes and broadcasts."""
    if stopwords is None:
        stopwords = DEFAULT_STOP_WORDS
    if isinstance(stopwords, DataFrame):
        sw = stopwords.select(F.col("word").alias(term)).distinct()
        return toks.join(sw, term, "left_anti")
    return toks.where(~F.col(term).isin(list(stopwords)))


TEXT_PER_TASK = 16 << 20    # characters whose (document, term) counts one task holds


def _text_tasks(docs: DataFrame, text_col: str) -> int:
    """Partitions for counting terms: as set for shuffles, more if the texts are large (a
    number that is given is kept, so small partitions are not merged into large tasks)."""
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(chars) // TEXT_PER_TASK))


def _in_tasks(rows: DataFrame, tasks: int, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to ``tasks`` partitions, if they need more than are set for
    shuffles (else a join or window deals them out itself, and AQE splits hot keys): what one
    task sorts then stays the same as the texts grow."""
    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, key) if tasks > few else rows


def term_freq(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "words",
              tokenizer: str = "ws", stopwords=False, extra: list[str] | None = None,
              by_doc: bool = True, tasks: int | None = None) -> DataFrame:
    """(doc_col, [extra], term, tf).

    With ``by_doc`` the documents are hash-partitioned on the document key
    before tokenising: the text is shuffled once (smaller than its tokens; a
    document is bounded, so no hot key) and the (doc, term) aggregation and
    any later per-document window run without another exchange."""
    # documents without an id cannot be keyed; filtering them here also keeps
    # every use of this plan identical, so Spark reuses one shuffle for all
    docs = docs.where(F.col(doc_col).isNotNull())
    if by_doc:
        docs = docs.repartition(tasks or _text_tasks(docs, text_col), doc_col)
    t = tokens(docs, doc_col, text_col, tokenizer, extra)
    if stopwords is not False:
        t = drop_stopwords(t, stopwords)
    return t.groupBy(doc_col, *(extra or []), "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_freq(tf: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(term, df): number of documents containing the term (map-side combined,
    so a term present in most documents is not a hot key for the shuffle)."""
    return tf.groupBy(*(scope or []), "term").agg(F.count(F.lit(1)).alias("df"))


def idf(tf: DataFrame, n_docs: Column, doc_col: str = "doc_id",
        scope: list[str] | None = None) -> DataFrame:
    """(term, df, idf) with idf = ln((m+1)/(df+1)); ``n_docs`` is m, usually a
    scalar subquery over the document table."""
    df = doc_freq(tf, scope)
    return df.withColumn("idf", F.log((n_docs + F.lit(1)) / (F.col("df") + F.lit(1))))


def tfidf(tf: DataFrame, idf_df: DataFrame, doc_col: str = "doc_id",
          scope: list[str] | None = None) -> DataFrame:
    """(doc_col, term, weight).  Join on the term; frequent terms are hot keys,
    which AQE's skew-join splitting handles (the df side has one row per term)."""
    keys = (scope or []) + ["term"]
    return (tf.join(idf_df.select(*keys, "idf"), keys)
            .select(doc_col, *(scope or []), "term",
                    (F.col("tf") * F.col("idf")).alias("weight")))


def top_per_group(df: DataFrame, group: list[str], weight: str, n: int,
                  tie: str = "term", rank_col: str | None = None,
                  round_to: int | None = None, keep_raw: bool = False) -> DataFrame:
    """Top-n rows per group by weight desc, ties by ``tie`` (a window with a
    row_number filter, which Spark plans as a per-group limit).  With
    ``round_to`` the ranking uses the rounded weight (stable ties); the
    output weight is rounded too unless ``keep_raw``."""
    key = F.round(weight, round_to) if round_to is not None else F.col(weight)
    w = Window.partitionBy(*group).orderBy(key.desc(), F.asc(tie))
    rk = rank_col or "_rk"
    out = df.withColumn(rk, F.row_number().over(w)).where(F.col(rk) <= n)
    if round_to is not None and not keep_raw:
        out = out.withColumn(weight, F.round(weight, round_to))
    return out if rank_col else out.drop(rk)


def keywords(docs: DataFrame, top: int = 10, doc_col: str = "doc_id",
             text_col: str = "words", round_to: int | None = 6,
             keep_raw: bool = False) -> DataFrame:
    """Top TF-IDF keywords of every document, IDF over the same documents,
    ranked by the weight rounded to ``round_to`` places (ties by term).
    Returns (doc_col, term, weight, rk); ``keep_raw`` keeps the unrounded weight."""
    tasks = _text_tasks(docs, text_col)
    m, docs = docs.count(), spread(docs)
    df = materialise(doc_freqs(docs, doc_col, text_col, tasks), "doc-freqs")     # used three times
    idf_t = df.select("term", F.log((F.lit(m) + F.lit(1)) / (F.col("df") + F.lit(1))).alias("idf"))
    some = top_candidates(docs, frequency_bounds(df, m, COMMON_SHARE, DF_BUCKETS), top, round_to, doc_col, text_col,
                          tasks=tasks)
    w = tfidf(_in_tasks(some, tasks, "term"), _in_tasks(idf_t, tasks, "term"), doc_col)
    return top_per_group(_in_tasks(w, tasks, doc_col), [doc_col], "weight", top, rank_col="rk", round_to=round_to,
                         keep_raw=keep_raw)


COMMON_SHARE = 1000      # a term in more than one of so many documents has its own entry
DF_BUCKETS = 1 << 19     # of the frequencies of all other terms


def can_be_top(tf: DataFrame, df: DataFrame, n_docs: Column, top: int, round_to: int | None,
               doc_col: str = "doc_id", covered: bool = True) -> DataFrame:
    """The rows of ``tf`` whose term can be among the ``top`` TF-IDF terms of its document.
    ``covered``: ``df`` (term, df) holds every term of ``tf``; if it need not, only common
    terms count for the lower bounds, as a hash cannot tell that a term is missing.

    Two small tables are broadcast: the frequencies of common terms (at most ``COMMON_SHARE``
    times the terms of an average document) and, for ``DF_BUCKETS`` hashes of the others, the
    least and largest frequency.  They bound every weight; a row stays if its upper bound
    reaches the ``top``-th largest lower bound of its document.  So only these few rows meet
    the exact frequencies, instead of one row per document and term."""
    hashed = F.xxhash64("term").bitwiseAND(F.lit(DF_BUCKETS - 1))     # never null: no filter that keeps
    # Spark from counting ``df`` once for both tables
    is_common = F.col("df") * F.lit(COMMON_SHARE) > n_docs
    common = df.where(is_common).select("term", F.col("df").alias("_df"))
    others = df.where(~is_common).groupBy(hashed.alias("_b")).agg(F.min("df").alias("_lo"), F.max("df").alias("_hi"))
    rows = (tf.join(F.broadcast(common), "term", "left").withColumn("_b", hashed)
            .join(F.broadcast(others), "_b", "left"))
    weight = lambda f: F.col("tf") * F.log((n_docs + F.lit(1)) / (F.coalesce(F.col("_df"), f) + F.lit(1)))
    rows = rows.select(*tf.columns, weight(F.col("_hi") if covered else F.lit(None)).alias("_least"),
                       weight(F.col("_lo")).alias("_most"))
    w = Window.partitionBy(doc_col).orderBy(F.desc("_least")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    # room for the rounding of the ranked weights: too many rows are harmless
    slack = 1e-9 if round_to is None else 2 * 10.0 ** -round_to
    rows = rows.withColumn("_floor", F.nth_value("_least", top).over(w))
    return rows.where(F.col("_floor").isNull() | (F.col("_most") >= F.col("_floor") - slack)).select(*tf.columns)


def _integral(docs: DataFrame, col: str) -> bool:
    return isinstance(docs.schema[col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def doc_freq_delta(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "words") -> DataFrame:
    """Document frequencies of some documents, to be stored and added up:
    (doc_id string, bucket long, bitmap binary, term, df).  A row with a term counts the
    documents that have it; the other rows say which documents have been counted.  Whole
    numbers are kept as bitmaps (one row of 4 KB for 32,768 ids, built map-side); other ids
    as one row each."""
    has = docs.where(F.col(doc_col).isNotNull())
    if _integral(docs, doc_col):
        key = F.col(doc_col).cast("long")
        counted = has.groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bitmap"))
    else:
        counted = has.select(F.col(doc_col).cast("string").alias("doc_id"))
    terms = doc_freqs(docs, doc_col, text_col)
    schema = {"doc_id": "string", "bucket": "long", "bitmap": "binary", "term": "string", "df": "long"}

    def full(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(c) if c in rows.columns else F.lit(0 if c == "df" else None).cast(t).alias(c)
                             for c, t in schema.items()])
    return full(counted).unionByName(full(terms))


def _counted(deltas: DataFrame) -> DataFrame:
    """(bucket, bitmap): one row per bucket of all ids that are kept as bitmaps."""
    return deltas.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def added_docs(docs: DataFrame, stored: DataFrame | None, doc_col: str = "doc_id") -> DataFrame:
    """The documents that the stored deltas have not counted yet.

    Whole-number ids look up their bit: the join is on the bucket, with one row for 32,768
    ids on the stored side, and at most as many distinct ids in one key.  Other ids are
    anti-joined one by one."""
    if stored is None:
        return docs
    if not _integral(docs, doc_col):
        seen = stored.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_seen")).distinct()
        return docs.join(seen, F.col(doc_col).cast("string") == F.col("_seen"), "left_anti")
    key = F.col(doc_col).cast("long")
    seen = _counted(stored).select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap"))
    rows = docs.join(seen, F.bitmap_bucket_number(key) == F.col("_bucket"), "left")
    return rows.where(F.coalesce(bit_of("_bitmap", key), F.lit(0)) == 0).select(*docs.columns)


def total_doc_freq(deltas: DataFrame) -> tuple[DataFrame, Column]:
    """((term, df) summed over all deltas, the number of documents counted)."""
    terms = deltas.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    ids = deltas.where(F.col("doc_id").isNotNull()).select(F.count_distinct("doc_id")).scalar()
    bits = _counted(deltas).select(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0))).scalar()
    return terms, ids + bits


def keywords_with_df(docs: DataFrame, deltas: DataFrame, top: int = 10,
                     doc_col: str = "doc_id", text_col: str = "words",
                     round_to: int | None = 6, keep_raw: bool = False) -> DataFrame:
    """Top keywords of corpus documents ``docs`` (a subset, e.g. the articles
    read in one batch) with the IDF of the whole corpus taken from stored
    ``doc_freq_delta`` tables that cover it: only the subset is tokenised.  Same
    result as ``keywords`` over the whole corpus, restricted to ``docs``."""
    tasks = _text_tasks(docs, text_col)
    terms, m = total_doc_freq(deltas)
    terms = materialise(terms, "doc-freqs")     # used three times
    m = docs.sparkSession.range(1).select(m).first()[0]
    idf_t = terms.select("term", F.log((F.lit(m) + F.lit(1)) / (F.col("df") + F.lit(1))).alias("idf"))
    bounds = frequency_bounds(terms, m, COMMON_SHARE, DF_BUCKETS)
    some = materialise(top_candidates(docs, bounds, top, round_to, doc_col, text_col, tasks=tasks), "keyword-candidates")
    # the terms that made up a document's bounds are among its candidates; if one was never counted
    # (a text that changed since), the document is done again without trusting its hashed terms
    odd = _in_tasks(some.select(doc_col, "term"), tasks, "term").join(
        _in_tasks(terms.select("term"), tasks, "term"), "term", "left_anti").select(doc_col).distinct()
    odd = materialise(odd, "keyword-changed")
    if not odd.isEmpty():
        again = top_candidates(docs.join(odd, doc_col, "left_semi"), bounds, top, round_to, doc_col, text_col,
                               covered=False, tasks=tasks)
        some = some.join(odd, doc_col, "left_anti").unionByName(again)
    w = tfidf(_in_tasks(some, tasks, "term"), _in_tasks(idf_t, tasks, "term"), doc_col)
    return top_per_group(_in_tasks(w, tasks, doc_col), [doc_col], "weight", top, rank_col="rk", round_to=round_to,
                         keep_raw=keep_raw)


def keywords_new_with_df(new_docs: DataFrame, deltas: DataFrame, top: int = 10,
                         round_to: int | None = 6, keep_raw: bool = False) -> DataFrame:
    """``keywords_new_vs_corpus`` with the corpus side taken from stored
    ``doc_freq_delta`` tables: each batch tokenises only its new documents, and
    only their terms are looked up in the corpus frequencies."""
    tf_n = term_freq(new_docs)
    df_n = doc_freq(tf_n)
    terms, m_c = total_doc_freq(deltas)
    m = new_docs.select(F.count(F.lit(1))).scalar() + F.coalesce(m_c, F.lit(0))
    df = (df_n.join(terms.select("term", F.col("df").alias("df_c")), "term", "left")
          .select("term", (F.col("df") + F.coalesce("df_c", F.lit(0))).alias("df")))
    idf_u = df.withColumn("idf", F.log((m + F.lit(1)) / (F.col("df") + F.lit(1))))
    w = tfidf(tf_n, idf_u, "doc_id")
    return top_per_group(w, ["doc_id"], "weight", top, rank_col="rk", round_to=round_to,
                         keep_raw=keep_raw)


def keywords_new_vs_corpus(new_docs: DataFrame, corpus: DataFrame, top: int = 10,
                           round_to: int | None = 6, keep_raw: bool = False) -> DataFrame:
    """Top keywords of new documents with the IDF over new ∪ corpus (both
    (doc_id, words)).  Returns (doc_id, term, weight, rk).

    The union's document frequency is df_corpus + df_new, so the corpus side
    is the same term-frequency plan as every other corpus query (Spark reuses
    its shuffle) and only the new documents' terms are looked up in it."""
    tf_n = term_freq(new_docs)
    df_n = doc_freq(tf_n)
    df_c = doc_freq(term_freq(corpus)).withColumnRenamed("df", "df_c")
    m = (new_docs.select(F.count(F.lit(1))).scalar()
         + corpus.select(F.count(F.lit(1))).scalar())
    df = (df_n.join(df_c, "term", "left")
          .select("term", (F.col("df") + F.coalesce("df_c", F.lit(0))).alias("df")))
    idf_u = df.withColumn("idf", F.log((m + F.lit(1)) / (F.col("df") + F.lit(1))))
    w = tfidf(tf_n, idf_u, "doc_id")
    return top_per_group(w, ["doc_id"], "weight", top, rank_col="rk", round_to=round_to,
                         keep_raw=keep_raw)


FILTER_BITS = 16_384     # of a user's candidate-term filter


def _scope_weight(x: Column, log_m: Column, df_u: Column) -> Column:
    return x["tf"] * (log_m - F.log(x["df_c"] + df_u + 1))


def _scope_rows(reads: DataFrame, corpus: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame, Column]:
    """(user_id, doc_id, r, m_u, r_max) per read article, (doc_id, terms, best) per corpus
    article that is read, and the corpus size.  ``best`` are the terms that can be among the
    ``top`` for some user, by the bounds of ``scope_candidates`` at the largest m_u and r_max:
    computed once an article instead of once a read."""
    corpus = spread(corpus)
    tf = term_counts(corpus, "doc_id", "words")
    df_c = doc_freqs(corpus, "doc_id", "words").withColumnRenamed("df", "df_c")
    rc = reads.groupBy("user_id", "doc_id").agg(F.count(F.lit(1)).alias("r"))
    per_user = rc.groupBy("user_id").agg(F.sum("r").alias("m_u"), F.max("r").alias("r_max"))
    packed = tf.join(df_c, "term").groupBy("doc_id").agg(
        F.collect_list(F.struct("term", "tf", "df_c", F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS)).cast(
            "int").alias("bit"))).alias("terms"))     # bounded by a document
    packed = packed.join(rc.select("doc_id").distinct(), "doc_id", "left_semi")
    m = corpus.select(F.count(F.lit(1))).scalar()
    most = per_user.agg(F.max("m_u").alias("m_u"), F.max("r_max").alias("r_max"))
    packed = packed.withColumns({"_m": m, "_mu": most.select("m_u").scalar(), "_rm": most.select("r_max").scalar()})
    packed = packed.withColumns({"_lo": F.log(F.col("_m") + 2), "_hi": F.log(F.col("_m") + F.col("_mu") + 1)})
    least = F.transform("terms", lambda x: _scope_weight(x, F.col("_lo"), F.least("_mu", F.col("_rm") * x["df_c"])))
    packed = packed.withColumn("_floor", F.get(F.sort_array(least, asc=False), top - 1))
    best = F.filter("terms", lambda x: F.col("_floor").isNull() | (
        _scope_weight(x, F.col("_hi"), F.lit(1)) >= F.col("_floor") - 1e-5))
    # of all terms only the term and its place in the filter are looked at again
    terms = F.transform("terms", lambda x: F.struct(x["term"].alias("term"), x["bit"].alias("bit")))
    return rc.join(per_user, "user_id"), packed.select("doc_id", terms.alias("terms"), best.alias("best")), m


def scope_candidates(rows: DataFrame, packed: DataFrame, m: Column, top: int,
                     round_to: int | None) -> DataFrame:
    """``rows`` with ``cand``: the terms of the article that can be among its ``top`` for the
    user.  The user's frequency of a term lies between r (this article's reads) and
    r + min(m_u - r, r_max * (df_c - 1)), the reads of all other articles with it; the
    ``top``-th largest weight at the upper frequency is a floor that a candidate's weight at
    the lower frequency must reach."""
    weight = lambda x, df_u: _scope_weight(x, F.col("_l"), df_u)
    rows = rows.join(packed.select("doc_id", "best"), "doc_id").withColumn("_l", F.log(m + F.col("m_u") + 1))
    least = F.transform("best", lambda x: weight(x, F.col("r") + F.least(
        F.col("m_u") - F.col("r"), F.col("r_max") * (x["df_c"] - 1))))
    rows = rows.withColumn("_floor", F.get(F.sort_array(least, asc=False), top - 1))
    # room for the rounding of the ranked weights: too many candidates are harmless
    slack = 1e-9 if round_to is None else 2 * 10.0 ** -round_to
    cand = F.filter("best", lambda x: F.col("_floor").isNull() | (weight(x, F.col("r")) >= F.col("_floor") - slack))
    return rows.select("user_id", "doc_id", "r", "m_u", cand.alias("cand"))


def scope_frequencies(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """(user_id, term, r): reads of articles with a term that is a candidate of the user (or
    takes a candidate's place in the user's filter); ``rows`` is ``scope_candidates``."""
    marks = rows.select("user_id", F.explode(F.transform("cand", lambda x: x["bit"])).alias("_b"))
    words = marks.groupBy("user_id", F.floor(F.col("_b") / 64).cast("int").alias("_w")).agg(
        F.bit_or(F.expr("shiftleft(1L, _b % 64)")).alias("_bits"))
    filters = words.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_f"))
    filters = filters.select("user_id", F.transform(
        F.sequence(F.lit(0), F.lit(FILTER_BITS // 64 - 1)), lambda i: F.coalesce(F.col("_f")[i], F.lit(0))).alias("_f"))
    seen = rows.select("user_id", "doc_id", "r").join(filters, "user_id").join(packed.select("doc_id", "terms"), "doc_id")
    kept = F.filter("terms", lambda x: F.getbit(
        F.get("_f", F.shiftright(x["bit"], 6)), x["bit"] % 64) == 1)
    return seen.select("user_id", "r", F.explode(F.transform(kept, lambda x: x["term"])).alias("term"))


def keywords_user_scope(reads: DataFrame, corpus: DataFrame, top: int = 10,
                        round_to: int | None = 6) -> DataFrame:
    """As originally coded: per user, IDF over corpus ∪ the user's read
    articles (one entry per read, so a read corpus article counts again).

    ``reads``: (user_id, doc_id) one row per read; ``corpus``: (doc_id, words).
    df_u(t) = df_corpus(t) + number of the user's reads containing t,
    m_u = |corpus| + |reads of u|.  One grouped plan, no per-user loop.

    Only terms that can reach an article's top ``top`` are weighted (see
    ``scope_candidates``), so the read x term rows that are shuffled for the per-user
    frequency are those of the users' candidate terms; a fixed-size filter per user
    (``FILTER_BITS``) keeps the others from being expanded.
    Returns (user_id, doc_id, term, weight, rk) per distinct (user, article).
    """
    rc, packed, m = _scope_rows(reads, corpus, top)
    packed = materialise(packed, "scope-articles")
    rows = materialise(scope_candidates(rc, packed, m, top, round_to), "scope-candidates")
    df_u = scope_frequencies(rows, packed).groupBy("user_id", "term").agg(F.sum("r").alias("df_u"))
    each = rows.select("user_id", "doc_id", "m_u", F.inline("cand")).drop("bit")
    w = each.join(df_u, ["user_id", "term"]).select(
        "user_id", "doc_id", "term",
        (F.col("tf") * F.log((m + F.col("m_u") + 1) / (F.col("df_c") + F.col("df_u") + 1))).alias("weight"))
    return top_per_group(w, ["user_id", "doc_id"], "weight", top, rank_col="rk",
                         round_to=round_to)


def word_count_topk(docs: DataFrame, k: int, text_col: str = "words") -> DataFrame:
    """(term, n): the k most frequent single-space tokens (ties by term)."""
    t = spread(docs).select(F.explode(tokens_ws(F.col(text_col))).alias("term"))
    return (t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("term")).limit(k))


def vocabulary(docs: DataFrame, size: int, text_col: str = "words",
               stopwords=None, doc_col: str = "doc_id") -> DataFrame:
    """(idx, term, n): the ``size`` most frequent terms (regex tokens,
    lower-cased, stop words removed), idx 0 = most frequent, ties by term.

    The top-``size`` cut runs first (per-partition top-k then a merge), so the
    index is assigned over at most ``size`` rows."""
    t = drop_stopwords(tokens(spread(docs), doc_col, text_col, "gap"), stopwords)
    top = (t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.asc("term")).limit(size))
    w = Window.orderBy(F.desc("n"), F.asc("term"))
    return top.select((F.row_number().over(w) - 1).cast("int").alias("idx"), "term", "n")


SUMMARY_COUNTERS = 1 << 20


def frequent_terms(docs: DataFrame, size: int, text_col: str = "words", stopwords=None,
                   doc_col: str = "doc_id", counters: int = SUMMARY_COUNTERS) -> DataFrame:
    """``vocabulary`` without shuffling every distinct term: same rows.

    1. Terms hash to ``counters`` counters; a counter's total is at least the count of each
       of its terms.  A task shuffles at most ``counters`` rows, and totals of tasks add up.
    2. The terms of the ``size`` largest counters are counted exactly: the ``size``-th
       largest of these counts is a floor under the true one.
    3. Only terms of counters that reach the floor can be among the ``size`` most frequent:
       these are counted exactly.
    Rare terms, the bulk of any vocabulary, never leave their task."""
    t = drop_stopwords(tokens(spread(docs), doc_col, text_col, "gap"), stopwords)
    t = t.select("term", F.pmod(F.xxhash64("term"), F.lit(counters)).cast("int").alias("_h"))
    totals = materialise(t.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")), "term-counters")
    largest = totals.orderBy(F.desc("_n"), "_h").limit(size).select("_h")
    some = t.join(F.broadcast(largest), "_h").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = some.orderBy(F.desc("n")).limit(size).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).first()
    floor = top["n"] if top["k"] >= size else 1
    reach = totals.where(F.col("_n") >= F.lit(floor)).select("_h")      # at most ``counters`` rows
    exact = t.join(F.broadcast(reach), "_h").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    best = exact.orderBy(F.desc("n"), F.asc("term")).limit(size)
    w = Window.orderBy(F.desc("n"), F.asc("term"))
    return best.select((F.row_number().over(w) - 1).cast("int").alias("idx"), "term", "n")


def count_vectors(docs: DataFrame, vocab: DataFrame, doc_col: str = "doc_id",
                  text_col: str = "words") -> DataFrame:
    """(doc_col, idx, tf): token counts restricted to the vocabulary (out-of-
    vocabulary tokens dropped).  Spark decides by size whether to broadcast it."""
    t = tokens(spread(docs), doc_col, text_col, "gap")
    return (t.join(vocab.select("term", "idx"), "term")
            .groupBy(doc_col, "idx").agg(F.count(F.lit(1)).alias("tf")))


def corpus_stats(docs: DataFrame, counts: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(n_docs, n_tokens, n_distinct_entries) of count vectors."""
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    return counts.agg(n_docs.alias("n_docs"),
                      F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("n_tokens"),
                      F.count(F.lit(1)).alias("n_distinct_entries"))


def tfidf_range(weights: DataFrame, col: str = "weight") -> DataFrame:
    """(min_w, max_w) over all stored TF-IDF entries."""
    return weights.agg(F.min(col).alias("min_w"), F.max(col).alias("max_w"))
