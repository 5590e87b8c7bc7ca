"""Text operators: tokenisers (same as the ML tokenizer), TF-IDF, keywords, vocabulary."""

import math

import pytest
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import functions as F

from tastemap.functions.text import tokens_regex_gap, tokens_regex_match, tokens_ws
from tastemap.operators import text as T
from tastemap.sources import testdata as TD

from conftest import SF_SMALL

DOCS = [(0, "the cat sat on the mat"), (1, "the dog sat"), (2, "a cat and a dog"), (3, "")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, words string")


def test_tokenizers_match_ml_regex_tokenizer(spark):
    d = TD.news(spark, SF_SMALL).select("rowkey", "words").limit(50)
    gap = RegexTokenizer(inputCol="words", outputCol="t").transform(d)
    a = {r["rowkey"]: r["t"] for r in gap.collect()}
    b = {r["rowkey"]: r["t"] for r in d.select("rowkey", tokens_regex_gap(F.col("words")).alias("t")).collect()}
    assert a == b
    m = RegexTokenizer(inputCol="words", outputCol="t", gaps=False, pattern=r"\p{L}+").transform(d)
    a = {r["rowkey"]: r["t"] for r in m.collect()}
    b = {r["rowkey"]: r["t"] for r in d.select("rowkey", tokens_regex_match(F.col("words")).alias("t")).collect()}
    assert a == b


def test_ws_split_drops_empty(spark):
    df = spark.createDataFrame([(" a  b ",), (None,)], "s string")
    assert [r[0] for r in df.select(tokens_ws("s")).collect()] == [["a", "b"], []]


def test_tfidf_and_keywords(spark):
    d = docs(spark)
    tf = T.term_freq(d)
    idf = T.idf(tf, d.select(F.count(F.lit(1))).scalar())
    w = {(r[0], r[1]): r[2] for r in T.tfidf(tf, idf).collect()}
    assert w[(0, "the")] == pytest.approx(2 * math.log(5 / 3))
    assert w[(0, "mat")] == pytest.approx(math.log(5 / 2))
    kw = T.keywords(d, 2, round_to=6).where("doc_id = 0").orderBy("rk").collect()
    # mat/on tie on weight: broken by term
    assert [(r["term"], r["rk"]) for r in kw] == [("the", 1), ("mat", 2)]
    assert T.keywords(d, 10).where("doc_id = 3").count() == 0


def test_keywords_new_vs_corpus_counts_union(spark):
    corpus = docs(spark)
    new = spark.createDataFrame([(0, "zebra cat")], "doc_id long, words string")
    got = {r["term"]: r["weight"] for r in T.keywords_new_vs_corpus(new, corpus, 5, round_to=None).collect()}
    m = 5  # 1 new + 4 corpus
    assert got["zebra"] == pytest.approx(math.log((m + 1) / 2))
    assert got["cat"] == pytest.approx(math.log((m + 1) / 4))


def test_keywords_user_scope_counts_reads_again(spark):
    corpus = docs(spark)
    reads = spark.createDataFrame([(7, 1), (7, 1)], "user_id long, doc_id long")
    got = {r["term"]: r["weight"] for r in T.keywords_user_scope(reads, corpus, 5, round_to=None).collect()}
    # m_u = 4 + 2; df_u(dog) = 2 (corpus) + 2 (two reads of doc 1)
    assert got["dog"] == pytest.approx(math.log(7 / 5))


def test_vocabulary_order_and_count_vectors(spark):
    d = docs(spark)
    v = T.vocabulary(d, 3).orderBy("idx").collect()
    assert [(r["idx"], r["term"], r["n"]) for r in v] == [(0, "cat", 2), (1, "dog", 2), (2, "sat", 2)]
    cv = {(r[0], r[1]): r[2] for r in T.count_vectors(d, T.vocabulary(d, 3)).collect()}
    assert cv == {(0, 0): 1, (0, 2): 1, (1, 1): 1, (1, 2): 1, (2, 0): 1, (2, 1): 1}
    st = T.corpus_stats(d, T.count_vectors(d, T.vocabulary(d, 3))).first()
    assert (st["n_docs"], st["n_tokens"], st["n_distinct_entries"]) == (4, 6, 6)


def test_word_count_topk(spark):
    got = [(r[0], r[1]) for r in T.word_count_topk(docs(spark), 3).collect()]
    assert got == [("the", 3), ("a", 2), ("cat", 2)]


def test_keywords_with_stored_df_equals_full(spark):
    d = TD.news(spark, SF_SMALL).select(F.col("rowkey").alias("doc_id"), "words")
    stored = T.doc_freq_delta(d)
    subset = d.where("doc_id % 7 = 0")
    a = {(r[0], r[1]): (r[2], r[3]) for r in T.keywords_with_df(subset, stored, 10).collect()}
    b = {(r[0], r[1]): (r[2], r[3]) for r in T.keywords(d, 10).where("doc_id % 7 = 0").collect()}
    assert a == b and len(a) > 0


def test_new_keywords_with_stored_df_equal_full(spark):
    corpus = TD.news(spark, SF_SMALL).select(F.col("rowkey").alias("doc_id"), "words")
    new = TD.new_articles(spark, SF_SMALL)
    a = {(r[0], r[1]): (r[2], r[3]) for r in
         T.keywords_new_with_df(new, T.doc_freq_delta(corpus), 10).collect()}
    b = {(r[0], r[1]): (r[2], r[3]) for r in T.keywords_new_vs_corpus(new, corpus, 10).collect()}
    assert a == b and len(a) > 0


def test_added_documents_bring_their_terms(spark):
    schema = "doc_id long, words string"
    first = spark.createDataFrame([(1, "a cat"), (2, "a dog")], schema)
    later = first.unionByName(spark.createDataFrame([(3, "a zebra quagga")], schema))
    stored = T.doc_freq_delta(first)
    added = T.added_docs(later, stored)
    assert [r.doc_id for r in added.collect()] == [3]
    both = stored.unionByName(T.doc_freq_delta(added))
    got = T.keywords_with_df(later.where("doc_id = 3"), both, 2)
    assert {r.term for r in got.collect()} == {"zebra", "quagga"}


def test_counted_ids_are_bitmaps(spark):
    """Ids of any sign, repeated and null, over several deltas; the stored side is one row a bucket."""
    import random
    rng = random.Random(2)
    ids = [rng.randrange(-100_000, 300_000) for _ in range(3000)] + [0, 1, -1, 32767, 32768, 32769, -32768, 2 ** 40]
    halves = [spark.createDataFrame([(i, f"w{i % 50} x") for i in part] + [(ids[0], "w1"), (None, "lost")],
                                    "doc_id long, words string") for part in (ids[::3], ids[1::3])]
    stored = halves[0].sparkSession.createDataFrame([], T.doc_freq_delta(halves[0]).schema)
    for h in halves:
        stored = stored.unionByName(T.doc_freq_delta(T.added_docs(h, stored)))
    known = {i for part in (ids[::3], ids[1::3]) for i in part} | {ids[0]}
    every = spark.createDataFrame([(i, "w", i) for i in ids] + [(None, "w", None)], "doc_id long, words string, bucket long")
    left = T.added_docs(every, stored)
    assert left.columns == every.columns
    want = sorted((i for i in ids if i not in known))
    got = [r.doc_id for r in left.collect()]
    assert got.count(None) == 1 and sorted(i for i in got if i is not None) == want
    terms, m = T.total_doc_freq(stored)
    assert spark.range(1).select(m).first()[0] == len(known)
    rows = stored.where("bucket IS NOT NULL")
    assert rows.count() < 40 and stored.where("doc_id IS NOT NULL").count() == 0
    text = T.added_docs(every.selectExpr("CAST(doc_id AS string) AS doc_id", "words"), T.doc_freq_delta(
        halves[0].selectExpr("CAST(doc_id AS string) AS doc_id", "words")))
    assert {int(r.doc_id) for r in text.where("doc_id IS NOT NULL").collect()} == set(ids) - set(ids[::3])


def test_user_scope_equals_plain_python_and_expands_less(spark):
    """Candidates, filter and floor: same rows as weighting every read x term; hot user included."""
    import math
    import random
    from collections import Counter
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(3000)]
    docs = {d: Counter(rng.choices(vocab, [1 / (i + 1) for i in range(3000)], k=120)) for d in range(60)}
    corpus = spark.createDataFrame([(d, " ".join(c.elements())) for d, c in docs.items()] + [(90, None), (91, "")],
                                   "doc_id long, words string")
    reads = [(u, rng.randrange(60)) for u in range(12) for _ in range(rng.randrange(1, 25))]
    reads += [(99, rng.randrange(60)) for _ in range(200)] + [(None, 3), (5, 777), (5, 90)]
    df = Counter(t for c in docs.values() for t in c)
    want = {}
    for u in {u for u, _ in reads if u is not None}:
        own = Counter(d for x, d in reads if x == u)
        m = len(docs) + 2 + sum(own.values())
        df_u = Counter()
        for d, r in own.items():
            for t in docs.get(d, ()):
                df_u[t] += r
        for d in own:
            w = [(-round(n * math.log((m + 1) / (df[t] + df_u[t] + 1)), 6), t) for t, n in docs.get(d, {}).items()]
            for k, (x, t) in enumerate(sorted(w)[:10], 1):
                want[u, d, k] = (t, -x)
    frame = spark.createDataFrame(reads, "user_id long, doc_id long")
    got = {(r.user_id, r.doc_id, r.rk): (r.term, r.weight) for r in T.keywords_user_scope(frame, corpus).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    rc, packed, m = T._scope_rows(frame, corpus)
    rows = T.scope_candidates(rc, packed, m, 10, 6)
    every = sum(len(docs.get(d, ())) for u, d in {x for x in reads if x[0] is not None})
    assert rows.select(F.sum(F.size("cand"))).first()[0] < 0.5 * every
    assert T.scope_frequencies(rows, packed).count() < 0.75 * every


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(T, "TEXT_PER_TASK", 100)
    d = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 20).alias("words"))
    assert T.term_freq(d).rdd.getNumPartitions() == 36
    assert [r.tf for r in T.term_freq(d).collect()] == [20] * 60


def test_keyword_partitions_grow_with_the_texts(spark, monkeypatch):
    """More text than the set shuffle partitions hold: the term join and the ranking run in
    as many tasks as the texts need, with the same rows."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 37}" for j in range(1, 30))) for i in range(40)],
                                 "doc_id long, words string")
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deltas = T.doc_freq_delta(docs)
    plain = [sorted(map(tuple, q.collect())) for q in (T.keywords(docs, 5), T.keywords_with_df(docs, deltas, 5))]
    chars = sum(len(r.words) for r in docs.collect())
    monkeypatch.setattr(T, "TEXT_PER_TASK", -(-chars // (few + 3)))
    tasks = T._text_tasks(docs, "words")
    assert tasks > few
    for q, rows in zip((T.keywords(docs, 5), T.keywords_with_df(docs, deltas, 5)), plain):
        assert sorted(map(tuple, q.collect())) == rows and q.rdd.getNumPartitions() == tasks
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(term" in plan and plan.count(f", {tasks})") >= 1
        joins = [line for line in plan.splitlines() if "Exchange hashpartitioning(term" in line]
        assert sum(f", {tasks})" in line for line in joins) >= 2


def _zipf_texts(n_docs=80, n_terms=4000):
    import random
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(n_terms)]
    return {d: rng.choices(vocab, [1 / (i + 1) for i in range(n_terms)], k=150) for d in range(n_docs)}


def _plain_keywords(texts, m, df, top=10):
    from collections import Counter
    want = {}
    for d, words in texts.items():
        w = sorted((-round(n * math.log((m + 1) / (df[t] + 1)), 6), t) for t, n in Counter(words).items() if df[t])
        want.update({(d, k): (t, -x) for k, (x, t) in enumerate(w[:top], 1)})
    return want


@pytest.mark.parametrize("buckets,share", [(1 << 19, 1000), (16, 10), (1, 4)])
def test_keywords_rank_few_rows_and_equal_plain_python(spark, monkeypatch, buckets, share):
    """Bounds from exact, shared and single buckets: same rows, fewer than one per document and term ranked."""
    from collections import Counter
    monkeypatch.setattr(T, "DF_BUCKETS", buckets)
    monkeypatch.setattr(T, "COMMON_SHARE", share)
    texts = _zipf_texts()
    rows = [(d, " ".join(w)) for d, w in texts.items()] + [(90, None), (91, ""), (None, "w1 w2"), (92, "w0 w0 lone")]
    texts[92] = ["w0", "w0", "lone"]
    frame = spark.createDataFrame(rows, "doc_id long, words string")
    df = Counter(t for w in texts.values() for t in set(w))
    want = _plain_keywords(texts, len(rows), df)
    got = {(r.doc_id, r.rk): (r.term, r.weight) for r in T.keywords(frame).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    tf = T.term_freq(frame)
    some = T.can_be_top(tf, T.doc_freq(tf), F.lit(len(rows)), 10, 6).count()
    assert len(want) <= some < (0.3 if buckets > 16 else 0.9) * tf.count()


@pytest.mark.parametrize("buckets,share", [(1 << 19, 1000), (1, 4)])
def test_stored_frequencies_may_lack_terms(spark, monkeypatch, buckets, share):
    """A text changed after it was counted: its unknown terms are left out, and cost no other term its place."""
    from collections import Counter
    monkeypatch.setattr(T, "DF_BUCKETS", buckets)
    monkeypatch.setattr(T, "COMMON_SHARE", share)
    texts = _zipf_texts()
    counted = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, words string")
    df = Counter(t for w in texts.values() for t in set(w))
    texts[3] = texts[3] + [f"new{i}" for i in range(30) for _ in range(9)]
    changed = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, words string")
    want = _plain_keywords(texts, len(texts), df)
    got = {(r.doc_id, r.rk): (r.term, r.weight)
           for r in T.keywords_with_df(changed, T.doc_freq_delta(counted)).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
