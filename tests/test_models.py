"""Model-based operators: invariants (their output is not hashable)."""

import pytest
from pyspark.sql import functions as F

from tastemap.config import Params
from tastemap.operators import cf, topics as TP
from tastemap.sources import testdata as TD

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def corpus(spark):
    return TD.news(spark, SF_SMALL).select(F.col("rowkey").alias("doc_id"), "words")


def test_lda_invariants(spark, corpus, tmp_path):
    p = Params(n_topics=4, vocab_multiplier=25)
    model = TP.build_topic_model(corpus, p, max_iter=5)
    inferred = TP.infer(model, corpus).collect()
    assert len(inferred) == corpus.count()
    for r in inferred:
        assert len(r["topic"]) == 4
        assert all(x >= 0 for x in r["topic"])
        s = sum(r["topic"])
        assert s == pytest.approx(1.0, abs=1e-6) or s == 0.0
    desc = TP.describe(model, 5).collect()
    assert {r["term"] for r in desc} <= set(model.vocab)
    assert {r["topic"] for r in desc} == {0, 1, 2, 3}
    model.save(str(tmp_path / "lda"))
    again = TP.TopicModel.load(str(tmp_path / "lda"))
    assert again.vocab == model.vocab
    unseen = spark.createDataFrame([(0, "qqqq zzzz")], "doc_id long, words string")
    mixture = TP.infer(again, unseen).first()["topic"]      # no known term: all zero
    assert mixture == pytest.approx([0.0] * 4, abs=1e-9)


def test_lda_online(spark, corpus):
    p = Params(n_topics=3, vocab_multiplier=20)
    model = TP.build_topic_model(corpus, p, optimizer="online", max_iter=3)
    assert TP.infer(model, corpus).count() == corpus.count()


def test_top_topics(spark):
    df = spark.createDataFrame([(1, [0.1, 0.5, 0.2, 0.5])], "id long, t array<double>")
    assert TP.top_topics(df, "id", "t", 2).first()["t"] == [0.0, 0.5, 0.0, 0.5]


def test_cf_invariants_and_round_trip(spark, tmp_path):
    log = TD.behaviour_log(spark, SF_SMALL)
    model = cf.train(log, Params(als_iterations=3))
    users = log.select("user_id").distinct()
    unknown = spark.createDataFrame([(10**9,)], "user_id long")
    recs = cf.recommend(model, users.unionByName(unknown), 2).collect()
    by_user = {}
    for r in recs:
        by_user.setdefault(r["user_id"], []).append(r["doc_id"])
    assert 10**9 not in by_user
    assert set(by_user) <= {r[0] for r in users.collect()}
    assert all(len(v) <= 2 and len(set(v)) == len(v) for v in by_user.values())
    model.save(str(tmp_path / "cf"))
    again = cf.CFModel.load(spark, str(tmp_path / "cf"))
    assert again.users is None and again.items is None      # integer ids need no dictionary
    items = {r[0] for r in log.select("doc_id").distinct().collect()}
    assert all(d in items for v in by_user.values() for d in v)
    same = cf.recommend(again, users, 2).collect()
    assert {(r["user_id"], r["rk"], r["doc_id"]) for r in same} == {(r["user_id"], r["rk"], r["doc_id"]) for r in recs}
    assert all(r["article_id"] == r["doc_id"] for r in recs)


def test_cf_returns_the_last_article_id_of_a_key(spark, tmp_path):
    rows = [(f"u{u}", f"k{i}", f"2024-01-0{d} 00:00:00", f"a{i}-{d}", 0.3) for u in range(6)
            for i in range(8) for d in (1, 2) if (u + i) % 3]
    log = spark.createDataFrame(rows, "user_id string, doc_id string, ts string, article_id string, weight double")
    log = log.withColumn("ts", F.to_timestamp("ts"))
    cf.train(log, Params(als_iterations=2)).save(str(tmp_path / "cf"))
    recs = cf.recommend(cf.CFModel.load(spark, str(tmp_path / "cf")), log.select("user_id"), 3).collect()
    assert len(recs) == 18 and all(r["article_id"] == f"a{r['doc_id'][1:]}-2" for r in recs)


def test_string_ids_get_dense_dictionary(spark):
    r = spark.createDataFrame([("u1", "a", 1.0), ("u2", "b", 2.0), ("u1", "b", 1.0)],
                              "user_id string, doc_id string, rating double")
    users, items = cf.dictionaries(r)
    u = users.collect()
    assert sorted(x["user_idx"] for x in u) == [0, 1]
    assert len({x["user_id"] for x in u}) == 2


def test_lda_likelihood_finite_and_topic_argmax(spark, corpus):
    import math
    p = Params(n_topics=3, vocab_multiplier=30)
    model = TP.build_topic_model(corpus, p, max_iter=8)
    feats = corpus
    for stage in model.pipeline.stages[:-1]:
        feats = stage.transform(feats)
    assert math.isfinite(model.lda.logLikelihood(feats))
    # a document made only of one topic's top terms is assigned to that topic
    desc = TP.describe(model, 5).collect()
    by_topic = {}
    for r in desc:
        by_topic.setdefault(r["topic"], []).append(r["term"])
    # use the topic whose top terms are least shared with the others
    def overlap(t):
        return sum(len(set(by_topic[t]) & set(v)) for k, v in by_topic.items() if k != t)
    t = min(by_topic, key=overlap)
    doc = spark.createDataFrame([(0, " ".join(by_topic[t] * 20))], "doc_id long, words string")
    dist = TP.infer(model, doc).first()["topic"]
    assert max(range(len(dist)), key=lambda i: dist[i]) == t


def test_dense_dictionary_is_a_bijection(spark):
    vals = spark.createDataFrame([(f"u{i % 137}",) for i in range(2000)], "user_id string").repartition(7)
    d = cf.index_dictionary(vals, "user_id", "user_idx").collect()
    assert len(d) == 137
    assert sorted(r["user_idx"] for r in d) == list(range(137))
    assert len({r["user_id"] for r in d}) == 137


def test_em_blocks_follow_the_updates_entry_by_entry():
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(3)
    vocab, k, alpha, eta = ["a", "b", "c", "d"], 3, 50 / 3 + 1, 1.1
    texts = ["a b\ta  c", "zz", "", "d d\n d", "b"]
    words, counts, ends = TP._count_texts(pa.array(texts), pa.array(vocab))
    assert words.tolist() == [0, 1, 2, 3, 1] and counts.tolist() == [2, 1, 1, 3, 1] and ends.tolist() == [0, 3, 4, 5]
    blocks = list(TP._blocks(words, counts, ends))
    assert len(blocks) == 1 and blocks[0][2].tolist() == [0, 3, 4, 5]
    by_doc, by_word = rng.random((k, 3)) * 5, rng.random((k, 4)) * 5
    total = by_word.sum(axis=1)
    by_term = (by_word + (eta - 1)) / (total[:, None] + 4 * (eta - 1))
    topics, share = TP.em_step(words, counts, ends, by_doc, by_term, alpha)
    summed = np.zeros((k, 4))
    TP._add_terms(summed, words, share)
    want_doc, want_word = np.zeros((k, 3)), np.zeros((k, 4))
    for d in range(3):
        for e in range(ends[d], ends[d + 1]):
            p = [(by_word[t, words[e]] + eta - 1) * (by_doc[t, d] + alpha - 1) / (total[t] + 4 * (eta - 1)) for t in range(k)]
            for t in range(k):
                want_doc[t, d] += counts[e] * p[t] / sum(p)
                want_word[t, words[e]] += counts[e] * p[t] / sum(p)
    assert np.allclose(topics, want_doc) and np.allclose(summed, want_word)


def test_em_blocks_hold_whole_documents(monkeypatch):
    import numpy as np
    monkeypatch.setattr(TP, "BLOCK_ENTRIES", 4)
    ends = np.array([0, 3, 5, 6, 16, 17])       # the fourth document is larger than a block
    parts = list(TP._blocks(np.arange(17), np.arange(17), ends))
    assert [p[2].tolist() for p in parts] == [[0, 3], [0, 2, 3], [0, 10], [0, 1]]
    assert np.concatenate([p[0] for p in parts]).tolist() == list(range(17))


def test_em_trains_without_a_graph(spark, monkeypatch):
    """Text by text and in many parts: every token is dealt to the topics, no graph is kept."""
    monkeypatch.setattr(TP, "TEXT_AT_ONCE", 64)
    monkeypatch.setattr(TP, "FEW_PARTS", 1)
    monkeypatch.setattr(TP, "CUT_EVERY", 2)
    rows = [(i, None if i == 7 else " ".join(f"w{(i * j) % 11}" for j in range(i % 9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, words string").repartition(3)
    model = TP.build_topic_model(docs, Params(n_topics=3, vocab_multiplier=4), max_iter=5)
    assert not model.lda.isDistributed()
    tokens = sum(len(t.split()) for _, t in rows if t)
    counts = model.lda.topicsMatrix().toArray()
    assert counts.sum() == pytest.approx(tokens) and counts.shape == (11, 3)
    again = TP.build_topic_model(docs, Params(n_topics=3, vocab_multiplier=4), max_iter=5)
    assert again.lda.topicsMatrix().toArray().sum() == pytest.approx(tokens)
