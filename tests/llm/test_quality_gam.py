import numpy as np
from pyspark.sql import functions as F

from tastemap.llm.catalogue import op3_quality
from tastemap.llm.quality_gam import FEATURES, fit, labelled, score, train


def test_additive_and_pair_effects_are_learnt():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 4))
    z = 2 * np.sin(2 * x[:, 0]) + 3 * (x[:, 1] > 0) * (x[:, 2] > 0) - 1
    y = (rng.random(6000) < 1 / (1 + np.exp(-z))).astype(float)
    model = fit(x[:4000], y[:4000])
    assert (1, 2) in {(a, b) for a, b, _ in model.pairs}
    p = model.score(x[4000:])
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    pos = y[4000:] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())
    best = z[4000:]
    rank[np.argsort(best)] = np.arange(len(p))
    ideal = (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > ideal - 0.02
    # a score is nothing but table entries
    by_hand = model.intercept + sum(t[np.searchsorted(e, x[0, f], "right")]
                                    for f, (e, t) in enumerate(zip(model.edges, model.tables)))
    by_hand += sum(g[np.searchsorted(model.pair_edges[a], x[0, a], "right"),
                     np.searchsorted(model.pair_edges[b], x[0, b], "right")] for a, b, g in model.pairs)
    assert np.isclose(model.logit(x[:1])[0], by_hand)


def test_one_class_and_no_rows():
    x = np.zeros((5, len(FEATURES)))
    assert np.allclose(fit(x, np.ones(5)).score(x), 6 / 7)
    assert np.allclose(fit(x[:0], np.zeros(0)).score(x), 0.5)


def test_labels_with_nulls_repeats_and_a_bound(spark, edge_docs):
    rows = [(100 + i, i % 2) for i in range(40)] + [(100, 0), (None, 1), (140, None), (999_999, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = labelled(edge_docs, labels)
    assert {r.doc_id for r in got.collect()} == {100 + i for i in range(40)}
    few = labelled(edge_docs, labels, max_rows=7).select("doc_id").distinct()
    assert few.count() == 7
    model = train(edge_docs, labels)
    out = score(edge_docs.drop("score"), model, ["doc_id", "text"])
    assert out.count() == edge_docs.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = train(no_docs, labels)
    assert score(no_docs.drop("score"), model, ["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    from tests.conftest import SF_CHECK
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    out = op3_quality(spark, SF_CHECK).where("held_out").join(labels, "doc_id")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def plain_features(text):
    """The features of one text, word by word and character by character."""
    import re
    from collections import Counter
    from math import log1p
    text = text or ""
    symbol, mark = set("#*$%&|<>{}[]\\^~=+_@"), set("!?;:\"'()-")
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    n, chars = max(len(words), 1), max(len(text), 1)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    rate = lambda chosen, of: sum(c in chosen for c in text) / of
    upper, lower = (sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text))
    ends = [w[-1] in symbol | mark for w in words]
    twice = lambda items: sum(k for k in Counter(items).values() if k > 1)
    return [log1p(len(words)), mean, max(sum(s * s for s in sizes) / n - mean * mean, 0) ** 0.5,
            rate(symbol, chars), rate(mark, chars), rate(set(".,"), n), rate(set("0123456789"), chars),
            upper / max(upper + lower, 1), sum(e and s == 1 for e, s in zip(ends, sizes)) / n, sum(ends) / n,
            twice(words) / n, twice(list(zip(words, words[1:]))) / n, len(words) / (text.count("\n") + 1),
            1 - sum(sizes) / chars, sum(s <= 3 for s in sizes) / n, sum(s >= 15 for s in sizes) / n]


def test_features_equal_plain_python():
    import random
    import pyarrow as pa
    from tastemap.llm.quality_gam import batch_features
    from .conftest import edge_texts, prose
    rng = random.Random(12)
    alphabet = "aB1 .,!#\n\té日🎉-_"
    texts = edge_texts() + [prose(rng, rng.randrange(1, 200)) for _ in range(50)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(300)]
    got = batch_features(pa.array(texts, pa.string()))
    assert got.shape == (len(texts), len(FEATURES))
    for text, row in zip(texts, got):
        assert np.allclose(row, plain_features(text), rtol=1e-9, atol=1e-6), repr((text or "")[:80])
