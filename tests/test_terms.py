"""Term counts where the texts lie: tokens, documents in several rows, bounds and ties."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tastemap.operators import terms as TC
from tastemap.operators import text as T

ROWS = [(1, "b a  a"), (2, None), (3, ""), (None, "lost"), (4, "é ß é\tx"), (5, " c"), (1, "a z"), (6, "a\nb a"), (1, None)]


def _plain(rows):
    want = Counter()
    for d, t in rows:
        want.update((d, w) for w in (t or "").split(" ") if w and d is not None)
    return dict(want)


@pytest.mark.parametrize("at_once", [1, 6, 1 << 20])
def test_counts_equal_the_shuffled_ones_without_moving_texts(spark, monkeypatch, at_once):
    monkeypatch.setattr(TC, "TEXT_AT_ONCE", at_once)
    rows = ROWS + [(9, f"w{i % 7} again") for i in range(40)] + [(20 + i, f"w{i} w{i}") for i in range(20)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, words string").repartition(5)
    got = {(r.doc_id, r.term): r.tf for r in TC.term_counts(docs).collect()}
    assert got == _plain(rows) == {(r.doc_id, r.term): r.tf for r in T.term_freq(docs).collect()}
    assert TC.term_counts(docs).count() == len(got)
    df = {r.term: r.df for r in TC.doc_freqs(docs).collect()}
    assert df == Counter(t for _, t in _plain(rows))
    once = spark.createDataFrame([r for r in rows if r[0] not in (1, 9)], "doc_id long, words string").repartition(5).cache()
    plan = T.keywords(once, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan
    shuffled = [line for line in TC.term_counts(once)._jdf.queryExecution().executedPlan().toString().splitlines()
                if "Exchange hashpartitioning" in line]
    assert not shuffled


def test_text_ids_and_no_documents(spark):
    docs = spark.createDataFrame([("a", "x x"), ("b", "x"), ("a", "y")], "doc_id string, words string")
    assert {(r.doc_id, r.term): r.tf for r in TC.term_counts(docs).collect()} == {("a", "x"): 2, ("a", "y"): 1, ("b", "x"): 1}
    none = docs.where("false")
    assert TC.term_counts(none).collect() == [] and T.keywords(none).collect() == []


def test_hashes_do_not_depend_on_the_neighbours():
    rng = random.Random(4)
    terms = ["", "a", "ab", "ba", "é", "日本", "x" * 300] + ["".join(rng.choices("abc", k=rng.randrange(1, 9))) for _ in range(500)]
    every = TC.term_hash(pa.array(terms))
    assert all(TC.term_hash(pa.array([t]))[0] == h for t, h in zip(terms, every))
    assert len(set(every.tolist())) == len(set(terms))
    assert np.array_equal(TC.term_hash(pa.array(terms).slice(3, 5)), every[3:8])


@pytest.mark.parametrize("buckets,share", [(1 << 10, 3), (64, 2), (1, 1000)])
def test_keywords_with_many_ties_send_few_rows(spark, monkeypatch, buckets, share):
    """Most terms occur once: of a document's equal weights only the first terms can rank."""
    monkeypatch.setattr(T, "DF_BUCKETS", buckets)
    monkeypatch.setattr(T, "COMMON_SHARE", share)
    monkeypatch.setattr(TC, "RANGE", 16)
    rng = random.Random(8)
    texts = {d: [f"u{d}-{i}" for i in range(60)] + rng.choices([f"w{i}" for i in range(30)], k=40) for d in range(30)}
    rows = [(d, " ".join(rng.sample(w, len(w)))) for d, w in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, words string")
    df = Counter(t for w in texts.values() for t in set(w))
    want = {}
    for d, w in texts.items():
        ranked = sorted((-round(n * math.log(31 / (df[t] + 1)), 6), t) for t, n in Counter(w).items())
        want.update({(d, k): t for k, (_, t) in enumerate(ranked[:10], 1)})
    assert {(r.doc_id, r.rk): r.term for r in T.keywords(docs).collect()} == want
    bounds = TC.frequency_bounds(TC.doc_freqs(docs), 30, share, buckets)
    some = TC.top_candidates(docs, bounds, 10, 6).count()
    assert len(want) <= some <= 2 * len(want)


def test_stored_frequencies_bound_as_well_as_fresh_ones(spark, monkeypatch):
    """Frequencies that cover the texts: few rows meet them; a changed text alone is done again."""
    calls = []
    real = T.top_candidates
    monkeypatch.setattr(T, "COMMON_SHARE", 2)
    monkeypatch.setattr(T, "top_candidates", lambda *a, **k: calls.append(real(*a, **k)) or calls[-1])
    rows = [(d, " ".join([f"u{d}-{i}" for i in range(50)] + [f"w{d % 5}"] * 3)) for d in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, words string")
    deltas = T.doc_freq_delta(docs)
    got = sorted(map(tuple, T.keywords_with_df(docs, deltas).collect()))
    assert got == sorted(map(tuple, T.keywords(docs).collect())) and len(got) == 300
    assert len(calls) == 2 and calls[0].count() <= 600
    calls.clear()
    monkeypatch.setattr(T, "DF_BUCKETS", 1)         # a hash that cannot tell a new term
    monkeypatch.setattr(TC, "MOST_BUCKETS", 1)
    changed = spark.createDataFrame([(d, t + " new new new new" if d == 4 else t) for d, t in rows], "doc_id long, words string")
    again = sorted(map(tuple, T.keywords_with_df(changed, deltas).collect()))
    assert again == got and len(calls) == 2
