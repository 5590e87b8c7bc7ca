import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tastemap.llm import lexical as L
from tests.llm.conftest import prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    own = [(d, Counter(words(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in own)
    n_terms = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    merged = {}
    for item, t in items:
        merged.setdefault(item, set()).update(words(t))
    out = []
    for item, wanted in merged.items():
        scores = []
        for d, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark):
    import random
    rng = random.Random(8)
    rows = [(i, prose(rng, 25), "x") for i in range(12)]
    rows += [(50, None, "x"), (51, "", "x"), (52, " .,- ", "x"), (53, "É日本語 red1 RED1", "x"), (54, "zzz qqq", "x"),
             (55, "red1", "x"), (55, "blue2 x", "x"), (55, "red1", "x"), (None, "stone3 same line of text", "x")]
    return rows, spark.createDataFrame(rows, "item_id long, text string, score string")


def test_equals_brute_force_on_odd_rows(edge_docs, doc_rows, items):
    rows, table = items
    docs = [(r["doc_id"], r["text"]) for r in doc_rows]
    got = Counter(map(tuple, L.search(edge_docs, table).collect()))
    assert got == brute(docs, [r[:2] for r in rows])
    assert Counter(map(tuple, L.search(edge_docs, table, top=3).collect())) == brute(docs, [r[:2] for r in rows], 3)


def test_null_ids_rank_last_among_equals(spark, items):
    docs = spark.createDataFrame([(None, "red1 stone3"), (5, "red1 stone3"), (2, "red1 stone3"), (9, "other words")],
                                 "doc_id long, text string")
    got = [tuple(r) for r in L.search(docs, items[1]).orderBy("item_id", "rank").collect() if r.item_id == 55]
    assert [r[2] for r in got] == [2, 5, None]


def test_many_small_blocks_change_nothing(edge_docs, items, monkeypatch):
    whole = Counter(map(tuple, L.search(edge_docs, items[1]).collect()))
    small = L.blocks
    monkeypatch.setattr(L, "blocks", lambda rows: small(rows, 5, 300))
    assert Counter(map(tuple, L.search(edge_docs, items[1]).collect())) == whole
    sizes = [len(b.item_id) for b in small(items[1], 5, 300)]
    assert len(sizes) > 2 and max(sizes) <= 5


def test_bounds_hold_and_spare_exact_scores(doc_rows):
    import random
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(5, 120)) for _ in range(600)]
    wanted = {i: {w.encode() for w in words(t)} for i, t in enumerate(texts[:20])}
    block = L.Block.of(wanted)
    weight = np.full(len(block.vocabulary), 5000, np.int64)
    best = L.Best(len(wanted), 10)
    n_terms = sum(len(words(t)) for t in texts)
    args = (block, block.lookup(), weight, len(texts), n_terms)
    scores = L.search_slice(*args, pa.array(texts), np.arange(len(texts)), best)
    assert scores < 0.5 * len(texts) * len(wanted)       # most pairs are never scored
    want = {}
    for q, own in wanted.items():
        every = []
        for d, t in enumerate(texts):
            c = Counter(w.encode() for w in words(t))
            m = 10 + 90 * sum(c.values()) * len(texts) // n_terms
            every.append((-sum(5000 * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m)) for w in own if c[w]), d))
        want[q] = [(d, -s) for s, d in sorted(every)[:10]]
    got = {q: [(int(d), int(s)) for i, d, s in zip(best.item, best.doc_id, best.score) if i == q] for q in wanted}
    assert got == want


def test_two_coordinates_are_exact_too(edge_docs, doc_rows, items, monkeypatch):
    """A sketch of two coordinates bounds badly, but never loses a result."""
    rows = [r for r in items[0] if r[0] in (1, 2, 55)]
    block = L.Block.of({i: {w.encode() for r in rows if r[0] == i for w in words(r[1])} for i in (1, 2, 55)}, 2)
    best = L.Best(3, 10)
    texts = pa.array([r["text"] for r in doc_rows], pa.string())
    weight = np.full(len(block.vocabulary), 7, np.int64)
    L.search_slice(block, block.lookup(2), weight, 80, 9000, texts, np.arange(len(texts)), best, 2)
    full = L.Block.of({i: {w.encode() for r in rows if r[0] == i for w in words(r[1])} for i in (1, 2, 55)})
    other = L.Best(3, 10)
    L.search_slice(full, full.lookup(), weight, 80, 9000, texts, np.arange(len(texts)), other)
    assert (best.score == other.score).all() and (best.doc_id == other.doc_id).all()


def test_empty_tables(edge_docs, no_docs, items):
    assert L.search(no_docs, items[1]).count() == 0
    assert L.search(edge_docs, items[1].where("false")).count() == 0
