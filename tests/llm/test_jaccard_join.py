import random
import re
from collections import Counter
from itertools import combinations

import pytest

from tastemap.llm.jaccard_join import (CHILDREN, DEPTH, POSITIONS, RECALL, SMALL, THRESHOLD, components,
                                       jaccard_groups, leaves)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, threshold=0.8):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append((i, frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    parent, links = {i: i for i, _ in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: (find(i), links[i]) for i, _ in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10 ** 6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    passage = [f"license{i}" for i in range(60)]
    rows = []
    for g in range(30):                      # groups of near and exact copies of growing size
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(6, 250))]
        for _ in range(rng.randrange(1, 8)):
            rows.append(" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 40))))
    big = [f"b{rng.randrange(3000)}" for _ in range(200)]
    rows += [" ".join(edited(rng, big, rng.randrange(0, 4))) for _ in range(130)]
    rows += [" ".join([f"u{rng.randrange(10 ** 6)}" for _ in range(150)] + passage) for _ in range(90)]
    rows += [rows[0].upper(), None, "", " \n", "two words", "two words", "Two  words"]
    return list(enumerate(rows))


@pytest.mark.parametrize("small,block", [(128, 256), (6, 20)])
def test_equals_brute_force(spark, corpus, small, block):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in corpus], "doc_id long, text string, n int, leaf string")
    out = jaccard_groups(docs, small=small, block=block)
    got = {r.doc_id: (r.class_id, r.n_links) for r in out.collect()}
    assert got == brute(corpus)


def test_runs_cover_splits_after_the_first(spark):
    alike = spark.createDataFrame([(i, 1, list(range(POSITIONS))) for i in (1, 2)], "rep long, weight long, sig array<long>")
    runs = leaves(alike, THRESHOLD, SMALL, RECALL).select("path").distinct().count()

    def missed(depth):       # of a pair at the threshold, in a bucket of this depth
        return 0 if depth == DEPTH else (1 - THRESHOLD + THRESHOLD * missed(depth + 1)) ** CHILDREN
    assert (1 - THRESHOLD + THRESHOLD * missed(1)) ** runs <= 1 - RECALL


def test_odd_rows_and_empty_table(edge_docs, no_docs, doc_rows):
    out = jaccard_groups(edge_docs).collect()
    assert len(out) == len(doc_rows)
    by = {r.doc_id: r for r in out}
    assert all(by[200 + i].class_id == by[102 + i].class_id and by[200 + i].n_links > 0 for i in range(5))
    assert by[0].class_id == 0
    assert by[0].n_links == 0 and by[2].n_links == 0
    assert jaccard_groups(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 101)],
                                  "rep long, other long")
    got = {r.rep: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 101: 100}


def test_low_thresholds_get_all_their_runs(spark):
    """0.5 and 0.4 need more runs than the default samples: nothing is cut, links equal brute force."""
    import random
    from tastemap.llm.jaccard_join import jaccard_groups, leaves, runs_needed
    assert runs_needed(0.5, RECALL) > POSITIONS
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(24)]
        texts.append(words)
        for cut in (3, 5, 7, 8):
            texts.append(words[:24 - cut] + [f"x{rng.randrange(900)}" for _ in range(cut)])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    for threshold in (0.5, 0.4):
        near = [sum(len(a & b) / len(a | b) >= threshold for b in sets) - 1 for a in sets]
        got = {r.doc_id: r.n_links for r in jaccard_groups(docs, threshold=threshold).collect()}
        assert [got[i] for i in range(len(sets))] == near and sum(near) > 40
    import pytest
    some = spark.createDataFrame([(1, 1, [0] * 4)], "rep long, weight long, sig array<long>")
    with pytest.raises(ValueError):
        leaves(some, 0.5, SMALL, RECALL, positions=4)
