"""Exact similarity joins against brute force (numpy / python sets)."""

import itertools
import math

import numpy as np
import pytest

from tastemap.operators import similarity as S


def brute_cos(L, R, t):
    out = {}
    for (lk, a), (rk, b) in itertools.product(L, R):
        n = max(len(a), len(b))
        a2, b2 = np.pad(a, (0, n - len(a))), np.pad(b, (0, n - len(b)))
        na, nb = np.linalg.norm(a2), np.linalg.norm(b2)
        if na == 0 or nb == 0:
            continue
        c = float(a2 @ b2 / (na * nb))
        if c > t:
            out[(lk, rk)] = c
    return out


def make_vectors(rng, n, k, sparse=False):
    rows = []
    for i in range(n):
        v = rng.normal(size=k)
        if sparse:
            v[rng.random(k) < 0.7] = 0.0
            v = np.abs(v)
        rows.append((i, [float(x) for x in v]))
    rows.append((n, [0.0] * k))  # zero vector never matches
    return rows


@pytest.mark.parametrize("sparse,t,k", [(False, 0.2, 16), (True, 0.5, 16), (True, 0.0, 8),
                                        (False, 0.1, 80)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_cosine_join_matches_brute_force(spark, sparse, t, k, broadcast):
    rng = np.random.default_rng(7)
    L, R = make_vectors(rng, 40, k, sparse), make_vectors(rng, 15, k, sparse)
    ldf = spark.createDataFrame(L, "user_id long, v array<double>")
    rdf = spark.createDataFrame(R, "doc_id long, w array<double>")
    got = S.cosine_join(ldf, rdf, ["user_id"], ["doc_id"], "v", "w", t,
                        broadcast_bytes=None if broadcast else 0)
    rows = got.collect()
    assert len(rows) == len({(r[0], r[1]) for r in rows})  # no duplicate pairs
    exp = brute_cos(L, R, t)
    assert {(r[0], r[1]) for r in rows} == set(exp)
    for r in rows:
        assert r[2] == pytest.approx(exp[(r[0], r[1])], abs=1e-12)


def test_cosine_join_unequal_lengths(spark):
    L = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0])]
    R = [(10, [1.0, 0.1]), (11, [0.0, 0.0, 5.0])]
    ldf = spark.createDataFrame(L, "user_id long, v array<double>")
    rdf = spark.createDataFrame(R, "doc_id long, w array<double>")
    got = {(r[0], r[1]): r[2] for r in
           S.cosine_join(ldf, rdf, ["user_id"], ["doc_id"], "v", "w", 0.05).collect()}
    assert got == pytest.approx(brute_cos(L, R, 0.05))


def test_cosine_join_rejects_negative_threshold(spark):
    df = spark.createDataFrame([(1, [1.0])], "user_id long, v array<double>")
    with pytest.raises(ValueError):
        S.cosine_join(df, df.withColumnRenamed("user_id", "doc_id"), ["user_id"], ["doc_id"],
                      "v", "v", -0.1)


def test_cosine_of_pairs_symmetric_and_bounded(spark):
    rng = np.random.default_rng(3)
    L = make_vectors(rng, 10, 6)
    ldf = spark.createDataFrame(L, "a long, v array<double>")
    rdf = spark.createDataFrame(L, "b long, v array<double>")
    pairs = spark.createDataFrame([(i, j) for i in range(11) for j in range(11)], "a long, b long")
    sims = {(r[0], r[1]): r[2] for r in
            S.cosine_of_pairs(pairs, ldf, rdf, ["a"], ["b"], "v", "v").collect()}
    for (i, j), s in sims.items():
        assert -1 - 1e-12 <= s <= 1 + 1e-12
        assert s == pytest.approx(sims[(j, i)])


def brute_jac(L, R):
    ls, rs = {}, {}
    for k, t in L:
        ls.setdefault(k, set()).add(t)
    for k, t in R:
        rs.setdefault(k, set()).add(t)
    out = {}
    for a, sa in ls.items():
        for b, sb in rs.items():
            inter = len(sa & sb)
            if inter:
                out[(a, b)] = inter / len(sa | sb)
    return out


def test_jaccard_join_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    vocab = [f"t{i}" for i in range(30)]
    L = [(u, vocab[int(x)]) for u in range(25) for x in rng.integers(0, 30, 6)]
    R = [(d, vocab[int(x)]) for d in range(12) for x in rng.integers(0, 30, 5)]
    got = S.jaccard_join(spark.createDataFrame(L, "user_id long, term string"),
                         spark.createDataFrame(R, "doc_id long, term string"),
                         ["user_id"], ["doc_id"], salt_buckets=4).collect()
    exp = brute_jac(L, R)
    assert {(r[0], r[1]) for r in got} == set(exp)
    for r in got:
        assert 0 < r["sim"] <= 1
        assert r["sim"] == pytest.approx(exp[(r[0], r[1])])


@pytest.mark.parametrize("seed,t", [(1, 0.1), (2, 0.3), (3, 0.5), (4, 0.8), (5, 1.0)])
def test_jaccard_threshold_matches_brute_force(spark, seed, t):
    """Prefixes lose nothing, and a term that every set holds makes no candidates."""
    rng = np.random.default_rng(seed)
    def side(n, near):
        out = []
        for i in range(n):
            own = {f"t{x}" for x in rng.zipf(1.3, int(rng.integers(1, 14))) % 60}
            if i % 3 == 0 and near:
                own = set(near[int(rng.integers(0, len(near)))]) ^ {f"t{int(rng.integers(0, 60))}"}
            out.append(sorted(own | {"everywhere"}))
        return out
    left = side(70, None)
    right = side(40, left)
    L = [(u, w) for u, ws in enumerate(left) for w in ws]
    R = [(d, w) for d, ws in enumerate(right) for w in ws]
    ldf = spark.createDataFrame(L + [(0, None)], "user_id long, term string")
    rdf = spark.createDataFrame(R + R[:5], "doc_id long, term string")
    got = S.jaccard_join(ldf, rdf, ["user_id"], ["doc_id"], salt_buckets=3, min_sim=t).collect()
    exp = {k: v for k, v in brute_jac(L, R).items() if v >= t - 1e-12}
    assert {(r[0], r[1]) for r in got} == set(exp) and (exp or t == 1.0)
    assert all(r["sim"] == pytest.approx(exp[r[0], r[1]]) for r in got)
    cand = S.jaccard_candidates(ldf, rdf, ["user_id"], ["doc_id"], "term", t, 3).count()
    assert t < 0.3 or cand < (0.7 if t < 0.5 else 0.4) * 70 * 40     # sharing a term alone: all 2,800 pairs


# weights, threshold, keyword floor: the second and third need a keyword similarity by themselves
@pytest.mark.parametrize("sig, bet, t, floor", [
    (0.7, 0.3, 0.2, 0.0), (0.3, 0.7, 0.5, 0.0), (0.0, 1.0, 0.1, 0.0), (0.7, 0.3, 0.2, 0.1), (0.7, 0.3, 0.2, 0.6),
    (0.5, 0.5, 0.4, 0.3), (0.0, 1.0, 0.1, 0.3), (1.0, 0.0, 0.3, 0.2)])
def test_hybrid_matches_brute_force(spark, sig, bet, t, floor):
    rng = np.random.default_rng(5)
    Lv, Rv = make_vectors(rng, 30, 8), make_vectors(rng, 12, 8)
    vocab = [f"t{i}" for i in range(20)]
    Lt = [(u, vocab[int(x)]) for u in range(31) for x in rng.integers(0, 20, 5)]
    Rt = [(d, vocab[int(x)]) for d in range(13) for x in rng.integers(0, 20, 4)]
    got = S.hybrid_join(spark.createDataFrame(Lv, "user_id long, v array<double>"),
                        spark.createDataFrame(Rv, "doc_id long, v array<double>"),
                        spark.createDataFrame(Lt, "user_id long, term string"),
                        spark.createDataFrame(Rt, "doc_id long, term string"),
                        ["user_id"], ["doc_id"], "v", "v", t, sig, bet, salt_buckets=2,
                        keyword_floor=floor).collect()
    cos_all = brute_cos(Lv, Rv, -2.0)
    jac = brute_jac(Lt, Rt)
    exp = {}
    # a keyword pair needs no vector: one side may be unknown to the other index
    for lk in {r[0] for r in Lv + Lt}:
        for rk in {r[0] for r in Rv + Rt}:
            st, sk = cos_all.get((lk, rk), 0.0), jac.get((lk, rk), 0.0)
            score = (st * sig + sk * bet) / math.sqrt(sig * sig + bet * bet)
            if score > t:
                exp[(lk, rk)] = score
    assert {(r[0], r[1]) for r in got} == set(exp) and len(got) == len(exp) > 0
    for r in got:
        assert r["score"] == pytest.approx(exp[(r[0], r[1])])


def test_prefix_is_what_the_bound_needs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(20)]
    df = S.with_unit(spark.createDataFrame(rows, "id long, v array<double>"), "v", "u")
    got = {r.id: r.p for r in S.with_prefix(df, "u", 0.3, "p").collect()}
    for i, v in rows:
        u = np.array(v) / np.linalg.norm(v)
        order = sorted(range(12), key=lambda k: (-abs(u[k]), k))
        assert got[i] == [k for j, k in enumerate(order) if np.linalg.norm(u[order[j:]]) > 0.3]


@pytest.mark.parametrize("broadcast", [True, False])
def test_candidates_are_made_once_and_pruned_when_sparse(spark, broadcast):
    rng = np.random.default_rng(5)
    for sparse, t in ((False, 0.2), (True, 0.6)):
        L, R = make_vectors(rng, 60, 24, sparse), make_vectors(rng, 25, 24, sparse)
        if sparse:      # a few concentrated dimensions a vector
            L, R = [[(i, [x if k % 6 == i % 6 else 0.0 for k, x in enumerate(v)]) for i, v in side] for side in (L, R)]
        ldf = spark.createDataFrame(L, "user_id long, v array<double>")
        rdf = spark.createDataFrame(R, "doc_id long, w array<double>")
        lu = S.prepare_left(ldf, ["user_id"], "v", t)
        cand = S.cosine_candidates(lu, rdf, ["user_id"], ["doc_id"], "w", 10 ** 9 if broadcast else 0)
        pairs = [(r.user_id, r.doc_id) for r in cand.collect()]
        assert len(pairs) == len(set(pairs)) and set(brute_cos(L, R, t)) <= set(pairs)
        assert len(pairs) <= 60 * 25
        if sparse:
            assert len(pairs) < 60 * 25 / 3


@pytest.mark.parametrize("broadcast", [True, False])
def test_dense_pairs_are_pruned_by_angles(spark, broadcast, monkeypatch):
    """Clustered dense vectors: few pairs become candidates; scattered ones stay exact, too."""
    monkeypatch.setattr(S, "DENSE_ROWS", 64)
    rng = np.random.default_rng(17)
    def side(n, centres, noise):
        x = centres[rng.integers(0, len(centres), n)] + noise * rng.normal(size=(n, 12))
        return [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    for centres, noise, t in ((rng.normal(size=(9, 12)), 0.05, 0.8), (np.zeros((1, 12)), 1.0, 0.3)):
        L, R = side(150, centres, noise), side(110, centres, noise)
        ldf = spark.createDataFrame(L, "user_id long, v array<double>")
        rdf = spark.createDataFrame(R, "doc_id long, w array<double>")
        limit = 10 ** 9 if broadcast else 0
        lu = S.prepare_left(ldf, ["user_id"], "v", t)
        cand = S.cosine_candidates(lu, rdf, ["user_id"], ["doc_id"], "w", limit, t)
        pairs = [(r.user_id, r.doc_id) for r in cand.select("user_id", "doc_id").collect()]
        exp = brute_cos(L, R, t)
        assert len(pairs) == len(set(pairs)) and set(exp) <= set(pairs)
        if noise < 1:
            assert len(pairs) < 0.2 * 150 * 110
            plan = cand._jdf.queryExecution().executedPlan().toString()
            assert "Cartesian" not in plan and "NestedLoop" not in plan
        got = S.cosine_join(ldf, rdf, ["user_id"], ["doc_id"], "v", "w", t, broadcast_bytes=limit).collect()
        assert {(r[0], r[1]) for r in got} == set(exp)
        assert all(r[2] == pytest.approx(exp[(r[0], r[1])], abs=1e-12) for r in got)


def test_dense_pairs_meet_as_matrices(spark, monkeypatch):
    """A large dense right side: no pair is a row before its cosine is known; parts, chunks and
    slices of any size give the exact pairs, repeated rows and null keys too."""
    for name, value in (("DENSE_ROWS", 64), ("CHUNK_ROWS", 100), ("PART_BYTES", 8 * 12 * 70), ("SLICE", 16),
                        ("CHUNK_BYTES", 8 * 12 * 90), ("PAIRS_AT_ONCE", 37)):
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(23)
    def side(n, centres, noise):
        x = centres[rng.integers(0, len(centres), n)] + noise * rng.normal(size=(n, 12))
        return [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    for centres, noise, t in ((rng.normal(size=(9, 12)), 0.05, 0.8), (np.zeros((1, 12)), 1.0, 0.3)):
        L, R = side(150, centres, noise), side(330, centres, noise)
        L += [(150, [0.0] * 12), (151, [1.0, 2.0])]
        extra = [(0, L[0][1]), (None, L[1][1])]
        ldf = spark.createDataFrame(L + extra, "user_id long, v array<double>")
        rdf = spark.createDataFrame(R + R[:3], "doc_id long, w array<double>")
        got = S.cosine_join(ldf, rdf, ["user_id"], ["doc_id"], "v", "w", t)
        assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
        rows = sorted((-1 if u is None else u, d, s) for u, d, s in got.collect())
        exp = [(-1 if u is None else u, d, s) for u, v in L + extra
               for (_, d), s in brute_cos([(u, v)], R, t).items() for _ in range(2 if d < 3 else 1)]
        assert [r[:2] for r in rows] == [r[:2] for r in sorted(exp)] and len(exp) > 100
        assert all(r[2] == pytest.approx(e[2], abs=1e-12) for r, e in zip(rows, sorted(exp)))


@pytest.mark.parametrize("broadcast", [True, False])
def test_cosine_join_long_left_short_right(spark, broadcast):
    """Left vectors longer than 64 against right vectors of at most 64 dims:
    prefix dimensions >= 64 must not disturb the first-shared-dimension test."""
    rng = np.random.default_rng(13)
    L = []
    for i in range(60):
        v = rng.normal(size=80) * 0.05
        v[64 + (i % 16)] = 3.0          # largest entry beyond the right's width
        v[i % 16] = 2.0                 # then one the right side has
        L.append((i, [float(x) for x in v]))
    R = [(j, [float(x) for x in rng.normal(size=16)]) for j in range(12)]
    ldf = spark.createDataFrame(L, "user_id long, v array<double>")
    rdf = spark.createDataFrame(R, "doc_id long, w array<double>")
    got = S.cosine_join(ldf, rdf, ["user_id"], ["doc_id"], "v", "w", 0.05,
                        broadcast_bytes=None if broadcast else 0).collect()
    exp = brute_cos(L, R, 0.05)
    assert {(r[0], r[1]) for r in got} == set(exp) and len(exp) > 0


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), k=st.integers(1, 20), sparsity=st.floats(0.0, 0.9),
       t=st.floats(0.0, 0.95), broadcast=st.booleans())
def test_cosine_join_property(spark, seed, k, sparsity, t, broadcast):
    rng = np.random.default_rng(seed)

    def vecs(n):
        out = []
        for i in range(n):
            length = int(rng.integers(1, k + 1))
            v = rng.normal(size=length)
            v[rng.random(length) < sparsity] = 0.0
            out.append((i, [float(x) for x in v]))
        return out
    L, R = vecs(25), vecs(10)
    got = S.cosine_join(spark.createDataFrame(L, "user_id long, v array<double>"),
                        spark.createDataFrame(R, "doc_id long, w array<double>"),
                        ["user_id"], ["doc_id"], "v", "w", t,
                        broadcast_bytes=None if broadcast else 0).collect()
    exp = brute_cos(L, R, t)
    sims = {(r[0], r[1]): r[2] for r in got}
    assert len(sims) == len(got)                       # no duplicate pairs
    # pairs within 1e-12 of the threshold may fall either way through rounding
    assert {p for p, c in exp.items() if c > t + 1e-12} <= sims.keys()
    assert all(p in exp or abs(v - t) < 1e-12 for p, v in sims.items())
    assert all(v > t for v in sims.values())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6), vocab=st.integers(2, 40), per=st.integers(1, 8))
def test_jaccard_join_property(spark, seed, vocab, per):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocab)]
    L = [(u, words[int(x)]) for u in range(15) for x in rng.integers(0, vocab, per)]
    R = [(d, words[int(x)]) for d in range(8) for x in rng.integers(0, vocab, per)]
    got = {(r[0], r[1]): r["sim"] for r in S.jaccard_join(
        spark.createDataFrame(L, "user_id long, term string"),
        spark.createDataFrame(R, "doc_id long, term string"),
        ["user_id"], ["doc_id"], salt_buckets=3).collect()}
    exp = brute_jac(L, R)
    assert got.keys() == exp.keys()
    for key, v in got.items():
        assert 0 < v <= 1 and v == pytest.approx(exp[key])


def test_hybrid_checkpointed_pairs_same_result(spark):
    from tastemap.plans import catalogue as C
    from tastemap.sources import testdata as TD
    from conftest import SF_SMALL
    P = C.PARAMS
    args = (C.morning_profiles(spark, SF_SMALL), TD.new_article_topics(spark, SF_SMALL),
            C._morning_terms(spark, SF_SMALL), C.new_keywords(spark, SF_SMALL).select("doc_id", "term"),
            ["user_id"], ["doc_id"], "topic", "topic", P.min_similarity, P.topic_weight, P.keyword_weight)
    a = sorted(map(tuple, S.hybrid_join(*args).collect()))
    b = sorted(map(tuple, S.hybrid_join(*args, checkpoint_pairs=True).collect()))
    assert a == b and len(a) > 0


def test_dense_sides_are_sent_a_bounded_number_of_times():
    """650,000 vectors of 64 doubles and 540,000 profiles: copies sent, and what a task holds."""
    n, n_left, width = 650_000, 540_000, 64
    chunk, parts = S._dense_sizes(n, n_left, width)
    assert 8 * width * max(chunk, -(-n_left // parts)) <= 32 << 20
    assert -(-n // chunk) <= 17 and parts <= 9
    assert 8 * width * (n_left * -(-n // chunk) + n * parts) < 8e9
    assert S._dense_sizes(1024, 100, 64) == (1024, 1) and S._dense_sizes(10, 0, 8)[1] == 1


def test_products_at_once_are_bounded(monkeypatch):
    import numpy as np
    rng = np.random.default_rng(6)
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(50, 5)), rng.normal(size=(70, 5))))
    pairs = lambda: {(int(i), int(j)): x for a, b, c in S._pairs_above(u, v, 0.4) for i, j, x in zip(a, b, c)}
    want = pairs()
    assert set(want) == set(zip(*(x.tolist() for x in np.nonzero(u @ v.T > 0.4))))
    for most in (1, 100, 1000):
        monkeypatch.setattr(S, "PRODUCTS", most)
        assert pairs() == want
