"""Exact top-n by inner product: against numpy, against MLlib's list, and what is skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemap.operators import cells as C
from tastemap.operators import mips as M

FIELDS = "key long, features array<double>"


def frame(spark, x, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [float(e) for e in v]) for i, v in enumerate(x)],
                                 FIELDS)


def brute(users, items, n):
    out = set()
    wide = max((len(v) for v in items if v is not None), default=0)
    pad = lambda v: np.r_[np.array(v if v is not None else []), np.zeros(64)][:max(wide, 64)]
    for q, u in enumerate(users):
        s = [(-float(np.dot(pad(u), pad(v))), i) for i, v in enumerate(items)]
        s = sorted((round(a, 9) + 0.0, i) for a, i in s)[:n]
        out |= {(q, i, k, round(-a, 4) + 0.0) for k, (a, i) in enumerate(s, 1)}
    return out


def found(spark, users, items, n, **kw):
    top = M.top_items(frame(spark, users).withColumnRenamed("key", "u"),
                      frame(spark, items).withColumnRenamed("key", "i"), n, "u", "i", **kw)
    return top, {(r.u, r.i, r.rk, round(round(r.score, 9), 4) + 0.0) for r in top.rows.collect()}


@pytest.mark.parametrize("dim,small_blocks,broadcast", [(5, False, True), (5, True, False), (24, True, True)])
def test_equals_brute_force(spark, monkeypatch, dim, small_blocks, broadcast):
    rng = np.random.default_rng(dim)
    items = rng.normal(size=(700, dim)) * rng.lognormal(0, 0.8, size=(700, 1))
    users = rng.normal(size=(60, dim))
    if small_blocks:
        monkeypatch.setattr(M, "BLOCK_ROWS", 8)
    if not broadcast:
        monkeypatch.setattr(M, "BROADCAST_BYTES", -1)
    top, got = found(spark, users, items, 4)
    assert got == brute(users, items, 4)
    scored, pairs = top.blocks_scored()
    if dim == 5 and small_blocks:
        assert scored < 0.35 * pairs                      # most blocks are never met
    plan = top.rows._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_norm_order_alone_prunes(spark, monkeypatch):
    """One direction, growing norms: Cauchy-Schwarz leaves the small norms out."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(2)
    items = np.array([[1.0, 0.01 * rng.normal()]]) * np.arange(1, 401)[:, None]
    users = np.abs(rng.normal(size=(30, 2)))
    top, got = found(spark, users, items, 3)
    assert got == brute(users, items, 3)
    scored, pairs = top.blocks_scored()
    assert scored <= 0.5 * pairs


def test_odd_vectors(spark):
    items = [None, [], [0.0, 0.0], [1.0], [1.0, 0.0], [1.0, 0.0], [-1.0, -1.0], [0.0, 2.0, 3.0]]
    users = [None, [0.0, 0.0], [1.0, 0.0], [-1.0, 0.0], [0.0, 0.0, 1.0], [-1.0, -1.0, -1.0]]
    for n in (3, 20):
        assert found(spark, users, items, n)[1] == brute(users, items, n)
    assert found(spark, users, [], 3)[1] == set()
    assert found(spark, [], items, 3)[1] == set()
    assert found(spark, users, [[0.0], None], 3)[1] == brute(users, [[0.0], None], 3)


def test_ties_take_the_smallest_items(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 2)
    items = [[1.0, 1.0]] * 40 + [[2.0, 0.0], [0.0, 2.0]] * 10
    users = [[1.0, 1.0], [1.0, 0.0], [-1.0, -1.0]]
    assert found(spark, users, items, 5)[1] == brute(users, items, 5)


def test_equals_the_library_on_a_saved_model(spark, tmp_path, monkeypatch):
    from tastemap.config import Params
    from tastemap.operators import cf
    monkeypatch.setattr(M, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(4)
    rows = [(int(u), int(i), float(rng.choice([0.2, 0.3, 0.5]))) for u in range(120)
            for i in rng.choice(500, 25, replace=False)]
    log = spark.createDataFrame(rows, "user_id long, doc_id long, weight double")
    cf.train(log, Params()).save(str(tmp_path / "cf"))
    model = cf.CFModel.load(spark, str(tmp_path / "cf"))
    users = log.select("user_id").distinct()
    got = {}
    for r in cf.recommend(model, users, 6).collect():
        got.setdefault(r.user_id, {})[r.rk] = (r.doc_id, r.score)
    lib = model.model.recommendForUserSubset(users.select(F.col("user_id").cast("int").alias("user_idx")), 6).collect()
    assert len(got) == len(lib) == 120
    for r in lib:
        own = got[r.user_idx]
        assert sorted(own) == [1, 2, 3, 4, 5, 6]
        for k, rec in enumerate(r.recommendations, 1):
            assert abs(own[k][1] - rec.rating) < 1e-5
        # the same items; neighbours may swap only where the library's floats are equal
        assert {d for d, _ in own.values()} == {x.item_idx for x in r.recommendations}


def test_pivots_are_units_and_bounded(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = np.array(C.pivots_of(frame(spark, x), "features", 9))
    assert p.shape == (9, 6) and np.allclose(np.linalg.norm(p, axis=1), 1)
    assert C.pivots_of(frame(spark, []), "features", 9) == []
    cells = C.with_cell(frame(spark, x), "features", p.tolist(), "cell", "angle").collect()
    for r in cells:
        cos = p @ np.array(r.features)
        assert abs(cos[r.cell] - cos.max()) < 1e-9 and abs(np.cos(r.angle) - cos.max()) < 1e-9


def test_second_round_multiplies_matrices_in_bounded_chunks(spark, monkeypatch):
    """Many queries and weak pruning: (part of the queries, chunk of items) meet as matrices, and the rows
    are those of every pair scored; a block larger than a chunk is dealt to several."""
    monkeypatch.setattr(M, "CHUNK_ITEMS", (50, 50))
    monkeypatch.setattr(M, "PART_QUERIES", (20, 20))
    rng = np.random.default_rng(9)
    items = np.repeat(rng.normal(size=(150, 20)), 3, axis=0)        # copies: ties in every list
    users = rng.normal(size=(70, 20))
    top, got = found(spark, users, items, 4)
    assert got == brute(users, items, 4)
    plan = top.rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    blocks = [{"_b": b, "n": n} for b, n in ((-1, 10), (0, 30), (1, 170), (2, 20), (3, 30))]
    chunks, place = M._chunks(blocks, 260)
    assert [[r["_b"] for r in c] for c in chunks] == [[-1, 0], [1], [1], [1], [1], [2, 3]]
    assert place == {-1: (0, 1), 0: (0, 1), 1: (1, 4), 2: (5, 1), 3: (5, 1)}


def test_bounds_are_worked_out_in_as_many_tasks_as_the_queries_need(spark, monkeypatch):
    """A query is a few bytes but meets every block's bound: the tasks follow the number of queries, and a
    slice's bounds are those of the plan."""
    monkeypatch.setattr(M, "TASK_QUERIES", 10)
    monkeypatch.setattr(M, "BOUNDS_AT_ONCE", 100)
    monkeypatch.setattr(M, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(31)
    items = [None, [0.0] * 6, *(rng.normal(size=(500, 6)) * rng.lognormal(0, 0.8, size=(500, 1)))]
    users = rng.normal(size=(65, 6))
    top, got = found(spark, users, items, 3)
    assert got == brute(users, items, 3)
    plan = top.rows._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(7)" in plan and "MapInArrow" in plan
    blocks = [{"_b": i, "b": i, "cell": c, "lo": lo, "hi": lo + 1.0, "r": r} for i, (c, lo, r) in enumerate(
        [(-1, 0.0, 0.0), (0, 0.5, 0.2), (1, 2.0, 1.5), (1, 0.1, 3.0)])]
    rows = [(0.5, [0.1, 2.5]), (3.0, [3.1, 0.0]), (1.0, [1.2, 1.6])]
    df = spark.createDataFrame([(u, a, blocks) for u, a in rows], "_un double, _al array<double>, bl array<struct<"
                               "b:int,cell:int,lo:double,hi:double,r:double>>")
    plan_bounds = [[x["bound"] for x in r.bd] for r in df.select(F.transform("bl", M._bound).alias("bd")).collect()]
    assert np.allclose(M._bound_matrix(np.array([u for u, _ in rows]), np.array([a for _, a in rows]), blocks),
                       plan_bounds, rtol=1e-14)
