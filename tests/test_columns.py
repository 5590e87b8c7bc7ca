import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemap.operators import columns as K
from tastemap.operators import text as T


@pytest.mark.parametrize("seed,density,t", [(1, 0.08, 0.4), (2, 0.3, 0.7), (3, 0.08, 0.9)])
def test_equals_numpy(spark, seed, density, t):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(70, 40)) * (rng.random((70, 40)) < density)
    x[:, 5], x[:, 7], x[:, 9] = 2 * x[:, 4], -x[:, 4], 0
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    rows += [(0, 39, 0.0), (None, 3, 1.0), (3, None, 1.0), (4, 2, None)]
    got = K.column_similarities(spark.createDataFrame(rows, "r long, c long, v double"), "r", "c", "v", t).collect()
    n = np.linalg.norm(x, axis=0)
    want = {(i, j): x[:, i] @ x[:, j] / (n[i] * n[j]) for i in range(40) for j in range(i + 1, 40) if n[i] and n[j]}
    want = {k: v for k, v in want.items() if v >= t}
    assert {(r.c_a, r.c_b) for r in got} == set(want) and (4, 5) in want
    assert all(abs(r.sim - want[r.c_a, r.c_b]) < 1e-12 for r in got)


@pytest.mark.parametrize("few", [0, 39])
def test_many_columns_take_the_prefixes(spark, monkeypatch, few):
    monkeypatch.setattr(K, "FEW_COLUMNS", few)
    test_equals_numpy(spark, 2, 0.3, 0.7)


def test_few_columns_shuffle_no_pair_of_a_row(spark):
    """400 rows that all hold the same 30 columns: one sum per pair and task, not one per row."""
    rows = spark.range(400).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("c"),
                                   F.lit(1.0).alias("v"))
    got = K.column_similarities(rows, "r", "c", "v", 0.9)
    assert got.count() == 30 * 29 // 2 and got.agg(F.min("sim")).first()[0] > 1 - 1e-12
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_many" not in plan


def test_cells_add_up_and_thresholds_are_positive(spark):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, "a", 1.0), (1, "b", 2.0), (2, "b", 1.0), (3, "z", 1.0)]
    df = spark.createDataFrame(rows, "r long, c string, v double")
    got = [tuple(r) for r in K.column_similarities(df, "r", "c", "v", 0.99).collect()]
    assert [g[:2] for g in got] == [("a", "b")] and abs(got[0][2] - 1) < 1e-12
    assert K.column_similarities(df.where("false"), "r", "c", "v", 0.5).count() == 0
    with pytest.raises(ValueError):
        K.column_similarities(df, "r", "c", "v", 0.0)


def test_long_rows_and_unlike_columns_make_no_candidates(spark):
    """One row holds every column: without prefixes its outer product alone is all pairs."""
    rng = np.random.default_rng(8)
    rows = [(1000, c, 1.0) for c in range(80)]
    rows += [(int(r), c, 1.0) for c in range(80) for r in rng.choice(400, 6, replace=False)]
    df = spark.createDataFrame(rows, "_row long, _col long, _v double")
    n = df.groupBy("_col").agg(F.sqrt(F.sum("_v")).alias("_n"))
    unit = df.join(n, "_col").select("_row", "_col", (F.col("_v") / F.col("_n")).alias("_x"))
    pairs = K.column_candidates(unit, 0.6).count()
    assert pairs < 0.1 * 80 * 79 / 2


@pytest.mark.parametrize("counters", [7, 64, 1 << 20])
def test_frequent_terms_equal_the_vocabulary(spark, counters):
    import random
    rng = random.Random(counters)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=40))) for i in range(60)]
    df = spark.createDataFrame(docs + [(90, None), (91, "  ")], "doc_id long, words string")
    for size in (1, 25, 1000):
        want = T.vocabulary(df, size).collect()
        assert T.frequent_terms(df, size, counters=counters).collect() == want
    assert T.frequent_terms(df.where("false"), 5, counters=counters).count() == 0


def test_ids_keep_their_index_over_runs(spark, tmp_path, monkeypatch):
    from tastemap.operators import cf
    from tastemap.sources import delta_store
    monkeypatch.setattr(delta_store, "MAX_DELTA_SHARE", 10.0)      # no compaction in between
    ids = cf.IdDictionary(spark, str(tmp_path / "ids"), "u", "i")
    assert ids.read() is None
    before = {}
    for run in (["b", "a", None, "a"], ["c", "a"], ["a"], ["d", "e", "b"]):
        got = dict(tuple(r) for r in ids.extend(spark.createDataFrame([(x,) for x in run], "u string")).collect())
        assert before.items() <= got.items() and sorted(got.values()) == list(range(len(got)))
        assert set(got) == set(before) | {x for x in run if x}
        before = got
    assert ids.store.snapshot().layers["ids"][-1]["rows"] == 2     # a run writes only its new ids


def test_retrained_models_share_their_indices(spark, tmp_path):
    from tastemap.config import Params
    from tastemap.operators import cf
    make = lambda us: spark.createDataFrame([(f"u{u}", f"n{i}", 0.2 + (u + i) % 3) for u in us
                                             for i in range(6)], "user_id string, doc_id string, weight double")
    p, ids = Params(als_iterations=2), str(tmp_path / "ids")
    one = cf.train(make(range(5)), p, ids=ids)
    two = cf.train(make(range(3, 9)), p, ids=ids)
    first = {tuple(r) for r in one.users.collect()}
    assert first <= {tuple(r) for r in two.users.collect()} and two.users.count() == 9
    assert cf.recommend(two, make([8]), 2).count() == 2
