"""Golden values for the column functions (hand-computed)."""

import math

import pytest
from pyspark.sql import functions as F

from tastemap.functions import scalar as X


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("ts,label", [
    ("2016-05-20 00:00:00", "凌晨"), ("2016-05-20 05:59:59", "凌晨"),
    ("2016-05-20 06:00:00", "上午"), ("2016-05-20 11:59:59", "上午"),
    ("2016-05-20 12:00:00", "下午"), ("2016-05-20 17:59:59", "下午"),
    ("2016-05-20 18:00:00", "晚上"), ("2016-05-20 23:59:59", "晚上"),
    ("2016-05-20 18:59:59", "晚上"),
])
def test_time_bucket_edges(spark, ts, label):
    assert one(spark, X.time_bucket(X.parse_log_time(F.col("s"))), s=ts) == label


@pytest.mark.parametrize("bad", [None, "2016-05-20", "2016-05-20 25:00:00", "garbage"])
def test_time_bucket_bad_input_is_null(spark, bad):
    df = spark.createDataFrame([(bad,)], "s string")
    assert df.select(X.time_bucket(X.parse_log_time("s")).alias("b")).first()["b"] is None


def test_in_zone_inclusive(spark):
    df = spark.createDataFrame([("2016-05-20 05:59:59",), ("2016-05-20 06:00:00",)], "s string")
    got = [r[0] for r in df.select(X.in_zone(X.parse_log_time("s"), "00:00:00", "05:59:59")).collect()]
    assert got == [True, False]


def test_behaviour_weight(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (None,)], "c int")
    got = [r[0] for r in df.select(X.behaviour_weight("c")).collect()]
    assert got == [0.2, 0.2, 0.3, 0.3, None, None]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [3.0, 1.0]),
                                ([1.0, 2.0, 3.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(X.cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(0.707107, abs=1e-6)
    assert got[1] == 0.0
    assert got[2] == pytest.approx(5 / (math.sqrt(14) * math.sqrt(5)))


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], []), (["a", "a"], ["a"])],
                               "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.jaccard("a", "b")).collect()] == [0.5, 0.0, 1.0]


def test_blend_score(spark):
    assert one(spark, X.blend_score(F.lit(0.8), F.lit(0.5), 3.0, 4.0)) == pytest.approx(0.88)


def test_pad(spark):
    df = spark.createDataFrame([([1.0],), ([1.0, 2.0, 3.0],)], "a array<double>")
    got = [r[0] for r in df.select(X.pad("a", 3)).collect()]
    assert got == [[1.0, 0.0, 0.0], [1.0, 2.0, 3.0]]


def test_merge_mean_running_mean(spark):
    df = spark.createDataFrame([([0.3, 0.1, 0.2], [0.12, 0.32], 10, 2)],
                               "s array<double>, o array<double>, c long, n long")
    got = df.select(X.merge_mean("s", "o", "c", "n")).first()[0]
    assert got == pytest.approx([1.5 / 12, 3.3 / 12, 0.2 / 12])
    assert [round(x, 6) for x in got] == [0.125, 0.275, 0.016667]


def test_unscale(spark):
    df = spark.createDataFrame([([0.5, 0.25], 4)], "a array<double>, n long")
    assert df.select(X.unscale("a", "n")).first()[0] == [2.0, 1.0]


def test_idf_formula(spark):
    from tastemap.operators import text as T
    docs = spark.createDataFrame([(0, "x y"), (1, "y"), (2, "y"), (3, "y")], "doc_id long, words string")
    tf = T.term_freq(docs)
    idf = {r["term"]: r["idf"] for r in T.idf(tf, docs.select(F.count(F.lit(1))).scalar()).collect()}
    assert idf["x"] == pytest.approx(math.log(5 / 2))
    assert idf["y"] == pytest.approx(0.0)


def test_jaccard_disjoint_and_identical(spark):
    df = spark.createDataFrame([(["a", "b"], ["c"]), (["x", "y"], ["y", "x"])],
                               "a array<string>, b array<string>")
    assert [r[0] for r in df.select(X.jaccard("a", "b")).collect()] == [0.0, 1.0]
