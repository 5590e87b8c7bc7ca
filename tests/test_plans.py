"""Plan properties: JVM-only expressions, no cartesian products, pruned and
pushed-down scans, broadcast only where bounded."""

import pytest

from conftest import SF_SMALL
from tastemap.plans.catalogue import QUERIES

SKIP = {"lda_topics", "lda_describe", "lda_online", "cf_recommend", "cf_text_ids", "stream_recommend",
        "recs_append", "job_vocabulary", "job_cf"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_python_udf_no_cartesian(spark, name):
    p = plan(QUERIES[name](spark, SF_SMALL))
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name}: {bad}"


def test_scan_pruning_and_pushdown(spark):
    p = plan(QUERIES["kv_scan_filter"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(n_chars,5000)" in p
    p = plan(QUERIES["attach_text"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    # events: only the columns the log mapping needs (``value`` is pruned)
    assert ("ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,"
            "event_type:string,props:string>") in p


def test_cosine_join_broadcasts_bounded_index(spark):
    p = plan(QUERIES["score_single"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["user_id", "doc_id", "sim", "rk"]
    assert len(rows) > 0 and all(r["rk"] <= 5 for r in rows)


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_hot_groups_are_cut_before_the_shuffle(spark):
    """Per-group top-k: partial WindowGroupLimit before the exchange, final after."""
    p = plan(QUERIES["keyword_delta"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and ", Partial" in p and ", Final" in p
    p = plan(QUERIES["ratings"](spark, SF_SMALL))
    assert "partial_sum" in p  # map-side combine before the shuffle


def test_attach_words_hashes_a_text_once(spark, tmp_path):
    """Row keys keep four characters: texts that share one are hashed before they meet the events."""
    import hashlib
    from datetime import datetime
    docs = [(i, f"text {i}", "s") for i in range(300)] + [(10_000 + i, f"text {10_000 + i}", None) for i in range(10)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ev = [(i, datetime(2024, 1, 1), 10, "view", '{"k": %d}' % (i % 3)) for i in range(12)]
    spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string"
                          ).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["attach_words"](spark, str(tmp_path))
    top = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "md5(" not in top and "words#" not in top
    rows = {(r.event_id, r.rowkey, r.n_chars, r.words_md5) for r in got.collect()}
    want = set()
    for i, _ts, user, _t, _p in ev:
        key = ("gone-" if i % 5 == 0 else "") + "news" + str(100 * (user % 3) + i % 3)[:4].rjust(4, "0")
        texts = [t for n, t, _s in docs if "news" + str(n)[:4].rjust(4, "0") == key] or [""]
        want |= {(i, key, len(t), hashlib.md5(t.encode()).hexdigest()) for t in texts}
    assert rows == want


@pytest.mark.parametrize("name", ["score_hybrid", "score_hybrid_floor", "score_hybrid_keywords"])
def test_hybrid_queries_read_the_corpus_once(spark, name):
    """Profiles, their keywords and the new articles' keywords are stored before the join, which reads
    them several times: neither texts nor events are in its plan."""
    p = plan(QUERIES[name](spark, SF_SMALL))
    assert "text:string" not in p and "event_type" not in p
