"""Base-and-delta tables: touched keys only, one log, conflicts, replays, crashes, compaction."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tastemap.session import scratch_path
from tastemap.sources import delta_store as D
from tastemap.sources import files
from tastemap.sources import store as ST


def make(spark, tables=("t",)):
    base = scratch_path(spark, "delta-test")
    return D.DeltaStore(spark, f"{base}/log", {n: D.Table(f"{base}/{n}", ["k"]) for n in tables})


def rows(spark, d):
    return spark.createDataFrame([(k, v) for k, vs in d.items() for v in vs], "k long, v long")


def state(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, []).append(r.v)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("broadcast", [True, False])
def test_reads_equal_a_dictionary(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(D, "BROADCAST_KEYS", -1)
    rng = random.Random(5)
    store, want = make(spark), {}
    assert store.read("t") is None
    for step in range(5):
        change = {rng.randrange(30): [rng.randrange(9) for _ in range(rng.randrange(1, 4))] for _ in range(8)}
        want.update(change)
        at = store.transact(lambda at: {"t": rows(spark, change)})
        assert state(store.read("t")) == {k: sorted(v) for k, v in want.items()}
        # a delta holds the touched keys, nothing else
        assert at.layers["t"][-1]["rows"] == sum(map(len, change.values())) or at.layers["t"][-1]["kind"] == "base"
        some = rows(spark, {k: [0] for k in (1, 2, 99)})
        assert state(store.read("t", touched=some)) == {k: sorted(want[k]) for k in (1, 2) if k in want}
    before = state(store.read("t"))
    at = store.compact()
    assert [one["kind"] for one in at.layers["t"]] == ["base"] and state(store.read("t")) == before
    assert store.vacuum(keep=1) > 0 and state(store.read("t")) == before
    assert state(ST.read_latest(spark, store.tables["t"].path)) == before


def test_updates_compact_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_DELTAS", 2)
    monkeypatch.setattr(D, "MAX_DELTA_SHARE", 10.0)
    store = make(spark)
    for i in range(5):
        at = store.transact(lambda at: {"t": rows(spark, {i: [i]})})
        assert len(at.layers["t"]) <= 3
    assert state(store.read("t")) == {i: [i] for i in range(5)}


def test_a_crash_before_the_commit_changes_nothing(spark, monkeypatch):
    store = make(spark)
    store.transact(lambda at: {"t": rows(spark, {1: [1]})})
    monkeypatch.setattr(D, "put_if_absent", lambda *a: 1 / 0)     # the layer is written, the version is not
    with pytest.raises(ZeroDivisionError):
        store.transact(lambda at: {"t": rows(spark, {1: [2], 3: [3]})}, ("job", 7))
    monkeypatch.undo()
    assert state(store.read("t")) == {1: [1]} and store.snapshot().batches == {}
    store.transact(lambda at: {"t": rows(spark, {1: [2], 3: [3]})}, ("job", 7))
    assert state(store.read("t")) == {1: [2], 3: [3]}
    assert store.vacuum(keep=1) == 1                               # the orphan of the crash


def test_replayed_batches_add_nothing(spark):
    store = make(spark)
    add = lambda at: {"t": rows(spark, {1: [1]}) if store.read("t", at) is None else
                      store.read("t", at).withColumn("v", F.col("v") + 1)}
    for batch in (0, 1, 1, 0, 2, 2):
        store.transact(add, ("stream", batch))
    store.transact(add, ("other", 0))                              # another producer counts for itself
    assert state(store.read("t")) == {1: [4]}


def test_tables_become_current_together(spark):
    store = make(spark, ("a", "b"))
    store.transact(lambda at: {"a": rows(spark, {1: [1]}), "b": rows(spark, {1: [10]})})
    old = store.snapshot()
    store.transact(lambda at: {"a": rows(spark, {1: [2]}), "b": rows(spark, {1: [20]})})
    assert (state(store.read("a", old)), state(store.read("b", old))) == ({1: [1]}, {1: [10]})
    assert (state(store.read("a")), state(store.read("b"))) == ({1: [2]}, {1: [20]})


def test_the_second_writer_starts_again(spark):
    store, seen = make(spark), []
    store.transact(lambda at: {"t": rows(spark, {1: [0]})})

    def slow(at):
        seen.append(at.version)
        if len(seen) == 1:                                         # another writer commits meanwhile
            store.transact(lambda at: {"t": rows(spark, {1: [5]})})
        return {"t": store.read("t", at).withColumn("v", F.col("v") + 1)}
    store.transact(slow)
    assert seen == [0, 1] and state(store.read("t")) == {1: [6]}


def test_two_writers_at_once_lose_no_update(spark):
    store = make(spark)
    store.transact(lambda at: {"t": rows(spark, {1: [0]})})
    errors = []

    def writer():
        try:
            for _ in range(3):
                store.transact(lambda at: {"t": store.read("t", at).withColumn("v", F.col("v") + 1)})
        except Exception as e:      # noqa: BLE001
            errors.append(e)
    threads = [threading.Thread(target=writer) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and state(store.read("t")) == {1: [6]}


def test_put_if_absent_has_one_winner(spark):
    path = scratch_path(spark, "claim") + "/x"
    got = []
    threads = [threading.Thread(target=lambda i=i: got.append((files.put_if_absent(spark, path, f"by {i}"), i)))
               for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [i for ok, i in got if ok]
    assert len(got) == 8 and len(winners) == 1 and files.read_text(spark, path) == f"by {winners[0]}"
    assert not files.put_if_absent(spark, path, "late")


def test_two_appenders_with_one_listing_lose_no_row(spark, monkeypatch):
    base = scratch_path(spark, "appenders")
    monkeypatch.setattr(ST, "_batches", lambda *a: [])             # both believe the sink is empty
    one = spark.createDataFrame([(1, 1, "cf")], "user_id long, doc_id long, source string")
    two = spark.createDataFrame([(2, 2, "cf")], "user_id long, doc_id long, source string")
    assert ST.append_batch(one, base, job="cf") == 0
    assert ST.append_batch(two, base, job="cf") == 1
    monkeypatch.undo()
    assert {(r.user_id, r.batch_id) for r in ST.read_recs(spark, base).collect()} == {(1, 0), (2, 1)}
    assert ST.append_batch(one, base, job="cf") == 2


def test_the_queue_writes_marked_entries_only(spark):
    store = ST.queue_store(spark, scratch_path(spark, "queue"))
    done = spark.createDataFrame([(3, "x"), (3, "x"), (70, "x")], "doc_id long, doc_type string")
    assert ST.mark_read_stored(store, done) == 0                   # nothing queued yet
    entries = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("doc_type"),
                                     F.col("id").cast("string").alias("rowkey"), F.lit(False).alias("has_read"))
    store.transact(lambda at: {"queue": entries})
    ST.mark_read_stored(store, done)
    assert store.snapshot().layers["queue"][-1]["rows"] == 1
    read = store.read("queue")
    assert read.count() == 50 and [r.doc_id for r in read.where("has_read").collect()] == [3]
    assert ST.queue_unread(read).count() == 49


def test_a_replayed_micro_batch_of_the_profile_stream(spark):
    """The batch number is committed with the rows: running a batch again changes nothing."""
    from conftest import SF_SMALL
    from tastemap.plans import jobs as J
    from tastemap.sources import testdata as TD
    paths = J.Paths(scratch_path(spark, "profile-replay"))
    news, vecs = TD.news(spark, SF_SMALL), TD.article_topics(spark, SF_SMALL)
    log = TD.behaviour_log(spark, SF_SMALL)
    part = [log.where(F.pmod("event_id", F.lit(2)) == i) for i in (0, 1)]
    for i in (0, 1, 1, 0):
        J.update_profiles(spark, part[i], news, paths, vecs, train_cf=False, batch=("stream-x", i))
    store = J.profile_store(spark, paths)
    assert store.read("topics").groupBy().sum("news_cnt").first()[0] == log.count()
    touched = log.select("user_id", "bucket").distinct().where("user_id < 3")
    some = store.read("topics", touched=touched)
    assert {r.user_id for r in some.collect()} == {r.user_id for r in touched.collect()}
