import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tastemap.llm.common import last_start
from tastemap.llm.mixing import mix, mixed_texts, permuted, running_total, taken_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, active, out = 1.5 * sum(sizes.values()), list(names), {}
    while active:
        total = sum(weight[s] for s in active)
        share = {s: left * weight[s] / total for s in active}
        over = [s for s in active if share[s] > 2 * sizes[s]]
        if not over:
            out.update(share)
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            active.remove(s)
    return out


def test_targets_and_taken_words(edge_docs, doc_rows):
    sizes = Counter()
    for r in doc_rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = targets(sizes)
    rows = taken_words(edge_docs).collect()
    assert len(rows) == len(doc_rows)
    by_id = defaultdict(set)
    for r in doc_rows:
        by_id[r["doc_id"]].add((len(WORD.findall(r["text"] or "")), r["source"]))
    taken = Counter()
    for r in rows:
        (size, source), = by_id[r.doc_id]
        assert r.size == size and r.source_size == sizes[source]
        assert abs(r.target - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r.taken <= 2 * size
        taken[source] += r.taken
    # half a block by rounding, and up to one as a source's last block is short
    assert all(abs(taken[s] - want[s]) <= 96 for s in sizes)


def test_reruns_agree(edge_docs):
    a, b = (sorted(tuple(r) for r in taken_words(edge_docs).collect()) for _ in range(2))
    assert a == b


def test_slots_are_multinomial_draws_and_take_each_block_once_a_pass(spark):
    docs = spark.range(400).select("id", F.concat(F.lit("s"), F.col("id") % 5).alias("source"),
                                   F.repeat(F.lit("w "), 500).alias("text")).withColumnRenamed("id", "doc_id")
    placed, pieces = mix(docs)
    once = pieces.groupBy("s", "pass", "doc_id", "first").count()
    assert once.where("count > 1").count() == 0
    shards = pieces.groupBy("shard").pivot("s").agg(F.countDistinct("pass", "doc_id", "first")).na.fill(0)
    assert shards.count() >= 2


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 7, 64, 1000):
        df = permuted(spark.range(n).withColumn("len", F.lit(n).cast("long")), "id", "len", ["len"], 3, "image")
        image = [r.image for r in df.orderBy("id").collect()]
        assert sorted(image) == list(range(n))
    assert image != list(range(n))


def test_halving_search_and_running_total(spark):
    starts = [0, 0, 5, 5, 9]
    df = spark.range(12).withColumn("a", F.array(*[F.lit(x).cast("long") for x in starts]))
    got = {r.id: r.i for r in last_start(df, F.col("id"), F.col("a"), 5, "i").collect()}
    assert got == {v: max(k for k, x in enumerate(starts) if x <= v) for v in range(12)}
    rows = spark.range(1000).select((F.col("id") % 2).alias("p"), "id", (F.col("id") % 5).alias("v"))
    out = running_total(rows, "p", F.floor(F.col("id") / 100), ["id"], "v", "t").collect()
    for r in out:
        assert r.t == sum(i % 5 for i in range(r.p, r.id, 2))


def test_texts_of_the_mix(edge_docs, no_docs, doc_rows):
    out = mixed_texts(edge_docs)
    assert out.columns == edge_docs.columns
    words = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    want = Counter()
    for r in taken_words(edge_docs).collect():
        want[r.doc_id] += r.taken
    assert words == +want
    assert taken_words(no_docs).count() == 0 and mixed_texts(no_docs).count() == 0
