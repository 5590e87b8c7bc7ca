import hashlib
from collections import Counter

from pyspark.sql import functions as F

from tastemap.llm.fingerprint import LONGEST, fingerprints, peel, sketch, subtract, digests, with_next


def units(text):
    for m in ".!?":
        text = text.replace(m + " ", m + "\n")
    return {u[i:i + LONGEST] for u in text.split("\n") for i in range(0, len(u), LONGEST)}


def jaccard(a, b):
    a, b = units(a), units(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_equals_brute_force_on_odd_rows(edge_docs, doc_rows):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in doc_rows))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        e = t[:len(t) - h] + nxt[:h]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(t, e), 9), round(jaccard(t, nxt), 9))] += 1
    out = fingerprints(edge_docs).collect()
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in out)
    assert got == want
    texts = dict(rows)
    prints = {}
    for r in out:   # equal texts, equal prints; other sets, other prints
        assert prints.setdefault(frozenset(units(texts[r.doc_id])), r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_peeling_recovers_the_digests(spark):
    row = spark.range(1).select(digests(F.lit("a\nb\nc\nd")).alias("x"), digests(F.lit("b\nc\ne")).alias("y"))
    row = row.select("x", "y", peel(subtract(sketch(F.col("x")), sketch(F.col("y")))).alias("r")).first()
    assert set(row.r.left) == set(row.x) - set(row.y) and set(row.r.right) == set(row.y) - set(row.x)


def test_large_differences_are_retried(spark):
    a = "\n".join(f"line {i}" for i in range(3000))
    b = "\n".join(f"line {i}" for i in range(1500, 6000))
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert out[1].near_next == out[2].near_next == 1500 / 6000


def test_next_document_across_ranges(spark):
    ids = [i * i for i in range(300)] + [-5]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next.text for r in with_next(docs, ["text"]).collect()}
    order = sorted(ids)
    assert got == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_one_document_and_none(spark, no_docs):
    one = fingerprints(spark.createDataFrame([(7, "ab cd. ef")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"ab cdab c").hexdigest()
    assert fingerprints(no_docs).count() == 0
