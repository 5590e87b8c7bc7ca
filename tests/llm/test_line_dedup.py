import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tastemap.llm.line_dedup import keep_bitmaps, line_dedup

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=10):
    keys = defaultdict(set)
    norm = lambda line: line.strip(WHITE).translate(LOWER)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            keys[norm(line)].add(r["doc_id"])
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(norm(x)) < min_chars or len(keys[norm(x)]) < 2
                or min(keys[norm(x)]) == r["doc_id"]]
        text = "\n".join(kept)
        out.append((r["doc_id"], len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def got(docs):
    out = line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    return Counter(tuple(r) for r in out.collect())


def test_equals_brute_force_on_odd_rows(edge_docs, doc_rows):
    assert got(edge_docs) == brute(doc_rows)


def test_empty_table(no_docs):
    assert line_dedup(no_docs).count() == 0


def test_extra_columns_pass_through(edge_docs):
    out = line_dedup(edge_docs)
    assert set(edge_docs.columns) <= set(out.columns)


def test_hot_line_and_long_document(spark):
    many = "\n".join(f"unique line number {i}" for i in range(300))
    rows = [(i, f"the same line everywhere\nown line {i} of this text") for i in range(500)]
    rows += [(1000, many), (1001, many + "\nand one more line here"), (None, "the same line everywhere\nnull id row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert out[None].n_dropped == 0                       # a null doc_id counts as the smallest
    assert all(out[i].kept_text == f"own line {i} of this text" for i in range(500))
    assert out[1001].kept_text == "and one more line here" and out[1001].n_dropped == 300
    words = keep_bitmaps(docs).where("doc_id = 1001").first().dropped
    assert len(words) == 5 and sum(bin(w & (2 ** 64 - 1)).count("1") for w in words) == 300


def test_time_grows_with_the_lines_of_a_text(spark):
    """A long text of many lines is hashed once, not once a line."""
    import time
    from pyspark.sql import functions as F
    from tastemap.llm.line_dedup import line_dedup

    def seconds(n):
        docs = spark.range(2).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.transform(
            F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("line number "), i.cast("string")))).alias("text"))
        docs.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getCheckpointDir()}/many-lines-{n}")
        at = time.time()
        rows = line_dedup(spark.read.parquet(path)).select("doc_id", "n_lines", "n_dropped").collect()
        assert sorted(map(tuple, rows)) == [(0, n, 0), (1, n, n)]
        return time.time() - at
    seconds(1000)
    assert seconds(250_000) < 60
