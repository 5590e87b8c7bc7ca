"""Line deduplication: range-partitioned line hashes, first occurrences, keep bitmaps.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lower-cased.  Keys of at least ``min_chars`` code points that occur in two or
more documents keep their lines in the smallest doc_id only.

Plan (DataFrame operators only):

1. Explode the lines once to (128-bit key hash, doc_id, position) and store
   these narrow rows; texts do not move.
2. Keys that hold at least 1/``hot_share`` of all line rows, or more than a mean
   shuffle partition (so at most that many keys, whatever the data), are reduced to
   their first document by a map-side combined aggregate and broadcast.
3. All other rows are range-partitioned by the hash and sorted by (hash, doc_id,
   position); a running window streams the first document of each key.
4. Dropped positions become one bitmap per document (64 lines a word, only the
   words up to the last dropped line), which is joined to the texts once.

Defined results: a null or empty text is one empty line; a null doc_id counts as
the smallest document; repeated rows get equal results; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, stored

MIN_CHARS = 10
HOT_SHARE = 2000


def _text(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of every line whose key is long enough."""
    # hashed and split before the explode: beside it the text would be hashed for every line
    split = docs.select("doc_id", F.xxhash64(_text(docs)).alias("text_hash"),
                        F.split(_text(docs), "\n").alias("lines"))
    lines = split.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos",
                         F.btrim("line", F.lit(WHITE)).alias("line"))
    keyed = keyed.where(F.char_length("line") >= min_chars).withColumn(
        "line", ascii_lower(F.col("line")))
    return keyed.select(F.xxhash64("line").alias("h1"),
                        F.xxhash64(F.lit("second"), F.col("line")).alias("h2"),
                        "doc_id", "text_hash", "pos")


def dropped_rows(rows: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """The rows of ``line_rows`` whose line goes: (doc_id, text_hash, pos)."""
    out = ["doc_id", "text_hash", "pos"]
    total = rows.count()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_share = max(hot_share, parts)
    firsts = rows.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"),
        F.max(F.isnull("doc_id")).alias("no_id"))
    hot = firsts.where(F.col("n") * hot_share >= max(total, 1)).select(
        "h1", "h2", F.when(~F.col("no_id"), F.col("lo")).alias("first_id"))
    hot = F.broadcast(stored(hot, "hot-lines"))  # at most hot_share rows

    hot_drop = rows.join(hot, ["h1", "h2"]).where(
        ~F.col("doc_id").eqNullSafe(F.col("first_id"))).select(*out)

    cold = rows.join(hot, ["h1", "h2"], "left_anti").repartitionByRange(parts, "h1")
    w = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    cold_drop = cold.withColumn("first_id", F.first("doc_id").over(w)).where(
        ~F.col("doc_id").eqNullSafe(F.col("first_id"))).select(*out)
    return hot_drop.unionByName(cold_drop)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS,
                 hot_share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, text_hash, dropped array<long>, n_dropped) of the documents that
    lose lines; bit ``pos % 64`` of word ``pos / 64`` is set for a dropped line."""
    rows = stored(line_rows(docs, min_chars), "line-rows")
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = dropped_rows(rows, hot_share).groupBy(
        "doc_id", "text_hash", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(bit).alias("bits"))
    sparse = F.array_sort(F.collect_list(F.struct("word", "bits")))
    per_doc = words.groupBy("doc_id", "text_hash").agg(
        sparse.alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))
    dense = F.aggregate(
        "words", F.expr("cast(array() as array<bigint>)"),
        lambda acc, x: F.concat(acc, F.array_repeat(F.lit(0).cast("long"), x["word"] - F.size(acc)),
                                F.array(x["bits"])))
    return per_doc.select("doc_id", "text_hash", dense.alias("dropped"), "n_dropped")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped added."""
    b = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "dropped",
                       F.col("n_dropped").alias("_n"))
    j = docs.join(b, docs["doc_id"].eqNullSafe(b["_id"])
                  & (F.xxhash64(_text(docs)) == b["_hash"]), "left")
    kept = F.array_join(F.filter(
        F.split(_text(docs), "\n"),
        lambda x, i: F.coalesce(F.getbit(F.get(b["dropped"], F.floor(i / 64).cast("int")), i % 64),
                                F.lit(0)) == 0), "\n")
    n_lines = F.octet_length(_text(docs)) - F.octet_length(F.replace(_text(docs), F.lit("\n"))) + 1
    extra = {"kept_text": F.when(b["dropped"].isNull(), _text(docs)).otherwise(kept),
             "n_lines": n_lines.cast("long"),
             "n_dropped": F.coalesce(b["_n"], F.lit(0).cast("long"))}
    return j.select(*[docs[c] for c in docs.columns if c not in extra],
                    *[v.alias(k) for k, v in extra.items()])


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars))
