"""News corpus source: (rowkey, words[, doc_type])."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_news(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Corpus table projected to (rowkey, words); Parquet prunes the rest."""
    return spark.read.format(fmt).load(path).select("rowkey", "words")


def read_text_corpus(spark: SparkSession, paths) -> DataFrame:
    """Many text files, one document per line: (doc_id, words).  Ids are
    unique 64-bit values (not dense), assigned without a shuffle; repeated
    lines are separate documents, as in the line-per-document input."""
    df = spark.read.text(paths).select(F.col("value").alias("words"))
    return df.select(F.monotonically_increasing_id().alias("doc_id"), "words")


def scan(news: DataFrame, limit: int | None = None, key: str = "rowkey") -> DataFrame:
    """Corpus scan with an optional row limit (None or <= 0 means all rows):
    the rows of the first keys in order (row keys are unique).  Only keys are
    ordered and cut; the texts are selected where they lie."""
    if limit is None or limit <= 0:
        return news
    return news.join(news.select(key).orderBy(key).limit(limit), key, "left_semi")


def scan_where(df: DataFrame, column: str, min_value) -> DataFrame:
    """Key-value scan with ``column >= value`` (pushed into the Parquet scan)."""
    return df.where(F.col(column) >= F.lit(min_value))


def text_lines(news: DataFrame, key: str = "rowkey", text: str = "words") -> DataFrame:
    """(key, line_no, line): every line of every text (0-based line numbers)."""
    return news.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
                       .alias("line_no", "line"))


def attach_text(log: DataFrame, news: DataFrame, log_key: str = "doc_id",
                news_key: str = "rowkey") -> DataFrame:
    """Left join of the log with the corpus on the article key; a missing or
    NULL text reads as ''.  Only the text length travels through the join
    (the projection is computed before the shuffle)."""
    n = news.select(F.col(news_key).alias(log_key),
                    F.length(F.coalesce(F.col("words"), F.lit(""))).alias("n_chars"))
    return (log.join(n, log_key, "left")
            .withColumn("n_chars", F.coalesce(F.col("n_chars"), F.lit(0))))


IN_KEYS = 1_000            # article keys that go into the scan as a pushed IN filter
BROADCAST_KEYS = 1_000_000  # article keys that are broadcast (some 64 MB)


BITMAPS = 16_384           # bitmaps of 32,768 whole-number keys each that are broadcast (64 MB)


def bit_of(bitmap: str, key) -> F.Column:
    """Whether ``key`` is in the bitmap of its bucket (1 or 0; null without a bitmap)."""
    at = F.bitmap_bit_position(key)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int"))


def select_keys(news: DataFrame, keys: DataFrame, key: str, news_key: str = "rowkey") -> DataFrame:
    """The corpus rows of the distinct ``keys`` (not null).  Few keys become a
    filter that the scan prunes row groups by, more are broadcast after a count, still
    more whole numbers as bitmaps, and beyond that the semi-join is left to Spark.
    Only in the last case texts are shuffled."""
    head = [r[0] for r in keys.limit(IN_KEYS + 1).collect()]     # bounded
    if len(head) <= IN_KEYS:
        return news.where(F.col(news_key).isin(head)) if head else news.where("false")
    k = keys.select(F.col(key).alias(news_key))
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    whole = ("bigint", "int", "smallint", "tinyint")
    if not few and {k.schema[0].dataType.simpleString(), news.schema[news_key].dataType.simpleString()} <= set(whole):
        number, of = F.col(news_key).cast("long"), F.bitmap_bucket_number(F.col(news_key).cast("long"))
        bits = k.groupBy(of.alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bitmap"))
        if bits.limit(BITMAPS + 1).count() <= BITMAPS:
            found = news.join(F.broadcast(bits), of == F.col("_bucket"))
            return found.where(bit_of("_bitmap", number) == 1).select(*news.columns)
    return news.join(F.broadcast(k) if few else k, news_key, "left_semi")


def attach_words(log: DataFrame, news: DataFrame, log_key: str = "doc_id",
                 news_key: str = "rowkey") -> DataFrame:
    """Left join returning the text itself ('' when missing).  The corpus is
    first cut to the articles that the log names (``select_keys``), so only those
    texts meet the log."""
    keys = log.where(F.col(log_key).isNotNull()).select(log_key).distinct()
    found = select_keys(news.select(news_key, "words"), keys, log_key, news_key)
    texts = found.select(F.col(news_key).alias(log_key), "words")
    return (log.join(texts, log_key, "left")
            .withColumn("words", F.coalesce(F.col("words"), F.lit(""))))
