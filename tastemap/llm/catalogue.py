"""Registered queries of the training-data operators: ``opN_<name>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .fingerprint import fingerprints
from .host_rules import host_filter
from .jaccard_join import jaccard_groups
from .langid import learn_profiles, predict
from .lexical import search
from .line_dedup import line_dedup
from .mixing import taken_words
from .packing import pack
from .pii import joined, pii_spans
from .quality_gam import score, train
from .sentencepiece_bpe import decode, encode
from .token_align import token_links
from .url_filter import Rule, filter_urls


def tokenizer_files() -> dict[str, str]:
    """The public tokenizer of the queries and the same vocabulary as ranks."""
    import public_tokenizers
    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"),
            "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), **tokenizer_files()).drop("ids")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(fold(F.col("doc_id")) != 2), table(spark, sf_dir, "labels"))
    out = score(docs.withColumn("held_out", fold(F.col("doc_id")) == 2), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score",
                      F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn_profiles(docs.where(fold(F.col("doc_id")) != 2))
    out = predict(docs.withColumn("held_out", fold(F.col("doc_id")) == 2), profiles,
                  ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped",
                                   F.sha2("kept_text", 256).alias("kept_sha256"))


# Fixed rules of the query: (verdict, host, path).
URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"),
             Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"),
             Rule("block", "com", "/de/")]
UNWANTED = ["ads", "adult", "bets", "casino", "pills", "spam"]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, UNWANTED)


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_filter(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                      F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def piece_file() -> str:
    """The public SentencePiece model of the queries."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_links(table(spark, sf_dir, "documents"), model=piece_file(), **tokenizer_files())
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return out.withColumn("groups_sha256", digest).drop("groups")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(table(spark, sf_dir, "documents"), piece_file()), piece_file())
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op1_fingerprint": op1_fingerprint,
           "op2_packing": op2_packing,
           "op3_quality": op3_quality,
           "op4_jaccard_join": op4_jaccard_join,
           "op5_langid": op5_langid,
           "op6_url_filter": op6_url_filter,
           "op7_mixing": op7_mixing,
           "op8_line_dedup": op8_line_dedup,
           "op9_host_rules": op9_host_rules,
           "op10_pii": op10_pii,
           "op11_lexical": op11_lexical,
           "op12_token_align": op12_token_align,
           "op13_sentencepiece": op13_sentencepiece}
