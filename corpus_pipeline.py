"""The corpus pipeline: ``documents`` to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's rows as Parquet in the shared checkpoint folder and rereads them as the next
stage's documents.  All stages but the last return the columns of ``documents``.

1. quality: the additive model is trained on the labelled documents (held-out fold
   excluded); documents that score below 0.7 go.
2. lines: long lines that an earlier document holds are dropped from the texts.
3. near_duplicates: of each group of near copies the smallest doc_id stays (of a doc_id
   with several texts, all but one text count as the last ids).  Texts without words, such
   as the line stage makes, have no near copies and all stay here; mixing drops them.
4. mixing: texts are taken in blocks so that the sources come to their target shares.
5. packing: tokens in sequences of 2048, each in the sources' proportions.

The operators define what becomes of nulls, empty and repeated rows; a document
whose doc_id is null has no near-duplicate class and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.llm.catalogue import tokenizer_files
from tastemap.llm.common import fold, stored, table
from tastemap.llm.jaccard_join import jaccard_groups, text_ids
from tastemap.llm.line_dedup import line_dedup
from tastemap.llm.mixing import mixed_texts
from tastemap.llm.packing import pack
from tastemap.llm.quality_gam import score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs.where(fold(F.col("doc_id")) != 2), table(spark, sf_dir, "labels"))
    return score(docs, model, COLUMNS).where(F.col("score") >= MIN_QUALITY).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs.select(*COLUMNS)).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source",
        F.char_length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = text_ids(docs.select(*COLUMNS), "_id")
    groups = jaccard_groups(named.select(F.col("_id").alias("doc_id"), "text"))
    gone = groups.where("class_id < doc_id").select(F.col("doc_id").alias("_id")).distinct()
    left = named.join(gone, "_id", "left_anti")
    # rows that repeat a doc_id and its text are copies of each other
    return left.where("doc_id IS NOT NULL").dropDuplicates(["_id"]).unionByName(
        left.where("doc_id IS NULL")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_texts(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, **tokenizer_files()).drop("ids")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates),
          ("mixing", mixing), ("packing", packing)]

# The quality model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
