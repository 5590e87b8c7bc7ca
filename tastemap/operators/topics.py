"""Topic model (LDA) on top of the long-form vocabulary.

The vocabulary (at most ``n_topics * vocab_multiplier`` terms) and the matrix of
topics over it are the only things that reach the driver; it parameterises a
``CountVectorizerModel`` so training and inference use the same term index.

EM training is MLlib's update (collapsed EM with its default concentrations) over blocks of
documents instead of a graph with an edge per document and term: a block holds its documents'
term counts and topic counts as matrices, meets the topics of the last iteration in its task,
and only one matrix of term counts a task leaves it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemap.config import DEFAULT_PARAMS, DEFAULT_STOP_WORDS, Params
from tastemap.operators.text import vocabulary
from tastemap.session import materialise, spread

TEXT_AT_ONCE = 4 << 20      # bytes of text counted at once
BLOCK_ENTRIES = 1 << 16     # (document, term) entries of a block, about (a document is never cut)
FEW_PARTS = 256             # matrices of terms that the driver adds up itself
CUT_EVERY = 10              # iterations after which the lineage is cut
BLOCK = "words binary, counts binary, ends binary, topics binary, part binary"


class TopicModel:
    def __init__(self, pipeline: PipelineModel, vocab: list[str]):
        self.pipeline, self.vocab = pipeline, vocab

    @property
    def lda(self):
        return self.pipeline.stages[-1]

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> "TopicModel":
        p = PipelineModel.load(path)
        return cls(p, list(p.stages[2].vocabulary))


def read_vocabulary(spark, path: str) -> list[str]:
    """The stored vocabulary table (idx, term) as the ordered term list
    (bounded by the vocabulary size)."""
    return [r["term"] for r in spark.read.parquet(path).orderBy("idx").select("term").collect()]


def featurizer(vocab: list[str], text_col: str = "words", stopwords=None):
    tok = RegexTokenizer(inputCol=text_col, outputCol="_raw")  # \s+ gaps, lower case
    sw = StopWordsRemover(inputCol="_raw", outputCol="_tokens",
                          stopWords=list(DEFAULT_STOP_WORDS if stopwords is None else stopwords))
    cv = CountVectorizerModel.from_vocabulary(vocab, inputCol="_tokens", outputCol="features")
    return [tok, sw, cv]


def build_topic_model(corpus: DataFrame, params: Params = DEFAULT_PARAMS,
                      optimizer: str = "em", max_iter: int | None = None,
                      seed: int = 42, text_col: str = "words", stopwords=None) -> TopicModel:
    """Vocabulary (top terms) -> count vectors -> LDA (EM by default; 'online'
    uses mini-batches of ``min(1, 2/maxIter + 1/corpusSize)``).  ``stopwords``:
    a word list (default ``config.DEFAULT_STOP_WORDS``; see
    ``sources.stopwords.default_plus_custom`` for that list + custom words).

    Tokenising and counting run once: the vectors are kept (online: memory, then disk; EM: on
    disk) while the training passes over them."""
    v = vocabulary(corpus, params.vocab_size, text_col, stopwords=stopwords)
    vocab = [r["term"] for r in v.orderBy("idx").collect()]  # bounded by vocab_size
    max_iter = max_iter or params.lda_iterations
    lda = LDA(k=params.n_topics, maxIter=max_iter, optimizer=optimizer, seed=seed,
              featuresCol="features", topicDistributionCol="_dist", checkpointInterval=CUT_EVERY)
    # none of these stages is fitted, so the pipeline only puts them together
    features = PipelineModel(stages=featurizer(vocab, text_col, stopwords))
    if optimizer == "em":
        fitted = fit_em(corpus, vocab, lda, text_col)
        return TopicModel(PipelineModel(stages=[*features.stages, fitted]), vocab)
    if optimizer == "online":
        n = corpus.count()
        lda.setSubsamplingRate(min(1.0, 2.0 / max_iter + 1.0 / max(n, 1)))
    data = features.transform(spread(corpus)).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = lda.fit(data)
    finally:
        data.unpersist()
    return TopicModel(PipelineModel(stages=[*features.stages, fitted]), vocab)


def _count_texts(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, counts, ends) of lower-cased texts: the entries of all texts that hold a term,
    text by text, and where each text's entries end (first 0)."""
    tokens = pc.ascii_split_whitespace(texts)       # the white space of a Java regex
    found = pc.index_in(tokens.flatten(), value_set=terms)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))[known]
    word = found.drop_null().to_numpy(zero_copy_only=False)
    cell, counts = np.unique(row * len(terms) + word, return_counts=True)
    row, words = np.divmod(cell, max(len(terms), 1))
    ends = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
    return words.astype(np.int32), counts.astype(np.int32), ends.astype(np.int64)


def _blocks(words: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole documents with about ``BLOCK_ENTRIES`` entries."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_ENTRIES, side="right")) - 1)
        cut = slice(ends[at], ends[to])
        yield words[cut], counts[cut], ends[at:to + 1] - ends[at]
        at = to


def em_step(words: np.ndarray, counts: np.ndarray, ends: np.ndarray, topics: np.ndarray | None,
            by_term: np.ndarray | None, alpha: float, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(new topics of the documents, entries' topics), both topic x column.  ``topics``: the
    documents' topic counts; ``by_term``: the smoothed topics, topic x term.  An entry's topics
    are its count, shared out by the product of the two (or at random, with ``rng``)."""
    if rng is not None:
        share = rng.random((topics.shape[0], len(words)))
    else:
        share = by_term[:, words]
        share *= np.repeat(topics + (alpha - 1), np.diff(ends), axis=1)
    share *= counts / share.sum(axis=0)
    return np.add.reduceat(share, ends[:-1], axis=1), share


def _part(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary())] * 4 + [pa.array([total.tobytes()], pa.binary())],
                                      ["words", "counts", "ends", "topics", "part"])


def _block(words: np.ndarray, counts: np.ndarray, ends: np.ndarray, topics: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([x.tobytes()], pa.binary()) for x in (words, counts, ends, topics)]
    return pa.RecordBatch.from_arrays([*cells, pa.nulls(1, pa.binary())], ["words", "counts", "ends", "topics", "part"])


def _add_terms(total: np.ndarray, words: np.ndarray, share: np.ndarray) -> None:
    for k in range(len(total)):
        total[k] += np.bincount(words, share[k], total.shape[1])


def _first_blocks(corpus: DataFrame, vocab: list[str], k: int, seed: int, text_col: str) -> DataFrame:
    """Blocks of the corpus, every entry dealt to the topics at random, and a row ``part`` a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = pa.array(vocab, pa.string()), np.zeros((k, len(vocab)))
        for batch in batches:
            texts = batch.column(0)
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            cuts = [0, *np.flatnonzero(np.diff(size // TEXT_AT_ONCE)) + 1, len(texts)]
            for lo, hi in zip(cuts, cuts[1:]):
                for words, counts, ends in _blocks(*_count_texts(texts.slice(lo, hi - lo), terms)):
                    rng = np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(words.tobytes())])
                    topics, share = em_step(words, counts, ends, np.zeros((k, 0)), None, 0.0, rng)
                    _add_terms(total, words, share)
                    yield _block(words, counts, ends, topics)
        yield _part(total)

    return spread(corpus).select(F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).mapInArrow(run, BLOCK)


def _next_blocks(blocks: DataFrame, by_term: np.ndarray, alpha: float) -> DataFrame:
    k, width = by_term.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width))
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = np.frombuffer(row["words"], np.int32), np.frombuffer(row["counts"], np.int32)
                ends, topics = np.frombuffer(row["ends"], np.int64), np.frombuffer(row["topics"]).reshape(k, -1)
                topics, share = em_step(words, counts, ends, topics, by_term, alpha)
                _add_terms(total, words, share)
                yield _block(words, counts, ends, topics)
        yield _part(total)

    return blocks.where("words IS NOT NULL").mapInArrow(run, BLOCK)


def _term_topics(blocks: DataFrame, k: int, width: int) -> np.ndarray:
    """The sum of all ``part`` rows; many are added up in tasks first."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * width)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts, tasks = blocks.where("part IS NOT NULL").select("part"), blocks.rdd.getNumPartitions()
    if tasks > FEW_PARTS:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(add, "part binary")
    total = np.zeros(k * width)
    for row in parts.collect():
        total += np.frombuffer(row["part"])
    return total.reshape(k, width)


def fit_em(corpus: DataFrame, vocab: list[str], lda: LDA, text_col: str = "words") -> LocalLDAModel:
    """``lda`` (EM optimiser) fitted to the corpus: MLlib's updates with its defaults
    (document concentration 50 / k + 1, topic concentration 1.1) from random topics.

    For entry (d, w) with count n, topic k gets a share of n in proportion to
    ``(N_wk + eta - 1) * (N_dk + alpha - 1) / (N_k + W * (eta - 1))``; the shares' sums are the
    next counts N_wk and N_dk.  Blocks keep N_dk and lie on disk between iterations."""
    k, width = lda.getK(), len(vocab)
    alpha, eta = 50.0 / k + 1.0, 1.1
    blocks = _first_blocks(corpus, vocab, k, lda.getSeed(), text_col).persist(StorageLevel.DISK_ONLY)
    counts = _term_topics(blocks, k, width)
    for i in range(1, lda.getMaxIter() + 1):
        by_term = (counts + (eta - 1)) / (counts.sum(axis=1, keepdims=True) + width * (eta - 1))
        before, blocks = blocks, _next_blocks(blocks, by_term, alpha).persist(StorageLevel.DISK_ONLY)
        counts = _term_topics(blocks, k, width)
        before.unpersist()
        if i % CUT_EVERY == 0 and i < lda.getMaxIter():
            before, blocks = blocks, materialise(blocks, "lda-blocks")
            before.unpersist()
    blocks.unpersist()
    return _local_model(corpus.sparkSession, lda, counts, alpha, eta)


def _local_model(spark, lda: LDA, counts: np.ndarray, alpha: float, eta: float) -> LocalLDAModel:
    """A fitted model from its term counts (topic x term), with the settings of ``lda``."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def doubles(x: np.ndarray):
        to = gateway.new_array(jvm.double, x.size)
        jvm.java.nio.ByteBuffer.wrap(x.astype(">f8").tobytes()).asDoubleBuffer().get(to)
        return to

    linalg, (k, width) = jvm.org.apache.spark.mllib.linalg, counts.shape
    # by column, as matrices are stored: term x topic
    old = jvm.org.apache.spark.mllib.clustering.LocalLDAModel(
        linalg.DenseMatrix(width, k, doubles(counts.ravel())), linalg.DenseVector(doubles(np.full(k, alpha))), eta, 100.0)
    lda._transfer_params_to_java()
    java = lda._java_obj
    model = jvm.org.apache.spark.ml.clustering.LocalLDAModel(java.uid(), width, old, spark._jsparkSession)
    java.copyValues(model, jvm.org.apache.spark.ml.param.ParamMap.empty())
    out = LocalLDAModel(model)
    lda._copyValues(out)
    return out


def infer(model: TopicModel, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, topic array<double>) topic mixture of each (possibly unseen) document."""
    out = model.pipeline.transform(docs)
    return out.select(key, vector_to_array("_dist").alias("topic"))


def describe(model: TopicModel, max_terms: int = 10) -> DataFrame:
    """(topic, term, weight): top terms of every topic, indices mapped to words."""
    d = model.lda.describeTopics(max_terms)
    spark = d.sparkSession
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate(model.vocab)], "idx int, term string")
    ex = d.select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("z"))
    return (ex.join(vocab, F.col("z.termIndices") == F.col("idx"))
            .select("topic", "term", F.col("z.termWeights").alias("weight")))


def top_topics(vectors: DataFrame, key: str, vec: str, n: int) -> DataFrame:
    """Keep the n largest components of every vector (ties by index), zeros
    elsewhere; the array keeps its length (indexed by topic).  Pure array
    expressions: no explode, no shuffle; the sort runs once per row."""
    ranked = F.array_sort(F.transform(vec, lambda x, i: F.struct((-x).alias("nx"), i.alias("k"))))
    kept = F.transform(F.col("_ranked"), lambda e, j: F.struct(
        e["k"].alias("k"), F.when(j < n, -e["nx"]).otherwise(F.lit(0.0)).alias("x")))
    return (vectors.select(key, ranked.alias("_ranked"))
            .select(key, F.transform(F.array_sort(kept), lambda e: e["x"]).alias(vec)))
