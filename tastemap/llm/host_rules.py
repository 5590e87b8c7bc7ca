"""Host-level quality rules with an empirical beta prior.

1. Rule counts of every whole text are measured in Arrow batches.
2. Rule failures are summed by host (for ``documents``: the source column);
   the sums are map-side combined, so a host with a third of all rows is one row
   per task before the shuffle.
3. A beta prior is fitted to the hosts' failure rates by the method of moments;
   a host's shrunk rate is (failures + a) / (documents + a + b).
4. Host verdicts join back to the documents.  The verdict table has one row per
   host; Spark broadcasts it when it is small and shuffles otherwise.

A document that fails a base rule goes.  Hosts are judged by their shrunk rate of documents
failing any rule: above ``max_rate`` a host loses all its documents; above the prior mean
(a host worse than the typical one) it loses the documents that fail a rule of the method;
up to the mean, such a document gets the benefit of the doubt and stays.

Defined results: null text has no words (and fails the base rule); null is a
host of its own; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textnum import Slice, byte_table, later_copies, range_hashes, repeated, slices, text_buffer

SYMBOLS = byte_table("#*$%&|<>")
WINDOW = 8
MAX_RATE = 0.5
MARGIN = 1e-9           # rates this close to the mean are not above it

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def counts_of(s: Slice) -> list[np.ndarray]:
    """The counts of each document of a slice, in the order of ``_COUNTS``."""
    chars = s.per_doc(s.code_points & s.inside)
    symbols = s.per_doc(SYMBOLS[s.buf])

    start, end, doc = s.lines()
    inside = np.zeros(len(s.buf) + 1, np.int64)
    np.cumsum(s.inside, out=inside[1:])
    filled = inside[end] > inside[start]
    start, end, doc = start[filled], end[filled], doc[filled]
    copy = later_copies(doc, range_hashes(s.buf, start, end))
    dup_lines = np.bincount(doc[copy], minlength=s.n)

    at, grams = s.shingles(s.word_hashes(), WINDOW)
    word_doc = s.word_doc()
    twice = at[repeated(word_doc[at], grams)]
    cover = np.zeros(len(word_doc) + 1, np.int64)
    cover += np.bincount(twice, minlength=len(cover))
    cover -= np.bincount(twice + WINDOW, minlength=len(cover))
    covered = np.cumsum(cover)[:-1] > 0
    return [s.n_words, chars, symbols, dup_lines, np.bincount(word_doc[covered], minlength=s.n),
            np.bincount(doc, minlength=s.n)]


def rule_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the counts of every whole text."""
    out = docs.select(*keep).schema
    for c in _COUNTS:
        out = out.add(c, "long")
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffer(b.column("_text"))
            got = [counts_of(Slice(buf, offs, i, j)) for i, j in slices(offs)]
            if got:
                cols = [b.column(c) for c in keep]
                cols += [pa.array(np.concatenate([g[k] for g in got]), pa.int64())
                         for k in range(len(_COUNTS))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, out)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def any_failed() -> Column:
    """Base rules, or a text full of symbols, or mostly of repeated lines (of those with a word)."""
    return (base_failed() | (F.col("n_symbols") > F.col("n_words"))
            | (2 * F.col("n_dup_lines") > F.col("n_lines"))
            | (F.col("word_chars") > 20 * F.col("n_words")))


def host_verdicts(counts: DataFrame, host: str, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_worse, host_failed), rate shrunk by the fitted prior."""
    per_host = counts.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"),
                                        F.count_if(any_failed()).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    n_hosts = F.count(F.lit(1))
    prior = per_host.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v"), n_hosts.alias("k"))
    # a + b from the moments; no spread between hosts (or one host) means a weak prior of two
    strength = F.when(F.col("v") > 0, F.greatest(
        F.lit(2.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(2.0)
    prior = prior.select("m", strength.alias("s"))
    m, s = prior.select("m").scalar(), prior.select("s").scalar()
    rate = (F.col("n_failed") + m * s) / (F.col("n_docs") + s)
    return per_host.select(host, "n_docs", "n_failed", rate.alias("rate"),
                           (rate > m + MARGIN).alias("host_worse"), (rate > max_rate).alias("host_failed"))


def host_filter(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """(doc_id, host, counts, base_failed, host_rate, kept) per document."""
    counts = stored(rule_counts(docs.select("doc_id", host, "text"), ["doc_id", host]), "rule-counts")
    verdicts = host_verdicts(counts, host, max_rate).select(
        F.col(host).alias("_host"), F.col("rate").alias("host_rate"), "host_worse", "host_failed")
    j = counts.join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left")
    kept = ~base_failed() & ~F.col("host_failed") & ~(F.col("host_worse") & any_failed())
    return j.select("doc_id", host, *_COUNTS, base_failed().alias("base_failed"), "host_rate", kept.alias("kept"))
