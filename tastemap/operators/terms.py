"""Term counts of whole texts where the texts lie (Arrow batches, numpy), without a shuffle of texts.

A document is mostly one row, and its terms can be counted there.  Documents that come in
several rows are found by their ids first; only these are brought together, each document's
rows next to each other, and counted row by row (``one_by_one``).  Tokens are those of
``text.tokens`` with single spaces ("ws").

``doc_freqs`` counts the documents of every term.  ``top_candidates`` returns the few
(document, term) rows that can be among a document's top TF-IDF terms, by bounds of the
document frequencies (as ``text.can_be_top`` does for rows that are already counted): the
exact frequencies of common terms and, for hashed terms, the least and largest frequency of
a bucket as powers of two in eighths, rounded outwards.  These tables go to the tasks as one
broadcast: at most ``COMMON_SHARE`` times the terms of an average document, and two bytes for
each of at most ``MOST_BUCKETS`` buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_AT_ONCE = 4 << 20      # bytes of text counted at once
FEW_REPEATED = 1_000_000    # ids of documents in several rows that are broadcast
RANGE = 1 << 16             # buckets packed together
MOST_BUCKETS = 1 << 24
_NONE = 255                 # least frequency of a bucket without terms


class Counts:
    """Entries (document, term, count), document by document: ``doc`` (ids of the documents),
    ``row`` (ascending) and ``word`` of every entry index ``doc`` and ``terms``."""

    def __init__(self, doc: pa.Array, row: np.ndarray, terms: pa.Array, word: np.ndarray, n: np.ndarray):
        self.doc, self.row, self.terms, self.word, self.n = doc, row, terms, word, n

    def of(self, entries: np.ndarray) -> list[pa.Array]:
        """(document, term, count) of some entries."""
        return [self.doc.take(pa.array(self.row[entries])), self.terms.take(pa.array(self.word[entries])),
                pa.array(self.n[entries], pa.int64())]


def _entries(doc: pa.Array, row: np.ndarray, tokens: pa.Array, n: np.ndarray | None = None) -> Counts:
    """Tokens (``n`` times each) of rows, those of a row with the same term added up."""
    coded = pc.dictionary_encode(tokens)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    terms = coded.dictionary
    cell = row * np.int64(max(len(terms), 1)) + coded.indices.to_numpy()
    if n is None:
        cell.sort()
    else:
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], n[order]
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    counts = np.diff(np.append(starts, len(cell))) if n is None else np.add.reduceat(n, starts) if len(starts) else n
    row, word = np.divmod(cell[starts], max(len(terms), 1))
    return Counts(doc, row, terms, word, counts.astype(np.int64))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    some = pc.not_equal(flat, "")
    return row[some.to_numpy(zero_copy_only=False)], flat.filter(some)


def count_terms(batches: Iterator[pa.RecordBatch], adjacent: bool) -> Iterator[Counts]:
    """Counts of (id, text) rows, some texts at a time.  ``adjacent``: rows of one document
    follow each other and are added up, however many there are."""
    held = None             # (id, terms, counts) of the last document so far
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        cuts = [0, *np.flatnonzero(np.diff(size // TEXT_AT_ONCE)) + 1, len(size)] if len(size) else [0]
        for lo, hi in zip(cuts, cuts[1:]):
            doc, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
            row, tokens = _tokens(texts)
            if not adjacent:
                yield _entries(doc, row, tokens)
                continue
            first = np.append(True, pc.not_equal(doc.slice(1), doc.slice(0, len(doc) - 1)).to_numpy(zero_copy_only=False))
            row, doc = (np.cumsum(first) - 1)[row], doc.filter(pa.array(first))
            n = np.ones(len(row), np.int64)
            if held is not None and held[0].equals(doc[0]):
                row, n = np.append(np.zeros(len(held[1]), np.int64), row), np.append(held[2], n)
                tokens = pa.concat_arrays([held[1], tokens])
            elif held is not None:
                yield _entries(pa.array([held[0].as_py()], doc.type), np.zeros(len(held[1]), np.int64), held[1], held[2])
            some = _entries(doc, row, tokens, n)
            last = some.row == len(doc) - 1
            held = (doc[len(doc) - 1], some.terms.take(pa.array(some.word[last])), some.n[last])
            yield Counts(doc, some.row[~last], some.terms, some.word[~last], some.n[~last])
    if held is not None:
        yield _entries(pa.array([held[0].as_py()], held[0].type), np.zeros(len(held[1]), np.int64), held[1], held[2])


def one_by_one(docs: DataFrame, doc_col: str, text_col: str, tasks: int | None = None) -> list[tuple[DataFrame, bool]]:
    """``docs`` with an id as (id, text) rows, to be counted in one or two parts: documents
    in one row, and those in several, next to each other."""
    rows = docs.where(F.col(doc_col).isNotNull()).select(doc_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    again = rows.groupBy(doc_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(doc_col)
    n = again.limit(FEW_REPEATED + 1).count()
    if not n:
        return [(rows, False)]
    again = F.broadcast(again) if n <= FEW_REPEATED else again
    several = rows.join(again, doc_col, "left_semi")
    several = several.repartition(tasks, doc_col) if tasks else several.repartition(doc_col)
    return [(rows.join(again, doc_col, "left_anti"), False), (several.sortWithinPartitions(doc_col), True)]


def _map_counts(docs: DataFrame, doc_col: str, text_col: str, tasks: int | None, schema: T.StructType,
                use: Callable[[Counts], list[pa.Array]]) -> DataFrame:
    names, out = schema.names, None

    def run(adjacent: bool):
        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for counts in count_terms(batches, adjacent):
                columns = use(counts)
                for at in range(0, max(len(columns[0]), 1), 100_000):
                    yield pa.RecordBatch.from_arrays([x.slice(at, 100_000) for x in columns], names)
        return body

    for rows, adjacent in one_by_one(docs, doc_col, text_col, tasks):
        part = rows.mapInArrow(run(adjacent), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _schema(docs: DataFrame, doc_col: str) -> T.StructType:
    return T.StructType([docs.schema[doc_col], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])


def term_counts(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "words", tasks: int | None = None) -> DataFrame:
    """(doc_col, term, tf): ``text.term_freq`` without a shuffle of the texts."""
    return _map_counts(docs, doc_col, text_col, tasks, _schema(docs, doc_col), lambda c: c.of(np.arange(len(c.row))))


def doc_freqs(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "words", tasks: int | None = None) -> DataFrame:
    """(term, df): the number of documents with the term; a task sends a term once."""
    def use(c: Counts) -> list[pa.Array]:
        n = np.bincount(c.word, minlength=len(c.terms))
        has = np.flatnonzero(n)         # a document that is held back takes its terms along
        return [c.terms.take(pa.array(has)), pa.array(n[has], pa.int64())]

    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType())])
    return _map_counts(docs, doc_col, text_col, tasks, schema, use).groupBy("term").agg(F.sum("df").alias("df"))


def term_hash(terms: pa.Array) -> np.ndarray:
    """64-bit hashes of the terms' bytes: a polynomial, mixed."""
    if not len(terms):
        return np.zeros(0, np.uint64)
    raw = terms.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].astype(np.uint64) + np.uint64(1)
    size = np.diff(ends)
    power = np.full(max(int(size.max()), 1), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    data *= np.cumprod(power)[np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size)]
    out = np.zeros(len(terms), np.uint64)
    full = size > 0
    out[full] = np.add.reduceat(data, (ends[:-1] - ends[0])[full]) if full.any() else 0
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _level(df: np.ndarray, up: bool) -> np.ndarray:
    eighths = np.log2(np.maximum(df, 1)) * 8
    return np.minimum(np.ceil(eighths) if up else np.floor(eighths), _NONE - 1).astype(np.uint8)


class Bounds:
    """Least and largest document frequency of any term (broadcast to the tasks)."""

    def __init__(self, common: pa.Array, df: np.ndarray, least: np.ndarray, most: np.ndarray, m: int):
        self.common, self.df, self.least, self.most, self.m = common, df, least, most, m

    def idf(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at the largest, at the least frequency, whether the frequency is known exactly) of
        each term; NaN for a term that was counted nowhere."""
        found = pc.index_in(terms, value_set=self.common)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        at = (term_hash(terms) & np.uint64(len(self.least) - 1)).astype(np.int64)
        level = 2.0 ** (np.arange(256) / 8)
        level[_NONE] = np.nan
        top = np.append(level[:_NONE - 1], [max(self.m, 1)] * 2)        # the last level is open
        least = level[self.least[at]]
        most = np.where(np.isnan(least), np.nan, top[self.most[at]])
        exact = self.df[found.fill_null(0).to_numpy()] if len(self.df) else np.ones(len(terms))
        least, most = np.where(known, exact, least), np.where(known, exact, most)
        idf = lambda df: np.log((self.m + 1) / (df + 1))
        return idf(most), idf(least), known


def frequency_bounds(df: DataFrame, m: int, share: int, buckets: int) -> Bounds:
    """The tables for ``df`` (term, df) over ``m`` documents."""
    is_common = F.col("df") * F.lit(share) > F.lit(m)
    common = df.where(is_common & F.col("term").isNotNull()).toArrow()
    others = df.where(~is_common)
    n = others.count()
    while buckets < min(MOST_BUCKETS, 2 * n):
        buckets *= 2
    size = min(buckets, RANGE)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (term_hash(batch.column(0)) & np.uint64(buckets - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // size, pa.int32()), pa.array(at % size, pa.int32()),
                                              batch.column(1)], ["r", "b", "df"])

    def pack(rows: pa.Table) -> pa.Table:
        at, df = rows.column("b").to_numpy(), rows.column("df").to_numpy()
        least, most = np.full(size, _NONE, np.uint8), np.zeros(size, np.uint8)
        np.minimum.at(least, at, _level(df, False))
        np.maximum.at(most, at, _level(df, True))
        return pa.table([rows.column("r").slice(0, 1), pa.array([least.tobytes()], pa.binary()),
                         pa.array([most.tobytes()], pa.binary())], ["r", "least", "most"])

    least, most = np.full(buckets, _NONE, np.uint8), np.zeros(buckets, np.uint8)
    packed = others.select("term", "df").mapInArrow(place, "r int, b int, df long").groupBy("r").applyInArrow(
        pack, "r int, least binary, most binary")
    for row in packed.toArrow().to_pylist():        # at most MOST_BUCKETS / RANGE rows
        cut = slice(row["r"] * size, (row["r"] + 1) * size)
        least[cut], most[cut] = np.frombuffer(row["least"], np.uint8), np.frombuffer(row["most"], np.uint8)
    terms = common.column("term").combine_chunks()
    terms = terms if isinstance(terms, pa.Array) else pa.concat_arrays(terms.chunks)
    return Bounds(terms, common.column("df").to_numpy().astype(float), least, most, m)


def can_reach(c: Counts, bounds: Bounds, top: int, slack: float, covered: bool) -> np.ndarray:
    """The entries whose term can be among the ``top`` of its document: by its bounds, and, of
    terms with one known weight, by their order."""
    at_most, at_least, exact = bounds.idf(c.terms)
    low, high = c.n * at_most[c.word], c.n * at_least[c.word]
    if not covered:         # a bucket cannot tell that a term is missing
        low = np.where(exact[c.word], low, -np.inf)
    low = np.where(np.isnan(low), -np.inf, low)
    starts = np.flatnonzero(np.diff(c.row, prepend=-1))
    size = np.diff(np.append(starts, len(c.row)))
    order = np.lexsort((-low, c.row))
    floor = np.full(len(starts), -np.inf)
    long = size >= top
    floor[long] = low[order[starts[long] + top - 1]]
    kept = np.flatnonzero(high >= np.repeat(floor, size) - slack)       # never where it is NaN
    # terms of a document with the same count and (known) frequency rank by the term: the first ``top`` do
    tied = kept[low[kept] == high[kept]]
    words, place = np.unique(c.word[tied], return_inverse=True)
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(c.terms.take(pa.array(words))).to_numpy()] = np.arange(len(words))
    keys = (rank[place], at_least[c.word[tied]], c.n[tied], c.row[tied])
    order = np.lexsort(keys)
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys[1:]], axis=0)) if len(tied) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    late = tied[order[np.arange(len(order)) - first >= top]]
    return np.setdiff1d(kept, late, assume_unique=True)


def top_candidates(docs: DataFrame, bounds: Bounds, top: int, round_to: int | None, doc_col: str = "doc_id",
                   text_col: str = "words", covered: bool = True, tasks: int | None = None) -> DataFrame:
    """(doc_col, term, tf) of the terms that can be among the ``top`` TF-IDF terms of their
    document.  ``covered``: the frequencies hold every term of ``docs``."""
    # room for the rounding of the ranked weights: too many rows are harmless
    slack = 1e-9 if round_to is None else 2 * 10.0 ** -round_to
    sent = docs.sparkSession.sparkContext.broadcast(bounds)
    return _map_counts(docs, doc_col, text_col, tasks, _schema(docs, doc_col),
                       lambda c: c.of(can_reach(c, sent.value, top, slack, covered)))
