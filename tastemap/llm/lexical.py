"""Ranked lexical search with hashed max-sketches.

The items (queries) are dealt into blocks of bounded size; each block is answered by two
passes over all documents.  The first counts the corpus: documents with a term, terms,
and the document frequency of every term of the block.  In the second, a document's
impacts (weight times saturated frequency, of the block's terms) are folded into a sketch:
a term hashes to one of ``COORDS`` coordinates, which keeps the largest impact.  One
matrix product looks up all items in the sketches of a slice of documents; the sum over an
item's coordinates is never below its score.  Per item, documents are rescored exactly in
order of descending bound, until the bound falls below the item's k-th best score so far
in the task.  A task returns at most k documents an item; a salted and a final ranking
merge the tasks.

Scores are 64-bit integers: term weight w = floor(1000 ln((2N+2)/(2df+1))), impact
w * ((10^9 tf) div (1000 tf + 8m)), m = 10 + (90 n N) div L.

Defined results: null or empty texts have no terms and match nothing; items without terms
have no rows; rows that share an item_id are one item with the terms of all of them; a
repeated document row counts and ranks as a document of its own; equal scores go by
ascending doc_id, null last; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .textnum import slices, text_buffer

TOP = 10
COORDS = 1024           # coordinates of a sketch
ITEMS = 256             # most items of a block
ITEM_BYTES = 4 << 20    # most bytes of items' texts in a block (one item at least)
SLICE_BYTES = 4 << 20   # texts sketched together
SLICE_DOCS = 1024
STEP = 16               # documents rescored an item and round
SALTS = 64
NO_ID = np.iinfo(np.int64).max

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts end to end, number of terms of each text)."""
    buf, offs = text_buffer(texts)
    buf, offs = buf[offs[0]:offs[-1]], offs - offs[0]
    inside = _TERM[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offs[:-1][offs[:-1] < len(buf)]
    first[begins] = inside[begins]
    data = _LOWER[buf[inside]]
    starts = np.flatnonzero(first)
    at = np.flatnonzero(first[inside])
    rows = pa.BinaryArray.from_buffers(pa.binary(), len(at), [
        None, pa.py_buffer(np.r_[at, len(data)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return rows, np.diff(np.searchsorted(starts, offs))


@dataclass
class Block:
    """Items of one block; terms are numbered by (coordinate, term)."""
    item_id: list
    vocabulary: list[bytes]
    coordinate: np.ndarray       # of each term
    code: np.ndarray             # terms of all items end to end
    begin: np.ndarray            # of each item in ``code``, and the end

    @classmethod
    def of(cls, items: dict, coords: int = COORDS) -> "Block":
        place = {t: zlib.crc32(t) % coords for own in items.values() for t in own}
        vocabulary = sorted(place, key=lambda t: (place[t], t))
        number = {t: i for i, t in enumerate(vocabulary)}
        codes = [sorted(number[t] for t in own) for own in items.values()]
        return cls(list(items), vocabulary, np.array([place[t] for t in vocabulary], np.int64),
                   np.array([c for own in codes for c in own], np.int64),
                   np.cumsum([0, *map(len, codes)]))

    def postings(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, frequency) of the block's terms, by document and term, and the
        number of terms of each document."""
        words, n = terms(texts)
        code = pc.fill_null(pc.index_in(words, value_set=pa.array(self.vocabulary, pa.binary())), -1).to_numpy()
        known = np.flatnonzero(code >= 0)
        key = np.repeat(np.arange(len(n)), n)[known] * len(self.vocabulary) + code[known]
        key, tf = np.unique(key, return_counts=True)
        doc, code = np.divmod(key, max(1, len(self.vocabulary)))
        return doc, code, tf, n

    def lookup(self, coords: int = COORDS) -> np.ndarray:
        """How many terms of each item have each coordinate."""
        out = np.zeros((coords, len(self.item_id)))
        np.add.at(out, (self.coordinate[self.code], np.repeat(np.arange(len(self.item_id)), np.diff(self.begin))), 1)
        return out


def blocks(items: DataFrame, n_items: int = ITEMS, n_bytes: int = ITEM_BYTES) -> Iterator[Block]:
    """Items in order of their id, a block at a time (never all of them at once)."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id")
    own: dict[int | None, set] = {}
    size = 0
    for r in rows.toLocalIterator(prefetchPartitions=False):
        if r["item_id"] not in own and (len(own) >= n_items or size >= n_bytes):
            yield Block.of(own)
            own, size = {}, 0
        found, _ = terms(pa.array([r["text"]], pa.string()))
        own.setdefault(r["item_id"], set()).update(found.to_pylist())
        size += len(r["text"])
    if own:
        yield Block.of(own)


def corpus_counts(docs: DataFrame, block: Block) -> DataFrame:
    """(code, n): document frequency by term number; -1 counts documents with a term and
    -2 all terms.  One row a term and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(block.vocabulary), np.int64), 0, 0
        for whole in batches:
            for lo, hi in slices(text_buffer(whole.column("text"))[1], SLICE_BYTES):
                _, code, _, n = block.postings(whole.column("text").slice(lo, hi - lo))
                df += np.bincount(code, minlength=len(df))
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1, -2]), pa.array(np.r_[df[used], n_docs, n_terms])],
                                         ["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Best:
    """The k best (score, doc_id) of every item so far."""

    def __init__(self, n_items: int, k: int):
        self.k, self.item = k, np.zeros(0, np.int64)
        self.score, self.doc_id = self.item, self.item
        self.floor = np.ones(n_items, np.int64)          # a score must reach this

    def add(self, item: np.ndarray, score: np.ndarray, doc_id: np.ndarray) -> None:
        new = score >= self.floor[item]
        item, score, doc_id = (np.r_[a, b[new]] for a, b in (
            (self.item, item), (self.score, score), (self.doc_id, doc_id)))
        order = np.lexsort((doc_id, -score, item))
        item, score, doc_id = item[order], score[order], doc_id[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.score, self.doc_id = item[keep], score[keep], doc_id[keep]
        last = rank == self.k - 1
        self.floor[item[last]] = score[last]


def search_slice(block: Block, lookup: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int,
                 texts: pa.Array, doc_id: np.ndarray, best: Best, coords: int = COORDS) -> int:
    """Rank one slice of documents into ``best``; returns the number of exact scores."""
    doc, code, tf, n = block.postings(texts)
    if not len(doc):
        return 0
    m = 10 + (90 * n * n_docs) // max(1, n_terms)
    impact = weight[code] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    cell = doc * coords + block.coordinate[code]
    head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sketch = np.zeros(len(n) * coords)
    sketch[cell[head]] = np.maximum.reduceat(impact, head)
    bound = sketch.reshape(len(n), coords) @ lookup      # whole numbers below 2^53
    order = np.argsort(-bound, axis=0, kind="stable")
    key, rescored = doc * len(block.vocabulary) + code, 0
    for at in range(0, len(n), STEP):
        d = order[at:at + STEP]
        q = np.broadcast_to(np.arange(bound.shape[1]), d.shape)
        open_ = bound[d, q] >= best.floor[q]
        d, q = d[open_], q[open_]
        if not len(d):
            break
        size = block.begin[q + 1] - block.begin[q]
        row = np.repeat(np.arange(len(d)), size)
        own = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + block.begin[q][row]
        want = d[row] * len(block.vocabulary) + block.code[own]
        found = np.minimum(np.searchsorted(key, want), len(key) - 1)
        part = np.where(key[found] == want, impact[found], 0)
        best.add(q, np.add.reduceat(part, np.cumsum(size) - size), doc_id[d])
        rescored += len(d)
    return rescored


def search_block(docs: DataFrame, block: Block, top: int = TOP) -> DataFrame:
    """(item_id, doc_id, score): at most ``top`` rows an item and task, among them the best of all."""
    counts = {r["code"]: r["n"] for r in corpus_counts(docs, block).collect()}   # terms of a block
    n_docs, n_terms = counts.pop(-1, 0) or 0, counts.pop(-2, 0) or 0
    weight = np.zeros(len(block.vocabulary), np.int64)
    for code, df in counts.items():
        weight[code] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    job = docs.sparkSession.sparkContext.broadcast((block, weight))              # bounded as the block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = job.value
        best, lookup = Best(len(block.item_id), top), block.lookup()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_DOCS):
                some = whole.slice(at, SLICE_DOCS)
                for lo, hi in slices(text_buffer(some.column("text"))[1], SLICE_BYTES):
                    b = some.slice(lo, hi - lo)
                    ids = pc.fill_null(b.column("doc_id").cast(pa.int64()), NO_ID).to_numpy()
                    search_slice(block, lookup, weight, n_docs, n_terms, b.column("text"), ids, best)
        ids = pa.array(best.doc_id, mask=best.doc_id == NO_ID)
        item = pa.array([block.item_id[i] for i in best.item.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([item, ids, pa.array(best.score)], ["item_id", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item."""
    spark = docs.sparkSession
    found = [stored(search_block(docs, b, top), "lexical-best") for b in blocks(items) if len(b.vocabulary)]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("item_id", "salt").orderBy(*order)
    rows = (reduce(DataFrame.unionAll, found)
            .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
            .withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top))
    whole = Window.partitionBy("item_id").orderBy(*order)
    return (rows.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))
