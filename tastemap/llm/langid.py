"""Language identification by rank-order n-gram profiles (out-of-place distance).

A text is lower-cased, every run of non-letters becomes one gap, and the 1-, 2-
and 3-grams of letters and gaps are counted.  A language's profile is the ranking
of its ``profile_size`` most frequent n-grams over all training documents; a
document is given the language whose profile has the smallest out-of-place
distance from the document's own ranking (an n-gram that a profile lacks costs
the largest distance).

N-grams are hashed to ``2 ** BITS`` bins, so a count table has a fixed size.
Training counts are summed per task and then by Spark; only the profiles
(languages x profile_size rows) reach the driver and, with the task, the workers.

Defined results: a null text or one without a letter is ``und`` with score 0;
ties go to the first language in order; with no profile at all every text is
``und``; repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textnum import slices, text_buffer

BITS = 18
PROFILE_SIZE = 400
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bin) of every n-gram, and whether each document has a letter.
    ``buf`` holds lower-cased UTF-8."""
    first = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=first[1:])
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = first[offs]
    n = len(offs) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    letter = _letters()[chars]
    # a gap stays where a letter precedes it in the same document, and one opens each document
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])
    code = np.where(letter, chars, 0).astype(np.uint32)[keep]
    doc = doc[keep]
    opens = np.searchsorted(doc, np.arange(n))
    code = np.insert(code, opens, 0)
    doc = np.insert(doc, opens, np.arange(n, dtype=np.int32))

    k1, k2, k3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - BITS)
    one = code * k1
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * k2 + code[1:] * k3
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * k1 + code[2:] * k2
    fin = lambda h: ((h ^ (h >> np.uint32(13))) * k2) >> shift
    is1 = code > 0
    is2 = (doc[:-1] == doc[1:]) & (is1[:-1] | is1[1:])
    is3 = (doc[:-2] == doc[2:]) & is1[1:-1]
    docs = np.concatenate([doc[is1], doc[:-1][is2], doc[:-2][is3]])
    bins = np.concatenate([fin(one[is1]), fin(two[is2]), fin(three[is3])])
    has = np.bincount(doc[is1], minlength=n) > 0
    return docs, bins, has


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, bin, n) over whole texts; ``docs`` has text and a non-null lang."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy(zero_copy_only=False)
            names = langs.dictionary.to_pylist()
            buf, offs = text_buffer(b.column("text"), lower=True)
            for i, j in slices(offs):
                doc, bins, _ = ngrams(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                mine = codes[i:j][doc]
                for c in np.unique(codes[i:j]):
                    t = tables.setdefault(names[c], np.zeros(1 << BITS, np.int64))
                    t += np.bincount(bins[mine == c], minlength=1 << BITS)
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                 pa.array(t[at], pa.int64())], ["lang", "bin", "n"])

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, bin int, n long")
    return counts.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


@dataclass
class Profiles:
    """Ranks of the profiled n-grams: one row of ``ranks`` a language."""
    langs: list[str]
    ranks: np.ndarray          # (languages, 2 ** BITS) of uint16; ``size`` where absent
    size: int


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from every row of ``docs`` (text, lang) with a non-null lang."""
    counts = count_ngrams(docs.where(F.col("lang").isNotNull()))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("bin"))
    top = counts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= size)
    rows = top.select("lang", "bin", "rk").collect()      # languages x size rows
    langs = sorted({r["lang"] for r in rows})
    ranks = np.full((len(langs), 1 << BITS), size, np.uint16)
    for r in rows:
        ranks[langs.index(r["lang"]), r["bin"]] = r["rk"] - 1
    return Profiles(langs, ranks, size)


def classify(doc: np.ndarray, bins: np.ndarray, has: np.ndarray,
             p: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """(language index or -1, score) of each document."""
    n = len(has)
    key = np.sort((doc.astype(np.int64) << BITS) | bins)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    doc = key >> BITS
    order = np.lexsort((key, -count, doc))
    doc, bins = doc[order], key[order] & ((1 << BITS) - 1)
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    top = rank < p.size
    doc, bins, rank = doc[top], bins[top], rank[top]
    found = p.ranks[:, bins].astype(np.int64)
    away = np.where(found == p.size, p.size, np.abs(found - rank))
    dist = np.stack([np.bincount(doc, weights=a, minlength=n) for a in away])
    best = dist.argmin(axis=0)
    worst = np.maximum(np.bincount(doc, minlength=n) * p.size, 1)
    score = 1 - dist[best, np.arange(n)] / worst
    return np.where(has, best, -1), np.where(has, score, 0.0)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred and score of every whole text."""
    out = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    names = out.names
    shared = docs.sparkSession.sparkContext.broadcast(profiles)   # languages x 2 ** BITS ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        labels = np.array([*p.langs, UNDETERMINED], dtype=object)
        for b in batches:
            buf, offs = text_buffer(b.column("_text"), lower=True)
            best, score = [], []
            for i, j in slices(offs, 2 << 20):
                doc, bins, has = ngrams(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                if p.langs:
                    x, s = classify(doc, bins, has, p)
                else:
                    x, s = np.full(j - i, -1), np.zeros(j - i)
                best.append(x)
                score.append(s)
            if best:
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in keep],
                     pa.array(labels[np.concatenate(best)], pa.string()),
                     pa.array(np.concatenate(score), pa.float64())], names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, out)
