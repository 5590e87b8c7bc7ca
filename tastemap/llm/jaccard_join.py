"""Near-duplicate join on word 5-grams by chosen paths (Jaccard >= threshold).

A document's set is the hashes of its five-word windows (words lower-cased; a
shorter non-empty text is one window).  Equal sets are one class; classes are
joined, and copies are carried as a weight.

1. Each class gets ``POSITIONS`` (more if more runs are needed) min-wise samples of its set: the value at a
   position is the token of the set with the smallest hash under that position's
   seed.  Two sets share the token at a position with probability J.
2. A run splits all classes on one sampled token.  Buckets of more than ``SMALL``
   classes are split again on ``CHILDREN`` further positions, chosen by a hash of
   the bucket's path, and so on; a bucket that keeps half of its parent (a group
   of true near copies) stays as it is.  Runs are repeated until the chance of
   missing a pair at the threshold, whose buckets may all be split again, is below
   1 - ``RECALL`` (runs taken as independent).
3. Small buckets with the same members are merged, and so are large buckets with
   the same smallest member, so that the runs do not repeat a large group.  Each
   bucket is compared by brute force on the exact sets; a large one is cut into
   blocks and each pair of blocks is its own group, so no group is unbounded.  A
   pair that shares several buckets counts in the smallest one only.
4. Per bucket only link counts and a spanning forest of the links leave the task
   (never all pairs); stars of the forest are joined into components by repeated
   large-star and small-star steps.

Result: one row per document: ``class_id`` (smallest doc_id of its component) and
``n_links`` (number of other documents at least that similar, copies included).

Defined results: a null or empty text has no set and stands alone (so do texts of
white space only); rows of one doc_id are one node, repeated ones count as copies;
a null doc_id gets no class; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, stored
from .textnum import Slice, mix, slices, text_buffer

K = 5
THRESHOLD = 0.8
POSITIONS = 64
CHILDREN = 2
RECALL = 0.99999
SMALL = 128
BLOCK = 256
DEPTH = 8
HOT_SHARE = 2000


def _seeds(positions: int) -> np.ndarray:
    return mix(np.arange(1, positions + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = K) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each document, slice by slice."""
    for i, j in slices(offs, 2 << 20):
        s = Slice(buf, offs, i, j)
        words = s.word_hashes()
        at, grams = s.shingles(words, k)
        lo = np.searchsorted(at, s.word_offs[:-1])
        hi = np.searchsorted(at, s.word_offs[1:])
        out = []
        for d in range(s.n):
            if hi[d] > lo[d]:
                out.append(np.unique(grams[lo[d]:hi[d]]))
            elif s.n_words[d]:
                h = np.uint64(0)
                with np.errstate(over="ignore"):
                    for w in words[s.word_offs[d]:s.word_offs[d + 1]]:
                        h = h * np.uint64(0x9E3779B97F4A7C15) + w
                out.append(mix(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        yield out


def signature(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The sampled token of each position, in bounded memory for long sets."""
    best = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(tokens), 4096):
        t = tokens[lo:lo + 4096]
        h = t[None, :] ^ seeds[:, None]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        best = np.minimum(best, h.min(axis=1))
    return best


def signatures(docs: DataFrame, k: int = K, positions: int = POSITIONS) -> DataFrame:
    """(doc_id, set_a, set_b, sig array<long>): a 128-bit name of the set and its samples;
    null for documents without words."""
    seeds = _seeds(positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffer(b.column("text"), lower=True)
            at, name_a, name_b, sigs, n = [], [], [], [], 0
            for sets in shingle_sets(buf, offs, k):
                for d, t in enumerate(sets):
                    if len(t):
                        at.append(n + d)
                        name_a.append(mix(t + np.uint64(len(t))).sum())
                        name_b.append(mix(t ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())
                        sigs.append(signature(t, seeds))
                n += len(sets)
            if not n:
                continue
            row = np.full(n, -1, np.int64)       # the found set of each document
            row[at] = np.arange(len(at))
            take = pa.array(row, mask=row < 0)
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            flat = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * positions, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), longs(name_a).take(take), longs(name_b).take(take), lists.take(take)],
                ["doc_id", "set_a", "set_b", "sig"])

    schema = docs.select("doc_id").schema.add("set_a", "long").add("set_b", "long").add(
        "sig", T.ArrayType(T.LongType()))
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def members(docs: DataFrame, k: int = K, positions: int = POSITIONS) -> DataFrame:
    """(doc_id, rep, weight, sig): the class of every document by its smallest doc_id, the
    number of its documents, and on the representative's row the samples of its set.

    Classes that hold more than 1/``HOT_SHARE`` of all documents, or more than a mean shuffle
    partition (so at most that many), reach their documents by a broadcast; only the rest
    meet in a shuffle."""
    named = stored(signatures(docs, k, positions), "signatures")
    classes = stored(named.where("set_a IS NOT NULL").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    share = max(HOT_SHARE, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.col("weight") * share >= max(named.count(), 1)
    rows = named.join(F.broadcast(classes.where(hot)), ["set_a", "set_b"], "left")
    met = F.col("weight").isNotNull() | F.col("set_a").isNull()
    cold = rows.where(~met).drop("rep", "weight").join(classes.where(~hot), ["set_a", "set_b"], "left")
    rows = rows.where(met).unionByName(cold)
    return stored(rows.select(
        "doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("weight", F.lit(1)).cast("long").alias("weight"),
        F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")), "members")


def runs_needed(threshold: float, recall: float) -> int:
    """Runs that bring the chance of missing a pair at the threshold below 1 - recall."""
    lost = 0.0    # chance that a pair in one bucket ends in none, as that bucket and its children are split
    for _ in range(DEPTH - 1):
        lost = (1 - threshold + threshold * lost) ** CHILDREN
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold + threshold * lost)))


def leaves(classes: DataFrame, threshold: float, small: int, recall: float,
           positions: int = POSITIONS) -> DataFrame:
    """(rep, weight, path, n, lead, a, b, large): the classes of the buckets in which the
    splitting ends, each with its bucket's size, smallest class and the hashes of its
    members; ``classes`` is (rep, weight, sig)."""
    runs = runs_needed(threshold, recall)
    if runs > positions:
        raise ValueError(f"{runs} runs need as many sampled positions, not {positions}")
    level = classes.select("rep", "weight", F.posexplode(F.slice("sig", 1, runs)).alias("run", "token")).select(
        "rep", "weight", F.xxhash64("run", "token").alias("path"), F.lit(None).cast("long").alias("parent_n"))
    carried = ["rep", "weight"]
    done = []
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("path").agg(
            F.count(F.lit(1)).alias("n"), F.max("parent_n").alias("_p"), F.min("rep").alias("lead"),
            F.sum(F.xxhash64(F.lit(1), "rep").cast("decimal(38,0)")).alias("a"),
            F.bit_xor(F.xxhash64(F.lit(2), "rep")).alias("b")).where("n > 1")
        large = F.col("n") > small
        stuck = F.coalesce(F.col("n") * 2 >= F.col("_p"), F.lit(False))
        rows = level.select(*carried, "path").join(sizes.select(
            "path", "n", "lead", "a", "b", large.alias("large"),
            (~large | stuck | F.lit(depth == DEPTH)).alias("ends")), "path")
        rows = stored(rows, "buckets")
        done.append(rows.where("ends").select("rep", "weight", "path", "n", "lead", "a", "b", "large"))
        big = rows.where(~F.col("ends")).select(*carried, "path", F.col("n").alias("parent_n"))
        if big.isEmpty():
            break
        if depth == 1:     # the classes that are split again take their samples along
            big = big.join(classes.select("rep", "sig"), "rep")
            carried = ["rep", "weight", "sig"]
        picks = F.explode(F.array(*[
            F.pmod(F.xxhash64(F.lit(c), "path"), F.lit(positions)).cast("int") for c in range(CHILDREN)]))
        level = big.select(*carried, "path", "parent_n", picks.alias("p")).select(
            *carried, F.xxhash64("path", "p", F.get("sig", F.col("p"))).alias("path"), "parent_n")
        if depth == 1:
            level = stored(level, "split-buckets")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def merged(ends: DataFrame) -> DataFrame:
    """(leaf, rep, weight, n): small buckets with the same members are one leaf, and large
    buckets with the same smallest class are one."""
    few = ends.where(~F.col("large")).select(
        F.xxhash64(F.lit("few"), "n", "a", "b").alias("leaf"), "rep", "weight", "n").distinct()
    big = stored(ends.where("large").select(
        F.xxhash64(F.lit("large"), "lead").alias("leaf"), "rep", "weight").distinct(), "large-buckets")
    sizes = big.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    return few.unionByName(big.join(sizes, "leaf").select("leaf", "rep", "weight", "n"))


def _overlaps(sets: list[np.ndarray], split: int | None) -> np.ndarray:
    """Sizes of the pairwise intersections, tokens taken in column blocks."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(t) for t in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    col = np.cumsum(new) - 1
    shared = np.bincount(col) > 1
    use = shared[col]
    owner, col = owner[use], (np.cumsum(shared) - 1)[col[use]]
    left = slice(0, m if split is None else split)
    right = slice(0 if split is None else split, m)
    out = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, [lo, lo + 4096])
        x = np.zeros((m, 4096), np.float32)
        x[owner[i:j], col[i:j] - lo] = 1
        out += x[left] @ x[right].T
    return out


def compare(sets: list[np.ndarray], split: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs (i < j) of a group; with ``split`` only pairs across it."""
    inter = _overlaps(sets, split)
    size = np.array([len(t) for t in sets], np.float64)
    a, b = (size, size) if split is None else (size[:split], size[split:])
    hit = inter >= threshold * (a[:, None] + b[None, :] - inter) - 1e-9
    if split is None:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit & (inter > 0))
    return i, j + (0 if split is None else split)


def _forest(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """Component label of each of ``m`` members under the links."""
    label = np.arange(m)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verify(groups: DataFrame, threshold: float, k: int = K) -> DataFrame:
    """(rep, n, other) from rows sorted by group: ``n`` linked documents of rep found
    in this group (0 rows when none), ``other`` a member of the same component."""
    def one(rows: list[tuple]) -> tuple[list, list, list]:
        same = rows[0][1] == rows[0][2]
        rows = list({(r[3] if not same else 0, r[4]): r for r in rows}.items())   # one row a class
        rows = [r for _, r in sorted(rows, key=lambda x: x[0])]
        split = None if same else sum(r[3] == rows[0][3] for r in rows)
        if len(rows) < 2 or split == len(rows):
            return [], [], []
        i, j = compare([r[6] for r in rows], split, threshold)
        if len(i):   # a pair counts in the smallest bucket that both are in
            leaf, homes = rows[0][0], [r[7] for r in rows]
            several = np.array([len(h) > 1 for h in homes])
            ok = np.ones(len(i), bool)
            for t in np.flatnonzero(several[i] & several[j]):
                ok[t] = min(set(homes[i[t]]) & set(homes[j[t]])) == leaf
            i, j = i[ok], j[ok]
        if not len(i):
            return [], [], []
        w = np.array([r[5] for r in rows], np.int64)
        n = np.bincount(i, w[j], len(rows)) + np.bincount(j, w[i], len(rows))
        label = _forest(i, j, len(rows))
        at = np.flatnonzero(n)
        return [rows[t][4] for t in at], [int(x) for x in n[at]], [rows[label[t]][4] for t in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], ([], [], [])

        def flush():
            for have, new in zip(out, one(rows)):
                have.extend(new)

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
                ["rep", "n", "other"])

        for b in batches:
            buf, offs = text_buffer(b.column("text"), lower=True)
            sets = (t for part in shingle_sets(buf, offs, k) for t in part)
            cols = [b.column(c).to_pylist() for c in ("leaf", "bi", "bj", "block", "rep", "weight", "homes")]
            for leaf, bi, bj, block, rep, weight, homes, t in zip(*cols, sets):
                if (leaf, bi, bj) != key:
                    if rows:
                        flush()
                    key, rows = (leaf, bi, bj), []
                rows.append((leaf, bi, bj, block, rep, weight, t, homes))
            if len(out[0]) > 10_000:
                yield made()
                out = ([], [], [])
        if rows:
            flush()
        if out[0]:
            yield made()

    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(parts, "leaf", "bi", "bj").sortWithinPartitions("leaf", "bi", "bj")
    return dealt.mapInArrow(lean(run), "rep long, n long, other long")


def components(edges: DataFrame) -> DataFrame:
    """(rep, component) from (rep, other), for every class but the smallest of each
    component: alternate large-star and small-star steps until only stars are left.
    Every step is a map-side combined minimum and a join."""
    e = stored(edges.where("rep <> other").select(
        F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")).distinct(), "edges")
    while True:
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        # in a star a class has one edge up, or edges from below, not both
        odd = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0")
        if odd.isEmpty():
            return e.select(F.col("a").alias("rep"), F.col("b").alias("component"))
        n = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        down = n.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        e = stored(down.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
            F.struct("a", F.col("low").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct(), "edges")


def text_ids(docs: DataFrame, out: str) -> DataFrame:
    """Add ``out``, an id of (doc_id, text): the doc_id, and where one has several texts, for
    all but one of them a number from 2 ** 62 on, hashed from both; null for a null doc_id."""
    own = F.col("doc_id").cast("long")
    clash = stored(docs.where("doc_id IS NOT NULL").select(own.alias("_doc"), F.xxhash64("text").alias("h")).groupBy(
        "_doc").agg(F.min("h").alias("_first"), F.max("h").alias("_last")).where("_first < _last").select(
        "_doc", "_first"), "text-clashes")
    if clash.isEmpty():
        return docs.withColumn(out, own)
    high = F.shiftrightunsigned(F.xxhash64(F.lit(out), "doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
    return docs.join(clash, own == F.col("_doc"), "left").withColumn(
        out, F.when(F.xxhash64("text") > F.col("_first"), high).otherwise(own)).drop("_doc", "_first")


def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, small: int = SMALL,
                   block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) per document; ``doc_id`` must be an integer."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    positions = max(POSITIONS, runs_needed(threshold, recall))      # every run samples its own
    member = members(docs, k, positions)
    rows = merged(leaves(member.where("sig IS NOT NULL").select("rep", "weight", "sig"), threshold, small, recall,
                         positions))

    # each class with all its leaves; a cluster in blocks, each pair of blocks a group
    homes = rows.groupBy("rep").agg(F.first("weight").alias("weight"),
                                    F.collect_set(F.struct("leaf", "n")).alias("homes"))
    placed = homes.select("rep", "weight", F.sort_array(F.transform("homes", lambda h: h["leaf"])).alias("homes"),
                          F.explode("homes").alias("h"))
    blocks = F.ceil(F.col("h.n") / block).cast("int")
    mine = F.when(blocks > 1, F.pmod(F.xxhash64(F.lit("block"), "rep"), blocks)).otherwise(0).cast("int")
    placed = placed.select("rep", "weight", "homes", F.col("h.leaf").alias("leaf"), mine.alias("block"),
                           F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    placed = placed.select("rep", "weight", "homes", "leaf", "block", F.least("block", "o").alias("bi"),
                           F.greatest("block", "o").alias("bj"))
    groups = placed.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    found = stored(verify(groups, threshold, k), "links")

    links = found.groupBy("rep").agg(F.sum("n").alias("linked"))
    comp = components(found.select("rep", "other"))
    return member.select("doc_id", "rep", "weight").join(links, "rep", "left").join(comp, "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
