"""Exact top-n by inner product without scoring every pair.

Items are dealt into blocks by direction (metric cells) and, within a cell, by bands of
their norm.  A block knows its smallest and largest norm and the largest angle r to its
pivot p.  For a query vector u, no item of the block scores above

    |u| * M * cos(max(0, angle(u, p) - r))      (the smallest norm where the cosine is negative)

which is Cauchy-Schwarz sharpened by the direction.  Two rounds use it:

1. every query scores the *heads* (largest norms) of its ``FIRST_BLOCKS`` best-bound blocks:
   its n-th score so far is a floor under the final n-th score;
2. the blocks whose bound reaches the floor are scored in full.

A query and a block below its floor never meet.  The bounds of a slice of queries for all
blocks are one matrix (numpy, ``BOUNDS_AT_ONCE`` entries), in as many tasks as the queries
need.  The heads are joined on the block:
broadcast after a size check, else shuffled with a salt.  In the second round neighbouring
blocks make up chunks of bounded size; a bounded part of the queries and a chunk meet in one
task as matrices (numpy), where a query keeps the n best of the chunk.  A product of matrices
only finds what can be among them: their scores are summed term by term, as in the first
round.  What reaches the driver is bounded: a sample for the pivots
and the list of blocks (at most ``MAX_CELLS * MAX_BANDS`` + 1 rows, as one scalar).

Results: (query, item, rk, score) by descending score, equal scores by ascending item;
zero query vectors score 0 everywhere and get the smallest items; null vectors count as
zero; no items, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.functions.scalar import dot, l2_norm
from tastemap.operators.cells import MAX_CELLS, matrix, n_cells, pivots_of, with_angles, with_cell
from tastemap.session import materialise

BLOCK_ROWS = 256            # items of a block, until MAX_CELLS * MAX_BANDS blocks are reached
MAX_BANDS = 64
HEAD = 32                   # items of a block's head (at least n)
FIRST_BLOCKS = 4
SALTS = 8
BROADCAST_BYTES = 64 * 1024 * 1024
CHUNK_ITEMS = (2048, 32_768)    # items of a chunk: a 64th of all, within these
PART_QUERIES = (1024, 16_384)   # queries that meet a chunk at once: an eighth of all, within these
SLICE = 256                 # queries multiplied at once
TASK_QUERIES = 8192         # queries whose bounds one task works out
BOUNDS_AT_ONCE = 1 << 20    # entries of a matrix of bounds
UNROLL = 16                 # widest dot product written out term by term (one code path, no lambda)


@dataclass
class TopItems:
    """The rows, and what it took to get them."""
    rows: DataFrame
    wanted: DataFrame       # (query, block) pairs of the second round
    queries: DataFrame
    n_blocks: int

    def blocks_scored(self) -> tuple[int, int]:
        """(query, block) pairs scored in full, and all there are (for tests and tuning)."""
        return self.wanted.count(), self.queries.count() * self.n_blocks


def _dot(a: str, b: str, width: int) -> Column:
    if not 0 < width <= UNROLL:
        return dot(a, b)
    terms = [F.coalesce(F.get(F.col(a), k) * F.get(F.col(b), k), F.lit(0.0)) for k in range(width)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _vectors(df: DataFrame, key: str, vec: str, k: str, v: str, norm: str) -> DataFrame:
    x = F.coalesce(F.col(vec).cast("array<double>"), F.array().cast("array<double>"))
    return (df.select(F.col(key).alias(k), x.alias(v)).withColumn(norm, l2_norm(v)))


def item_blocks(items: DataFrame, key: str, vec: str, n: int) -> tuple[DataFrame, list[list[float]]]:
    """(stored items (_i, _iv, _in, _b, _cell, _ang, _head), pivots): the block of each item,
    and whether it is among the block's largest norms."""
    rows = _vectors(items, key, vec, "_i", "_iv", "_in")
    unit = rows.where("_in > 0").withColumn("_unit", F.transform("_iv", lambda x: x / F.col("_in")))
    n_rows = unit.count()
    k = n_cells(n_rows)
    pivots = pivots_of(unit, "_unit", k)
    bands = max(1, min(MAX_BANDS, n_rows // (k * BLOCK_ROWS)))
    cut = [i / bands for i in range(1, bands)]
    none = {"_cell": F.lit(-1), "_ang": F.lit(0.0)}
    placed = with_cell(unit, "_unit", pivots, "_cell", "_ang") if pivots else unit.withColumns(none)
    if cut:
        cuts = unit.agg(F.percentile_approx("_in", cut, 10_000).alias("c")).select("c").scalar()
        placed = placed.withColumn("_cut", cuts).withColumn(
            "_band", F.size(F.filter("_cut", lambda c: c < F.col("_in")))).drop("_cut")
    else:
        placed = placed.withColumn("_band", F.lit(0))
    placed = placed.withColumn("_b", F.col("_cell") * bands + F.col("_band")).drop("_band", "_unit")
    both = placed.unionByName(rows.where("_in = 0").withColumns({**none, "_b": F.lit(-1)}))
    w = Window.partitionBy("_b").orderBy(F.desc("_in"), F.asc("_i"))
    both = both.withColumn("_head", F.row_number().over(w) <= max(HEAD, n))
    return materialise(both, "mips-blocks"), pivots


def _bound(b: Column) -> Column:
    """A block with its bound for the query of the row."""
    cos = F.cos(F.greatest(F.lit(0.0), F.coalesce(F.get("_al", b["cell"]), F.lit(0.0)) - b["r"]))
    # room for rounding: a bound may be too high, never too low
    top = F.col("_un") * F.when(cos >= 0, b["hi"]).otherwise(b["lo"]) * cos
    return F.struct((top + (F.col("_un") * b["hi"] + 1) * 1e-9).alias("bound"), b["b"].alias("b"))


def _bounds(probe: DataFrame, blocks: Column) -> DataFrame:
    """Add ``_bd``: every block with its bound for the query."""
    return probe.withColumn("_bl", blocks).withColumn(
        "_bd", F.reverse(F.array_sort(F.transform("_bl", _bound)))).drop("_bl")


def _bound_matrix(norms: np.ndarray, angles: np.ndarray, blocks: list) -> np.ndarray:
    """``_bound`` of every query (row) and block."""
    cell = np.array([r["cell"] for r in blocks], int)
    lo, hi, r = (np.array([b[k] for b in blocks], float) for k in ("lo", "hi", "r"))
    with np.errstate(invalid="ignore", over="ignore"):
        cos = np.cos(np.maximum(0.0, np.where(cell >= 0, angles[:, np.maximum(cell, 0)], 0.0) - r))
        top = norms[:, None] * np.where(cos >= 0, hi, lo) * cos
        return top + (norms[:, None] * hi + 1) * 1e-9


def _slices(batches: Iterator[pa.RecordBatch], blocks: list, n_pivots: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Queries (_un, _al, ...) and their bounds, some at a time."""
    rows = max(1, BOUNDS_AT_ONCE // max(1, len(blocks)))
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            yield b, _bound_matrix(b.column("_un").to_numpy(zero_copy_only=False),
                                   matrix(pa.chunked_array([b.column("_al")]), n_pivots), blocks)


def _best_blocks(probe: DataFrame, blocks: list, n_pivots: int) -> DataFrame:
    """(_u, _uv, _b): the ``FIRST_BLOCKS`` best-bound blocks of every query."""
    names = np.array([r["_b"] for r in blocks], np.int32)
    k = min(FIRST_BLOCKS, len(blocks))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bound in _slices(batches, blocks, n_pivots):
            bound[np.isnan(bound)] = np.inf
            first = np.argpartition(-bound, k - 1, axis=1)[:, :k] if k else np.zeros((len(bound), 0), int)
            q = pa.array(np.repeat(np.arange(len(bound)), k))
            yield pa.RecordBatch.from_arrays([b.column("_u").take(q), b.column("_uv").take(q),
                                              pa.array(names[first.ravel()])], ["_u", "_uv", "_b"])

    return probe.select("_u", "_uv", "_un", "_al").mapInArrow(best, probe.select("_u", "_uv").schema.add("_b", "integer"))


def _asked_chunks(rows: DataFrame, blocks: list, chunks: list[list], n_pivots: int) -> DataFrame:
    """(_u, _uv, _fs, _g, _bs): the chunks with a block that reaches a query's floor, and
    these blocks."""
    place = {r["_b"]: i for i, r in enumerate(blocks)}
    entries = [(g, place[r["_b"]], r["_b"]) for g, c in enumerate(chunks) for r in c]
    chunk, col, name = (np.array(e, np.int32) for e in (zip(*entries) if entries else ([], [], [])))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bound in _slices(batches, blocks, n_pivots):
            floor, none = b.column("_fs").to_numpy(zero_copy_only=False), np.asarray(b.column("_fs").is_null())
            q, e = np.nonzero((none[:, None] | ~(bound < floor[:, None]))[:, col])
            start = np.flatnonzero(np.diff(q, prepend=-1) | np.diff(chunk[e], prepend=-1))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(q)), pa.int32()), pa.array(name[e], pa.int32()))
            at = pa.array(q[start])
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("_u", "_uv", "_fs")],
                                              pa.array(chunk[e[start]], pa.int32()), lists], ["_u", "_uv", "_fs", "_g", "_bs"])

    schema = rows.select("_u", "_uv", "_fs").schema.add("_g", "integer").add("_bs", T.ArrayType(T.IntegerType()))
    return rows.select("_u", "_uv", "_un", "_al", "_fs").mapInArrow(ask, schema)


def _meet(wanted: DataFrame, items: DataFrame, size: int, width: int) -> DataFrame:
    """(_u, _i, _s): scores of queries with the items of their wanted blocks."""
    if size <= BROADCAST_BYTES:
        j = wanted.join(F.broadcast(items), "_b")
    else:
        wanted = wanted.withColumn("_salt", F.pmod(F.xxhash64("_u"), F.lit(SALTS)).cast("int"))
        items = items.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        j = wanted.join(items, ["_b", "_salt"])
    return j.select("_u", "_i", _dot("_uv", "_iv", width).alias("_s"), "_fs", "_fi").where(
        (F.col("_s") > F.col("_fs")) | ((F.col("_s") == F.col("_fs")) & (F.col("_i") <= F.col("_fi")))
        | F.col("_fs").isNull()).select("_u", "_i", "_s")


def _share(n: int, parts: int, limits: tuple[int, int]) -> int:
    return min(limits[1], max(limits[0], n // parts))


def _chunks(blocks: list, n_items: int) -> tuple[list[list], dict[int, tuple[int, int]]]:
    """(blocks of each chunk, first chunk and number of chunks of each block): blocks in
    order fill a chunk, a block larger than a chunk is dealt to several of its own."""
    most = _share(n_items, 64, CHUNK_ITEMS)
    chunks, place, room = [], {}, 0
    for r in sorted(blocks, key=lambda r: r["_b"]):
        parts = -(-r["n"] // most)
        if parts > 1 or r["n"] > room:
            chunks.extend([] for _ in range(parts))
            room = 0 if parts > 1 else most
        place[r["_b"]] = (len(chunks) - parts, parts)
        for c in chunks[-parts:]:
            c.append(r)
        room -= r["n"] if parts == 1 else 0
    return chunks, place


def _best_of_chunk(queries: pa.Table, items: pa.Table, n: int, width: int) -> tuple[np.ndarray, ...]:
    """(query row, item row, score): the ``n`` best items of every query by score and item
    among those of its blocks that reach its floor (others that reach it do no harm)."""
    v, blk = matrix(items.column("_iv"), width), items.column("_b").to_numpy()
    by_id = items.column("_i").combine_chunks()
    rank = np.empty(len(v), np.int64)
    rank[pc.sort_indices(by_id, null_placement="at_start").to_numpy()] = np.arange(len(v))
    order = np.argsort(blk, kind="stable")
    v, blk, rank = v[order], blk[order], rank[order]
    names, first = np.unique(blk, return_index=True)
    last = np.append(first[1:], len(blk))
    u = matrix(queries.column("_uv"), width)
    floor = queries.column("_fs").to_numpy()
    none = np.asarray(queries.column("_fs").is_null())
    # room for the rounding of the product of matrices
    room = 1e-12 * (width + 1) * np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1).max()
    least = np.where(none, -np.inf, floor - room)
    lists = queries.column("_bs").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    wants = np.zeros((len(u), len(names)), bool)
    asked = lists.values.to_numpy()[ends[0]:ends[-1]]
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    here = names[at] == asked           # a part of a large block may be without items
    wants[np.repeat(np.arange(len(u)), np.diff(ends))[here], at[here]] = True
    out = []
    for lo in range(0, len(u), SLICE):
        x, w = u[lo:lo + SLICE], wants[lo:lo + SLICE]
        if w.mean() > 0.25:
            s = x @ v.T
        else:
            s = np.full((len(x), len(v)), -np.inf)
            for b in np.flatnonzero(w.any(axis=0)):
                rows = np.flatnonzero(w[:, b])
                s[rows, first[b]:last[b]] = x[rows] @ v[first[b]:last[b]].T
        q, i = np.nonzero(~(s < least[lo:lo + SLICE, None]) & (s != -np.inf))
        near = s[q, i]
        by = np.lexsort((-near, q))
        place = np.arange(len(q)) - np.searchsorted(q, q)          # q ascends
        nth = np.full(len(x), -np.inf)
        nth[q[place == n - 1]] = near[by][place == n - 1]
        kept = ~(near < nth[q] - 2 * room[lo + q])
        q, i = q[kept], i[kept]
        terms = (x[q, k] * v[i, k] for k in range(width))
        exact = next(terms, np.zeros(len(q))) + (0.0 if width > UNROLL else -0.0)
        for t in terms:
            exact = exact + t
        kept = none[lo + q] | ~(exact < floor[lo + q])
        q, i, exact = q[kept], i[kept], exact[kept]
        by = np.lexsort((rank[i], -exact, ~np.isnan(exact), q))
        q, i, exact = q[by], i[by], exact[by]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < n
        out.append((lo + q[kept], order[i[kept]], exact[kept]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _meet_chunks(rows: DataFrame, items: DataFrame, n: int, width: int, n_queries: int) -> DataFrame:
    """(_u, _i, _s): the best ``n`` items of every query and chunk; ``rows`` are queries with
    ``_bs``, their wanted blocks, as (_u, _uv, _fs, _g, _bs), ``_g`` the chunk."""
    parts = -(-max(1, n_queries) // _share(n_queries, 8, PART_QUERIES))
    left = rows.withColumn("_q", F.pmod(F.xxhash64("_u"), F.lit(parts)).cast("int"))
    right = items.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = rows.select("_u").schema
    schema = schema.add(items.schema["_i"]).add("_s", "double")

    def score(queries: pa.Table, near: pa.Table) -> pa.Table:
        if not queries.num_rows or not near.num_rows:
            return pa.table({"_u": queries.column("_u")[:0], "_i": near.column("_i")[:0], "_s": pa.array([], pa.float64())})
        q, i, s = _best_of_chunk(queries, near, n, width)
        return pa.table({"_u": queries.column("_u").take(pa.array(q)), "_i": near.column("_i").take(pa.array(i)),
                         "_s": pa.array(s)})

    return left.groupBy("_g", "_q").cogroup(right.groupBy("_g", "_q")).applyInArrow(score, schema)


def _top(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("_u").orderBy(F.desc("_s"), F.asc("_i"))
    return rows.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n)


def _floor(top: DataFrame, n: int) -> DataFrame:
    """(_u, _fs, _fi): the n-th score and its item, where there is one."""
    return top.where(F.col("_rk") == n).select("_u", F.col("_s").alias("_fs"), F.col("_i").alias("_fi"))


def top_items(queries: DataFrame, items: DataFrame, n: int, query: str, item: str,
              query_vec: str = "features", item_vec: str = "features") -> TopItems:
    """The ``n`` items with the largest inner product for every query row (keys unique)."""
    placed, pivots = item_blocks(items, item, item_vec, n)
    found = placed.groupBy("_b").agg(
        F.first("_cell").alias("cell"), F.min("_in").alias("lo"), F.max("_in").alias("hi"),
        F.max("_ang").alias("r"), F.count(F.lit(1)).alias("n"), F.max(F.size("_iv")).alias("w")).collect()
    width = max((r["w"] for r in found), default=0)
    size = sum(r["n"] for r in found) * (8 * width + 48)
    block = "array<struct<b:int,cell:int,lo:double,hi:double,r:double>>"
    entry = lambda r: (r["_b"], r["cell"], r["lo"], r["hi"], r["r"])
    scalar = lambda value, kind: queries.sparkSession.createDataFrame(
        [(value,)], f"l {kind}").select("l").scalar()
    blocks = scalar([entry(r) for r in found], block)
    chunks, place = _chunks(found, sum(r["n"] for r in found))

    probe = _vectors(queries, query, query_vec, "_u", "_uv", "_un")
    zero = probe.where("_un = 0").select("_u")
    probe = probe.where("_un > 0").withColumn("_unit", F.transform("_uv", lambda x: x / F.col("_un")))
    probe = materialise(with_angles(probe, "_unit", pivots or [[0.0]], "_al").drop("_unit"), "mips-probe")
    none = [F.lit(None).cast("double").alias("_fs"), F.lit(None).cast(placed.schema["_i"].dataType).alias("_fi")]

    # few bytes but much work a row: dealt to tasks by number
    n_queries = probe.count()
    tasks = max(queries.sparkSession.sparkContext.defaultParallelism, -(-n_queries // TASK_QUERIES))
    n_pivots = max(1, len(pivots))

    # 1: a floor from the heads of the best blocks
    best = _best_blocks(probe.repartition(tasks), found, n_pivots).select("_u", "_uv", "_b", *none)
    heads = placed.where("_head").select("_b", "_i", "_iv")
    floor = materialise(_floor(_top(_meet(best, heads, size, width), n), n), "mips-floor")

    # 2: every block that reaches it
    rows = _bounds(probe.join(floor, "_u", "left"), blocks)
    wanted = rows.select("_u", "_uv", "_fs", "_fi", F.explode(F.transform(F.filter(
        "_bd", lambda b: F.col("_fs").isNull() | (b["bound"] >= F.col("_fs"))), lambda b: b["b"])).alias("_b"))
    asked = _asked_chunks(probe.join(floor, "_u", "left").repartition(tasks), found, chunks, n_pivots)
    where = queries.sparkSession.createDataFrame([(b, *at) for b, at in place.items()], "_b int, at int, k int")
    dealt = placed.select("_b", "_i", "_iv").join(F.broadcast(where), "_b").select(
        "_b", "_i", "_iv", (F.col("at") + F.pmod(F.xxhash64("_i"), F.col("k"))).cast("int").alias("_g"))
    out = _top(_meet_chunks(asked, dealt, n, width, n_queries), n)
    smallest = placed.select("_i").orderBy("_i").limit(n).agg(
        F.array_sort(F.collect_list("_i")).alias("l")).select("l").scalar()
    nothing = zero.select("_u", F.posexplode(smallest).alias("_p", "_i")).select(
        "_u", "_i", F.lit(0.0).alias("_s"), (F.col("_p") + 1).alias("_rk"))
    rows = out.select("_u", "_i", "_s", "_rk").unionByName(nothing).select(
        F.col("_u").alias(query), F.col("_i").alias(item), F.col("_rk").cast("int").alias("rk"),
        F.col("_s").alias("score"))
    return TopItems(rows, wanted, probe, len(found))
