"""Exact similarity joins without a cartesian product.

Cosine (threshold join)
    Vectors are normalised.  For a threshold ``t >= 0`` a pair (u, a) can only
    satisfy ``u.a > t`` if ``a`` is non-zero on at least one dimension of the
    *prefix* of ``u``: the largest-magnitude dimensions of ``u`` kept until the
    norm of the remaining ones is ``<= t`` (Cauchy-Schwarz bounds the rest of the
    dot product by that norm).  The right side is grouped by its set of non-zero
    dimensions (a bit mask, dimensions folded into ``MASK_BITS``); a left row
    looks up the distinct masks that meet its prefix and joins on the mask, so
    every candidate pair is made exactly once and then gets its exact dot product.
    Sparse vectors skip the masks that miss the prefix.

    Dense vectors all have one mask, which skips nothing.  They are pruned by angles
    instead: the right side is dealt to the nearest of a few pivots (``operators.cells``),
    each cell with the smallest and largest angle to its pivot.  By the triangle
    inequality a left row within ``acos(t)`` of a right row is as close in its angle to
    any pivot, so a left row joins only with the cells whose interval it reaches, and a
    pair gets its dot product only if the two angles to the pivot differ by less.  From
    ``CHUNK_ROWS`` right rows on, neighbouring cells make up chunks of bounded size: a
    bounded part of the left rows and a chunk meet in one task as matrices (numpy).  The
    product of matrices only finds the pairs near or above the threshold; their cosines are
    summed term by term, as in the plan.

    The right side (new articles) is packed into blocks and broadcast only after
    a size check (rows x vector width <= ``BROADCAST_INDEX_BYTES``).  Beyond it
    both sides are dealt into a grid of (left part, right part) cells sized from
    the right side, and joined on (mask, cell).

Jaccard (set overlap)
    Inverted index on the term: join the two (key, term) sets on the (salted)
    term, count shared terms per pair, ``shared / (nA + nB - shared)``.  Pairs
    sharing no term have similarity 0 and are not emitted.  With a least similarity
    only prefixes of the sets, rare terms first, are indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.functions.scalar import blend_score, dot, l2_norm
from tastemap.operators.cells import ANGLE_EPS, matrix, n_cells, pivots_of, with_angles, with_cell
from tastemap.session import materialise, spread

_EPS = 1e-9


def with_unit(df: DataFrame, vec: str, out: str) -> DataFrame:
    """Add the unit vector of ``vec`` (NULL for zero/empty vectors).  The norm
    is computed once per row in its own projection (inside a lambda it would
    be re-evaluated for every element)."""
    n = "_norm_" + out
    return (df.withColumn(n, l2_norm(vec))
            .withColumn(out, F.when(F.col(n) > 0, F.transform(vec, lambda x: x / F.col(n))))
            .drop(n))


def with_prefix(df: DataFrame, unit: str, threshold: float, out: str) -> DataFrame:
    """Add the prefix dimensions of unit vector ``unit``: its dimensions in
    order of decreasing |x|, kept while the norm of the dimensions from there
    on (inclusive) exceeds ``threshold``; zero entries are never kept.
    Sorted entries and suffix sums are each computed once per row."""
    t2 = threshold * threshold - _EPS
    e, c = "_ent_" + out, "_suf_" + out
    ent = F.array_sort(F.transform(
        unit, lambda x, i: F.struct((-F.abs(x)).alias("na"), i.alias("k"), (x * x).alias("sq"))))
    # running sums over the reversed entries give the inclusive suffix sums
    cum = F.aggregate(
        F.reverse(F.col(e)),
        F.struct(F.array().cast("array<double>").alias("a"), F.lit(0.0).alias("s")),
        lambda acc, x: F.struct(F.concat(acc["a"], F.array(acc["s"] + x["sq"])).alias("a"),
                                (acc["s"] + x["sq"]).alias("s")),
        lambda acc: F.reverse(acc["a"]))
    keep = F.filter(F.arrays_zip(F.col(e).alias("e"), F.col(c).alias("s")),
                    lambda z: (z["s"] > F.lit(t2)) & (z["e"]["na"] < 0))
    return (df.withColumn(e, ent).withColumn(c, cum)
            .withColumn(out, F.transform(keep, lambda z: z["e"]["k"]))
            .drop(e, c))


def nonzero_dims(v: Column) -> Column:
    idx = F.transform(v, lambda x, i: F.when(x != 0, i))
    return F.filter(idx, lambda i: i.isNotNull())


def _salt(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


# Largest right side (bytes, estimated from row count and vector length) that is
# broadcast; beyond it the join is a shuffle join on grid cells.
BROADCAST_INDEX_BYTES = 256 * 1024 * 1024
MASK_BITS = 64
MAX_MASKS = 4096        # distinct masks that a left row looks through
FEW_BITS = 12           # masks folded to this width are never more than MAX_MASKS
BLOCK_ROWS = 256        # right rows packed together
DENSE_ROWS = 256        # a dense right side of fewer rows is one cell
CHUNK_ROWS = 1024       # a dense right side of fewer rows meets the left rows one by one
CHUNK_BYTES = 32 << 20  # vectors of a chunk, at most (and a 16th of all): every left row that reaches it is sent to it
PART_BYTES = 32 << 20   # vectors of the left rows that meet a chunk at once, at most (and an eighth of all): a chunk is sent to each
SLICE = 256             # left rows multiplied at once, at most
PRODUCTS = 1 << 21      # products at once
PAIRS_AT_ONCE = 1 << 18  # pairs summed at once


def _mask(dims: Column, bits: int = MASK_BITS) -> Column:
    """Bit mask of a list of dimensions, folded into ``bits`` bits."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (k % bits).cast("int"))
    return F.aggregate(dims, F.lit(0).cast("long"), lambda m, k: m.bitwiseOR(bit(k)))


def prepare_left(left: DataFrame, left_keys: list[str], left_vec: str,
                 threshold: float) -> DataFrame:
    """Probe-ready left side of ``cosine_join``: (keys, _lu unit vector, _pre
    prefix dimensions).  Depends only on the left side and the threshold, so a
    caller scoring many batches against the same profiles (the stream) can
    compute and persist it once."""
    if threshold < 0:
        raise ValueError("cosine_join needs threshold >= 0 (pairs sharing no "
                         "dimension have cosine 0)")
    lu = with_unit(left.select(*left_keys, left_vec), left_vec, "_lu").where(F.col("_lu").isNotNull())
    return with_prefix(lu.select(*left_keys, "_lu"), "_lu", threshold, "_pre")


def _masked(lu: DataFrame, ru: DataFrame, left_keys: list[str], bits: int) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by ``_rm``: the right side's masks, and those that a left prefix meets."""
    ru = ru.withColumn("_rm", _mask(F.col("_nz"), bits)).drop("_nz")
    masks = ru.agg(F.collect_set("_rm").alias("m")).select("m").scalar()
    probe = lu.select(*left_keys, "_lu", _mask(F.col("_pre"), bits).alias("_pm"), masks.alias("_ms"))
    return probe.select(*left_keys, "_lu", F.lit(0.0).alias("_la"), F.explode(F.filter(
        "_ms", lambda m: m.bitwiseAND(F.col("_pm")) != 0)).alias("_rm")), ru.withColumn("_ra", F.lit(0.0))


def _celled(lu: DataFrame, ru: DataFrame, left_keys: list[str], n: int,
            near: float, each: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by ``_rm``: the right side's cells, and those that a left row reaches;
    ``_la`` and ``_ra`` are the angles to the cell's pivot.  Without ``each`` a left row comes
    once, with the list ``_rms`` of its cells."""
    pivots = pivots_of(ru, "_ru", n_cells(n))
    ru = with_cell(ru.drop("_nz"), "_ru", pivots, "_rm", "_ra")
    info = ru.groupBy("_rm").agg(F.min("_ra").alias("lo"), F.max("_ra").alias("hi"))
    by_cell = F.map_from_entries(F.collect_list(F.struct("_rm", F.struct("lo", "hi"))))
    cells = info.agg(by_cell.alias("m")).select(F.transform(
        F.array(*[F.lit(i) for i in range(len(pivots))]), lambda i: F.col("m")[i]).alias("c")).scalar()
    probe = with_angles(lu.select(*left_keys, "_lu"), "_lu", pivots, "_al").withColumn("_cl", cells)
    # the angles enter as an argument: inside the lambda they would be computed for every cell
    reach = F.filter(F.transform(F.arrays_zip("_cl", "_al"), lambda z, i: F.struct(
        i.alias("_rm"), z["_al"].alias("_la"), z["_cl"]["lo"].alias("lo"), z["_cl"]["hi"].alias("hi"))),
        lambda c: (c["_la"] - c["hi"] < near) & (c["lo"] - c["_la"] < near))
    if not each:
        return probe.select(*left_keys, "_lu", F.transform(reach, lambda c: c["_rm"]).alias("_rms")), ru
    return probe.select(*left_keys, "_lu", F.inline(reach)).drop("lo", "hi"), ru


def _right_side(right: DataFrame, right_keys: list[str], right_vec: str) -> tuple[DataFrame, int, int, int]:
    """(unit vectors ``_ru`` with their non-zero dimensions ``_nz``, rows, width, about how many masks)."""
    ru = (with_unit(right.select(*right_keys, right_vec), right_vec, "_ru")
          .where(F.col("_ru").isNotNull()).select(*right_keys, "_ru"))
    # read several times: computed once
    ru = materialise(ru.withColumn("_nz", nonzero_dims(F.col("_ru"))), "cosine-right")
    r = ru.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_ru")).alias("k"),
               F.approx_count_distinct(_mask(F.col("_nz"))).alias("m")).first()
    return ru, int(r["n"] or 0), int(r["k"] or 0), r["m"]


def _candidates(probe: DataFrame, ru: DataFrame, left_keys: list[str], right_keys: list[str],
                broadcast_bytes: int, n: int, width: int, near: float) -> DataFrame:
    """The pairs of two sides that are keyed by ``_rm``."""
    size = n * (8 * width + 64)
    if size <= broadcast_bytes:
        chunk = F.pmod(F.xxhash64(*right_keys), F.lit(max(1, -(-n // BLOCK_ROWS))))
        blocks = ru.groupBy("_rm", chunk.alias("_c")).agg(
            F.collect_list(F.struct(*right_keys, "_ru", "_ra")).alias("_rows")).drop("_c")
        pairs = (probe.join(F.broadcast(blocks), "_rm")
                 .select(*left_keys, "_lu", F.inline(F.filter(
                     "_rows", lambda x: F.abs(x["_ra"] - F.col("_la")) < near))))
        return pairs.select(*left_keys, "_lu", *right_keys, "_ru")
    parts = int(ru.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-size // max(broadcast_bytes, 1 << 20)))      # parts of at least 1 MB
    down = max(1, -(-parts // across))
    cells = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    probe = probe.withColumn("_d", F.pmod(F.xxhash64(*left_keys), F.lit(down))).withColumn("_a", cells(across))
    ru = ru.withColumn("_a", F.pmod(F.xxhash64(*right_keys), F.lit(across))).withColumn("_d", cells(down))
    return (probe.join(ru, ["_rm", "_a", "_d"]).where(F.abs(F.col("_ra") - F.col("_la")) < near)
            .select(*left_keys, "_lu", *right_keys, "_ru"))


def _chunk_of_cells(cells: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """First chunk and number of chunks of every cell (of so many rows): cells in order fill
    a chunk of ``most`` rows, a larger one is dealt to several of its own."""
    place, n, room = {}, 0, 0
    for c in sorted(cells):
        parts = -(-cells[c] // most)
        if parts > 1 or cells[c] > room:
            n, room = n + parts, 0 if parts > 1 else most
        place[c] = (n - parts, parts)
        room -= cells[c] if parts == 1 else 0
    return place


def _pairs_above(u: np.ndarray, v: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of ``u``, row of ``v``, dot product), some at a time, of the pairs above the threshold."""
    least = threshold - 1e-12 * (u.shape[1] + 1)    # room for the rounding of a product of unit vectors
    some = max(1, min(SLICE, PRODUCTS // max(len(v), 1)))
    for lo in range(0, len(u), some):
        near = np.flatnonzero(~(u[lo:lo + some] @ v.T < least))
        for at in range(0, len(near), PAIRS_AT_ONCE):
            i, j = np.divmod(near[at:at + PAIRS_AT_ONCE], len(v))
            exact = np.zeros(len(i))
            for k in range(u.shape[1]):
                exact += u[lo + i, k] * v[j, k]
            kept = ~(exact <= threshold)
            yield lo + i[kept], j[kept], exact[kept]


def _dense_sizes(n: int, n_left: int, width: int) -> tuple[int, int]:
    """(rows of a chunk, left parts) for so many right and left rows.  A left row is sent to every
    chunk that it reaches and a chunk to every part, so both are as large as a task can hold."""
    chunk = max(1, min(CHUNK_BYTES // (8 * width), max(CHUNK_ROWS, n // 16)))
    return chunk, max(1, -(-n_left // max(1, min(PART_BYTES // (8 * width), max(CHUNK_ROWS, n_left // 8)))))


def dense_join(lu: DataFrame, ru: DataFrame, left_keys: list[str], right_keys: list[str], n: int, width: int,
               threshold: float, out: str) -> DataFrame:
    """Keys and cosine of the pairs above the threshold: parts of the left rows and chunks of the
    right side (unit vectors ``_lu`` and ``_ru``) as matrices.  A left row goes to the chunks
    with a cell that it reaches."""
    lu = spread(materialise(lu.select(*left_keys, "_lu"), "cosine-left"))
    probe, ru = _celled(lu, spread(ru), left_keys, n, math.acos(min(1.0, threshold)) + ANGLE_EPS, each=False)
    ru = materialise(ru, "cosine-cells")
    chunk, parts = _dense_sizes(n, lu.count(), width)
    place = _chunk_of_cells({r["_rm"]: r["n"] for r in ru.groupBy("_rm").agg(F.count(F.lit(1)).alias("n")).collect()}, chunk)
    row = lu.sparkSession.createDataFrame([(place,)], "p map<int,struct<at:int,k:int>>")
    at = row.select("p").scalar()
    asked = F.array_distinct(F.flatten(F.transform("_rms", lambda c: F.sequence(
        F.col("_p")[c]["at"], F.col("_p")[c]["at"] + F.col("_p")[c]["k"] - 1))))
    none = lambda df, keys: [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
    left = probe.withColumn("_p", at).select(
        F.explode(asked).alias("_g"), F.pmod(F.xxhash64(*left_keys, "_lu"), F.lit(parts)).cast("int").alias("_q"),
        F.lit(True).alias("_left"), *left_keys, *none(ru, right_keys), F.col("_lu").alias("_v"))
    right = ru.withColumn("_p", at).select(
        (F.col("_p")[F.col("_rm")]["at"] + F.pmod(F.xxhash64(*right_keys, "_ru"), F.col("_p")[F.col("_rm")]["k"])).cast("int").alias("_g"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_q"),
        F.lit(False).alias("_left"), *none(lu, left_keys), *right_keys, F.col("_ru").alias("_v"))
    schema = T.StructType([*[lu.schema[k] for k in left_keys], *[ru.schema[k] for k in right_keys],
                           T.StructField(out, T.DoubleType())])
    names = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        a, b = rows.filter(rows.column("_left")), rows.filter(pc.invert(rows.column("_left")))
        if not a.num_rows or not b.num_rows:
            return
        wide = max(width, 1)
        u, v = matrix(a.column("_v"), wide), matrix(b.column("_v"), wide)
        a, b, rows = a.select(left_keys), b.select(right_keys), None        # the vectors are held once
        for i, j, sim in _pairs_above(u, v, threshold):
            columns = [a.column(k).take(pa.array(i)).combine_chunks() for k in left_keys]
            columns += [b.column(k).take(pa.array(j)).combine_chunks() for k in right_keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sim)], names)

    return left.unionByName(right).groupBy("_g", "_q").applyInArrow(score, schema)


def cosine_candidates(lu: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                      right_vec: str, broadcast_bytes: int, threshold: float = 0.0) -> DataFrame:
    """(left keys, _lu, right keys, _ru): every pair that can exceed ``threshold``, each once
    (sparse sides: a right vector non-zero on a prefix dimension, up to folding; dense
    sides: angles to a pivot that allow it)."""
    ru, n, width, masks = _right_side(right, right_keys, right_vec)
    return _cosine_candidates(lu, ru, left_keys, right_keys, broadcast_bytes, threshold, n, width, masks)


def _cosine_candidates(lu: DataFrame, ru: DataFrame, left_keys: list[str], right_keys: list[str],
                       broadcast_bytes: int, threshold: float, n: int, width: int, masks: int) -> DataFrame:
    near = math.acos(min(1.0, threshold)) + ANGLE_EPS
    if masks == 1 and n >= DENSE_ROWS:
        probe, ru = _celled(lu, ru, left_keys, n, near)
    else:
        probe, ru = _masked(lu, ru, left_keys, MASK_BITS if masks <= MAX_MASKS // 2 else FEW_BITS)
    return _candidates(probe, ru, left_keys, right_keys, broadcast_bytes, n, width, near)


def cosine_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                left_vec: str, right_vec: str, threshold: float, out: str = "sim",
                broadcast_bytes: int | None = None,
                prepared_left: DataFrame | None = None) -> DataFrame:
    """All pairs with cosine(left_vec, right_vec) > threshold (exact).

    Returns ``left_keys + right_keys + [out]``.  Zero vectors never match.
    Key names of the two sides must be distinct.  ``right`` is the side that is
    broadcast if it fits ``broadcast_bytes`` (new articles)."""
    limit = BROADCAST_INDEX_BYTES if broadcast_bytes is None else broadcast_bytes
    lu = prepared_left if prepared_left is not None else prepare_left(
        left, left_keys, left_vec, threshold)
    ru, n, width, masks = _right_side(right, right_keys, right_vec)
    if masks == 1 and n >= max(CHUNK_ROWS, DENSE_ROWS):
        return dense_join(lu, ru, left_keys, right_keys, n, width, threshold, out)
    j = _cosine_candidates(lu, ru, left_keys, right_keys, limit, threshold, n, width, masks)
    return (j.select(*left_keys, *right_keys, dot("_lu", "_ru").alias(out))
            .where(F.col(out) > F.lit(threshold)))


def cosine_of_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame,
                    left_keys: list[str], right_keys: list[str],
                    left_vec: str, right_vec: str, out: str = "sim") -> DataFrame:
    """Exact cosine for given (left, right) key pairs (0.0 for zero vectors)."""
    lu = with_unit(left.select(*left_keys, left_vec), left_vec, "_lu").drop(left_vec)
    ru = with_unit(right.select(*right_keys, right_vec), right_vec, "_ru").drop(right_vec)
    j = pairs.join(lu, left_keys, "left").join(ru, right_keys, "left")
    sim = F.when(F.col("_lu").isNotNull() & F.col("_ru").isNotNull(),
                 dot("_lu", "_ru")).otherwise(F.lit(0.0))
    return j.select(*pairs.columns, sim.alias(out))


def _term_sets(df: DataFrame, keys: list[str], term: str, size: str) -> DataFrame:
    rows = df.select(*keys, term).where(F.col(term).isNotNull()).distinct()
    return rows.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def jaccard_candidates(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                       term: str, min_sim: float, salt_buckets: int) -> DataFrame:
    """(left keys, right keys): every pair that can have Jaccard >= ``min_sim`` > 0.

    Terms are put in one order, rare ones first.  Of n terms a side indexes the first
    ``n - ceil(min_sim * n) + 1`` (its prefix): two sets that share none of these share too
    few of the rest.  The shared term's places in the two prefixes and the sets' sizes bound
    the overlap that is still possible.  Frequent terms stay out of most prefixes, so the
    index has no hot keys but those of sets made of frequent terms alone."""
    lset, rset = _term_sets(left, left_keys, term, "_nl"), _term_sets(right, right_keys, term, "_nr")
    df = lset.select(term).unionAll(rset.select(term)).groupBy(term).agg(F.count(F.lit(1)).alias("_df"))

    def prefix(rows: DataFrame, keys: list[str], size: str, place: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("_df", term)
        ranked = rows.join(df, term).withColumn(place, F.row_number().over(w)).drop("_df")
        return ranked.where(F.col(place) <= F.col(size) - F.ceil(F.col(size) * min_sim - _EPS) + 1)

    probe = prefix(lset, left_keys, "_nl", "_pl").withColumn("_salt", _salt(left_keys, salt_buckets))
    index = prefix(rset, right_keys, "_nr", "_pr").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    need = F.ceil((F.col("_nl") + F.col("_nr")) * (min_sim / (1 + min_sim)) - _EPS)     # terms to share
    # this term, at most those behind it on the shorter side, and those before it in both
    most = F.least("_pl", "_pr") + F.least(F.col("_nl") - F.col("_pl"), F.col("_nr") - F.col("_pr"))
    return probe.join(index, [term, "_salt"]).where(most >= need).select(*left_keys, *right_keys).distinct()


def jaccard_of_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, left_keys: list[str],
                     right_keys: list[str], term: str = "term", out: str = "sim") -> DataFrame:
    """(keys, shared, out) of the given distinct pairs that share a term."""
    lset, rset = _term_sets(left, left_keys, term, "_nl"), _term_sets(right, right_keys, term, "_nr")
    keys = left_keys + right_keys
    both = (pairs.select(*keys).join(lset, left_keys).join(rset, [*right_keys, term])
            .groupBy(*keys, "_nl", "_nr").agg(F.count(F.lit(1)).alias("shared")))
    return both.select(*keys, "shared", (F.col("shared") / (F.col("_nl") + F.col("_nr") - F.col("shared"))).alias(out))


def jaccard_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str],
                 term: str = "term", salt_buckets: int = 8, out: str = "sim", min_sim: float = 0.0) -> DataFrame:
    """Pairs sharing at least one term, with the Jaccard similarity of their
    term sets; with ``min_sim``, those that reach it (found through prefixes, see
    ``jaccard_candidates``).  Returns ``left_keys + right_keys + [shared, out]``."""
    lset, rset = _term_sets(left, left_keys, term, "_nl"), _term_sets(right, right_keys, term, "_nr")
    sim = F.col("shared") / (F.col("_nl") + F.col("_nr") - F.col("shared"))
    keys = left_keys + right_keys
    if min_sim > 0:
        few = jaccard_candidates(left, right, left_keys, right_keys, term, min_sim, salt_buckets)
        return jaccard_of_pairs(few, left, right, left_keys, right_keys, term, out).where(
            F.col(out) >= min_sim - _EPS)
    probe = lset.withColumn("_salt", _salt(left_keys, salt_buckets))
    index = rset.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
    pairs = (probe.join(index, [term, "_salt"])
             .groupBy(*keys, "_nl", "_nr").agg(F.count(F.lit(1)).alias("shared")))
    return pairs.select(*keys, "shared", sim.alias(out))


def hybrid_join(left_vecs: DataFrame, right_vecs: DataFrame,
                left_terms: DataFrame, right_terms: DataFrame,
                left_keys: list[str], right_keys: list[str],
                left_vec: str, right_vec: str, threshold: float,
                sigma: float, beta: float, term: str = "term",
                salt_buckets: int = 8, checkpoint_pairs: bool = False,
                keyword_floor: float = 0.0) -> DataFrame:
    """Pairs whose combined score ``(simT*sigma + simK*beta)/sqrt(sigma^2+beta^2)``
    exceeds ``threshold`` (exact, threshold >= 0).

    No cosine exceeds 1, so a pair needs ``simK >= (threshold*norm - sigma) / beta`` (norm is
    the square root above).  The floor is this bound or ``keyword_floor``, whichever is larger:

    - Pairs with simK at or above the floor come from the keyword index (through prefixes of
      rare terms if the floor is positive, else every pair sharing a keyword) and get their
      exact cosine.
    - Pairs below it need ``simT > (threshold*norm - floor*beta) / sigma``: those come from the
      cosine index at that threshold and get their exact simK.

    A positive ``keyword_floor`` keeps pairs that only share frequent keywords out of the
    index, at the price of a lower cosine threshold; it changes the plan, not the result.
    Returns keys + sim_t, sim_k, score.
    """
    norm = (sigma * sigma + beta * beta) ** 0.5
    floor = max((threshold * norm - sigma) / beta, keyword_floor, 0.0) if beta > 0 else 0.0
    # slightly lower bound so float rounding cannot drop a qualifying pair
    t_topic = max((threshold * norm - floor * beta) / sigma - 1e-12, 0.0) if sigma > 0 else float("inf")
    if sigma == 0:          # the cosine does not count: pairs below the bound have no other way
        floor = threshold
    kw = jaccard_join(left_terms, right_terms, left_keys, right_keys, term,
                      salt_buckets, out="sim_k", min_sim=floor).drop("shared")
    if checkpoint_pairs:
        # the keyword pairs are used three times below; a job whose term
        # sets are expensive to derive writes them once (reliable checkpoint)
        from tastemap.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(kw.sparkSession)
        kw = kw.checkpoint(eager=True)
    keys = left_keys + right_keys
    # Exact cosine of every keyword pair by vector lookup.  The profile
    # vectors are first semi-joined with the keys that occur in keyword pairs
    # (Spark broadcasts those keys when few), so the lookup never shuffles the
    # whole profile table; the reduced vectors are then small to join.
    lu = (with_unit(left_vecs.select(*left_keys, left_vec), left_vec, "_lu").drop(left_vec)
          .join(kw.select(*left_keys).distinct(), left_keys, "left_semi"))
    ru = (with_unit(right_vecs.select(*right_keys, right_vec), right_vec, "_ru").drop(right_vec)
          .join(kw.select(*right_keys).distinct(), right_keys, "left_semi"))
    computed = F.when(F.col("_lu").isNotNull() & F.col("_ru").isNotNull(),
                      dot("_lu", "_ru")).otherwise(F.lit(0.0))
    kwt = (kw.join(lu, left_keys, "left").join(ru, right_keys, "left")
           .select(*keys, "sim_k", computed.alias("_kt")))
    if t_topic >= 1.0:      # no cosine alone suffices
        allp = kwt.select(*keys, F.col("_kt").alias("sim_t"), "sim_k")
    else:
        tp = cosine_join(left_vecs, right_vecs, left_keys, right_keys, left_vec, right_vec,
                         t_topic, out="_tt")
        if floor > 0:
            tp = materialise(tp.join(kw.select(*keys), keys, "left_anti"), "hybrid-topic-pairs")
            low = jaccard_of_pairs(tp, left_terms, right_terms, left_keys, right_keys, term, "sim_k")
            allp = kwt.select(*keys, F.col("_kt").alias("sim_t"), "sim_k").unionByName(
                tp.join(low.drop("shared"), keys, "left").select(
                    *keys, F.col("_tt").alias("sim_t"), F.coalesce("sim_k", F.lit(0.0)).alias("sim_k")))
        else:
            allp = (tp.join(kwt, keys, "full_outer")
                    .select(*keys, F.coalesce("_kt", "_tt").alias("sim_t"),
                            F.coalesce("sim_k", F.lit(0.0)).alias("sim_k")))
    score = blend_score("sim_t", "sim_k", sigma, beta)
    return (allp.select(*keys, "sim_t", "sim_k", score.alias("score"))
            .where(F.col("score") > F.lit(threshold)))
