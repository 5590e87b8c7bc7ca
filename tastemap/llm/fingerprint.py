"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's units are its paragraphs (lines), cut at sentence ends and, where still
longer, every ``LONGEST`` code points; the 64-bit digests of the distinct units
are its set.  The sketch has three tables of ``SLOTS`` cells; each digest is added
to one cell of each table: a count, the xor of the digests and the xor of their
check hashes.  Equal sets have equal sketches, and sketches subtract cell by cell.

To compare two texts their sketches are subtracted: what they share cancels.  The
difference is peeled: a cell that holds a single digest (count +-1, check hash
right) gives it up, and the digest is taken out of its other cells, until all
cells are empty.  Then the differing digests are known exactly, and the likeness
is the Jaccard index of the two sets.  If peeling fails, the pair is retried
larger: the digest space is split in ``FAN``, so there are that many times as many
cells, each part a sketch of its own that peels alone; parts that fail are split
again, ``LEVELS`` times at most (beyond, the digests themselves are compared).

DataFrame operators only.  Each text moves once, to stand beside its successor:
documents are dealt into ranges of doc_id of about equal size, and a copy of the
first row of each range stands at the end of the range before it.

Defined results: a null text counts as empty; an empty text has an empty sketch,
and two empty sets are alike (1.0); a null doc_id comes first, repeated ones are
ordered by text; the only document of a table is its own next document; extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import last_start, let, stored

TABLES = 3
SLOTS = 8
CELLS = TABLES * SLOTS
LONGEST = 400
ROUNDS = 10
FAN = 8
LEVELS = 6


def digests(text: Column) -> Column:
    """Sorted distinct digests of a text's units."""
    lines = text
    for mark in ".!?":
        lines = F.replace(lines, F.lit(mark + " "), F.lit(mark + "\n"))
    units = F.filter(F.split(lines, "\n"), lambda u: F.char_length(u) > 0)
    parts = F.transform(units, lambda u: F.when(F.char_length(u) <= LONGEST, F.array(F.xxhash64(u))).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.char_length(u) - 1) / LONGEST).cast("int")),
                    lambda i: F.xxhash64(F.substring(u, i * LONGEST + 1, F.lit(LONGEST))))))
    return F.sort_array(F.array_distinct(F.flatten(parts)))


def _check(d: Column) -> Column:
    return F.hash(F.lit("check"), d)


def _slot(d: Column, table: int) -> Column:
    """The cell, numbered through all tables, that holds a digest in a table."""
    return F.pmod(F.shiftrightunsigned(d, 8 * table), F.lit(SLOTS)).cast("int") + table * SLOTS


def _mark(slot: int, table: int) -> int:
    """The bits of a digest that name this slot of a table, in place (``SLOTS`` is a power of two)."""
    return slot << 8 * table


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"))


def sketch(d: Column) -> Column:
    """The ``CELLS`` cells (n, key, check) of an array of digests."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0))

    def table(t: int) -> Column:
        bits = F.lit(_mark(SLOTS - 1, t)).cast("long")
        return F.transform(F.array(*[F.lit(_mark(i, t)).cast("long") for i in range(SLOTS)]), lambda m: F.aggregate(
            F.filter(d, lambda x: x.bitwiseAND(bits) == m), empty,
            lambda c, x: _cell(c["n"] + 1, c["key"].bitwiseXOR(x), c["check"].bitwiseXOR(_check(x)))))
    return F.concat(*[table(t) for t in range(TABLES)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(
        x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["check"].bitwiseXOR(y["check"])))


def peel(cells: Column) -> Column:
    """struct(cells, left, right, go): the digests of the first and of the second set only;
    the peeling worked when every cell is empty."""
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("left"), none.alias("right"), F.lit(True).alias("go"))
    single = lambda c: (F.abs(c["n"]) == 1) & (c["check"] == _check(c["key"]))
    # the cells of a digest, as bits: one in each table
    bit = lambda key, t: F.call_function("shiftleft", F.lit(1), _slot(key, t))
    at = lambda key: reduce(Column.bitwiseOR, [bit(key, t) for t in range(TABLES)])

    def remove(st: Column, pure: Column) -> Column:
        cell = lambda c, i: F.aggregate(pure, c, lambda acc, p: F.when(
            F.getbit(p["at"], i) == 1, _cell(acc["n"] - p["n"], acc["key"].bitwiseXOR(p["key"]),
                                                acc["check"].bitwiseXOR(p["check"]))).otherwise(acc))
        keys = lambda n: F.transform(F.filter(pure, lambda p: p["n"] == n), lambda p: p["key"])
        return F.struct(F.transform(st["cells"], cell).alias("cells"),
                        F.concat(st["left"], keys(1)).alias("left"),
                        F.concat(st["right"], keys(-1)).alias("right"), F.lit(True).alias("go"))

    def one_round(st: Column, _: Column) -> Column:
        pure = F.transform(F.array_distinct(F.filter(st["cells"], single)), lambda c: F.struct(
            c["n"].alias("n"), c["key"].alias("key"), c["check"].alias("check"), at(c["key"]).alias("at")))
        stop = F.struct(st["cells"].alias("cells"), st["left"].alias("left"), st["right"].alias("right"),
                        F.lit(False).alias("go"))
        return F.when(st["go"], let(pure, lambda p: F.when(F.size(p) > 0, remove(st, p)).otherwise(stop))).otherwise(st)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)


def _counts(left: Column, right: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"))


def _peeled(r: Column, a: Column, b: Column) -> Column:
    return F.forall(r["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0)) & (
        F.size(a) - F.size(r["left"]) == F.size(b) - F.size(r["right"]))


def _parts(a: Column, b: Column, level: Column) -> Column:
    """The ``FAN`` parts of two sets at a level: array<struct<a, b>>."""
    in_part = lambda x, q: F.call_function(
        "shiftrightunsigned", x, 64 - 3 * level).bitwiseAND(F.lit(FAN - 1).cast("long")) == q
    return F.transform(F.array(*[F.lit(q).cast("long") for q in range(FAN)]), lambda q: F.struct(
        F.filter(a, lambda x: in_part(x, q)).alias("a"), F.filter(b, lambda x: in_part(x, q)).alias("b")))


def difference(a: Column, b: Column, cells: Column) -> Column:
    """struct(left, right): how many digests only ``a`` and only ``b`` has; ``cells`` is the
    difference of their sketches."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda n, x: n + f(x))

    def retry(st: Column, level: Column) -> Column:
        tried = F.transform(st["open"], lambda p: let(
            peel(subtract(sketch(p["a"]), sketch(p["b"]))), lambda r: F.struct(
                p["a"].alias("a"), p["b"].alias("b"), _peeled(r, p["a"], p["b"]).alias("ok"),
                F.size(r["left"]).alias("left"), F.size(r["right"]).alias("right"))))
        return F.when(F.size(st["open"]) > 0, let(tried, lambda ts: F.struct(
            F.flatten(F.transform(F.filter(ts, lambda t: ~t["ok"]), lambda t: _parts(
                t["a"], t["b"], level + 1))).alias("open"),
            (st["left"] + total(ts, lambda t: F.when(t["ok"], t["left"]).otherwise(0))).alias("left"),
            (st["right"] + total(ts, lambda t: F.when(t["ok"], t["right"]).otherwise(0))).alias("right")))
        ).otherwise(st)

    start = F.struct(_parts(a, b, F.lit(1)).alias("open"), F.lit(0).alias("left"), F.lit(0).alias("right"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, retry)
    larger = let(done, lambda st: _counts(
        st["left"] + total(st["open"], lambda p: F.size(F.array_except(p["a"], p["b"]))),
        st["right"] + total(st["open"], lambda p: F.size(F.array_except(p["b"], p["a"])))))
    return let(peel(cells), lambda r: F.when(
        _peeled(r, a, b), _counts(F.size(r["left"]), F.size(r["right"]))).otherwise(larger))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two prints (struct of digests ``d`` and sketch ``cells``)."""
    diff = difference(a["d"], b["d"], subtract(a["cells"], b["cells"]))
    return let(diff, lambda x: F.when(F.size(b["d"]) + x["left"] == 0, 1.0).otherwise(
        (F.size(a["d"]) - x["left"]) / (F.size(b["d"]) + x["left"])))


def fingerprint_of(text: Column) -> Column:
    """struct(d, cells) of a text."""
    return let(digests(text), lambda d: F.struct(d.alias("d"), sketch(d).alias("cells")))


def encoded(cells: Column) -> Column:
    """The sketch as text: count-key-check of each cell, keys and checks in hex."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(
        "-", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["check"].cast("long")))), ".")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``next``: a struct of ``columns`` of the following
    document by doc_id (after the last: the first)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    low = F.lit(-(1 << 63)).cast("long")
    starts = stored(docs.agg(F.concat(F.array(low), F.percentile_approx("doc_id", at, 20 * n)).alias("starts")),
                    "doc-ranges")

    def ranged(df: DataFrame) -> DataFrame:
        return last_start(df, F.coalesce("doc_id", low), starts.select("starts").scalar(), max(n, 2), "range")

    # at most n rows: the first id of each range, which follows the last id of the range before
    firsts = ranged(docs.select("doc_id")).groupBy("range").agg(F.min(F.coalesce("doc_id", low)).alias("first_id"))
    by_range = Window.orderBy("range")
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = stored(firsts.select("first_id", F.coalesce(
        F.lag("range").over(by_range), F.last("range").over(everything)).alias("_range")), "range-heads")

    own = ranged(docs).withColumn("extra", F.lit(0))
    copies = docs.join(F.broadcast(heads), F.coalesce(docs["doc_id"], low) == heads["first_id"]).select(
        *[docs[c] for c in docs.columns], F.col("_range").alias("range"), F.lit(1).alias("extra"))
    # a number for each range whose hash is the range's own partition: no two ranges share a task
    tries = spark.range(32 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("part"))
    found = tries.groupBy("part").agg(F.min("id").alias("id"))
    by_part = F.array_sort(F.collect_list(F.struct("part", "id")))
    places = stored(found.agg(F.transform(by_part, lambda x: x["id"]).alias("places")), "range-places")
    both = own.unionByName(copies).withColumn("_places", places.select("places").scalar())
    both = both.withColumn("_place", F.when(F.size("_places") == n, F.get("_places", F.col("range"))).otherwise(
        F.col("range").cast("long")))
    w = Window.partitionBy("_place").orderBy("extra", "doc_id", "text")
    both = both.drop("_places").withColumn("next", F.lead(F.struct(*columns)).over(w))
    return both.where("extra = 0").drop("extra", "range", "_place")


def edited_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, print, edited, edited_print, next_print): each document and its edit,
    whose last half is the beginning of the next document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = with_next(rows.withColumn("print", fingerprint_of(F.col("text"))), ["text", "print"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next.text", half))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), "print", F.col("next.print").alias("next_print"),
                       let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha256"),
                                                      fingerprint_of(e).alias("print"))).alias("edit"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edit, and their likenesses."""
    rows = edited_documents(docs)
    return rows.select(
        "doc_id", "n_chars", F.col("edit.sha256").alias("edited_sha256"),
        encoded(F.col("print.cells")).alias("fingerprint"),
        encoded(F.col("edit.print.cells")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edit.print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))
