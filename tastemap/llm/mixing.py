"""Mixing sources to target weights in fixed-length blocks (DataFrame operators only).

1. Sizes are words.  A source's target is its weight's part of ``factor`` times all
   words, at most ``cap`` times its size; the excess is shared again by weight
   (water-filling over one row per source).
2. A source's documents, laid end to end, are cut into blocks of ``block`` words.
   Only positions are computed (two-level running sums), texts do not move.
3. The mix has one slot per block to take, in output shards of ``SHARD`` slots.
   Each slot of a shard draws its source, so a shard's source counts are
   multinomial; running sums of the counts number the slots of each source.  The
   draws' totals miss the targets by chance; the slots that a source has too many
   are handed, in order, to the sources that have too few.
4. Slot ``j`` of a source takes, in pass ``j / blocks``, the block at the image of
   ``j % blocks`` under a pseudorandom permutation of that source and pass
   (swap-or-not rounds: a bijection on any length).  A pass takes no block twice,
   and there are at most ``cap`` passes, so no document exceeds ``cap`` copies.
5. Slots and document pieces are joined by (source, block index).

Everything is a function of the rows and ``seed``; reruns agree.

Defined results: a null or empty text has size 0 and nothing is taken from it; null
is a source of its own, ordered last; repeated rows are separate documents with
equal shares in expectation; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, last_start, let, stored

BLOCK = 64
SHARD = 1024
WEIGHTS = (5.0, 2.0, 1.0)
FACTOR = 1.5
CAP = 2.0
ROUNDS = 10
GROUP = 1024           # shards summed together before their running total
SLOTS_PER_TASK = 100_000
DOC_GROUP = 512        # documents of all sources in a group, on average


def document_sizes(docs: DataFrame) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, factor: float = FACTOR,
                   cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """(s, source, source_size, target, n_blocks, slots): one row per source, numbered in
    code-point order (null last).  Its windows see one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select((s).alias("s"), "source", "source_size")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("s", F.lit(len(weights))))
    per = per.select("*", weight.alias("w"), (cap * F.col("source_size")).alias("most"))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), "s")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # the level that a source and all with a larger cap per weight would share
    level = (factor * F.sum("source_size").over(everything)
             - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.select("*", level.alias("level"))
    ratio = F.col("most") / F.col("w")
    # the first source, by ratio, that the level leaves below its cap sets the level for all
    first = F.min(F.when(F.col("level") <= ratio, F.struct(ratio.alias("r"), "s", "level"))).over(everything)
    per = per.select("*", first["level"].alias("water"))
    target = F.least("most", F.col("w") * F.coalesce("water", F.lit(0.0)))
    n_blocks = F.ceil(F.col("source_size") / block)
    per = per.select("s", "source", "source_size", target.alias("target"), n_blocks.alias("n_blocks"))
    part = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    slots = F.least(F.floor(cap * F.col("n_blocks")), F.round(part * F.col("n_blocks")).cast("long"))
    return stored(per.select("*", slots.alias("slots")), "mix-sources")


def _arrays(rows: DataFrame, **cols: Column) -> DataFrame:
    """One row with an array per column, in the order of ``s`` (one entry a source)."""
    named = F.struct("s", *[c.alias(k) for k, c in cols.items()])
    one = rows.agg(F.array_sort(F.collect_list(named)).alias("a"))
    return stored(one.select(*[F.col(f"a.{k}").alias(k) for k in cols]), "mix-arrays")


def _exclusive(value: Column) -> Column:
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


def running_total(df: DataFrame, part: str, group: Column, order: list[str], value: str,
                  out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``part``, by (group, order): inside
    each group, plus the sums of the earlier groups.  No task sees a whole part."""
    g = df.withColumn("_g", group)
    sums = g.groupBy(part, "_g").agg(F.sum(value).alias("_n"))
    earlier = Window.partitionBy(part).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(part, "_g", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(part, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return g.join(base, [part, "_g"]).withColumn(out, (F.col("_in") + F.col("_base")).cast("long")).drop(
        "_g", "_in", "_base")


def permuted(df: DataFrame, index: str, length: str, key: list[str], seed: int, out: str) -> DataFrame:
    """``out``: the image of ``index`` under a permutation of ``0 .. length`` for each key."""
    df = df.withColumn(out, F.col(index))
    for r in range(ROUNDS):
        k = F.pmod(F.xxhash64(F.lit(seed), F.lit(2 * r), *key), F.col(length))
        df = df.withColumn("_p", F.pmod(k - F.col(out), F.col(length)))
        coin = F.xxhash64(F.lit(seed), F.lit(2 * r + 1), *key, F.greatest(out, "_p"))
        df = df.withColumn(out, F.when(F.pmod(coin, F.lit(2)) == 1, F.col("_p")).otherwise(F.col(out)))
    return df.drop("_p")


def slots(sources: DataFrame, seed: int = 7) -> DataFrame:
    """(shard, s, pass, block): which block each slot of the mix takes."""
    spark = sources.sparkSession
    head = sources.agg(F.sum("slots").alias("slots"), F.count(F.lit(1)).alias("n")).first()
    total, n = int(head["slots"] or 0), int(head["n"])
    a = _arrays(sources.withColumn("start", _exclusive(F.col("slots"))),
                start=F.col("start"), n_blocks=F.col("n_blocks"), slots=F.col("slots"))
    drawn = spark.range(total).select(F.floor(F.col("id") / SHARD).alias("shard"),
                                      F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("u"))
    drawn = last_start(drawn, F.col("u"), a.select("start").scalar(), n, "s")
    counts = stored(drawn.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n")), "mix-draws")
    numbered = running_total(counts, "s", F.floor(F.col("shard") / GROUP), ["shard"], "n", "first")

    over = sources.join(counts.groupBy("s").agg(F.sum("n").alias("drawn")), "s", "left").select(
        "s", "slots", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    over = over.select("*", F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)).alias("many"),
                       F.greatest(F.col("slots") - F.col("drawn"), F.lit(0)).alias("few"))
    fix = _arrays(over.select("*", _exclusive(F.col("many")).alias("many_at"),
                              _exclusive(F.col("few")).alias("few_at")),
                  many_at=F.col("many_at"), few_at=F.col("few_at"), drawn=F.col("drawn"))
    pick = lambda f, c, i: F.get(f.select(c).scalar(), i)

    # few rows that become many: dealt out by shard before they do
    tasks = max(1, math.ceil(total / SLOTS_PER_TASK))
    each = numbered.repartition(tasks, "shard").select("shard", "s", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("j"))
    # the place of a slot among all that their sources have too many (negative: it stays)
    extra = F.col("j") - pick(a, "slots", F.col("s"))
    each = each.withColumn("extra", F.when(extra >= 0, extra + pick(fix, "many_at", F.col("s"))).otherwise(-1))
    each = last_start(each, F.col("extra"), fix.select("few_at").scalar(), n, "t")
    moved = F.col("extra") >= 0
    each = each.select(
        "shard", F.when(moved, F.col("t")).otherwise(F.col("s")).alias("s"),
        F.when(moved, pick(fix, "drawn", F.col("t")) + F.col("extra") - pick(fix, "few_at", F.col("t")))
        .otherwise(F.col("j")).alias("j"))
    each = each.withColumn("n_blocks", pick(a, "n_blocks", F.col("s")))
    each = each.select("shard", "s", "n_blocks", F.floor(F.col("j") / F.col("n_blocks")).alias("pass"),
                       F.pmod("j", "n_blocks").alias("i"))
    return permuted(each, "i", "n_blocks", ["s", "pass"], seed, "block").select("shard", "s", "pass", "block")


def document_pieces(sizes: DataFrame, sources: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents with s and their place ``a``; one row per document and block it overlaps)."""
    docs = sizes.join(sources.select(F.col("source").alias("_source"), "s", "source_size", "target"),
                      F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    groups = max(1, math.ceil(sizes.count() / DOC_GROUP))
    docs = stored(running_total(docs, "s", F.pmod(F.xxhash64("doc_id"), F.lit(groups)),
                                ["doc_id", "size"], "size", "a"), "mix-documents")
    blocks = F.sequence(F.floor(F.col("a") / block), F.floor((F.col("a") + F.col("size") - 1) / block))
    pieces = docs.where("size > 0").select("doc_id", "s", "a", "size", F.explode(blocks).alias("block"))
    lo = F.greatest("a", F.col("block") * block)
    hi = F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * block)
    return docs, pieces.select("doc_id", "s", "a", "size", "block", (lo - F.col("a")).alias("first"),
                               (hi - lo).alias("words"))


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents, taken pieces).  Documents: doc_id, source, size, s, source_size, target,
    a.  Pieces: doc_id, s, a, size, first, words, shard, pass; one row for each time that a
    slot takes words ``first .. first + words`` of a document."""
    sizes = stored(document_sizes(docs), "mix-sizes")
    sources = source_targets(sizes, block=block)
    docs, pieces = document_pieces(sizes, sources, block)
    # stored: the join's null filters must not be rewritten through the permutation's rounds
    return docs, pieces.join(stored(slots(sources, seed), "mix-slots"), ["s", "block"])


def taken_words(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document."""
    docs, pieces = mix(docs, seed)
    key = ["doc_id", "s", "a", "size"]
    got = pieces.groupBy(*key).agg(F.sum("words").alias("taken"))
    got = got.select(*[F.col(k).alias("_" + k) for k in key], "taken")
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in key]
    out = docs.join(got, same[0] & same[1] & same[2] & same[3], "left")
    return out.select("doc_id", "size", "source_size", "target",
                      F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The documents that the mix takes words of, with the text that it takes and its n_chars.

    A pass that takes a whole document gives its text as it is; one that takes some blocks
    gives their words, joined by spaces; passes follow each other on new lines."""
    same = Window.partitionBy("doc_id", "source", "size")
    placed, pieces = mix(docs, seed)
    key = ["doc_id", "s", "a", "size"]
    got = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pass", "first", "words"))).alias("_spans"))
    got = placed.select(*key, "source").join(got.select(*[F.col(k).alias("_" + k) for k in key], "_spans"), [
        F.col("doc_id").eqNullSafe(F.col("_doc_id")), F.col("s") == F.col("_s"), F.col("a") == F.col("_a")])
    # repeated rows are told apart by their order
    got = got.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
                     "_spans", F.row_number().over(same.orderBy("a")).alias("_row"))
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("doc"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    rows = rows.withColumn("row", F.row_number().over(
        Window.partitionBy("doc.doc_id", "doc.source", "size").orderBy("doc.text")))
    j = rows.join(got, F.col("doc.doc_id").eqNullSafe(F.col("_id")) & F.col("doc.source").eqNullSafe(F.col("_source"))
                  & (F.col("size") == F.col("_size")) & (F.col("row") == F.col("_row")))
    text = F.coalesce("doc.text", F.lit(""))

    def one_pass(spans: Column, words: Column) -> Column:
        n = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["words"])
        cut = F.flatten(F.transform(spans, lambda x: F.slice(
            words, (x["first"] + 1).cast("int"), x["words"].cast("int"))))
        return F.when(n == F.col("size"), text).otherwise(F.array_join(cut, " "))

    passes = F.array_distinct(F.transform("_spans", lambda x: x["pass"]))
    taken = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda words: F.array_join(F.transform(
        passes, lambda p: one_pass(F.filter("_spans", lambda x: x["pass"] == p), words)), "\n"))
    out = j.select("doc", taken.alias("taken"))
    new = {"text": F.col("taken"), "n_chars": F.char_length("taken").cast("long")}
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
