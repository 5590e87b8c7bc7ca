"""Collaborative filtering: implicit ratings, id dictionaries, ALS.

Ratings are the sum of behaviour weights per (user, article).  ALS needs
32-bit integer ids; instead of string hash codes (which collide) ids come
from dictionaries: numeric ids that fit in an int are used as they are,
anything else gets a dense index computed in the JVM (no collect, no
Python function).  The dictionaries are saved together with the model.
"""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemap.config import DEFAULT_PARAMS, Params
from tastemap.operators.mips import top_items
from tastemap.sources.delta_store import DeltaStore, Table

INT_MAX = 2**31 - 1


def ratings(log: DataFrame, user: str = "user_id", item: str = "doc_id") -> DataFrame:
    """(user, item, rating) = sum of behaviour weights (map-side combined)."""
    return log.groupBy(user, item).agg(F.sum("weight").alias("rating"))


def item_dictionary(parsed_log: DataFrame) -> DataFrame:
    """Last-seen news id per row key: (rowkey, doc_id, last_ts).  'Last' is the
    latest event, ties by the larger id, so the result does not depend on
    file order."""
    return (parsed_log.groupBy("rowkey")
            .agg(F.max_by("doc_id", F.struct("ts", "doc_id")).alias("doc_id"),
                 F.max("ts").alias("last_ts")))


def index_dictionary(values: DataFrame, col: str, idx: str) -> DataFrame:
    """(col, idx int) dense dictionary 0..n-1 of the distinct values of ``col``,
    computed in the JVM: the distinct values are checkpointed (stable on
    recomputation), then idx = rows in earlier partitions + position within
    the partition.  Only one row per partition goes through the running sum."""
    from pyspark.sql import Window
    from tastemap.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(values.sparkSession)
    distinct = values.select(col).distinct().checkpoint(eager=True)
    tagged = distinct.select(col, F.spark_partition_id().alias("_p"),
                             F.monotonically_increasing_id().alias("_m"))
    # monotonically_increasing_id = (partition << 33) + position in partition
    tagged = tagged.withColumn("_pos", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33))
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_o"))
    d = tagged.join(F.broadcast(offsets), "_p")  # one row per partition
    out = d.select(col, (F.col("_o") + F.col("_pos")).alias("_i"))
    n = out.agg(F.max("_i")).first()[0]
    if n is not None and n > INT_MAX:
        raise ValueError(f"{col}: more than 2^31-1 distinct values")
    return out.select(col, F.col("_i").cast("int").alias(idx))


class IdDictionary:
    """A stored, append-only dictionary id -> dense index: an id keeps its index over all
    later runs, new ids get the next ones.

    Kept as a base-and-delta table: a run writes only its new ids.  Two runs at once both
    read the same next index, but only one can commit it; the other starts again from the
    extended dictionary (``DeltaStore.transact``), so a range is never given out twice."""

    def __init__(self, spark: SparkSession, path: str, col: str, idx: str):
        self.spark, self.col, self.idx = spark, col, idx
        self.store = DeltaStore(spark, f"{path}/{col}", {"ids": Table(f"{path}/{col}/ids", [col])})

    def read(self) -> DataFrame | None:
        return self.store.read("ids")

    def extend(self, values: DataFrame) -> DataFrame:
        """The dictionary with every id of ``values``."""
        values = values.where(F.col(self.col).isNotNull()).select(self.col).distinct()

        def change(at):
            have = self.store.read("ids", at)
            if have is None:
                return {"ids": index_dictionary(values, self.col, self.idx)}
            new = index_dictionary(values.join(have.select(self.col), self.col, "left_anti"), self.col, self.idx)
            start = (have.agg(F.max(self.idx)).first()[0] + 1) if not have.isEmpty() else 0
            n = new.count()
            if start + n - 1 > INT_MAX:
                raise ValueError(f"{self.col}: more than 2^31-1 distinct values")
            return {"ids": new.withColumn(self.idx, (F.col(self.idx) + start).cast("int"))} if n else {}
        self.store.transact(change)
        return self.read()


def _integral(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.IntegerType, T.LongType, T.ShortType))


def fits_int(r: DataFrame, cols: list[str]) -> dict[str, bool]:
    """Which columns are integers that ALS takes as they are (one aggregate job)."""
    whole = [c for c in cols if _integral(r, c)]
    out = dict.fromkeys(cols, False)
    if whole:
        row = r.agg(*[F.min(c).alias(f"lo_{c}") for c in whole],
                    *[F.max(c).alias(f"hi_{c}") for c in whole]).first()
        for c in whole:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            out[c] = lo is None or (lo >= 0 and hi <= INT_MAX)
    return out


def dictionaries(r: DataFrame, user: str = "user_id", item: str = "doc_id"):
    """(user_dict, item_dict); identity casts when ids already fit an int."""
    fits = fits_int(r, [user, item])
    out = []
    for col, idx in ((user, "user_idx"), (item, "item_idx")):
        if fits[col]:
            out.append(r.select(col).distinct().select(col, F.col(col).cast("int").alias(idx)))
        else:
            out.append(index_dictionary(r, col, idx))
    return tuple(out)


class CFModel:
    """ALS model plus what maps its ids back: a dictionary of users and items whose
    ids are not integers themselves (None for those that are), and the published
    article id of each item key (None when the key is the id)."""

    def __init__(self, model: ALSModel, users: DataFrame | None, items: DataFrame | None,
                 articles: DataFrame | None = None, user: str = "user_id", item: str = "doc_id",
                 user_type: str = "bigint", item_type: str = "bigint"):
        self.model, self.users, self.items, self.articles = model, users, items, articles
        self.user, self.item, self.user_type, self.item_type = user, item, user_type, item_type

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/als")
        tables = {"users": self.users, "items": self.items, "articles": self.articles}
        for name, table in tables.items():
            if table is not None:
                table.write.mode("overwrite").parquet(f"{path}/{name}")
        row = (self.user_type, self.item_type, *[t is not None for t in tables.values()])
        spark.createDataFrame([row], "user_type string, item_type string, users boolean, items boolean, "
                              "articles boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, user: str = "user_id", item: str = "doc_id"):
        meta = spark.read.parquet(f"{path}/meta").first()
        table = lambda name: spark.read.parquet(f"{path}/{name}") if meta[name] else None
        return cls(ALSModel.load(f"{path}/als"), table("users"), table("items"), table("articles"),
                   user, item, meta["user_type"], meta["item_type"])


def train(log: DataFrame, params: Params = DEFAULT_PARAMS, user: str = "user_id",
          item: str = "doc_id", seed: int = 42, ids: str | None = None) -> CFModel:
    """Explicit ALS on float ratings (rank, iterations, lambda from params).  With ``ids``, a
    folder, ids that need a dictionary keep their indices from run to run (``IdDictionary``).

    Integer ids go into ALS by a cast; only others are joined with a dictionary.
    A log with ``article_id`` and ``ts`` gives the last published id of each item."""
    r = ratings(log, user, item)
    fits = fits_int(r, [user, item])
    def dictionary(col: str, idx: str) -> DataFrame | None:
        if fits[col]:
            return None
        if ids is None:
            return index_dictionary(r, col, idx)
        return IdDictionary(log.sparkSession, ids, col, idx).extend(r)
    users, items = dictionary(user, "user_idx"), dictionary(item, "item_idx")
    data = r if users is None else r.join(users, user)
    data = data if items is None else data.join(items, item)
    data = data.select((F.col(user).cast("int") if users is None else F.col("user_idx")).alias("user_idx"),
                       (F.col(item).cast("int") if items is None else F.col("item_idx")).alias("item_idx"),
                       F.col("rating").cast("float").alias("rating"))
    als = ALS(rank=params.als_rank, maxIter=params.als_iterations, regParam=params.als_reg,
              userCol="user_idx", itemCol="item_idx", ratingCol="rating",
              coldStartStrategy="drop", seed=seed, checkpointInterval=10)
    articles = None
    if "article_id" in log.columns:
        named = item_dictionary(log.select(F.col(item).alias("rowkey"), F.col("article_id").alias("doc_id"), "ts"))
        articles = named.select(F.col("rowkey").alias(item), F.col("doc_id").alias("article_id"))
    # ALS hash-partitions the ratings into its own user/item blocks
    return CFModel(als.fit(data), users, items, articles, user, item,
                   log.schema[user].dataType.simpleString(), log.schema[item].dataType.simpleString())


def recommend(m: CFModel, users: DataFrame, n: int) -> DataFrame:
    """Top-n items per requested user: (user, item, article_id, rk, score); article_id is
    the published id of the item (the item key itself when the log had none).  Unknown
    users get no rows.  Items come from the exact pruned search (``operators.mips``),
    equal scores by item index; no user meets every item."""
    u = users.select(m.user).distinct()
    u = (u.select(F.col(m.user).try_cast("int").alias("user_idx")).where("user_idx IS NOT NULL")
         if m.users is None else u.join(m.users, m.user))
    factors = m.model.userFactors.join(u.select(F.col("user_idx").alias("id")), "id", "left_semi")
    out = top_items(factors.withColumnRenamed("id", "user_idx"),
                    m.model.itemFactors.withColumnRenamed("id", "item_idx"), n, "user_idx", "item_idx").rows
    out = (out.withColumn(m.user, F.col("user_idx").cast(m.user_type)) if m.users is None
           else out.join(u, "user_idx"))
    out = (out.withColumn(m.item, F.col("item_idx").cast(m.item_type)) if m.items is None
           else out.join(m.items, "item_idx"))
    out = (out.withColumn("article_id", F.col(m.item)) if m.articles is None
           else out.join(m.articles, m.item, "left"))
    return out.select(m.user, m.item, "article_id", "rk", "score")
