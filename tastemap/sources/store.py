"""Table sinks without MERGE: versioned snapshots and idempotent appends.

* ``write_version``: upserts are computed as a full outer join and written as
  a new version folder ``v=<n>``; readers take the highest committed version.
  A path being read is never overwritten.
* ``append_batch``: recommendation lists are appended as partition
  ``job=<producer>/batch_id=<n>``.  Without a batch id the next free one is
  taken, so runs add up; with one, only that partition is replaced, so
  replaying a batch adds nothing (and an empty replay leaves it empty).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.sources.delta_store import DeltaStore, Table, table_store
from tastemap.sources.files import hadoop_fs, put_if_absent

_COMMITTED = "_SUCCESS"


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return bool(fs.exists(p))


def list_versions(spark: SparkSession, base: str, committed_only: bool = True) -> list[int]:
    """Version numbers under ``base``; by default only committed ones (with
    the job-commit marker), which are the only ones readers see."""
    fs, p = hadoop_fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if not (name.startswith("v=") and name[2:].isdigit()):
            continue
        if committed_only and not fs.exists(st.getPath().suffix("/" + _COMMITTED)):
            continue
        out.append(int(name[2:]))
    return sorted(out)


def read_latest(spark: SparkSession, base: str) -> DataFrame | None:
    """The current rows of a stored table: of its store (``delta_store``), or the highest
    committed version folder; None when there are none."""
    found = table_store(spark, base)
    if found is not None:
        store, name = found
        return store.read(name)
    v = list_versions(spark, base)
    return spark.read.parquet(f"{base}/v={v[-1]}") if v else None


def read_all(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows of every committed version (for tables whose versions are deltas)."""
    v = list_versions(spark, base)
    return spark.read.parquet(*[f"{base}/v={n}" for n in v]) if v else None


def read_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base}/v={version}")


def write_version(spark: SparkSession, df: DataFrame, base: str) -> int:
    """Write ``df`` as the next version; returns its number.  A folder left
    by a failed attempt (no commit marker) is skipped, never reused or read."""
    v = list_versions(spark, base, committed_only=False)
    nxt = (v[-1] + 1) if v else 0
    df.write.mode("errorifexists").parquet(f"{base}/v={nxt}")
    return nxt


def _batches(spark: SparkSession, base: str, job: str) -> list[int]:
    fs, p = hadoop_fs(spark, f"{base}/job={job}")
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(int(n[9:]) for n in names if n.startswith("batch_id=") and n[9:].isdigit())


def append_batch(df: DataFrame, base: str, batch_id: int | None = None, job: str = "batch") -> int:
    """Append one batch as partition (job, batch_id); returns the batch id.

    ``batch_id=None`` appends after the job's batches so far: the number is claimed by
    creating a marker file that must not exist, so two runs at once take two numbers.  A
    given id names a batch that may be replayed: its rows replace the ones of an earlier
    attempt.  Producers (stream, CF job, hybrid job) never touch each other's batches."""
    if batch_id is None:
        have = _batches(df.sparkSession, base, job)
        batch_id = have[-1] + 1 if have else 0
        while not put_if_absent(df.sparkSession, f"{base}/_claims/job={job}/{batch_id}", ""):
            batch_id += 1
    df.write.mode("overwrite").parquet(f"{base}/job={job}/batch_id={int(batch_id)}")
    return int(batch_id)


def read_sink(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Read an append sink; the key types are those of the stored rows.  A sink
    without a batch yet (or without a folder) reads as an empty ``schema``."""
    fs, p = hadoop_fs(spark, base)
    jobs = ([st.getPath().getName()[4:] for st in fs.listStatus(p)
             if st.getPath().getName().startswith("job=")] if fs.exists(p) else [])
    if not any(_batches(spark, base, j) for j in jobs):
        return spark.createDataFrame([], schema)
    out = spark.read.parquet(base)
    return out.withColumns({"job": F.col("job").cast("string"), "batch_id": F.col("batch_id").cast("int")})


RECS_SCHEMA = "user_id long, doc_id long, source string, job string, batch_id int"


def read_recs(spark: SparkSession, base: str, keys=("user_id", "doc_id", "source"),
              schema: str = RECS_SCHEMA) -> DataFrame:
    """All appended recommendations, de-duplicated on ``keys``."""
    return read_sink(spark, base, schema).dropDuplicates(list(keys))


def write_nested(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Seed / save a nested document table."""
    df.write.mode(mode).parquet(path)


# -- new-article queue ---------------------------------------------------------

def queue_from(articles: DataFrame, seen: DataFrame, doc_type: str,
               key: str = "doc_id") -> DataFrame:
    """(doc_id, doc_type, rowkey, has_read): an article is read once its id
    appears in ``seen``."""
    s = seen.select(F.col(key).alias("_s")).distinct()
    j = articles.select(key).join(s, F.col(key) == F.col("_s"), "left")
    return j.select(F.col(key).alias("doc_id"), F.lit(doc_type).alias("doc_type"),
                    F.col(key).cast("string").alias("rowkey"),
                    F.col("_s").isNotNull().alias("has_read"))


def queue_unread(queue: DataFrame) -> DataFrame:
    return queue.where(~F.col("has_read")).select("doc_id", "doc_type", "rowkey")


def mark_read(queue: DataFrame, done: DataFrame) -> DataFrame:
    """Set has_read for entries whose (doc_id, doc_type) is in ``done``."""
    d = done.select("doc_id", "doc_type").distinct().withColumn("_m", F.lit(True))
    j = queue.join(d, ["doc_id", "doc_type"], "left")
    return j.select("doc_id", "doc_type", "rowkey",
                    (F.col("has_read") | F.coalesce(F.col("_m"), F.lit(False))).alias("has_read"))


def queue_store(spark: SparkSession, base: str) -> DeltaStore:
    """The stored queue: marking entries writes only those entries."""
    return DeltaStore(spark, base, {"queue": Table(f"{base}/queue", ["doc_id", "doc_type"])})


def mark_read_stored(store: DeltaStore, done: DataFrame) -> int:
    """Set has_read of the stored entries named in ``done``; returns the store's version."""
    def change(at):
        have = store.read("queue", at, touched=done)
        return {} if have is None else {"queue": have.withColumn("has_read", F.lit(True))}
    return store.transact(change).version


# -- bucketed catalog tables (co-located merges) -----------------------------

def _table(name: str, v: int) -> str:
    return f"{name}_v{v}"


def table_versions(spark: SparkSession, name: str) -> list[int]:
    """Committed versions of a versioned catalog table ``<name>_v<n>``."""
    db, _, base = name.rpartition(".")
    tables = spark.catalog.listTables(db) if db else spark.catalog.listTables()
    out = []
    for t in tables:
        if t.name.startswith(base + "_v") and t.name[len(base) + 2:].isdigit():
            out.append(int(t.name[len(base) + 2:]))
    return sorted(out)


def read_table_version(spark: SparkSession, name: str, version: int) -> DataFrame:
    return spark.table(_table(name, version))


def read_latest_table(spark: SparkSession, name: str) -> DataFrame | None:
    v = table_versions(spark, name)
    return spark.table(_table(name, v[-1])) if v else None


def write_table_version(spark: SparkSession, df: DataFrame, name: str, keys: list[str],
                        n_buckets: int) -> int:
    """Write the next version as a table bucketed (and sorted) by ``keys``.

    A later merge that joins on exactly these keys reads the stored side
    without a shuffle; only the (smaller) delta is hash-partitioned to match.
    """
    from pyspark.errors import AnalysisException

    v = table_versions(spark, name)
    nxt = (v[-1] + 1) if v else 0
    for attempt in range(nxt, nxt + 8):
        try:
            (df.write.bucketBy(n_buckets, *keys).sortBy(*keys).mode("errorifexists")
               .saveAsTable(_table(name, attempt)))
            return attempt
        except AnalysisException as e:
            # files left at that name by a failed attempt: take the next number
            if "LOCATION_ALREADY_EXISTS" not in str(e) and "already exists" not in str(e):
                raise
    raise RuntimeError(f"no free version name for {name} after {nxt + 7}")
