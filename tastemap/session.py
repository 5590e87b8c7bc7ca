"""Session helpers: local sessions for tests/bench and the shared scratch area."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tastemap") -> SparkSession:
    """A local session configured the way the library expects (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # local runs only: catalog tables go to a temp folder, not the cwd
        .config("spark.sql.warehouse.dir",
                os.environ.get("TASTEMAP_WAREHOUSE", tempfile.mkdtemp(prefix="tastemap-wh-")))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    share_package(spark)
    return spark


def share_package(spark: SparkSession) -> None:
    """Put this package's folder on the Python workers' path.  On a cluster the
    package is shipped with --py-files and the extra entry is harmless."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (HDFS/object store) folder and is
    used as is.  When it is unset, a local master gets a folder under the system
    temp directory (tests); any other master is refused, because executors and
    driver would not see each other's files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = os.path.join(os.environ.get("TMPDIR", "/tmp"), "tastemap-checkpoints")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder inside the shared checkpoint area."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tastemap/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df, name: str):
    """Write ``df`` to the shared checkpoint folder and read it back: later steps start
    from the written rows, whatever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """Round-robin ``df`` to the default parallelism when it has fewer
    partitions (a few large files or row groups); a no-op for inputs that
    are already split finer, as on a cluster.  Meant for plain table scans:
    on a plan with shuffles, asking for the partition count would run them."""
    sc = df.sparkSession.sparkContext
    target = sc.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def cluster_conf(input_bytes: int, executors: int = 1000, executor_cores: int = 4,
                 target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Settings for a large cluster run, sized from the input volume.

    Shuffle partitions are chosen so that a partition of the largest shuffle
    (at most about the input size: the corpus text, the event log) is around
    ``target_partition_bytes`` and there are at least two waves of tasks; AQE
    then coalesces small partitions and splits skewed ones at run time.
    ``spark.checkpoint.dir`` is not set here: the cluster names its shared
    folder."""
    cores = executors * executor_cores
    parts = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes // 2),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
