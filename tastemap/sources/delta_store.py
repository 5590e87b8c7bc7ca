"""Keyed tables as a base and deltas, with one log of committed versions.

An update writes only the rows of the keys it touches, as a new *delta* layer; a read
merges the layers (the newest layer that holds a key wins for all rows of that key);
compaction folds them into a new *base* layer.  Several tables share one log, so they
become current together: version n is the file ``_log/n.json`` under the store's root,
which names the layers of every table.  A layer that no version names is never read.

Committing version n + 1 creates its file only if it is absent, so of two writers that
started from version n one is told, and repeats its update from the new state
(``transact``).  A version also records the last batch of every producer: a replayed
batch is recognised and adds nothing.

Files are created exclusively by a hard link on local disks and by a rename that refuses
to overwrite elsewhere (HDFS and stores with that guarantee).  Keys must not be null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemap.sources.files import hadoop_fs, put_if_absent, read_text

BROADCAST_KEYS = 1_000_000      # touched keys (rows of keys only) that are broadcast
MAX_DELTAS = 8                  # layers beyond which an update compacts
MAX_DELTA_SHARE = 0.5           # of the base's rows


class Conflict(Exception):
    """Another writer committed first."""


@dataclass
class Table:
    path: str
    keys: list[str]


@dataclass
class Snapshot:
    """One committed version: layers per table (oldest first) and producers' last batches."""
    version: int = -1
    layers: dict[str, list[dict]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class DeltaStore:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    # -- log ------------------------------------------------------------------
    def versions(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.root}/_log")
        if not fs.exists(p):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The given or latest version; version -1 is the empty store."""
        if version is None:
            known = self.versions()
            version = known[-1] if known else -1
        if version < 0:
            return Snapshot()
        row = json.loads(read_text(self.spark, f"{self.root}/_log/{version}.json"))
        return Snapshot(version, row["layers"], row["batches"])

    def _commit(self, before: Snapshot, layers: dict[str, list[dict]], batches: dict[str, int]) -> Snapshot:
        after = Snapshot(before.version + 1, layers, batches)
        for name, t in self.tables.items():     # lets a reader of the table's folder find the log
            put_if_absent(self.spark, f"{t.path}/_store", json.dumps({"root": self.root, "table": name,
                                                                     "keys": t.keys}))
        text = json.dumps({"layers": layers, "batches": batches})
        if not put_if_absent(self.spark, f"{self.root}/_log/{after.version}.json", text):
            raise Conflict(f"{self.root}: version {after.version} was committed by another writer")
        return after

    # -- layers -----------------------------------------------------------------
    def _write(self, name: str, df: DataFrame, kind: str) -> dict:
        """A layer of ``df``, in ranges of the keys: a lookup skips files by their statistics."""
        keys = self.tables[name].keys
        folder = f"{kind}-{uuid.uuid4().hex[:12]}"
        path = f"{self.tables[name].path}/{folder}"
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
        return {"folder": folder, "kind": kind, "rows": self.spark.read.schema(df.schema).parquet(path).count()}

    def _layer(self, name: str, layer: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.tables[name].path}/{layer['folder']}")

    def read(self, name: str, at: Snapshot | None = None, touched: DataFrame | None = None) -> DataFrame | None:
        """Current rows (of the keys in ``touched`` only, if given); None before the first commit."""
        at = at or self.snapshot()
        layers, keys = at.layers.get(name), self.tables[name].keys
        if not layers:
            return None
        wanted = None
        if touched is not None:
            wanted = touched.select(*keys).distinct()
            wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
        some = [self._layer(name, one) for one in layers]
        if wanted is not None:
            some = [df.join(wanted, keys, "left_semi") for df in some]
        if len(some) == 1:
            return some[0]
        columns = some[0].columns
        deltas = reduce(DataFrame.unionByName, [df.withColumn("_seq", F.lit(i)) for i, df in enumerate(some[1:])])
        newest = deltas.groupBy(*keys).agg(F.max("_seq").alias("_last"))
        few = sum(one["rows"] for one in layers[1:]) <= BROADCAST_KEYS
        newest = F.broadcast(newest) if few else newest
        kept = some[0].join(newest, keys, "left_anti")
        changed = deltas.join(newest, keys).where(F.col("_seq") == F.col("_last"))
        return kept.select(*columns).unionByName(changed.select(*columns))

    # -- updates ----------------------------------------------------------------
    def commit(self, before: Snapshot, changes: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> Snapshot:
        """Write ``changes`` (all rows of every touched key) as delta layers on top of ``before``."""
        layers = {name: list(have) for name, have in before.layers.items()}
        for name, df in changes.items():
            have = layers.setdefault(name, [])
            have.append(self._write(name, df, "delta" if have else "base"))
        batches = dict(before.batches)
        if batch is not None:
            batches[batch[0]] = batch[1]
        return self._commit(before, layers, batches)

    def transact(self, change: Callable[[Snapshot], dict[str, DataFrame]], batch: tuple[str, int] | None = None,
                 attempts: int = 16) -> Snapshot:
        """Commit what ``change`` makes of the current version; repeated from the new state if
        another writer was first.  A ``batch`` (producer, number) already recorded adds nothing."""
        for _ in range(attempts):
            before = self.snapshot()
            if batch is not None and before.batches.get(batch[0], -1) >= batch[1]:
                return before
            try:
                after = self.commit(before, change(before), batch)
            except Conflict:
                continue
            return self.compact(after) if self._due(after) else after
        raise Conflict(f"{self.root}: no commit in {attempts} attempts")

    def _due(self, at: Snapshot) -> bool:
        return any(len(have) - 1 > MAX_DELTAS or sum(one["rows"] for one in have[1:]) > MAX_DELTA_SHARE * have[0]["rows"]
                   and len(have) > 2 for have in at.layers.values())

    def compact(self, at: Snapshot | None = None) -> Snapshot:
        """Fold every table's layers into a new base.  Rows stay the same; if a writer commits
        meanwhile, its version stands and the compaction is dropped."""
        at = at or self.snapshot()
        layers = {name: [self._write(name, self.read(name, at), "base")] if len(have) > 1 else have
                  for name, have in at.layers.items()}
        try:
            return self._commit(at, layers, at.batches)
        except Conflict:
            return self.snapshot()

    def vacuum(self, keep: int = 2) -> int:
        """Delete layers that none of the last ``keep`` versions names, and the log files
        before them; returns the number of layers deleted.  Not beside a running writer."""
        known = self.versions()
        if not known:
            return 0
        used = {(name, one["folder"]) for v in known[-keep:] for name, have in self.snapshot(v).layers.items()
                for one in have}
        gone = 0
        for name, t in self.tables.items():
            fs, p = hadoop_fs(self.spark, t.path)
            for st in fs.listStatus(p) if fs.exists(p) else []:
                folder = st.getPath().getName()
                if folder.startswith(("base-", "delta-")) and (name, folder) not in used:
                    gone += bool(fs.delete(st.getPath(), True))
        for v in known[:-keep]:
            fs, p = hadoop_fs(self.spark, f"{self.root}/_log/{v}.json")
            fs.delete(p, False)
        return gone


def table_store(spark: SparkSession, path: str) -> tuple[DeltaStore, str] | None:
    """The store that the table folder ``path`` belongs to, and the table's name."""
    fs, p = hadoop_fs(spark, f"{path}/_store")
    if not fs.exists(p):
        return None
    row = json.loads(read_text(spark, f"{path}/_store"))
    return DeltaStore(spark, row["root"], {row["table"]: Table(path, row["keys"])}), row["table"]
