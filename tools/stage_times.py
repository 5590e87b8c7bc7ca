"""Run catalogue queries with Spark's event log in a scratch folder and print
the slowest stages (the UI stays off).

    python tools/stage_times.py <sf_dir> <query> [<query> ...]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def read_events(path: str):
    for f in sorted(glob.glob(os.path.join(path, "*", "events*")) + glob.glob(os.path.join(path, "*.zstd"))):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            yield json.loads(line)


def main():
    sf, names = sys.argv[1], sys.argv[2:]
    from pyspark.sql import SparkSession
    evdir = tempfile.mkdtemp(prefix="tastemap-events-")
    spark = (SparkSession.builder.master("local[8]").appName("stage-times")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", evdir).config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from tastemap.session import ensure_checkpoint_dir
    from tastemap.plans.catalogue import QUERIES
    ensure_checkpoint_dir(spark)
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        print(f"{n}: {time.time() - t0:.2f}s")
    spark.stop()
    stages = {}
    for e in read_events(evdir):
        if e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Completion Time"] - si["Submission Time"],
                                      si["Number of Tasks"], si.get("Details", "").split("\n")[0][:40])
    print("stages:", len(stages), "sum ms:", sum(v[0] for v in stages.values()))
    for k, v in sorted(stages.items(), key=lambda x: -x[1][0])[:8]:
        print(f"  stage {k}: {v[0]} ms, {v[1]} tasks")


if __name__ == "__main__":
    main()
