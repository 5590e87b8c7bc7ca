"""Benchmark the headline queries.

Runs every headline query of the catalogue on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is fully executed with the ``noop`` sink (no collect to the
driver).  A small warm-up query runs first so JVM start-up is not billed to
the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "parse_log", "attach_text", "ratings", "vocabulary", "count_vectors", "tfidf",
    "keywords_self", "keywords_new_vs_corpus", "keywords_user_scope",
    "topic_delta", "topic_merge", "keyword_delta", "keyword_merge_add",
    "profile_nested", "cosine_pairs", "jaccard_pairs", "score_single", "score_hybrid",
    "blend", "top_topics", "cf_recommend", "lda_topics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from tastemap.session import local_session
    from tastemap.plans.catalogue import QUERIES

    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS",
                               int(cpus) * 2 if cpus.isdigit() else 16))
    spark = local_session(cpus, shuffle_partitions=parts, app="tastemap-bench")
    # warm-up on the smallest tables (JIT / codegen), not timed
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in ("parse_log", "keywords_self", "score_single"):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in only or HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
