"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs twice from empty caches and the second time counts, so the
figures show execution and not the start of the JVM and its Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lexatlas.plans import registry  # noqa: E402
from lexatlas.session import local_session  # noqa: E402

HEADLINE = (
    "bm25_top100",
    "rrf_three_source_weighted",
    "knn_exact_topk",
    "aggregate_documents",
    "macro_recall_precision",
    "candidate_depth_metrics",
    "mine_negatives",
    "clean_documents",
    "structure_nodes",
    "chunk_documents",
    "duplicate_documents",
    "latency_summary",
    "citations_verified",
)


def run(spark, query, folder: str) -> float:
    spark.catalog.clearCache()
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, os.environ.get("BENCH_MEMORY", "12g"))
    queries = registry.load()[0]
    seconds = {}
    for name in HEADLINE:
        run(spark, queries[name], folder)
        seconds[name] = round(run(spark, queries[name], folder), 3)
    spark.stop()
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
