"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.catalog import QUERIES  # noqa: E402
from corpusloom.session import build_session, ship_package  # noqa: E402

HEADLINE = [
    "tokenize", "chunk_fixed", "chunk_markdown", "chunk_recursive", "chunk_semantic", "embed", "index_job",
    "build_bm25_index", "bm25_search", "dense_search", "hybrid_search", "rerank", "format_context",
    "rewrite_queries", "route_queries", "decide", "extract_entities", "evaluate_run", "qa_overall",
    "add_random_negatives", "build_all",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    times: dict[str, float] = {}
    QUERIES["tokenize"](spark, sf_dir).limit(1).collect()  # start the engine and the workers
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else sf_dir,
            }
        )
    )


main()
