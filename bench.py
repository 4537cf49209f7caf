"""Times the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

Tables are first written anew, outside the timing, as folders of one file per core: a table of one file with one row
group is read by one task, which no table of size is.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from litflow.plans import catalog
from litflow.session import local_session

HEADLINE = (
    "w2_digest_top_k", "x3_keyword_score", "x13_x15_tfidf_fitted_score", "a10_keyword_timeline", "w3_citation_velocity",
    "w7_embedding_knn", "m5_pagerank", "k6_components_by_id", "a8_list_stats", "w9_suggest_next", "s1_x23_x24_x25_x27_rss_items",
    "k5_u3_similar_titles", "k6_greedy_by_id", "j11_reference_jaccard", "w11_reorder_items", "m2_auto_k_clusters", "t1_stream_ingest",
)


def in_files(spark, sf_dir: str, files: int) -> str:
    """A folder with the same tables, each as ``files`` files."""
    folder = os.path.join(tempfile.mkdtemp(prefix="bench-"), os.path.basename(sf_dir.rstrip("/")))
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf_dir}/{name}").repartition(files).write.parquet(f"{folder}/{name}")
    return folder


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    sf_dir = in_files(spark, given, int(cpus) if cpus.isdigit() else os.cpu_count() or 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name]
        best = None
        for _ in range(2):  # the first run also compiles
            start = time.time()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
