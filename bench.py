"""Run time of the headline queries; prints one JSON line.

Each query runs once, after a warm-up of the session. The result is written to
the ``noop`` sink, so all rows are computed and none travel to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusmill.plans import all_queries  # noqa: E402
from corpusmill.session import local_session  # noqa: E402

HEADLINE = [
    "text_clean", "text_fold", "html_strip_tags", "pages_split_recursive", "chunks_number", "chunks_point_ids",
    "ingest_documents", "sheet_chunks", "table_chunks", "ocr_reading_lines",
    "versions_log", "search_keyword", "search_semantic", "search_hybrid", "batch_search_contexts",
    "rank_rerank", "query_keywords", "query_intent",
    "student_records", "answer_grounding", "memory_update", "users_delete",
    "feedback_preference_pairs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", os.environ.get("BENCH_MEMORY", "12g"))
    queries, times = all_queries(), {}
    queries["users_list"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
