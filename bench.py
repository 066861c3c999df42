"""Times the headline queries and prints one JSON line.

Each query is planned and run to the end into the ``noop`` sink twice; the faster
run counts, so that the first query does not pay for starting the JVM. Queries
that write tables or streams include the writes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gazette.checks import queries as Q  # noqa: E402
from gazette.session import local_session  # noqa: E402

HEADLINES = [
    "search",
    "search_ranked",
    "hot_topics",
    "build_index",
    "index_language_stats",
    "gate_articles",
    "dedupe_url",
    "assign_ids",
    "identify_country",
    "category_rules",
    "process_article",
    "tokenize_en",
    "main_content",
    "page_images",
    "article_links",
    "rss_items",
    "country_stats",
    "source_stats",
    "v_news_detail",
    "news_detail",
    "retention_48h",
    "stream_source_stats",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gazette-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = Q.queries()
    times = {}
    for name in HEADLINES:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
