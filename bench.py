"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Each query is run
to a sink that takes all rows and stores none; the best of BENCH_RUNS runs counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINES = [
    "collapsed_space",  # whitespace of all documents
    "clean_text",  # URLs and whitespace of all documents
    "page_text",  # text of all pages
    "paragraph_text",
    "keyword_hits",  # keywords in all articles, in-row dictionary
    "keyword_hits_joined",  # the same by a join, for dictionaries of any size
    "article_category",
    "article_incidents",
    "report_table_rows",
    "search_links",
    "capped_links",
    "links_with_text",
    "keyword_fan_out",
    "esg_gate_web",
    "reply_json_fields",
    "news_records",
    "datamart_load",
    "monitor_single",
    "monitor_bulk",
    "monitor_keywords",
    "monitor_news_api",
    "monitor_single_tagged",
    "sentences",
    "sentence_vectors",
    "article_summary",
]


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": CPUS.strip("*") or "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "16g",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        best = None
        for _ in range(RUNS):
            started = time.time()
            catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.time() - started
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    scale = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
