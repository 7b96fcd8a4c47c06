"""Headline timings as one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Every query runs over the whole tables and is timed to
its last row by writing to Spark's no-op sink. Each is run twice; "queries" has
the better time, "first" the first one, which includes code generation and the
start of Python workers.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from checks import corpus
from checks.queries import DECIMALS, LIMIT, QUERIES
from lineseek.plans.build import save_index
from lineseek.plans.search import search
from lineseek.sources.index import load_index

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("lineseek-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    first: dict[str, float] = {}
    best: dict[str, float] = {}

    def timed(name: str, action) -> None:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            action()
            runs.append(round(time.perf_counter() - started, 3))
        first[name], best[name] = runs[0], min(runs)
        print(name, *runs, file=sys.stderr, flush=True)

    run(corpus.table(spark, SF_DIR, "region"))  # start-up is not part of a query
    index_dir = corpus.scratch(spark, "bench-index")
    asked = corpus.queries(spark, SF_DIR)

    timed("index_build", lambda: save_index(
        corpus.documents(spark, SF_DIR), index_dir,
        content_vectors=corpus.content_vectors(spark, SF_DIR),
        title_vectors=corpus.title_vectors(spark, SF_DIR), dim=corpus.DIM,
    ))
    index = load_index(spark, index_dir)
    one = asked.where("query_id = 0")
    timed("search_1_query", lambda: run(search(index, one, limit=LIMIT, decimals=DECIMALS)))
    timed("search_all_queries", lambda: run(search(index, asked, limit=LIMIT, decimals=DECIMALS)))
    timed("search_all_no_threshold", lambda: run(
        search(index, asked, limit=LIMIT, threshold=None, decimals=DECIMALS)
    ))
    for name in (
        "preprocess_text", "lemmatise", "term_counts", "doc_freq_idf", "tfidf_scores", "bm25_scores",
        "cosine_similarity", "nearest_exact", "nearest_approx", "profile_documents", "profile_types",
        "profile_sample", "jsonl_extract", "jsonl_rejects",
    ):
        timed(name, lambda: run(QUERIES[name](spark, SF_DIR)))

    print(json.dumps({
        "metric": "total time of headline queries, better of two runs",
        "value": round(sum(best.values()), 3),
        "unit": "sec",
        "queries": best,
        "first": first,
        "sf": SF_DIR.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
