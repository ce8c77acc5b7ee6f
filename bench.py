"""Times the headline queries. Prints one JSON line.

BENCH_SF_DIR: folder of the tables. BENCH_CPUS: threads. A query's time is that of computing all
its rows (written to the noop sink); tables that queries share are made first, under `build`.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "exact_lookup", "completions", "corrections_default", "corrections_exhaustive", "suggestions", "path_of", "content_of",
    "tree_stats", "recall_by_kind", "recall_at_5",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from wordloom.operators import evaluate, search
    from wordloom.plans import registry
    from wordloom.session import once

    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)

    timed("build", lambda: (registry.nodes(spark, sf_dir), registry.both(spark, sf_dir)))
    timed("index", lambda: registry.index(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    # Batches of many queries: words with a typo, and all prefixes of words.
    words, rates = registry.dictionary(spark, sf_dir), {}
    typos = evaluate.typo_queries(words, 1 << 30).selectExpr("query")
    starts = words.selectExpr("explode(transform(sequence(1, length(word)), i -> substr(word, 1, i))) AS query").distinct()
    every = once(spark, ("bench", sf_dir), lambda: typos.unionAll(starts).selectExpr("monotonically_increasing_id() AS query_id", "query"))
    have = every.count()
    took = 0.0
    for size in (100_000, 1_000_000):
        if took * 10 > 240:  # the next batch would take too long on this machine
            break
        started = time.perf_counter()
        batch = once(spark, ("bench", sf_dir, size), lambda: every.selectExpr("*", "xxhash64(query) AS h").orderBy("h").drop("h").limit(size) if size < have else every)
        n = batch.count()
        for name, run in (("suggestions", search.suggestions), ("corrections", search.corrections), ("completions", search.completions)):
            began = time.perf_counter()
            run(registry.index(spark, sf_dir), batch).write.format("noop").mode("overwrite").save()
            rates[f"{name}_of_{n}_queries_per_sec"] = round(n / (time.perf_counter() - began), 1)
        took = time.perf_counter() - started
        if n < size:
            break
    print(json.dumps({"metric": "total wall clock of headline queries", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], **rates}))


if __name__ == "__main__":
    main()
