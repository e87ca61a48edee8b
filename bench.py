"""Benchmark: run the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Each query is fully executed with the ``noop`` sink (every row computed,
nothing collected to the driver).  Every query runs twice and the faster run
is reported (the first run of a plan also pays JIT and code generation, which
a long job on a cluster amortises); both runs are printed to stderr.

Local-mode tuning: AQE may coalesce a small shuffle into one partition even
when the stage behind it is CPU-heavy (regex cleaning, stemming), so the bench
lowers the minimum coalesced partition size.  At cluster scale shuffles are
large and the setting does not matter.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from termlens.plans.queries import REGISTRY  # noqa: E402
from termlens.session import get_spark  # noqa: E402

HEADLINE = (
    "snippets_by_term",
    "cooccurrence_stats",
    "corpus_stats",
    "term_counts",
    "tfidf_by_term",
    "doc_snippet_text",
    "bib_records",
    "bib_json",
    "cooccurrence_upsert",
    "remove_term",
    "word_entropy",
    "mutual_information",
    "pmi",
    "network_nodes",
    "clean_tokens",
    "fold_ascii",
    "preprocess_text",
    "similarity_forest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    names = sys.argv[1:] or list(HEADLINE)
    spark = get_spark(f"local[{cpus}]", app="termlens-bench", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "8g"),
                             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"})
    # warm-up: JVM start, class loading, first codegen
    REGISTRY["term_counts"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(2):
            t0 = time.time()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.time() - t0, 3))
        times[name] = min(runs)
        print(f"# {name}: {runs} s", file=sys.stderr, flush=True)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
