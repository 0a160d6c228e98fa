"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the timed runs; the
median counts. One untimed run per query compiles its code first.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import queries  # noqa: E402
from checks.session import session  # noqa: E402

HEADLINE = (
    "column_profile_lineitem", "schema_profile_lineitem", "unique_exact", "unique_approx",
    "numeric_summary_lineitem", "numeric_quantiles", "distribution_shape_lineitem",
    "numeric_histogram", "correlations_lineitem", "duplicate_rows_lineitem", "duplicate_rows",
    "overview", "missingness", "row_missingness", "uniqueness_orders", "key_duplicates_lineitem",
    "key_top_repeated", "categorical_topk", "text_profile_documents", "listlike_items",
    "listlike_tokens", "temporal_coverage", "quality_warnings", "sample_exact_n", "typed_rows",
    "datasets_index", "sources_table",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:] or HEADLINE
    spark = session()
    known = queries()
    times = {}
    for name in chosen:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
