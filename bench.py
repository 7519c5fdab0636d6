"""Headline benchmark: runs the main queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced end-to-end with the ``noop`` sink (full computation, no driver collect).
Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "c18_clean_pipeline",          # cleaning + continent lookup (customer)
    "a09_privacy_report",          # class statistics
    "m01_mondrian_k",              # k-anonymity, people (k=10)
    "m09_mondrian_l",              # l-diversity, people (l=2)
    "m01_lineitem_k",              # k-anonymity at scale: lineitem
    "m09_lineitem_l",              # l-diversity at scale: lineitem
    "a07_ncp",                     # information loss
    "d17_protect_dataset",         # DP cell noise on the clean table
    "d14_post_process",            # keyed noise over every lineitem row
    "e03_batch_select",            # exponential mechanism per group
    "e09_sparse_vector",           # threshold queries over customer totals
    "e11_noisy_count",             # noisy counts (events)
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from umbra.plans.catalog import queries
    from umbra.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    # warm-up on the smallest tables (JVM JIT, codegen, Python workers); not timed
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in ("c18_clean_pipeline", "m01_mondrian_k", "d17_protect_dataset", "e03_batch_select"):
        qs[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
