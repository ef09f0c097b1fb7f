"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores. Each query writes its
whole result to the no-op sink; the best of ``BENCH_RUNS`` (default 2) counts, so compilation is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.catalog import load  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402

HEADLINE = [
    "agg1_monthly_cashflow", "agg4_top_merchants", "agg6_statement_metrics", "agg8_feedback_records", "enr1_category",
    "enr5_statement_period", "txn3_embedded_amounts", "txn10_hybrid_typing", "lay1_visual_rows", "lay6_trim_sections",
    "tag1_rule_tags", "tag5_decode", "tag8_merge_chunks", "joi6_align_labels", "joi7_match_counts", "evl2_entity_report",
    "bnk3_banks_in_text", "flt2_statement_content", "win2_quota_sample", "win4_evenly_spaced", "src10_submission_urls",
    "snk3_first_writes", "jsn3_salvaged_transactions", "flow_parsed_transactions"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=2 * int(cpus) if cpus.isdigit() else 16)
    queries, seconds = load()[0], {}
    for name in HEADLINE:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
