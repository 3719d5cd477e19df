"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line, median seconds of three warm runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from molinete.registry import QUERIES  # noqa: E402
from molinete.session import local_session, scratch  # noqa: E402

HEADLINE = (
    "top_clients_by_entries",
    "top_products",
    "sales_by_payment_method",
    "sales_per_month",
    "membership_summary",
    "list_clients",
    "client_membership_status",
    "session_history",
    "running_balance",
    "debtors",
    "running_stock",
    "entry_asof",
    "entry_cooldown",
    "register_entries",
    "sale_documents",
    "sale_audit",
    "enrol_memberships",
    "post_stock_movements",
    "post_sales_sales",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            with scratch(spark):
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
