"""Headline timings. Prints one JSON line; the folder and cores come from BENCH_SF_DIR and BENCH_CPUS.

`load` is the whole job from the given tables to committed Bronze and Silver tables; the other queries run on the
loaded tables, each in full (every row and column is computed).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import fixtures  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from tallymill.session import local_session  # noqa: E402

HEADLINES = [
    "rul04_jn05_wn02_rule_match", "rul04_rule_match_by_anchor", "rul04_rule_match_many_rules", "slv07_fact_transaction",
    "gld01_monthly_spending", "gld02_monthly_cashflow", "gld03_top_merchants", "gld04_uncategorized_summary",
    "gld05_category_trend", "gld06_jn01_jn02_transaction_ledger", "dsh01_ag04_summary_metrics", "dsh03_category_top8",
    "dsh04_merchant_top8", "led03_search_text", "led06_metric_cards", "led07_insights", "led08_cashflow_by_month",
    "led11_top_merchants", "rul09_rul10_suggest_rules", "rul08_approve_counts", "up01_merge_unconditional",
    "up02_up03_merge_changed", "ck02_foreign_keys", "dq15_integrity_report", "dq16_se02_trust_report",
    "dq18_row_counts",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench", memory="16g")
    seconds: dict[str, float] = {}

    start = time.perf_counter()
    fixtures.layers(spark, sf_dir)
    seconds["load"] = round(time.perf_counter() - start, 3)
    for name in HEADLINES:
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
