"""Time the headline queries and print one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import re
import time

from tillwork.plans import catalog
from tillwork.session import build_session

HEADLINE = ["pairs_four_scopes", "pairs_top_overall", "order_baskets", "item_shares_ranks", "branch_month_features", "customer_segments",
            "shift_features", "supply_profile", "staffing_gap", "attach_kpis", "assoc_rules_pairs", "growth_potential",
            "feasibility_scores", "forecast_ensemble", "report_roundtrip", "report_order_detail", "line_classes"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores, spark__sql__shuffle__partitions=cores, spark__ui__enabled="false", spark__driver__memory="12g")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
