"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sondeo.plans import catalogue  # noqa: E402
from sondeo.session import local_session  # noqa: E402

HEADLINE = (
    "pareto_event_type", "pareto_part_value", "pareto_summary_source_count", "numeric_profile_lineitem",
    "data_quality_lineitem", "data_quality_documents", "duplicate_text_documents", "column_roles_orders",
    "iqr_outliers_lineitem_sweep", "correlation_order_lines", "trend_shipdate", "topk_others_part_value",
    "top5_alerts_brand", "multi_agg_top8_customers", "measure_totals", "parse_locale_numbers", "fx_conversion",
    "forward_fill_priority", "grid_body", "hierarchy_reader", "kpis_orders", "chart_truth_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalogue.load()
    spark = local_session(cpus, shuffle_partitions=8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["frequency_lang"](spark, sf_dir).collect()   # start the session's machinery

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
