"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Hospital-shaped tables are stored tables, so writing them is timed apart as ``store_clinical_tables`` and left out of
the total. Every query is run once to warm the JVM up and then timed, planning included, writing to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "cohort_table", "chart_features", "lab_features", "assessment_features", "diagnosis_flags", "medication_flags",
    "fluid_balance", "first_day_features", "star_assembly", "entity_sequence", "hot_entity_sequence", "fanout_counts",
    "code_flags_all_keys", "item_report_top", "stratified_split", "exact_medians", "auroc", "subgroup_metrics",
    "roc_points", "reliability_table", "bootstrap_interval",
)


def main() -> None:
    from catalogue import all_queries, clinical
    from catalogue.registry import Tables
    from wardstone.session import local_session

    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    wanted = sys.argv[1:] or HEADLINE
    start = time.perf_counter()
    clinical.stored(Tables(spark, base))
    stored = time.perf_counter() - start

    queries, took = all_queries(), {}
    for name in wanted:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, base).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    chart = clinical.stored(Tables(spark, base), ["chartevents"])["chartevents"].count()
    print(json.dumps({
        "metric": "headline queries, warm, planning included", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": Path(base).name.removeprefix("sf"), "store_clinical_tables": round(stored, 3),
        "chart_rows": chart,
    }))


if __name__ == "__main__":
    main()
