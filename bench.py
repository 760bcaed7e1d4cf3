"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input
and the cores. Every query is planned and fully computed into a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import re
import time

HEADLINE = [
    "a09_dataset_statistics", "j03_clinical_features", "j05_transfer_counts", "j06_split_overlap",
    "w02_transfer_sequence", "w03_surrogate_key", "w04_readmissions", "w05_unit_transitions",
    "a01_similar_cases", "a05_common_treatments", "a06_peer_aggregates", "a10_network_statistics",
    "a15_numeric_profile", "a23_describe", "a24_group_summary", "a25_event_rate",
    "a38_roc_auc", "a40_site_and_pooled", "a44_threshold_sweep", "a49_threshold_report",
    "a51_slice_metrics", "m02_stratified_split", "m05_standardisation", "m06_label_encoding",
    "q03_schema_drift", "q04_quality_findings", "v04_anonymise", "v06_pattern_scan",
    "v10_k_anonymity", "v13_network_cohort_query", "v15_audit_records", "st2_action_counts_stream",
    "s08_ordered_build", "m11_oversampling", "m14_federated_rounds",
]


def main() -> None:
    from cohortlake.plans.catalogue import CATALOGUE
    from cohortlake.session import build_session, intermediates

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cores)
    # one unmeasured query starts the executor threads and the file system
    CATALOGUE["a25_event_rate"].run(spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        with intermediates(spark):
            CATALOGUE[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else folder,
        "cpus": int(cores),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
