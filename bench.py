"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the scale.
Every query is run to completion into a sink that keeps no rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from jetframe import plans
from jetframe.session import local_session

HEADLINE = (
    "split_partition_report",
    "stable_ids",
    "id_duplicates",
    "event_disjointness",
    "provenance_gaps",
    "nested_subsets",
    "particles_topk",
    "particle_features",
    "fit_scaling",
    "view_a",
    "view_d",
    "masked_sum_pool",
    "roc_auc",
    "metric_bundle",
    "paired_bootstrap",
    "seed_summary",
    "prediction_alignment",
    "data_audit",
    "reweight",
    "deltar_match",
    "terminal_copy",
    "sweep_grid",
    "matrix_status",
    "gate_rollup",
    "record_contract",
    "redact_text",
    "dataset_digest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry = plans.registry()
    # One small run starts the Python and code generation machinery.
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    spent: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(scale.group(1)) if scale else None,
                "spark": spark.version,
                "cores": cores,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
