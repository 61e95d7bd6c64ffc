"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed with the ``noop`` sink (every row produced, none
collected). One warm-up pass runs first (JIT, file listing); then ``BENCH_RUNS`` timed
passes (default 3), reporting each query's best. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "c4_annotate", "c5_reject_profile", "c7_child_set", "c10_head_per_model", "b11_number_prompts",
    "b14_completed_chat", "c12_supervised_labels", "e1_preference_rows", "e3_choice_accuracy", "e4_trait_rate",
    "c9_contrast_pairs", "d4_experiment_rows", "d5_trial_ledger", "f2_token_pooling", "f7_mean_difference",
    "f11_add_steering", "f12_encode_decode", "f22_reconstruct", "g6_stratified_split", "g11_roc_auc",
    "g10_per_class", "f15_feature_annotation",
]


def main() -> None:
    from loam.plans.registry import load_all
    from loam.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    chosen = names.split(",") if names else [n for n in HEADLINE if n in registry]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    runs = int(os.environ.get("BENCH_RUNS", "3"))
    warm = {}
    for n in chosen:
        warm[n] = round(run(n), 3)
    timed = {n: float("inf") for n in chosen}
    for _ in range(runs):
        for n in chosen:
            timed[n] = min(timed[n], round(run(n), 3))
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timed.values()), 3), "unit": "sec", "queries": timed,
        "warmup": warm, "sf": sf, "cpus": cpus, "spark": spark.version, "runs": runs, "stat": "min over runs",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
