"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores,
BENCH_QUERIES an optional comma-separated selection.  Every query is written to the no-op sink, so
all its rows are computed; the reported time includes planning and fitting passes.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from signalframe.plans.catalog import REGISTRY  # noqa: E402
from signalframe.session import local_session  # noqa: E402

HEADLINE = [
    "fisher_top_features", "scaler_apply", "stratified_split_documents", "random_split", "learning_curve_subset", "stratified_sample",
    "bootstrap_draws", "mean_impute", "one_hot", "detect_array_column", "parse_array_text", "expand_array_column", "auto_expand",
    "encode_target", "encode_numeric_target", "dataset_statistics", "class_describe", "correlation_ranking", "cohens_d",
    "three_phase_items", "vector_aggregates", "detector_statistics", "temporal_statistics", "event_time_statistics", "event_steps",
    "fft_summary", "stft_summary", "waveform_head", "wide_signals", "macro_summary", "per_class_metrics", "roc_pr_areas",
    "threshold_best", "multitask_metrics", "best_run_per_dataset", "benchmark_ranking", "family_means", "run_records", "slugs",
    "prompt_texts", "prepared_table", "logistic_regression_model", "random_forest_model", "cross_validation", "wide_signal_spectra",
]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["class_counts"].run(spark, d).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        start = time.perf_counter()
        REGISTRY[n].run(spark, d).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(n, times[n], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(d.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
