"""Time the registered queries: one JSON line on stdout.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 3)
BENCH_QUERIES  comma-separated query names (default: the headline queries)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from catalog.queries import QUERIES
from textsieve.session import local_session

HEADLINES = (
    "keyword_ratio", "keyword_top50", "keyword_stats", "vocab_intersect",
    "token_length", "token_length_plug_in", "length_filter_stats", "prompt_fill",
    "split_assign", "split_counts", "first_k_per_label",
    "profile_columns", "value_counts_top5", "label_distribution_by_source",
    "threshold_grid", "classification_report", "prob_stats",
    "roc_auc_by_dataset", "pr_curve", "optimal_threshold",
    "extract_yes_no", "reply_summary", "chat_render", "prob_from_logprobs", "score_documents",
    "mask_labels", "pad_batch", "chunk_windows", "chunk_vote",
    "cost_projection", "class_weights", "train_predict",
)


def consume(df) -> None:
    """Run the whole plan without bringing rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "")
    chosen = names.split(",") if names else list(HEADLINES)
    spark = local_session(cores, "bench", partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in chosen:
        times = []
        for i in range(1 if name == "train_predict" else runs + 1):
            start = time.perf_counter()
            consume(QUERIES[name](spark, folder))
            if i or name == "train_predict":
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
