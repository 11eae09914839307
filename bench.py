"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then ``REPEATS`` times; the median counts. Jobs that train or
write stores run once. A query is run to its end by the noop sink, which computes every column of
every row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

HEADLINE = [
    "label_prevalence", "label_prevalence_month", "monthly_label_share", "months_with_total",
    "permalink_code", "sequential_code", "clean_labelled", "apply_corrections",
    "cleaning_audit", "merge_stance", "stance_conflicts", "unmerge_stance",
    "attach_embeddings", "missing_embeddings", "verify_text", "align_predictions",
    "binary_metrics", "weighted_f1", "roc_auc_score", "roc_auc_many_scores", "roc_auc_ovo",
    "log_loss", "evaluate_labels", "argmax_top_prob", "best_epoch", "key_split",
    "exact_split", "stratified_folds", "class_weights", "pos_weights", "score_summary",
    "summarise_splits", "embed_documents", "embed_with_function", "pca_project",
    "predict_coverage", "embed_missing", "posts_csv_round_trip", "labelled_csv_round_trip",
    "embedding_store_round_trip", "score_table_round_trip", "months_of_mixed_dates",
    "evaluate_two_classes",
]
#: Jobs that train or write stores, timed once each.
HEAVY = [
    "train_and_score", "cross_validation", "epoch_log", "text_classifier", "classified_posts", "stream_scores",
    "stream_raw_posts", "predict_stacked", "embed_by_content", "versioned_store_round_trip",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from stancewright.catalog import QUERIES
    from stancewright.session import local_session

    spark = local_session(CPUS, shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE + HEAVY:
        if name in HEADLINE:
            run(name)
        repeats = REPEATS if name in HEADLINE else 1
        seconds[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
