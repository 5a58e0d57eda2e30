"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query runs to completion through the no-op sink (every row computed,
nothing collected); the cross-validated flagship run is timed end to end.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "f_num_characters", "f_word_length_std", "f_stopword_ratio", "f_avg_emoji_repetition", "clean_text",
    "issue_counts", "pooled_word_vectors", "lexicon_polarity", "token_windows", "vocab_encode", "char_encode",
    "softmax_pool", "stratified_folds", "task_metrics", "ensemble_vote", "standardize_embeddings", "svd_gram",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from glosa.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=2 * cpus, app="glosa-bench")
    from glosa.plans.flagship import flagship_run
    from glosa.plans.queries import QUERIES

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    run(QUERIES["f_num_words"](spark, sf_dir))  # warm-up, not timed
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    result = flagship_run(spark, sf_dir)
    run(result.cv.metrics)
    run(result.predictions)
    times["flagship_cv"] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
