"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Every query is computed in full: its result is written to the no-op sink. One small query runs
first, so that starting the JVM and the Python workers is not charged to the first measurement.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans.registry import QUERIES
from tidemark.session import local_session

HEADLINES = [
    "scores_wide",  # score run in moment form
    "focal_range_join",  # scores from pairs of blocks
    "code_novelty_impact",  # prefix counts
    "code_focal_join",  # code scores from pairs of blocks
    "preprocess",  # text cleaning
    "reassemble_words",
    "tfidf",
    "countvec",
    "novelty_impact_sparse",
    "window_pairs",
    "grade_models",
    "write_by_year",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["encode"](spark, sf_dir).limit(10).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
