"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then `BENCH_RUNS` times; the median counts.
Results are written to the no-op sink, so whole results are computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from frameglass.queries import QUERIES  # noqa: E402
from frameglass.session import local_session  # noqa: E402

HEADLINE = (
    "profile_report", "numeric_profile", "num_quantiles", "categorical_profile", "n_unique", "duplicate_rows",
    "null_counts", "first_unique_values", "pearson_pairs", "cramers_v_pairs", "histogram", "outlier_fences",
    "normality_shapiro", "datetime_profile", "infer_frequency", "overall_score", "read_csv", "impute_median",
    "outlier_iqr_clip", "scale_standard", "encode_label", "fit_transform_chain", "fit_then_transform_chain",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, "frameglass-bench")
    times: dict[str, float] = {}
    for name in names:
        spent = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - start)
        times[name] = round(median(spent[1:]), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
