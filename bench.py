"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from facetlens.plans.catalog import QUERIES
from facetlens.plans.views import Views
from facetlens.session import local_session

HEADLINE = [
    "group_vector_mean", "variance_decomposition", "endpoint_metrics", "family_holdout", "cross_axis_projection",
    "linear_relu_topk", "feature_stats", "contrast_feature_selectivity", "decoder_alignment",
    "prompt_grid", "match_contrast", "token_ranks", "token_localization", "token_feature_summary",
    "choice_metrics", "experiment_summary_by_feature", "bootstrap_mean_ci",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        # Nothing settled by one query may serve the next.
        Views.forget()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
