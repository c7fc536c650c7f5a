"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is run
once untimed on the same session, then timed; results are fully computed by
a write to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from stayline.plans.catalog import QUERIES
from stayline.session import local_session

HEADLINE = [
    "src_batch_csv",
    "src_batch_json",
    "val_errors",
    "val_valid_rows",
    "val_summary",
    "split_stratified",
    "kfold_stratified",
    "prep_median_fit",
    "prep_scale",
    "prep_onehot",
    "train_logistic",
    "model_leaderboard",
    "score_linear",
    "score_batch",
    "met_report",
    "met_lift_curve",
    "met_lift_ties",
    "dec_results",
    "sel_email_candidates",
    "sel_recipients",
    "sel_targets",
    "txt_sanitize_body",
    "txt_draft_set_check",
    "txt_pick_resolve",
    "rep_send_summary",
    "rep_errors_union",
    "out_from_batch",
    "out_from_records",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "stayline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for timed in (False, True):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
