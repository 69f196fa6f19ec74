"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query runs once to warm up and once for its time, written to the no-op sink
so that every row and column is computed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rolesift.plans.catalog import CATALOG  # noqa: E402
from rolesift.session import local_session  # noqa: E402

HEADLINE = [
    "posting_slice",
    "keyword_score",
    "default_rules_score",
    "source_profile_score",
    "normalized_postings",
    "canonical_url",
    "first_copy_wins",
    "source_dedupe",
    "blocked_pages",
    "attempt_resolution",
    "page_policy",
    "html_elements",
    "generic_html_cards",
    "generic_json_postings",
    "smartrecruiters_postings",
    "last_sighting_wins",
    "upsert_vacancies",
    "suppressed_postings",
    "suppression_history",
    "digest_text",
    "run_report",
    "site_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "rolesift-bench")
    spark.sparkContext.setLogLevel("ERROR")
    wanted = [q for q in HEADLINE if len(sys.argv) < 2 or q in sys.argv[1:]]
    times = {}
    for name in wanted:
        query = CATALOG[name][0]
        for _ in range(2):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
