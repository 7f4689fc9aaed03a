"""Benchmark: times the build and the headline queries, prints one JSON line.

``land_sources`` derives and writes the two source tables, ``build_master`` is
the whole build (both sources to a written master with families); the other
queries are timed as they stand, the reports on the written master. Every
result is consumed in full by the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from masterloom.session import local_session  # noqa: E402
from workload import queries as workload  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "entity_overlap", "normalize_number", "normalize_owner", "dedupe_absorb", "dedupe_first", "merge_master",
    "families", "family_members", "family_member_lists", "exceptions_long", "exception_summary", "exception_preview",
    "bulk_summary", "curated_summary", "overview_all", "view_page", "export_rows", "search_matches", "override_apply",
    "snapshot_diff",
)


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS))
    spark.range(1).count()  # start-up is not part of any query
    took: dict[str, float] = {}

    started = time.time()
    workload.curated_rows(spark, SF_DIR)
    workload.bulk_rows(spark, SF_DIR)
    took["land_sources"] = round(time.time() - started, 3)

    started = time.time()
    built = workload.mastered(spark, SF_DIR)
    took["build_master"] = round(time.time() - started, 3)

    for name in HEADLINE:
        started = time.time()
        workload.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - started, 3)

    rows = sum(spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in ("orders", "customer", "supplier"))
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "source_rows": rows,
        "records": built.master.count(),
        "build_rows_per_sec": round(rows / took["build_master"]),
    }))


if __name__ == "__main__":
    main()
