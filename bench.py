"""Headline queries on local cores; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the cores.
Each query is run once to warm up and then timed; the time covers everything from
building the query to the last row, which a no-op sink takes in. What a query needs
written beforehand is made anew for each run, outside the time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lineforge.session import build_session  # noqa: E402
from lineforge.workload.all import FIXTURES, QUERIES  # noqa: E402

HEADLINE = (
    "scan_parquet",
    "silver_parts",
    "gold_factparts",
    "gold_dimcarrier",
    "gold_emergency",
    "mixed_date",
    "json_pages",
    "write_csv",
    "merge_upsert",
    "dedupe_max_max",
    "dedupe_latest",
    "not_in_anti",
    "window_select",
    "holdout_tail",
    "dq_report",
    "ml_features",
    "ml_moments",
    "ml_fit",
    "ml_score",
    "new_rows_to_score",
    "daily_run_end_to_end",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        fixture, query = FIXTURES.get(name, (lambda _, folder: folder, QUERIES.get(name)))
        given = fixture(spark, sf_dir)
        start = time.perf_counter()
        query(spark, given).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
