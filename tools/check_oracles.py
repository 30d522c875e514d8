"""Run registered queries against their SQL checks.

check_oracles.py [sf_dir] [name ...] [key=value ...], the last being session settings.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lineforge.session import build_session  # noqa: E402
from lineforge.workload.all import ORACLES, QUERIES  # noqa: E402
from lineforge.workload.compare import oracle_connection, verdict  # noqa: E402


def main() -> int:
    words = [a for a in sys.argv[1:] if "=" not in a]
    sf_dir = words[0] if words else "/root/testdata/sf0.01"
    names = words[1:] or list(QUERIES)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **dict(a.split("=", 1) for a in sys.argv[1:] if "=" in a),
    }
    spark = build_session("check", "local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    duck = oracle_connection(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            result = verdict(frame, duck, ORACLES.get(name))
        except Exception as error:  # a failing query must not hide the others
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        ok = result.startswith("ok")
        bad += not ok
        print(f"{name:24s} {time.time() - start:6.1f}s {result}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
