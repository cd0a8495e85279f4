"""Times the table queries: prints one JSON line.

Every query is run to the end into Spark's no-op sink, which computes all rows
and columns without sending them to the driver.  The first run of a query
includes planning and code generation; nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankfold.plans.table_queries import all_queries  # noqa: E402
from rankfold.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session("rankfold-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: q for n, q in all_queries().items() if not only or n in only}
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()   # start-up
    seconds: dict[str, float] = {}
    for name, query in queries.items():
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of all queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
