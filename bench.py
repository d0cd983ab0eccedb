"""Time every registered query once and print one JSON line.

``build:<table>`` entries are the table builds that the queries share; they
run first, so each query is timed on written inputs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.session import local_session
from needscope.plans.queries import all_queries
from needscope.plans.store import Store, store_of


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    only = set(sys.argv[1:])
    spark = local_session("bench", os.environ.get("BENCH_CPUS"))
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the JVM side

    seconds: dict[str, float] = {}
    store = store_of(spark, folder)
    for table in Store.TABLES:
        start = time.perf_counter()
        getattr(store, table)
        seconds[f"build:{table}"] = round(time.perf_counter() - start, 3)

    for name, build in all_queries().items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        build(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of all table builds and queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
