"""Benchmark: build the star once (checkpointed), then time the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries": {name: sec}, "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shipshape import catalog  # noqa: E402
from shipshape.plans.star import VALIDATED, build_star, materialize  # noqa: E402
from shipshape.session import get_session  # noqa: E402

HEADLINE = [
    "kpi_orders", "kpi_sheet", "by_outcome", "time_decomposition", "order_composition", "category_stats",
    "seller_deciles_late", "by_state_excess", "by_seller_state", "value_bands", "repeat_by_first_outcome",
    "gap_by_region", "stratified_sample", "category_shares_ci", "scenario_grid", "fact_orders",
    "model_validation", "column_profile", "fk_profile", "trap_checks",
]


def main() -> None:
    src = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2),
                        extra={"spark.driver.memory": "16g"})
    times: dict[str, float] = {}
    t0 = time.time()
    star = materialize(build_star(spark, src), (*VALIDATED, "frame"))
    times["star_build"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        t = time.time()
        df = catalog.round_doubles(catalog.QUERIES[name](star))
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", src)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else src}))
    spark.stop()


if __name__ == "__main__":
    main()
