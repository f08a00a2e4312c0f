"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line with seconds per query.

Histories of swaps and the page of actions come twice: from the raw rows, and (`stored_`) from rollups and views that were
written before, as a running service reads them. Writing them is not part of a query's time.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from poolscope import catalog, catalog_stores  # noqa: E402
from poolscope.operators import history  # noqa: E402
from poolscope.plans import adapters  # noqa: E402
from poolscope.session import get_session, new_folder  # noqa: E402

#: One query for each published endpoint timing, and the heaviest folds.
HEADLINE = [
    "q1_swap_history_day",
    "q1_swap_history_month_pool",
    "agg4_swap_history_odd_range",
    "q5_earnings_history",
    "q6_liquidity_history",
    "q7_tvl_history",
    "q3_win11_depth_history",
    "q4_win15_candles",
    "q8_page_of_all_kinds",
    "mv4_action_counts",
    "mv6_q9_members",
    "q12_pools",
    "q13_pool_stats",
    "q14_q24_stats",
    "win1_mv5_balances",
    "fold1_fold2_block_depths",
]


def stored_queries(spark, sf_dir):
    """Swap histories out of stored day and hour rollups, pages of actions out of the stored view and its postings."""
    swaps, agg = adapters.swap_events(spark, sf_dir, addresses=False), history.swaps_aggregate()
    rollups = {}
    for interval in ("hour", "day", "month"):
        path = new_folder(spark, f"rollup-{interval}")
        agg.rollup(swaps, interval).coalesce(1).sortWithinPartitions("start_s").write.parquet(path)
        rollups[interval] = spark.read.parquet(path)
    asked = {"q1_swap_history_day": (catalog.DAYS, None), "q1_swap_history_month_pool": (catalog.MONTHS, "N.O"), "agg4_swap_history_odd_range": (catalog.ODD, None)}
    queries = {f"stored_{name}": (lambda b=b, p=p: history.swap_history(adapters.swap_events(spark, sf_dir, False, b), b, p, rollups)) for name, (b, p) in asked.items()}
    actions = catalog_stores.stored_actions(spark, sf_dir)
    queries["stored_q8_page_of_all_kinds"] = lambda: actions.page(50, 75)
    queries["stored_q8_page_of_address"] = lambda: actions.page(50, 0, address="17")
    return queries


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, seconds = catalog.queries(), {}
    asked = {name: (lambda name=name: registered[name](spark, sf_dir)) for name in HEADLINE} | stored_queries(spark, sf_dir)
    for name, ask in asked.items():
        best = []
        for _ in range(2):  # the first run also compiles code
            began = time.perf_counter()
            ask().write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        seconds[name] = round(min(best), 3)
        print(name, seconds[name], file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, best of two", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
