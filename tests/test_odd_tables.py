"""Queries against their SQL on small tables of odd rows: pools without assets, blocks of the same time, long ranges."""

from datetime import datetime, timedelta

import duckdb
import pytest

from poolscope import catalog
from tests.test_catalog import rows_of

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def matches(spark, tmp_path):
    """Whether a query over the given events equals its SQL."""

    def check(name, rows):
        path = f"{tmp_path}/events.parquet"
        spark.createDataFrame([(i, START + timedelta(seconds=t), user, kind, value, f'{{"k": {i % 90}}}') for i, t, user, kind, value in rows], EVENTS).coalesce(1).write.mode("overwrite").parquet(path)
        got = catalog.queries()[name](spark, str(tmp_path))
        duck = duckdb.connect()
        duck.execute("SET TimeZone = 'UTC'")
        duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
        result = duck.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in result.description]
        assert rows_of(got.columns, got.collect()) == rows_of(names, result.fetchall())

    return check


@pytest.mark.parametrize("name", ["q11_lp_report", "join15_lp_block_info"])
def test_lp_events_in_a_pool_without_assets(matches, name):
    rows = [(1, 10, 9, "click", 5.0), (2, 400, 9, "click", 3.0), (3, 420, 9, "click", 0.0), (4, 800, 24, "click", 0.001), (5, 801, 9, "view", 1.0)]
    matches(name, rows)  # user 24 has a price, 24 % 8 = 0 makes it 0; user 9 has one of 0.25


def test_unguarded_prices_of_any_size_as_text(matches):
    values = [(1, 0.0), (1024, 0.01), (3000, 0.3), (5120, 0.03), (70_000, 1.0), (100_000, 0.01), (100_001, 123.45), (600_000, 0.02), (10**6, 0.12), (2 * 10**6, 0.0), (40_000_000, 0.7), (300, 29999.99)]
    rows = [(i, k, k, "view", value) for k, (i, value) in enumerate(values)] + [(7, 50, 100, "click", 1.0), (8, 60, 101, "click", 0.0), (9, 70, 101, "view", 30.0)]
    matches("fn11_unguarded_usd_price", rows)


#: Of three events at one time, and two at another.
SAME_TIME = [(1, 10, 3, "purchase", 5.0), (2, 20, 3, "click", 2.0), (3, 20, 3, "view", 1.5), (4, 20, 23, "purchase", 9.0), (5, 30, 4, "error", 1.0), (6, 30, 24, "click", 4.0)]


def test_bonds_of_blocks_of_one_time_count_once(matches):
    matches("join12_bond_replay", SAME_TIME)


def test_heights_of_blocks_of_one_time(matches):
    matches("join8_action_heights", SAME_TIME)


@pytest.mark.parametrize("name", ["win6_requests", "win4_win7_bucket_grids"])
def test_requests_over_more_days_than_one_request_has(matches, name):
    rows = [(k, 86_400 * days + k, k, "click", 1.0) for k, days in enumerate((0, 12, 400, 401, 950, 1203))]
    matches(name, rows)


def test_a_stream_is_cut_into_batches_without_ordering_rows(spark):
    from poolscope.catalog_events import streamed

    rows = spark.range(3000).selectExpr("id * id AS height", "id AS v").unionAll(spark.range(50).selectExpr("4000000L AS height", "id AS v"))
    seen = []
    query = streamed(spark, rows).writeStream.foreachBatch(lambda batch, epoch: seen.append([r[0] for r in batch.select("height").collect()]))
    query.trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and all(seen) and sum(map(len, seen)) == 3050
    assert max(seen[0]) < min(seen[1]) and max(seen[1]) < min(seen[2])  # the block of 51 rows stays whole


def test_current_balances_are_sums_of_all_changes(spark):
    from poolscope.operators import ledger

    rows = [("a", "b", "X", 5, 10), ("b", "a", "X", 2, 20), ("a", "a", "Y", 7, 20), ("c", "b", "X", 1, 30), ("c", "d", "Y", 4, 5)]
    transfers = spark.createDataFrame(rows, "from_addr string, to_addr string, asset string, amount_e8 long, block_timestamp long")
    log = ledger.balances(transfers)
    assert sorted(ledger.balances_now(transfers).collect()) == sorted(ledger.current_balances(log).collect())
    late = log.filter("block_timestamp >= 20")
    assert sorted(ledger.balances_now(transfers, transfers["block_timestamp"] >= 20).collect()) == sorted(ledger.balances_of_slice(log, late).collect())


def exchanges(rows) -> int:
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_balances_order_rows_in_one_exchange_and_spread_busy_keys(spark):
    import random

    from poolscope.operators import ledger

    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice(["hot", "b", "c"]), "X", rng.randrange(9), rng.randrange(400) * 86400 * 10**9) for _ in range(900)]
    transfers = spark.createDataFrame(rows, "from_addr string, to_addr string, asset string, amount_e8 long, block_timestamp long")
    want, now = {}, {}
    for sender, receiver, asset, amount, t in sorted(rows, key=lambda r: r[4]):
        for addr, delta in ((sender, -amount), (receiver, amount)):
            now[addr] = want[addr, asset, t] = now.get(addr, 0) + delta
    for busy_rows in (0, 300, ledger.BUSY_ROWS):
        got = ledger.balances(transfers, busy_rows).collect()
        assert len(got) == len(want) and {tuple(r)[:3]: r["balance"] for r in got} == want
    got.clear()
    plain = ledger.balances(transfers)
    plain.collect()  # without a busy key nothing is left of what is carried
    final = plain._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1


def test_outbounds_and_fees_of_a_reference_in_one_exchange(spark):
    from poolscope.operators import actions

    outs = spark.createDataFrame([("o1", "v", "x", "A.A", 5, "r1", 2, 20), (None, "v", "y", "B.B", 6, "r1", 1, 10), ("o3", "v", "x", "A.A", 7, "r2", 3, 5)], "tx string, from_addr string, to_addr string, asset string, asset_e8 long, in_tx string, event_idx long, block_timestamp long")
    fees = spark.createDataFrame([("r1", "A.A", 1, 9, 30), ("r3", "B.B", 2, 8, 40)], "tx string, asset string, asset_e8 long, event_idx long, block_timestamp long")
    got = actions.outbounds_by_ref(outs, fees)
    assert exchanges(got) == 1
    assert {r["ref"]: (r["o"] and [o["to_addr"] for o in r["o"]], r["f"] and [f["amount"] for f in r["f"]]) for r in got.collect()} == {"r1": (["y", "x"], [1]), "r2": (["x"], None), "r3": (None, [2])}
