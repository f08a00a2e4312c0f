"""Golden values and invariants of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from poolscope import schemas
from poolscope.functions import assets, numeric, pricing
from poolscope.operators import actions, asof, buckets, decode, depths, history, ledger, lookups
from poolscope.operators.buckets import Buckets
from poolscope.operators.rollup import Aggregate

NS = 10**9


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def day(n):
    return 1_598_918_400 + n * 86400  # from 1 September 2020


def swap(t, direction, e8_from, e8_to, fee, slip=0, pool="BTC.BTC", tx="tx", idx=0, memo="m"):
    rune, native, synth = "THOR.RUNE", pool, pool.replace(".", "/")
    pair = {0: (rune, native), 1: (native, rune), 2: (rune, synth), 3: (synth, rune)}[direction]
    return (tx, "chain", "from", "to", pair[0], e8_from, pair[1], e8_to, memo, pool, 0, slip, fee, fee, direction, 1.0, idx, t * NS)


def swaps_of(spark, rows):
    return spark.createDataFrame(rows, schemas.table_schema("swap_events"))


def test_ten_swaps(spark):
    rows = [swap(day(0), 0, 10, 5, 1, 5, tx=f"a{i}") for i in range(4)] + [swap(day(0), 1, 7, 1000, 100, 6, tx=f"b{i}") for i in range(3)]
    rows += [swap(day(0), 2, 100000, 5, 10000, 7, tx=f"c{i}") for i in range(2)] + [swap(day(0), 3, 7, 10000000, 1000000, 8, tx="d")]
    got = history.swap_history(swaps_of(spark, rows), Buckets((day(0), day(1)), "day")).first()
    names = list(history.DIRECTIONS.values())
    assert [got[f"{n}_volume_e8"] for n in names] == [40, 3300, 200000, 11000000]
    assert [got[f"{n}_fees_e8"] for n in names] == [4, 300, 20000, 1000000]
    assert [got[f"{n}_average_slip"] for n in names] == [5, 6, 7, 8]


def test_swap_gap_fill(spark):
    rows = [swap(day(2), 0, 65, 1, 0), swap(day(4), 1, 1, 28, 0)]
    b = buckets.resolve(day(0), day(9), "day", start=day(2), until=day(5))
    got = history.swap_history(swaps_of(spark, rows), b).orderBy("start_s").collect()
    assert [(r["to_asset_volume_e8"], r["to_rune_volume_e8"], r["total_volume_e8"]) for r in got] == [(65, 0, 65), (0, 0, 0), (0, 28, 28)]
    meta = history.history_meta(history.swap_history(swaps_of(spark, rows), b), ["total_volume_e8"]).first()
    assert meta["total_volume_e8"] == 93


@pytest.mark.parametrize("seed", range(3))
def test_any_range_equals_raw(spark, seed):
    rng = random.Random(seed)
    rows = [swap(day(0) + rng.randrange(3 * 86400), rng.randrange(4), rng.randrange(1, 99), rng.randrange(1, 99), 1, pool=rng.choice(["A.A", "B.B"]), idx=k) for k in range(300)]
    df = swaps_of(spark, rows)
    a = day(0) + rng.randrange(86400)
    b = a + rng.randrange(10, 2 * 86400)
    agg = history.swaps_aggregate().last("newest", F.col("from_e8")).first("oldest", F.col("from_e8"))
    fold = lambda x: sorted(map(str, agg.final(x).collect()))
    raw = agg.partial(df.filter((F.col("block_timestamp") >= a * NS) & (F.col("block_timestamp") < b * NS)), F.lit(a).cast("long"))
    assert fold(agg.between(df, a * NS, b * NS)) == fold(raw)
    week = agg.final(agg.rollup(df, "week")).agg(F.sum("swap_count")).first()[0]
    assert week == 300


def test_compat_calendar(spark):
    rows = [("p", float(v), t * NS, i) for i, (v, t) in enumerate([(5, day(0)), (9, day(0) + 5), (7, day(0) + 9), (1, day(1)), (3, day(1) + 9)])]
    df = spark.createDataFrame(rows, "pool string, v double, block_timestamp long, event_idx long")
    agg = Aggregate("o", ["pool"]).first("open", F.col("v")).max("high", F.col("v")).min("low", F.col("v")).last("close", F.col("v"))
    right = agg.final(agg.rollup(df, "month")).first()
    compat = agg.final(agg.rollup(df, "month", compat_calendar=True)).first()
    assert tuple(right)[2:] == (5, 9, 1, 3) and tuple(compat)[2:] == (7, 7, 3, 3)


def depth(pool, asset, rune, t, idx=0):
    return (pool, asset, rune, 0, idx, t * NS)


DEPTH = "pool string, asset_e8 long, rune_e8 long, synth_e8 long, event_idx long, block_timestamp long"


def test_locf_and_seam(spark):
    df = spark.createDataFrame([depth("p", 1, 3, day(0)), depth("p", 2, 3, day(3)), depth("p", 8, 3, day(5))], DEPTH)
    got = history.depth_history(df, Buckets((day(1), day(2), day(3), day(4), day(5)), "day")).orderBy("start_s").collect()
    assert [r["asset_e8"] for r in got] == [1, 1, 2, 2]
    seam = spark.createDataFrame([depth("p", 1, 8, day(0) - 180), depth("p", 1, 10, day(0) + 120), depth("p", 1, 12, day(0) + 180)], DEPTH)
    assert history.depth_history(seam, Buckets((day(0) - 900, day(0) + 150))).first()["rune_e8"] == 10


def test_prices_and_units(spark):
    lit = lambda *v: [F.lit(x).cast("long") for x in v]
    # asset depth, synth balance, LP units
    assert one(spark, pricing.synth_units(*lit(10000, 2000, 90))) == 10
    assert one(spark, pricing.synth_units(*lit(1878459169, 1909971564, 35168185551))) == 36368256684
    assert one(spark, pricing.synth_units(*lit(0, 5, 5))) == 0 and one(spark, pricing.synth_units(*lit(5, 10, 5))) == 0
    assert math.isnan(one(spark, pricing.luvi(*lit(1, 1, 0)))) and math.isnan(one(spark, numeric.ieee_div(F.lit(0), F.lit(0))))
    assert one(spark, numeric.ieee_div(F.lit(-1), F.lit(0))) == float("-inf")
    assert [one(spark, numeric.rint_long(F.lit(x))) for x in (2.5, 3.5, -0.5)] == [2, 4, 0] and one(spark, numeric.half_up_long(F.lit(2.5))) == 3
    assert one(spark, numeric.int_div(F.lit(-7), 2)) == -3
    rows = [("USDA", 300, 100), ("USDB", 5000, 1000), ("BNB.BNB", 1000, 2000)]
    df = spark.createDataFrame(rows, "pool string, asset_e8 long, rune_e8 long")
    usd = pricing.rune_usd_price(df, ["USDA", "USDB"])
    assert usd.first()[0] == 5 and pricing.rune_usd_price(df, ["none"]).first()[0] is None
    priced = pricing.with_usd_price(df.withColumn("k", F.lit(1)), usd.withColumn("k", F.lit(1)), ["k"]).filter("pool = 'BNB.BNB'").first()
    assert priced["price"] == 2 and priced["priceusd"] == 10


def test_churn_and_rewards(spark):
    args = [(1042, 1000, 100, 10), (1100, 1000, 100, 10), (1110, 1000, 100, 10), (1119, 1000, 100, 10), (1120, 1000, 100, 10), (5, -1, 100, 10)]
    got = [one(spark, pricing.next_churn_height(*[F.lit(x).cast("long") for x in a])) for a in args]
    assert got == [1100, 1110, 1120, 1120, 1130, -1]
    r = one(spark, pricing.block_rewards(F.lit(2), F.lit(520), F.lit(5200), F.lit(0.25)))
    assert (r["block_reward"], r["bond_reward"], r["pool_reward"]) == (5, 3, 1)
    assert one(spark, pricing.floored_apy(F.lit(float("nan")))) == 0 and one(spark, pricing.compound(F.lit(0.5), F.lit(2.0))) == 1.25


def test_weighted_nodes(spark):
    df = spark.createDataFrame([(day(0) * NS + 3600 * NS, 1), (day(1) * NS + 12 * 3600 * NS, -2)], "block_timestamp long, delta long")
    got = asof.weighted_average(df, 4, Buckets((day(0), day(1), day(2), day(3)), "day")).orderBy("start_s").collect()
    assert [r["weighted_sum"] for r in got] == [4 * 3600 + 5 * 82800, 5 * 43200 + 3 * 43200, 3 * 86400]


def test_candles(spark):
    df = spark.createDataFrame([depth("p", 1, 4, day(1) + 10), depth("p", 1, 9, day(1) + 700), depth("p", 1, 2, day(1) + 1300), depth("p", 1, 3, day(1) + 2000)], DEPTH)
    got = history.candles(df, Buckets((day(0), day(1), day(2), day(3)), "day"), "p").orderBy("start_s").collect()
    assert [tuple(r)[3:] for r in got][0] == (0, 0, 0, 0, 0, 0)
    assert tuple(got[1])[3:] == (4, 9, 2, 3, day(1) + 600, day(1) + 1200) and tuple(got[2])[3:] == tuple(got[1])[3:]


def test_balances(spark):
    rows = [("a", "b", "RUNE", 10, NS), ("b", "a", "RUNE", 3, 2 * NS), ("a", "a", "RUNE", 99, 3 * NS), ("x", "a", "S/S", 300, 4 * NS)]
    df = spark.createDataFrame(rows, "from_addr string, to_addr string, asset string, amount_e8 long, block_timestamp long")
    log = ledger.balances(df)
    assert log.groupBy("block_timestamp").count().count() == 4
    assert {(r["addr"], r["asset"]): r["balance"] for r in ledger.current_balances(log).collect()} == {("a", "RUNE"): -7, ("b", "RUNE"): 7, ("x", "S/S"): -300, ("a", "S/S"): 300}
    assert ledger.balances_at(df, NS, "b").first()["balance"] == 10


STAKE = "pool string, asset_addr string, rune_addr string, asset_e8 long, stake_units long, rune_e8 long, asset_tx string, rune_tx string, event_idx long, block_timestamp long"
UNSTAKE = "tx string, from_addr string, to_addr string, asset string, asset_e8 long, emit_asset_e8 long, emit_rune_e8 long, pool string, stake_units long, basis_points long, asymmetry double, imp_loss_protection_e8 long, event_idx long, block_timestamp long"
PENDING = "pool string, asset_addr string, rune_addr string, asset_e8 long, rune_e8 long, pending_type string, asset_tx string, rune_tx string, event_idx long, block_timestamp long"


def unstake(who, pool, units, t, asset=1, rune=2, tx="w"):
    return (tx, who, "vault", pool, 1, asset, rune, pool, units, 5000, 0.0, 0, 0, t)


def test_members(spark):
    stakes = [("P.P", "a1", "r1", 10, 5, 20, "x", "y", 0, 1), ("P.P", None, "r1", 10, 7, 20, "x", "y", 0, 9), ("ETH.E", "AbC", None, 1, 3, 0, "x", None, 0, 4)]
    taken = [unstake("r1", "P.P", 5, 5), unstake("abc", "ETH.E", 1, 6)]
    waiting = [("P.P", "a9", "r9", 100, 0, "add", None, None, 0, 3), ("P.P", "a1", "r1", 50, 0, "add", None, None, 0, 0)]
    s, u, p = spark.createDataFrame(stakes, STAKE), spark.createDataFrame(taken, UNSTAKE), spark.createDataFrame(waiting, PENDING)
    got = {(r["member_id"], r["pool"]): r for r in ledger.members(ledger.member_changes(s, u, p)).collect()}
    second_life = got[("r1", "P.P")]
    assert (second_life["units"], second_life["asset_addr"], second_life["added_asset"], second_life["withdrawn_rune"]) == (7, None, 10, 0)
    assert (second_life["first_added"], second_life["pending_asset"]) == (9, 0)
    assert got[("abc", "ETH.E")]["units"] == 2 and got[("r9", "P.P")]["pending_asset"] == 100
    assert {r["rune_addr"] for r in ledger.open_pending(p, s).collect()} == {"r9"}


def test_members_against_a_fold_of_rows(spark):
    rng, changes = random.Random(8), []
    for _ in range(3000):
        member, kind, t = f"m{rng.randrange(60)}", rng.choice(["add", "withdraw", "withdraw", "pending_add", "pending_withdraw"]), rng.randrange(40)
        a, r = rng.choice([None, "a1", "a2"]), rng.choice([None, "r1"])
        x, y, n = rng.randrange(3), rng.randrange(3), rng.randrange(3)
        change = {
            "add": (t, kind, 0, n, a, r, x, y, None, None), "withdraw": (t, kind, 0, -n, None, None, -x, -y, None, None),
            "pending_add": (t, kind, 0, 0, a, r, None, None, x, y), "pending_withdraw": (t, kind, 0, 0, a, r, None, None, -x, -y),
        }[kind]
        changes += [(member, "P.P", change)] * rng.choice([1, 1, 1, 2])
    want = {}
    for member, _, c in sorted(changes, key=lambda x: (x[0], tuple((v is not None, v) for v in x[2]))):
        t, kind, _, units, a, r, asset, rune, p_asset, p_rune = c
        s = want.pop(member, None) or [None, None, 0, 0, 0, 0, 0, 0, 0, None, None]
        s[0], s[1], s[2] = s[0] or a, s[1] or r, s[2] + units
        if kind == "add":
            s[3:5], s[9], s[10] = [s[3] + asset, s[4] + rune], t if s[9] is None else s[9], t
        if kind == "withdraw":
            s[5:7] = [s[5] - asset, s[6] - rune]
        if kind == "pending_add":
            s[7:9] = [s[7] + p_asset, s[8] + p_rune]
        if kind in ("add", "pending_withdraw"):
            s[7:9] = [0, 0]
        if s[2] or s[7] or s[8]:
            want[member] = s
    got = ledger.members(spark.createDataFrame(changes, f"member_id string, pool string, change struct<{ledger.CHANGE.replace(' ', ':').replace(',:', ',')}>"))
    assert {r[0]: list(r[2:]) for r in got.collect()} == want and want
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_actions(spark):
    rune, pool = "THOR.RUNE", "BTC.BTC"
    memo = "=:THOR.RUNE:thoraddress:12345678:ouraffiliateaddress:100"
    rows = [swap(5, 1, 50, 40, 10000, 100, tx="dd", idx=0), swap(5, 0, 40, 30, 20000, 200, pool="ETH.ETH", tx="dd", idx=1), swap(6, 0, 5, 4, 1, 9, tx="ss", memo=memo)]
    out = [("o1", "vault", "to", "ETH.ETH", 30, "dd", 0, 6 * NS), (None, "vault", "to", rune, 40, "dd", 1, 6 * NS)]
    outbound = spark.createDataFrame(out, "tx string, from_addr string, to_addr string, asset string, asset_e8 long, in_tx string, event_idx long, block_timestamp long")
    fees = spark.createDataFrame([("dd", "ETH.ETH", 3, 0, 6 * NS)], "tx string, asset string, asset_e8 long, event_idx long, block_timestamp long")
    tables = {
        "swap_events": swaps_of(spark, rows), "outbound_events": outbound, "fee_events": fees,
        "stake_events": spark.createDataFrame([("P.P", "a1", "r1", 10, 5, 20, "x", "y", 0, 8)], STAKE),
        "pending_liquidity_events": spark.createDataFrame([("P.P", "a1", "r1", 0, 9, "add", None, "t", 0, 7), ("P.P", "a2", "r2", 0, 9, "add", None, "t", 0, 7)], PENDING),
        "unstake_events": spark.createDataFrame([unstake("r1", "P.P", 5, 9)], UNSTAKE),
        "block_log": spark.createDataFrame([(77, 5 * NS, "h")], "height long, timestamp long, hash string"),
    }
    got = actions.with_status(actions.build_actions(tables)).collect()
    assert sorted((r["type"], r["status"]) for r in got) == [("addLiquidity", "pending"), ("addLiquidity", "success"), ("swap", "pending"), ("swap", "success"), ("withdraw", "pending")]
    double = next(r for r in got if r["main_ref"] == "dd")
    assert (double["meta"]["swapSlip"], double["meta"]["liquidityFee"], double["height"], double["pools"]) == (298, 30000, 77, [pool, "ETH.ETH"])
    assert [t["tx_id"] for t in double["outs"]] == ["o1"] and [f["amount"] for f in double["fees"]] == [3]
    single = next(r for r in got if r["main_ref"] == "ss")
    assert (single["meta"]["affiliateAddress"], single["meta"]["affiliateFee"]) == ("ouraffiliateaddress", 100)
    assert [c["amount"] for t in single["ins"] for c in t["coins"]] == [5]
    everything = actions.build_actions(tables)
    assert actions.select_actions(everything, asset=pool, types=["swap"]).count() == 2 and actions.select_actions(everything, txid="o1").count() == 0
    assert [r["block_timestamp"] for r in actions.page(everything, 2, 0).collect()] == [6 * NS, 5 * NS]
    with pytest.raises(buckets.BadRequest):
        actions.page(everything, 51)


def test_swaps_are_exchanged_once(spark):
    """Single and double swaps come out of one pass, each first leg with each second leg of its tx and block."""
    rows = [swap(t, d, 10 + i, 5, 100 * i, i, pool=p, tx=tx, idx=i) for i, (tx, t, d, p) in enumerate([
        ("m", 1, 1, "A.A"), ("m", 1, 1, "B.B"), ("m", 1, 0, "C.C"), ("m", 1, 0, "A.A"), ("m", 2, 1, "A.A"), ("m", 2, 1, "A.A"), ("n", 1, 0, "A.A"), ("n", 1, 0, "B.B"), (None, 1, 1, "A.A"),
    ])]
    swaps = swaps_of(spark, rows)
    legs = [r.asDict() for r in swaps.collect()]
    want = []
    for a in legs:
        group = [b for b in legs if (b["tx"], b["block_timestamp"]) == (a["tx"], a["block_timestamp"])]
        if len({b["from_asset"] for b in group}) == 1:
            want.append((a["tx"], a["block_timestamp"], True, a["from_asset"], a["to_asset"], a["from_e8"], a["swap_slip_bp"], a["liq_fee_in_rune_e8"]))
        elif a["to_asset"] == "THOR.RUNE":
            for b in group:
                if b["from_asset"] == "THOR.RUNE" and b["to_asset"] != a["from_asset"]:
                    slip = a["swap_slip_bp"] + b["swap_slip_bp"] - a["swap_slip_bp"] * b["swap_slip_bp"] // 10000
                    want.append((a["tx"], a["block_timestamp"], False, a["from_asset"], b["to_asset"], a["from_e8"], slip, a["liq_fee_in_rune_e8"] + b["liq_fee_in_rune_e8"]))
    made = actions.swap_actions(swaps)
    got = [(r["main_ref"], r["block_timestamp"], r["meta"]["swapSingle"], *r["assets"], r["ins"][0]["coins"][0]["amount"], r["meta"]["swapSlip"], r["meta"]["liquidityFee"]) for r in made.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {w[2] for w in want} == {True, False}
    assert actions.swap_actions(swaps)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(tx") == 1


def test_adds_without_a_reference_are_not_exchanged(spark):
    """They have no outbounds; by their null reference they would all meet in one task."""
    stakes, pending = spark.createDataFrame([("P.P", "a1", "r1", 10, 5, 20, "x", "y", 0, 8)], STAKE), spark.createDataFrame([], PENDING)
    extras = spark.createDataFrame([(None, [(1,)], None)], "ref string, o array<struct<t:long>>, f array<struct<t:long>>")
    got = actions.with_extras(actions.done_adds(stakes), [actions.pending_adds(pending)], extras)
    assert [(r["meta"]["status"], r["o"], r["f"]) for r in got.collect()] == [("success", None, None)]
    first, parts = actions.base_parts({"stake_events": stakes, "pending_liquidity_events": pending})
    assert "Exchange" not in first._jdf.queryExecution().executedPlan().toString() and len(parts) == 1


def raw(height, idx, kind, **attributes):
    return (height, height * NS, idx, kind, [(k, v) for k, v in attributes.items()])


RAW = "height long, block_timestamp long, event_idx long, type string, attributes array<struct<key:string,value:string>>"


def test_decode_and_fold(spark):
    events = spark.createDataFrame(
        [
            raw(1, 0, "add_liquidity", pool="BTC.BTC", liquidity_provider_units="10", rune_address="r", rune_amount="1000", asset_amount="100", THOR_txid="t", BTC_txid="b"),
            raw(2, 0, "swap", pool="BTC.BTC", coin="100 THOR.RUNE", emit_asset="9 BTC.BTC", id="s", chain="ETH", **{"from": "AbC", "to": "X"}, liquidity_fee="1", liquidity_fee_in_rune="2"),
            raw(2, 1, "swap", pool="BTC.BTC", coin="x THOR.RUNE", emit_asset="9 BTC.BTC", id="bad"),
            raw(2, 2, "swap", pool="BTC.BTC", coin="1 THOR.RUNE", emit_asset="9 THOR.RUNE", id="same"),
            raw(3, 0, "rewards", bond_reward="7", **{"BTC.BTC": "50", "ETH.ETH": "5"}),
            raw(3, 1, "fee", tx_id="s", coins="4 BTC/BTC", pool_deduct="6"),
            raw(4, 0, "pool", pool="BTC.BTC", pool_status="Suspended"),
            raw(5, 0, "donate", pool="BTC.BTC", coin="8 BTC.BTC", id="d"),
            raw(5, 1, "mystery"), raw(5, 2, "tx"),
        ],
        RAW,
    )
    tables = decode.decode_all(events)
    swap_row = tables["swap_events"].collect()
    assert [(r["tx"], r["_direction"], r["from_addr"], r["to_e8"], r["liq_fee_in_rune_e8"]) for r in swap_row] == [("s", 0, "abc", 9, 2)]
    assert tuple(tables["stake_events"].select("rune_tx", "asset_tx", "asset_chain").first()) == ("t", "b", "BTC")
    assert tables["rewards_events"].first()["bond_e8"] == 7 and tables["rewards_event_entries"].count() == 2
    assert sorted(r["type"] for r in decode.dead_letters(events).collect()) == ["mystery", "swap", "swap"]
    used = {k: tables[k] for k in ("stake_events", "swap_events", "rewards_event_entries", "fee_events", "pool_events")}
    used["add_events"] = tables["add_events"].withColumn("rune_e8", F.coalesce("rune_e8", F.lit(0)))
    got = depths.block_depths(depths.depth_effects(used)).filter("pool = 'BTC.BTC'").orderBy("block_timestamp").collect()
    assert [tuple(r)[1:] for r in got] == [(NS, 100, 1000, 0), (2 * NS, 91, 1100, 0), (3 * NS, 91, 1144, -4), (4 * NS, 0, 0, -4), (5 * NS, 8, 0, -4)]
    gone = spark.createDataFrame([(2, "swap", "s")], "height long, type string, tx string")
    patch = spark.createDataFrame([(5, "d", "coin", "80 BTC.BTC")], "height long, tx string, key string, value string")
    fixed = decode.decode_all(decode.corrected(events, discard=gone, patches=patch))
    assert fixed["swap_events"].count() == 0 and fixed["add_events"].first()["asset_e8"] == 80


def test_swap_usd_price(spark):
    running = spark.createDataFrame([("p", NS, 0, 10, 20), ("p", 2 * NS, 0, 9, 22), ("p", 2 * NS, 1, 8, 24)], "pool string, block_timestamp long, event_idx long, asset_e8 long, rune_e8 long")
    prices = spark.createDataFrame([("p", NS, 6.0), ("p", 2 * NS, 9.0)], "pool string, block_timestamp long, priceusd double")
    df = swaps_of(spark, [swap(1, 0, 1, 1, 0, pool="p", idx=0), swap(2, 0, 1, 1, 0, pool="p", idx=1)])
    got = {r["block_timestamp"] // NS: r["priceusd"] for r in depths.swap_usd_prices(df, running, prices).collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(6.0 / (22 / 9))


def test_assets(spark):
    assert [one(spark, assets.coin_type(F.lit(a))) for a in ("THOR.RUNE", "BTC/BTC", "BTC.BTC", "x")] == ["rune", "synth", "native", "unknown"]
    assert tuple(one(spark, assets.asset_parts(F.lit("ETH.USDT-0X1-2")))) == ("ETH", "USDT", "0X1-2") and tuple(one(spark, assets.asset_parts(F.lit("X")))) == ("", "X", "")
    assert tuple(one(spark, assets.parse_lower_coin(F.lit("123btc/btc")))) == ("BTC/BTC", 123) and tuple(one(spark, assets.parse_lower_coin(F.lit("5rune")))) == ("THOR.RUNE", 5)
    assert [c["e8"] for c in one(spark, assets.parse_coin_list(F.lit("1 A.A, 2 B.B")))] == [1, 2]
    assert one(spark, assets.sanitised(F.lit(b"ok"))) == "ok" and one(spark, assets.sanitised(F.lit(b"\xff"))) == "BASE64:/w=="
    assert one(spark, assets.address_is_rune(F.lit("tthor1x"))) and not one(spark, assets.address_is_rune(F.lit("bnb1")))
    assert one(spark, assets.affiliate(F.lit("=:a:me:1:me:10"), F.lit("me")))["address"] is None
    assert one(spark, decode.unwrap_base64(F.lit("aGVsbG8="))) == "hello" and one(spark, decode.unwrap_base64(F.lit("no!"))) == decode.NO_BASE64 + "no!"


def test_bond_metrics(spark):
    df = spark.createDataFrame([("Active", b) for b in (5, 1, 3, 10)] + [("Standby", b) for b in (2, 8, 9)] + [("Disabled", 1)], "status string, bond long")
    got = {r["status"]: tuple(r)[1:] for r in pricing.bond_metrics(df, 5).collect()}
    assert got == {"Active": (19, 1, 10, 4, 5), "Standby": (19, 8, 9, 6, 8)}


def test_nodes_and_lookup(spark):
    keys = spark.createDataFrame([("n1", "s1", "e1", "v", 1), ("n2", "s1", "e2", "v", 2)], "node_addr string, secp256k1 string, ed25519 string, validator_consensus string, block_timestamp long")
    assert {(r["kind"], r["key"]): r["node_addr"] for r in lookups.node_keys(keys, 5).collect()} == {("secp256k1", "s1"): "n2", ("ed25519", "e1"): "n1", ("ed25519", "e2"): "n2"}
    assert schemas.schema_hash() == schemas.schema_hash() and len(schemas.table_names()) == 33


def test_every_event_is_asked_for_its_previous_depth(spark):
    rng = random.Random(9)
    left = [(rng.choice("abc"), k, rng.randrange(500)) for k in range(400)]
    right = sorted({(rng.choice("ab"), rng.randrange(500)) for _ in range(80)})
    right = [(p, t, k) for k, (p, t) in enumerate(right)]
    got = asof.as_of_join(
        spark.createDataFrame(left, "pool string, event_id long, block_timestamp long"),
        spark.createDataFrame(right, "pool string, block_timestamp long, asset_e8 long"), ["pool"], ["asset_e8"],
    )
    want = {k: max(((u, v) for q, u, v in right if q == p and u <= t), default=(0, None))[1] for p, k, t in left}
    assert {r["event_id"]: r["asset_e8"] for r in got.collect()} == want and got.count() == len(left)


def test_running_sums_with_resets_in_slices(spark):
    import random

    from poolscope.operators import asof

    rng, rows = random.Random(9), []
    for pool in "ab":
        for i in range(300):
            rows.append((pool, rng.randrange(40) * asof.SLICE_NANOS // 7, i, rng.randrange(-9, 10), rng.randrange(5), rng.random() < 0.05))
    df = spark.createDataFrame(rows, "pool string, block_timestamp long, event_idx long, x long, y long, reset boolean").repartition(4)
    got = asof.running(df, ["pool"], ["block_timestamp", "event_idx"], ["x"], F.col("reset"), ["y"])
    got = {(r["pool"], r["event_idx"]): (r["x"], r["y"]) for r in got.collect()}
    want = {}
    for pool in "ab":
        x = y = 0
        for _, t, i, dx, dy, reset in sorted(r for r in rows if r[0] == pool):
            x, y = (0 if reset else x + dx), y + dy
            want[pool, i] = (x, y)
    assert got == want


def test_suspended_pool_starts_anew(spark):
    from poolscope.operators import asof, depths

    day = asof.SLICE_NANOS
    rows = [("p", 10, 20, 0, False, 1, 5), ("p", 0, 0, 0, True, 2, day + 5), ("p", 3, 4, 1, False, 3, 3 * day), ("p", 0, 0, 0, False, 4, 4 * day)]
    df = spark.createDataFrame(rows, "pool string, asset long, rune long, synth long, reset boolean, event_idx long, block_timestamp long")
    got = [tuple(r)[1:] for r in depths.block_depths(df).orderBy("block_timestamp").collect()]
    assert got == [(5, 10, 20, 0), (day + 5, 0, 0, 0), (3 * day, 3, 4, 1)]


def test_requests_that_cannot_be_answered():
    from poolscope.operators import buckets

    bad = [{"count": 3}, {"interval": "hours"}, {"interval": "day", "count": 401}, {"interval": "day", "count": 1, "start": 1, "until": 2}, {"interval": "5min", "start": 0, "until": 10**9}]
    for request in bad:
        with pytest.raises(buckets.BadRequest):
            buckets.resolve(0, 10**9, **request)


def test_block_depths_order_sums_of_blocks_only(spark):
    import random

    from poolscope.operators import asof, depths

    rng, rows = random.Random(4), []
    for pool in "ab":
        for i in range(600):
            rows.append((pool, rng.randrange(-9, 10), rng.randrange(5), rng.randrange(3), rng.random() < 0.03, i, rng.randrange(60) * asof.SLICE_NANOS // 7))
    df = spark.createDataFrame(rows, "pool string, asset long, rune long, synth long, reset boolean, event_idx long, block_timestamp long").repartition(5)
    want = []
    for pool in "ab":
        now, ends = (0, 0, 0), {}
        for _, a, r, s, reset, _, t in sorted((x for x in rows if x[0] == pool), key=lambda x: (x[6], x[5])):
            now = (0, 0, now[2] + s) if reset else (now[0] + a, now[1] + r, now[2] + s)
            ends[t] = now
        before = (0, 0, 0)
        for t, d in sorted(ends.items()):
            want += [(pool, t, *d)] if d != before else []
            before = d
    assert sorted(map(tuple, depths.block_depths(df).collect())) == want
    sums = depths.block_effects(df)
    assert sums.filter("not reset").count() == len({(x[0], x[6]) for x in rows}) and sums.filter("reset").count() <= 120


def test_dead_letters_make_attributes_once_an_event(spark):
    """A filter on the reason that moves below the attributes makes them anew for every field."""
    text = F.concat(F.lit("made "), F.col("id").cast("string"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("swap_slip", text), ("coin", text), ("memo", text))])
    events = spark.range(4).select(
        F.col("id").alias("height"), F.col("id").alias("block_timestamp"), F.lit(0).cast("long").alias("event_idx"),
        F.when(F.col("id") == 0, "swap").when(F.col("id") == 1, "tx").when(F.col("id") == 2, "message").otherwise("mystery").alias("type"), pairs.alias("attributes"),
    )
    got = decode.dead_letters(events)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("made ") <= 3
    assert {r["height"]: r["malformed"] for r in got.collect()} == {0: ["from_asset,from_e8", "swap_slip_bp", "direction"], 3: ["unknown type"]}
