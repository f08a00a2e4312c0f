"""Histories: swaps, depths, candles, earnings, liquidity, locked value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.functions import pricing
from poolscope.functions.assets import like_any
from poolscope.functions.numeric import NANOS, rint_long
from poolscope.operators.asof import as_of, locf, running_total, weighted_average, zero_fill
from poolscope.operators.buckets import Buckets
from poolscope.operators.rollup import Aggregate

DIRECTIONS = {0: "to_asset", 1: "to_rune", 2: "to_synth", 3: "synth_to_rune"}


def swaps_aggregate(keys: list[str] | None = None) -> Aggregate:
    """Count, volume in the base asset, fees, slips and USD volume per pool and direction."""
    to_rune = F.col("_direction") % 2 == 1
    volume = F.when(to_rune, F.col("to_e8") + F.col("liq_fee_in_rune_e8")).otherwise(F.col("from_e8"))
    return (
        Aggregate("swaps", keys or ["pool", "_direction"])
        .sum("swap_count", F.lit(1))
        .sum("volume_e8", volume)
        .sum("volume_usd", rint_long(F.col("from_e8") * F.col("priceusd")))
        .sum("fees_e8", F.col("liq_fee_in_rune_e8"))
        .sum("slip_bp", F.col("swap_slip_bp"))
    )


def marked_swaps(swaps: DataFrame, patterns: list[tuple[str, int | None]]) -> DataFrame:
    """Swaps whose memo carries one of the given marks."""
    return swaps.filter(like_any(F.col("memo"), F.col("block_timestamp"), patterns))


def swap_history(swaps: DataFrame, buckets: Buckets, pool: str | None = None, rollups: dict | None = None) -> DataFrame:
    """Count, volume, fees and mean slip per direction, and totals, of every bucket."""
    rows = swaps if pool is None else swaps.filter(F.col("pool") == pool)
    sums = swaps_aggregate().query(rows, buckets, rollups)
    measures = ["swap_count", "volume_e8", "volume_usd", "fees_e8", "slip_bp"]
    columns = []
    for direction, name in DIRECTIONS.items():
        mine = F.col("_direction") == direction
        columns += [F.sum(F.when(mine, F.col(m))).alias(f"{name}_{m}") for m in measures]
    columns += [F.sum(m).alias(f"total_{m}") for m in measures]
    wide = sums.groupBy("start_s").agg(*columns)
    dense = zero_fill(wide, buckets, [c for c in wide.columns if c != "start_s"])
    for name in [*DIRECTIONS.values(), "total"]:
        n = F.col(f"{name}_swap_count")
        slip = F.when(n > 0, F.try_divide(F.col(f"{name}_slip_bp").cast("double"), n)).otherwise(0.0)
        dense = dense.withColumn(f"{name}_average_slip", slip).drop(f"{name}_slip_bp")
    return dense


def history_meta(history: DataFrame, sums: list[str]) -> DataFrame:
    """One row over all buckets: first start, last end, and the sums."""
    return history.agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), *[F.sum(c).alias(c) for c in sums])


def depths_aggregate() -> Aggregate:
    return (
        Aggregate("pool_depths", ["pool"])
        .last("asset_e8")
        .last("rune_e8")
        .last("synth_e8")
        .last("priceusd")
        .first("first_priceusd", F.col("priceusd"))
        .max("max_priceusd", F.col("priceusd"))
        .min("min_priceusd", F.col("priceusd"))
        .first("first_block_timestamp", F.col("block_timestamp"))
        .last("last_block_timestamp", F.col("block_timestamp"))
    )


DEPTHS = ["asset_e8", "rune_e8", "synth_e8"]


def depth_history(depths: DataFrame, buckets: Buckets, pools: list[str] | None = None) -> DataFrame:
    """Depths of each pool at the end of each bucket, carried forward; 0 before the first."""
    rows = depths if pools is None else depths.filter(F.col("pool").isin(pools))
    seed = as_of(rows, ["pool"], buckets.start * NANOS, DEPTHS, inclusive=False).select("pool", *DEPTHS)
    if buckets.interval is None:
        end = as_of(rows, ["pool"], buckets.end * NANOS, DEPTHS, inclusive=False)
        series = end.select(F.lit(buckets.start).cast("long").alias("start_s"), "pool", *DEPTHS)
    else:
        agg = Aggregate("ends", ["pool"])
        for name in DEPTHS:
            agg.last(name)
        series = agg.query(rows, buckets)
    dense = locf(series, seed, buckets, ["pool"], DEPTHS)
    return dense.select("start_s", "end_s", "pool", *[F.coalesce(c, F.lit(0)).alias(c) for c in DEPTHS])


def unit_changes(stakes: DataFrame, unstakes: DataFrame) -> DataFrame:
    """(pool, block_timestamp, units): LP units gained and lost."""
    gained = stakes.select("pool", "block_timestamp", F.col("stake_units").alias("units"))
    return gained.unionByName(unstakes.select("pool", "block_timestamp", (-F.col("stake_units")).alias("units")))


def unit_history(changes: DataFrame, buckets: Buckets) -> DataFrame:
    """LP units of each pool at the end of each bucket."""
    t = F.col("block_timestamp")
    before = changes.filter(t < buckets.start * NANOS).groupBy("pool").agg(F.sum("units").alias("units"))
    inside = changes.filter(buckets.holds(t)).groupBy(buckets.start_of(t).alias("start_s"), "pool").agg(F.sum("units").alias("units"))
    return running_total(inside, before, buckets, "units", ["pool"])


def pool_history(depths: DataFrame, changes: DataFrame, usd: DataFrame, buckets: Buckets, pool: str) -> DataFrame:
    """Depths, price, USD price, units and luvi of one pool per bucket; usd: (start_s, rune_price_usd)."""
    rows = depth_history(depths, buckets, [pool]).join(
        unit_history(changes.filter(F.col("pool") == pool), buckets), ["start_s", "end_s", "pool"], "left"
    )
    rows = rows.join(usd, "start_s", "left").withColumn("units", F.coalesce("units", F.lit(0)))
    a, r, s, u = (F.col(c) for c in (*DEPTHS, "units"))
    synth = pricing.synth_units(a, s, u)
    price = pricing.asset_price(a, r)
    return rows.select(
        "start_s", "end_s", "pool", *DEPTHS, price.alias("asset_price"),
        (price * F.coalesce("rune_price_usd", F.lit(float("nan")))).alias("asset_price_usd"),
        u.alias("lp_units"), synth.alias("synth_units"), (u + synth).alias("units"), pricing.luvi(a, r, u + synth).alias("luvi"),
    )


def usd_history(depths: DataFrame, buckets: Buckets, usd_pools: list[str]) -> DataFrame:
    """(start_s, rune_price_usd) at the end of each bucket, NaN where no listed pool has a depth."""
    rows = depth_history(depths, buckets, usd_pools)
    prices = pricing.rune_usd_price(rows, usd_pools, ["start_s"])
    return buckets.frame(depths.sparkSession).select("start_s").join(prices, "start_s", "left").select(
        "start_s", F.coalesce("rune_price_usd", F.lit(float("nan"))).alias("rune_price_usd")
    )


def candles(depths: DataFrame, buckets: Buckets, pool: str) -> DataFrame:
    """Open, high, low and close of a pool's price per bucket, with the times of high and low.

    An extreme's time is the start of the first five minutes that attain it, not before the bucket's start. Buckets
    before the first value are zero; later empty ones repeat the candle before.
    """
    t = F.col("block_timestamp")
    rows = depths.filter((F.col("pool") == pool) & buckets.holds(t))
    price, five = pricing.asset_price(F.col("asset_e8"), F.col("rune_e8")), F.call_function("div", t, F.lit(300 * NANOS)) * 300
    start = buckets.start_of(t)
    order = F.struct(t, F.col("event_idx")) if "event_idx" in depths.columns else t
    rows = rows.select("pool", start.alias("start_s"), price.alias("p"), F.greatest(five, start).alias("five"), order.alias("o"), *DEPTHS)
    grouped = rows.groupBy("start_s", "pool").agg(
        F.min_by("p", "o").alias("open"),
        F.max_by("p", "o").alias("close"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("five", F.struct("p", -F.col("five"))).alias("high_s"),
        F.min_by("five", F.struct("p", "five")).alias("low_s"),
    )
    values = ["open", "high", "low", "close", "high_s", "low_s"]
    dense = locf(grouped, grouped.limit(0).select("pool", *values), buckets, ["pool"], values)
    return dense.select("start_s", "end_s", "pool", *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def ohlcv(depths: DataFrame, swaps: DataFrame, buckets: Buckets, pool: str, usd_pools: list[str]) -> DataFrame:
    """Candles with the swap volume of each bucket and the pool's liquidity in USD at its end, truncated.

    Liquidity is asset depth at the closing price plus base-asset depth at its USD price, 0 where there is no USD price.
    """
    rows = candles(depths, buckets, pool)
    volume = swap_history(swaps, buckets, pool).select("start_s", F.col("total_volume_e8").alias("volume"))
    ends = depth_history(depths, buckets, [pool]).select("start_s", *DEPTHS[:2])
    usd = usd_history(depths, buckets, usd_pools)
    rows = rows.join(volume, "start_s", "left").join(ends, "start_s", "left").join(usd, "start_s", "left")
    value = F.col("asset_e8") * F.col("close") + F.col("rune_e8") * F.col("rune_price_usd")
    liquidity = F.when(F.isnan(value) | value.isNull(), F.lit(0)).otherwise(value.cast("long"))
    return rows.select("start_s", "end_s", "pool", "open", "high", "low", "close", "high_s", "low_s", "volume", liquidity.alias("liquidity"))


def earnings_history(
    swaps: DataFrame, rewards: DataFrame, entries: DataFrame, node_changes: DataFrame, active_before: int | Column, buckets: Buckets
) -> DataFrame:
    """Fees, rewards, earnings and average node count per bucket; node_changes: (block_timestamp, delta)."""
    t = F.col("block_timestamp")
    per = lambda df, value, name: df.filter(buckets.holds(t)).groupBy(buckets.start_of(t).alias("start_s")).agg(F.sum(value).alias(name))
    parts = [
        per(swaps, "liq_fee_in_rune_e8", "liquidity_fees"),
        per(entries, "rune_e8", "pool_rewards"),
        per(rewards, "bond_e8", "bonding_earnings"),
    ]
    out = buckets.frame(swaps.sparkSession).drop("idx")
    for part in parts:
        out = out.join(part, "start_s", "left")
    names = ["liquidity_fees", "pool_rewards", "bonding_earnings"]
    out = out.select("start_s", "end_s", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    nodes = weighted_average(node_changes, active_before, buckets).select("start_s", F.col("average").alias("avg_node_count"))
    liquidity = F.col("pool_rewards") + F.col("liquidity_fees")
    return out.join(nodes, "start_s", "left").select(
        "start_s", "end_s", "liquidity_fees", "bonding_earnings",
        (F.col("pool_rewards") + F.col("bonding_earnings")).alias("block_rewards"),
        liquidity.alias("liquidity_earnings"), (liquidity + F.col("bonding_earnings")).alias("earnings"), "avg_node_count",
    )


def pool_earnings(swaps: DataFrame, entries: DataFrame, buckets: Buckets) -> DataFrame:
    """Fees, rewards and earnings per bucket and pool; every pool seen in the range appears in every bucket."""
    t = F.col("block_timestamp")
    at = buckets.start_of(t).alias("start_s")
    zero = F.lit(0).cast("long")
    inside = swaps.filter(buckets.holds(t)).select(at, "pool", F.col("liq_fee_in_rune_e8").alias("fees"), zero.alias("rewards"))
    inside = inside.unionByName(entries.filter(buckets.holds(t)).select(at, "pool", zero.alias("fees"), F.col("rune_e8").alias("rewards")))
    sums = inside.groupBy("start_s", "pool").agg(F.sum("fees").alias("fees"), F.sum("rewards").alias("rewards"))
    dense = zero_fill(sums, buckets, ["fees", "rewards"], sums.select("pool").distinct())
    return dense.withColumn("earnings", F.col("fees") + F.col("rewards"))


def liquidity_history(stakes: DataFrame, unstakes: DataFrame, buckets: Buckets, pool: str | None = None) -> DataFrame:
    """Adds and withdraws per bucket: amounts, counts and their value in the base asset."""
    t = F.col("block_timestamp")

    def sums(df, prefix, asset, value, rune):
        rows = df.filter(buckets.holds(t))
        rows = rows if pool is None else rows.filter(F.col("pool") == pool)
        return rows.groupBy(buckets.start_of(t).alias("start_s")).agg(
            F.count(F.lit(1)).alias(f"{prefix}_count"),
            F.sum(value).alias(f"{prefix}_asset_volume"),
            F.sum(rune).alias(f"{prefix}_rune_volume"),
        )

    added = sums(stakes, "add", "asset_e8", "_asset_in_rune_e8", "rune_e8")
    taken = sums(unstakes, "withdraw", "emit_asset_e8", "_emit_asset_in_rune_e8", "emit_rune_e8")
    names = [f"{p}_{c}" for p in ("add", "withdraw") for c in ("count", "asset_volume", "rune_volume")]
    out = buckets.frame(stakes.sparkSession).drop("idx").join(added, "start_s", "left").join(taken, "start_s", "left")
    out = out.select("start_s", "end_s", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    net = F.col("add_asset_volume") + F.col("add_rune_volume") - F.col("withdraw_asset_volume") - F.col("withdraw_rune_volume")
    return out.withColumn("net", net)


def tvl_history(depths: DataFrame, buckets: Buckets) -> DataFrame:
    """Twice the summed base-asset depth of all pools at the end of each bucket."""
    rows = depth_history(depths, buckets)
    sums = rows.groupBy("start_s", "end_s").agg((2 * F.sum("rune_e8")).alias("total_pooled"))
    frame = buckets.frame(depths.sparkSession).drop("idx")
    return frame.join(sums, ["start_s", "end_s"], "left").select("start_s", "end_s", F.coalesce("total_pooled", F.lit(0)).alias("total_pooled"))


def bond_change(bonds: DataFrame) -> DataFrame:
    """(block_timestamp, delta): paid and reward count up, returned and cost down."""
    kind = F.col("bond_type")
    sign = F.when(kind.isin("bond_paid", "bond_reward"), 1).when(kind.isin("bond_returned", "bond_cost"), -1).otherwise(0)
    return bonds.select("block_timestamp", (sign * F.col("e8")).alias("delta"))


def bond_history(bonds: DataFrame, buckets: Buckets) -> DataFrame:
    """Total bond at the end of each bucket."""
    t, one = F.col("block_timestamp"), F.lit("all").alias("what")
    changes = bond_change(bonds)
    before = changes.filter(t < buckets.start * NANOS).groupBy(one).agg(F.sum("delta").alias("bond"))
    inside = changes.filter(buckets.holds(t)).groupBy(buckets.start_of(t).alias("start_s"), one).agg(F.sum("delta").alias("bond"))
    return running_total(inside, before, buckets, "bond", ["what"]).select("start_s", "end_s", "bond")


