"""Pool depths as an ordered fold of event effects, per pool, without loops over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.functions import pricing
from poolscope.functions.assets import ASSET_TO_RUNE, RUNE_TO_ASSET, RUNE_TO_SYNTH, SYNTH_TO_RUNE, coin_type, is_rune, native_asset
from poolscope.functions.numeric import ieee_div
from poolscope.operators.asof import as_of_join, previous, running

EFFECT = ["pool", "asset", "rune", "synth", "reset", "event_idx", "block_timestamp"]


def _effect(df: DataFrame, pool: Column, asset=None, rune=None, synth=None, reset=None) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.select(
        pool.alias("pool"),
        *[F.coalesce(x if x is not None else zero, zero).cast("long").alias(n) for n, x in (("asset", asset), ("rune", rune), ("synth", synth))],
        (reset if reset is not None else F.lit(False)).alias("reset"), "event_idx", "block_timestamp",
    )


def depth_effects(t: dict[str, DataFrame]) -> DataFrame:
    """What each event adds to its pool's balances; a suspended pool is reset to zero asset and rune."""
    c = F.col
    makers = {
        "add_events": lambda d: _effect(d, c("pool"), c("asset_e8"), c("rune_e8")),
        "stake_events": lambda d: _effect(d, c("pool"), c("asset_e8"), c("rune_e8")),
        "errata_events": lambda d: _effect(d, c("asset"), c("asset_e8"), c("rune_e8")),
        "gas_events": lambda d: _effect(d, c("asset"), -c("asset_e8"), c("rune_e8")),
        "rewards_event_entries": lambda d: _effect(d, c("pool"), rune=c("rune_e8")),
        "unstake_events": lambda d: _effect(
            d, c("pool"), -c("emit_asset_e8"), F.coalesce(c("imp_loss_protection_e8"), F.lit(0)) - c("emit_rune_e8")
        ),
        "fee_events": lambda d: _effect(
            d.filter(~is_rune(c("asset"))), native_asset(c("asset")),
            F.when(coin_type(c("asset")) == "native", c("asset_e8")), -c("pool_deduct"),
            F.when(coin_type(c("asset")) == "synth", -c("asset_e8")),
        ),
        "slash_amounts": lambda d: _effect(
            d, c("pool"), F.when(~is_rune(c("asset")), c("asset_e8")), F.when(is_rune(c("asset")), c("asset_e8"))
        ),
        "pool_balance_change_events": lambda d: _effect(
            d, c("asset"), F.when(c("asset_add"), c("asset_amt")).otherwise(-c("asset_amt")),
            F.when(c("rune_add"), c("rune_amt")).otherwise(-c("rune_amt")),
        ),
        "pool_events": lambda d: _effect(d.filter(F.lower("status") == "suspended"), c("asset"), reset=F.lit(True)),
        "swap_events": lambda d: _effect(
            d, c("pool"),
            F.when(c("_direction") == RUNE_TO_ASSET, -c("to_e8")).when(c("_direction") == ASSET_TO_RUNE, c("from_e8")),
            F.when(c("_direction") % 2 == 0, c("from_e8")).otherwise(-c("to_e8")),
            F.when(c("_direction") == RUNE_TO_SYNTH, c("to_e8")).when(c("_direction") == SYNTH_TO_RUNE, -c("from_e8")),
        ),
    }
    parts = [make(t[name]) for name, make in makers.items() if name in t]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def running_depths(effects: DataFrame) -> DataFrame:
    """Balances right after each effect: running sums that start anew at each reset (synths run on)."""
    return _running(effects).select("pool", "block_timestamp", "event_idx", *BALANCES)


BALANCES = ["asset_e8", "rune_e8", "synth_e8"]


def _running(effects: DataFrame) -> DataFrame:
    """running_depths with slice and opening."""
    sums = effects.withColumnsRenamed({"asset": "asset_e8", "rune": "rune_e8", "synth": "synth_e8"})
    return running(sums, ["pool"], ["block_timestamp", "event_idx"], BALANCES[:2], F.col("reset"), BALANCES[2:])


def block_effects(effects: DataFrame) -> DataFrame:
    """Effects summed by block, in partial sums without order; of a block with resets a reset, then what came after its last one."""
    block = ["pool", "block_timestamp"]
    resets = effects.filter("reset").groupBy(*block).agg(F.max("event_idx").alias("__reset"))
    counts = F.col("__reset").isNull() | (F.col("event_idx") > F.col("__reset"))
    since = [F.sum(F.when(counts, F.col(c)).otherwise(0)).alias(c) for c in ("asset", "rune")]
    sums = effects.join(resets, block, "left").groupBy(*block).agg(*since, F.sum("synth").alias("synth"))
    zeros = [F.lit(0).cast("long").alias(c) for c in ("asset", "rune", "synth")]
    anew = resets.select("pool", *zeros, F.lit(True).alias("reset"), F.lit(0).cast("long").alias("event_idx"), "block_timestamp")
    return sums.withColumns({"reset": F.lit(False), "event_idx": F.lit(1).cast("long")}).select(*EFFECT).unionByName(anew)


def block_depths(effects: DataFrame) -> DataFrame:
    """Balances at the end of each block that changed them: one row per (pool, block), only where a value differs."""
    last = F.max_by(F.struct("asset_e8", "rune_e8", "synth_e8"), "event_idx")
    rows = _running(block_effects(effects)).groupBy("pool", "slice", "block_timestamp").agg(last.alias("d"), F.first("opening").alias("opening"))
    before = F.coalesce(F.lag("d").over(Window.partitionBy("pool", "slice").orderBy("block_timestamp")), F.col("opening"))
    return rows.withColumn("before", before).filter("d <> before").select("pool", "block_timestamp", "d.*")


def swap_usd_prices(swaps: DataFrame, running: DataFrame, block_prices: DataFrame) -> DataFrame:
    """Swaps with priceusd: the pool's USD price after the block before, over its price just before the swap.

    running: balances after each effect; block_prices: (pool, block_timestamp, priceusd) per block. Unknown prices
    count as 0. Both lookups are ordered within slices of time.
    """
    before = running.select("pool", "block_timestamp", "event_idx", pricing.asset_price(F.col("asset_e8"), F.col("rune_e8")).alias("price"))
    before = previous(before, ["pool"], ["block_timestamp", "event_idx"], "price", "price_before").drop("price")
    known_prices = block_prices.select("pool", "block_timestamp", "priceusd").filter("priceusd is not null")
    usd = as_of_join(swaps.select("pool", "block_timestamp").distinct(), known_prices, ["pool"], ["priceusd"], strict=True)
    usd = usd.withColumnRenamed("priceusd", "usd_before")
    rows = swaps.drop("priceusd").join(before, ["pool", "block_timestamp", "event_idx"], "left").join(usd, ["pool", "block_timestamp"], "left")
    value = ieee_div(F.col("usd_before"), F.col("price_before"))
    known = F.col("usd_before").isNotNull() & ~F.isnan("usd_before") & F.col("price_before").isNotNull() & ~F.isnan("price_before")
    return rows.withColumn("priceusd", F.when(known, value).otherwise(F.lit(0.0))).drop("usd_before", "price_before")
