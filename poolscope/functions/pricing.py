"""Prices, units and yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.functions.numeric import ieee_div, int_div

YEAR_NANOS = 365 * 24 * 60 * 60 * 10**9


def asset_price(asset_e8: Column, rune_e8: Column) -> Column:
    """Base asset per pool asset; 0 for an empty pool."""
    return F.when(asset_e8 == 0, F.lit(0.0)).otherwise(ieee_div(rune_e8, asset_e8))


def synth_units(asset_e8: Column, synth_e8: Column, units: Column) -> Column:
    """units * synth / (2 * asset - synth), truncated; 0 where either depth or divisor is 0.

    Null if the result leaves 64 bits.
    """
    product = units.cast("decimal(19,0)") * synth_e8.cast("decimal(19,0)")
    divisor = asset_e8.cast("decimal(19,0)") * F.lit(2).cast("decimal(10,0)") - synth_e8.cast("decimal(19,0)")
    guarded = F.when(divisor != 0, divisor)
    exact = int_div(product.cast("decimal(38,0)"), guarded.cast("decimal(38,0)"))
    fits = F.abs(product.cast("double")) < F.abs(guarded.cast("double")) * F.lit(9.2e18)
    return F.when((asset_e8 == 0) | (divisor == 0), F.lit(0).cast("long")).when(fits, exact)


def luvi(asset_e8: Column, rune_e8: Column, units: Column) -> Column:
    """Liquidity unit value index: sqrt(asset * rune) / units; NaN without units."""
    value = F.sqrt(asset_e8.cast("double") * rune_e8.cast("double"))
    return F.when(units <= 0, F.lit(float("nan"))).otherwise(ieee_div(value, units))


def luvi_of_lp_units(asset_e8: Column, rune_e8: Column, synth_e8: Column, lp_units: Column) -> Column:
    return luvi(asset_e8, rune_e8, lp_units + synth_units(asset_e8, synth_e8, lp_units))


def price_shift_loss(asset0: Column, rune0: Column, asset1: Column, rune1: Column) -> Column:
    ratio = ieee_div(ieee_div(rune1, asset1), ieee_div(rune0, asset0))
    return ieee_div(2 * F.sqrt(ratio), 1 + ratio)


def apr(luvi_now: Column, luvi_before: Column, span_nanos: Column) -> Column:
    return (ieee_div(luvi_now, luvi_before) - 1) * ieee_div(F.lit(float(YEAR_NANOS)), span_nanos)


def floored_apy(value: Column) -> Column:
    """max(value, 0), where NaN counts as 0."""
    return F.when(F.isnan(value) | (value < 0), F.lit(0.0)).otherwise(value)


def compound(rate: Column, periods: Column) -> Column:
    """pow(1 + rate, periods) - 1, linear for at most one period."""
    return F.when(periods > 1, F.pow(1 + rate, periods) - 1).otherwise(rate * periods)


def next_churn_height(height: Column, last_churn: Column, interval: Column, retry: Column) -> Column:
    first = last_churn + interval
    retried = first + retry * (int_div(height - first, retry) + 1)
    return F.when(last_churn < 0, F.lit(-1).cast("long")).when(height < first, first).otherwise(retried)


def block_rewards(emission_curve: Column, blocks_per_year: Column, reserve: Column, pool_share: Column) -> Column:
    """struct(block_reward, bond_reward, pool_reward), each truncated."""
    block = ieee_div(reserve, emission_curve * blocks_per_year)
    bond = (1 - pool_share) * block
    return F.struct(
        block.cast("long").alias("block_reward"), bond.cast("long").alias("bond_reward"), (block - bond).cast("long").alias("pool_reward")
    )


def rune_usd_price(
    depths: DataFrame, usd_pools: list[str], keys: list[str] | None = None, guard_zero: bool = True, kept: list[str] | None = None
) -> DataFrame:
    """USD price of the base asset: the inverse price of the deepest listed pool; the first listed wins ties.

    depths: (keys, pool, asset_e8, rune_e8). With guard_zero a pool of price 0 counts as price 1. Keys without a listed
    pool have no row; join them from the left and read null as NaN. kept are columns of that pool to bring along.
    """
    place = F.array_position(F.lit(usd_pools), F.col("pool"))
    price = asset_price(F.col("asset_e8"), F.col("rune_e8"))
    # the quotient itself: the inverse of a rounded price can differ in its last digits
    inverse = F.when(price != 0, ieee_div(F.col("asset_e8"), F.col("rune_e8"))).otherwise(F.lit(1.0 if guard_zero else float("inf")))
    best = F.max_by(F.struct(inverse.alias("rune_price_usd"), *(kept or [])), F.struct("rune_e8", -place))
    listed = depths.filter(F.col("pool").isin(usd_pools) & (F.col("rune_e8") > -1))
    return listed.groupBy(*(keys or [])).agg(best.alias("best")).select(*(keys or []), "best.*")


def with_usd_price(depths: DataFrame, usd: DataFrame, keys: list[str]) -> DataFrame:
    """Adds price and priceusd of each pool; NaN without a USD price."""
    price = asset_price(F.col("asset_e8"), F.col("rune_e8"))
    joined = depths.join(usd, keys, "left").withColumn("price", price)
    return joined.withColumn("priceusd", F.col("price") * F.coalesce("rune_price_usd", F.lit(float("nan")))).drop("rune_price_usd")


#: Bins into which each round of a rank selection divides what is left.
BINS = 1024


def kth_values(rows: DataFrame, key: str, value: str, rank: Column) -> DataFrame:
    """(key, kth): of each key's sorted values that at a rank, which is a column of the count n, from 0.

    Two rounds count values in equal bins of what is left of their range and keep the bin that holds the rank; only
    the values of that last bin, each once, are ordered.
    """
    left = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("times"))
    asked = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"))
    asked = asked.select(key, "low", "high", rank.cast("long").alias("rank"))
    for _ in range(2):
        width = F.call_function("div", F.col("high") - F.col("low"), F.lit(BINS)) + 1
        at = F.call_function("div", F.col(value) - F.col("low"), width)
        inside = left.join(asked, key).filter(F.col(value).between(F.col("low"), F.col("high")))
        bins = inside.groupBy(key, "low", "high", "rank", at.alias("bin")).agg(F.sum("times").alias("times"))
        upto = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("times").over(upto)).withColumn("before", F.col("upto") - F.col("times"))
        low = F.col("low") + F.col("bin") * width
        hit = (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto"))
        asked = bins.filter(hit).select(key, low.alias("low"), F.least(low + width - 1, F.col("high")).alias("high"), (F.col("rank") - F.col("before")).alias("rank"))
    inside = left.join(asked, key).filter(F.col(value).between(F.col("low"), F.col("high")))
    upto = F.sum("times").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("upto", upto).filter(F.col("upto") > F.col("rank")).groupBy(key).agg(F.min(value).alias("kth"))


def bond_metrics(nodes: DataFrame, minimum_eligible: int) -> DataFrame:
    """Order statistics of bonds of active and standby nodes; nodes: (status, bond).

    Average is an integer division, median the element n // 2 of the sorted bonds; the standby minimum is the smallest
    bond that is eligible, else the smallest. The median comes of a rank selection, so no status is sorted in one task.
    """
    rows = nodes.filter(F.col("status").isin("Active", "Standby"))
    eligible = F.when(F.col("bond") >= minimum_eligible, F.col("bond"))
    sums = rows.groupBy("status").agg(
        F.sum("bond").alias("total"),
        F.when(F.first("status") == "Standby", F.coalesce(F.min(eligible), F.min("bond"))).otherwise(F.min("bond")).alias("minimum"),
        F.max("bond").alias("maximum"),
        int_div(F.sum("bond"), F.count(F.lit(1))).alias("average"),
    )
    median = kth_values(rows.filter("bond is not null"), "status", "bond", F.floor(F.col("n") / 2))
    return sums.join(median.withColumnRenamed("kth", "median"), "status", "left")
