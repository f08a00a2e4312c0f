"""Point lookups and snapshots: pools, nodes, names, constants, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.functions import pricing
from poolscope.functions.numeric import NANOS, ieee_div
from poolscope.operators.asof import as_of, as_of_join, running
from poolscope.operators.buckets import Buckets
from poolscope.operators.history import DEPTHS


def latest(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Newest values of each key."""
    order = F.struct("block_timestamp", "event_idx") if "event_idx" in table.columns else F.col("block_timestamp")
    return table.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("r")).select(*keys, "r.*")


def newest_block(block_log: DataFrame, moment: int | None = None) -> DataFrame:
    """The block at or before a moment."""
    rows = block_log if moment is None else block_log.filter(F.col("timestamp") <= moment)
    return rows.orderBy(F.desc("timestamp")).limit(1)


def last_activation_height(activations: DataFrame, block_log: DataFrame) -> DataFrame:
    """Height of the newest block in which a vault became active, -1 if there is none; one row."""
    newest = activations.agg(F.max("block_timestamp").alias("timestamp"))
    return newest.join(block_log, "timestamp", "left").agg(F.coalesce(F.max("height"), F.lit(-1).cast("long")).alias("height"))


def unique_times(block_log: DataFrame) -> DataFrame:
    """Blocks of one time a nanosecond apart each, in order of height, so that a time names one block.

    Times are in whole microseconds, so up to 1,000 blocks of one stay apart from the next.
    """
    later = F.row_number().over(Window.partitionBy("timestamp").orderBy("height")) - 1
    return block_log.withColumn("timestamp", F.col("timestamp") + later)


def height_nano(heights: DataFrame, block_log: DataFrame) -> DataFrame:
    """Heights with the time of their block in nanoseconds; null for unknown ones."""
    return heights.join(block_log.select("height", "timestamp"), "height", "left")


def pool_state_at_height(depths: DataFrame, block_log: DataFrame, height: int) -> DataFrame:
    """Newest depths of each pool at or before the block of a height."""
    moment = block_log.filter(F.col("height") == height).agg(F.max("timestamp").alias("moment"))
    rows = depths.join(F.broadcast(moment), F.col("block_timestamp") <= F.col("moment"))
    return latest(rows, ["pool"], DEPTHS)


def block_by_id(block_log: DataFrame, number: int) -> DataFrame:
    """The block whose height or timestamp is the number."""
    return block_log.filter((F.col("height") == number) | (F.col("timestamp") == number))


def pool_status(pool_events: DataFrame, pools: DataFrame) -> DataFrame:
    """Newest status of each pool in lower case; `staged` where there is none."""
    status = latest(pool_events.withColumnRenamed("asset", "pool"), ["pool"], ["status"])
    return pools.join(status, "pool", "left").withColumn("status", F.coalesce(F.lower("status"), F.lit("staged")))


def node_status(new_nodes: DataFrame, changes: DataFrame, moment: int) -> DataFrame:
    """Status of each node at a moment; empty for new nodes without a change."""
    known = new_nodes.filter(F.col("block_timestamp") <= moment).select("node_addr")
    changed = as_of(changes, ["node_addr"], moment, ["current"]).select("node_addr", "current")
    names = known.unionByName(changed.select("node_addr")).distinct()
    return names.join(changed, "node_addr", "left").select("node_addr", F.coalesce("current", F.lit("")).alias("status"))


def active_node_count(changes: DataFrame, moment: int) -> DataFrame:
    """Nodes whose newest status at a moment is Active."""
    now = as_of(changes, ["node_addr"], moment, ["current"])
    return now.agg(F.count(F.when(F.col("current") == "Active", 1)).alias("active_nodes"))


def active_node_changes(changes: DataFrame) -> DataFrame:
    """(block_timestamp, delta) of the number of active nodes."""
    delta = F.when(F.col("current") == "Active", 1).otherwise(0) - F.when(F.col("former") == "Active", 1).otherwise(0)
    return changes.select("block_timestamp", delta.cast("long").alias("delta")).filter("delta <> 0")


def node_keys(keys: DataFrame, moment: int) -> DataFrame:
    """Node address of each public key; later rows win."""
    rows = keys.filter(F.col("block_timestamp") <= moment)
    pair = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("secp256k1", "ed25519")]))
    rows = rows.select("node_addr", "block_timestamp", pair.alias("x"))
    return rows.groupBy("x.kind", "x.key").agg(F.max_by("node_addr", F.struct("block_timestamp", "node_addr")).alias("node_addr"))


def name_entries(names: DataFrame) -> DataFrame:
    """Newest row of each (name, chain)."""
    order = ["block_timestamp", *(["event_idx"] if "event_idx" in names.columns else [])]
    rest = [c for c in names.columns if c not in ("name", "chain")]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return names.groupBy("name", "chain").agg(newest.alias("r")).select("name", "chain", "r.*")


def name_owner(names: DataFrame) -> DataFrame:
    """Newest owner and expiry of each name."""
    return latest(names, ["name"], ["owner", "expire"])


def lookup_name(names: DataFrame, name: str, height: int) -> DataFrame:
    """Owner, expiry and current entries of an unexpired name."""
    mine = names.filter(F.col("name") == name)
    owner = name_owner(mine).filter(F.col("expire") > height)
    return owner.join(name_entries(mine).select("name", "chain", "address"), "name").select("name", "owner", "expire", "chain", "address")


def names_of_address(names: DataFrame, address: str | Column, height: int = 0) -> DataFrame:
    """Names whose current entry is the address and which have not expired."""
    current = name_entries(names).filter((F.col("address") == address) & (F.col("expire") > height))
    return current.select("name").distinct()


def names_of_owner(names: DataFrame, owner: str, height: int = 0) -> DataFrame:
    return name_owner(names).filter((F.col("owner") == owner) & (F.col("expire") > height)).select("name")


def constant_value(mimirs: DataFrame, key: str, default: int) -> DataFrame:
    """Newest override of a constant, matched without regard to case, else the default."""
    newest = mimirs.filter(F.col("key").ilike(key)).agg(F.max_by("value", "block_timestamp").alias("value"))
    return newest.select(F.lit(key).alias("key"), F.coalesce(F.col("value").try_cast("long"), F.lit(default)).alias("value"))


def window_sums(table: DataFrame, buckets: Buckets, sums: list[str], averages: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Row count, sums (0 if none) and averages of a table inside a window."""
    out = [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]]
    out += [F.avg(c).alias(f"avg_{c}") for c in averages or []]
    rows = table.filter(buckets.holds(F.col("block_timestamp")))
    return rows.groupBy(*keys).agg(*out) if keys else rows.agg(*out)


def unique_swappers(swaps: DataFrame, buckets: Buckets) -> DataFrame:
    rows = swaps.filter(buckets.holds(F.col("block_timestamp")))
    return rows.agg(F.count_distinct("from_addr").alias("unique_swappers"))


def switched_rune(switches: DataFrame) -> DataFrame:
    """Total of the base asset that switches minted, 0 without any; one row."""
    return switches.agg(F.coalesce(F.sum("mint_e8"), F.lit(0).cast("long")).alias("switched_rune"))


def global_stats(
    swaps: DataFrame, stakes: DataFrame, unstakes: DataFrame, switches: DataFrame, depths: DataFrame, usd_pools: list[str], now: int
) -> DataFrame:
    """Totals of the whole network before now, in one row: swaps, users, adds, withdraws, switches, depth and USD price."""
    t, end = F.col("block_timestamp"), now * NANOS
    volume = F.when(F.col("_direction") % 2 == 1, F.col("to_e8") + F.col("liq_fee_in_rune_e8")).otherwise(F.col("from_e8"))
    day, month = (t >= end - span * NANOS for span in (86400, 30 * 86400))
    zero = F.lit(0).cast("long")
    total = lambda value: F.coalesce(F.sum(value), zero)
    traded = [total(volume).alias("swap_volume"), F.count(F.lit(1)).alias("swap_count")]
    traded += [F.count(F.when(recent, 1)).alias(f"swap_count_{name}") for name, recent in (("24h", day), ("30d", month))]
    traded += [F.count(F.when(F.col("_direction") == d, 1)).alias(name) for d, name in enumerate(("to_asset_count", "to_rune_count", "synth_mint_count", "synth_burn_count"))]
    users = [F.count_distinct(F.when(recent, F.col("from_addr"))) for recent in (day, month, F.lit(True))]
    traded += [u.alias(n) for u, n in zip(users, ("daily_active_users", "monthly_active_users", "unique_swapper_count"))]
    added = total(F.col("_asset_in_rune_e8") + F.col("rune_e8")).alias("add_liquidity_volume")
    taken = total(F.col("_emit_asset_in_rune_e8") + F.col("emit_rune_e8")).alias("withdraw_volume")
    protection = total("imp_loss_protection_e8").alias("impermanent_loss_protection_paid")
    before = lambda df: df.filter(t < end)
    newest = latest(before(depths), ["pool"], ["asset_e8", "rune_e8"])
    usd = newest.transform(lambda d: pricing.rune_usd_price(d, usd_pools)).agg(F.max("rune_price_usd").alias("rune_price_usd"))
    parts = [
        before(swaps).agg(*traded), before(stakes).agg(F.count(F.lit(1)).alias("add_liquidity_count"), added),
        before(unstakes).agg(F.count(F.lit(1)).alias("withdraw_count"), taken, protection), switched_rune(switches),
        newest.agg(total("rune_e8").alias("rune_depth")), usd,
    ]
    out = parts[0]
    for part in parts[1:]:  # every part is one row
        out = out.join(F.broadcast(part))
    return out


def global_swap_stats(swaps: DataFrame, now: int) -> DataFrame:
    """Swap counts and volume per direction: all time, 24 hours and 30 days before now."""
    t, volume = F.col("block_timestamp"), F.when(F.col("_direction") % 2 == 1, F.col("to_e8") + F.col("liq_fee_in_rune_e8")).otherwise(F.col("from_e8"))
    out = [F.count(F.lit(1)).alias("swap_count"), F.sum(volume).alias("volume_e8")]
    for name, span in (("24h", 86400), ("30d", 30 * 86400)):
        recent = t >= (now - span) * NANOS
        out += [F.count(F.when(recent, 1)).alias(f"swap_count_{name}"), F.coalesce(F.sum(F.when(recent, volume)), F.lit(0)).alias(f"volume_{name}")]
    return swaps.groupBy("_direction").agg(*out)


def pool_summary(depths: DataFrame, swaps: DataFrame, changes: DataFrame, pool_events: DataFrame, now: int, apr_days: int = 30) -> DataFrame:
    """Latest depths, status, 24-hour volume, units and yield of each pool; now in seconds."""
    t = F.col("block_timestamp")
    moment, before = now * NANOS, (now - apr_days * 86400) * NANOS
    last = as_of(depths, ["pool"], moment, DEPTHS).select("pool", *DEPTHS)
    old = as_of(depths, ["pool"], before, DEPTHS, inclusive=False).select("pool", *[F.col(c).alias("old_" + c) for c in DEPTHS])
    units = changes.groupBy("pool").agg(
        F.coalesce(F.sum(F.when(t < moment, F.col("units"))), F.lit(0)).alias("lp_units"),
        F.coalesce(F.sum(F.when(t < before, F.col("units"))), F.lit(0)).alias("old_units"),
    )
    amount = F.when(F.col("_direction") % 2 == 1, F.col("to_e8") + F.col("liq_fee_in_rune_e8")).otherwise(F.col("from_e8"))
    day = swaps.filter((t >= (now - 86400) * NANOS) & (t < moment)).groupBy("pool").agg(F.sum(amount).alias("volume_24h"))
    rows = last.join(old, "pool", "left").join(units, "pool", "left").join(day, "pool", "left")
    rows = pool_status(pool_events, rows).fillna(0, ["volume_24h", "lp_units", "old_units", *["old_" + c for c in DEPTHS]])
    a, r, s, u = (F.col(c) for c in (*DEPTHS, "lp_units"))
    synth = pricing.synth_units(a, s, u)
    now_luvi = pricing.luvi(a, r, u + synth)
    old_luvi = pricing.luvi_of_lp_units(*[F.col("old_" + c) for c in DEPTHS], F.col("old_units"))
    yearly = pricing.apr(now_luvi, old_luvi, F.lit(moment - before))
    return rows.select(
        "pool", *DEPTHS, pricing.asset_price(a, r).alias("asset_price"), "status", "volume_24h", u.alias("lp_units"),
        synth.alias("synth_units"), (u + synth).alias("units"), yearly.alias("apr"), pricing.floored_apy(yearly).alias("apy"),
    )


def pool_stats(swaps: DataFrame, stakes: DataFrame, unstakes: DataFrame, depths: DataFrame, buckets: Buckets) -> DataFrame:
    """Per pool over one window: swaps by side, liquidity changes, members and depth at the end."""
    t, d = F.col("block_timestamp"), F.col("_direction")
    to_rune = d % 2 == 1
    volume = F.when(to_rune, F.col("to_e8") + F.col("liq_fee_in_rune_e8")).otherwise(F.col("from_e8"))
    traded = swaps.filter(buckets.holds(t)).groupBy("pool").agg(
        F.count(F.lit(1)).alias("swap_count"),
        F.sum(F.when(to_rune, volume).otherwise(0)).alias("to_rune_volume"),
        F.sum(F.when(~to_rune, volume).otherwise(0)).alias("to_asset_volume"),
        F.sum("liq_fee_in_rune_e8").alias("total_fees"),
        F.count_distinct("from_addr").alias("unique_swappers"),
    )
    member = F.coalesce("rune_addr", "asset_addr")
    added = stakes.filter(buckets.holds(t)).groupBy("pool").agg(
        F.count(F.lit(1)).alias("add_count"), F.sum("rune_e8").alias("add_rune"), F.count_distinct(member).alias("unique_members")
    )
    taken = unstakes.filter(buckets.holds(t)).groupBy("pool").agg(F.count(F.lit(1)).alias("withdraw_count"), F.sum("emit_rune_e8").alias("withdraw_rune"))
    end = as_of(depths, ["pool"], buckets.end * NANOS, DEPTHS, inclusive=False).select("pool", *DEPTHS)
    rows = traded.join(added, "pool", "full_outer").join(taken, "pool", "full_outer").join(end, "pool", "full_outer")
    return rows.fillna(0)


def network(depths: DataFrame, nodes: DataFrame, reserve: int, emission_curve: int, blocks_per_year: int, minimum_eligible: int) -> DataFrame:
    """Bond metrics, pool share and yields of the whole network; nodes: (status, bond); one row."""
    pooled = latest(depths, ["pool"], ["rune_e8"]).agg(F.coalesce(F.sum("rune_e8"), F.lit(0)).alias("pooled"))
    metrics = pricing.bond_metrics(nodes, minimum_eligible)
    names = ["total", "minimum", "maximum", "average", "median"]
    wide = metrics.agg(
        *[
            F.coalesce(F.max(F.when(F.col("status") == s, F.col(n))), F.lit(0)).alias(f"{s.lower()}_{n}")
            for s in ("Active", "Standby")
            for n in names
        ]
    )
    rows = wide.join(F.broadcast(pooled))
    bond, pool = F.col("active_total").cast("double"), F.col("pooled").cast("double")
    share = F.when(bond > pool, ieee_div(bond - pool, bond + pool)).otherwise(F.lit(0.0))
    rewards = pricing.block_rewards(F.lit(emission_curve), F.lit(blocks_per_year), F.lit(reserve), share)
    rows = rows.withColumn("pool_share", share).withColumn("rewards", rewards)
    yearly = lambda reward, base: ieee_div(F.col(f"rewards.{reward}") * blocks_per_year, base)
    return rows.select(
        *wide.columns, "pooled", "pool_share", "rewards.*",
        yearly("bond_reward", F.col("active_total")).alias("bonding_yield"), yearly("pool_reward", 2 * F.col("pooled")).alias("liquidity_yield"),
    )


def health(block_log: DataFrame, aggregated_ns: int, now_s: int, limit_s: int = 60) -> DataFrame:
    """Newest block, and whether what is aggregated is recent enough."""
    newest = block_log.agg(F.max("height").alias("height"), F.max("timestamp").alias("timestamp"))
    return newest.withColumn("in_sync", F.lit(now_s - aggregated_ns // NANOS < limit_s))


def lp_events(stakes: DataFrame, unstakes: DataFrame, member_id: str, pool: str) -> DataFrame:
    """Adds and withdraws of a member in a pool: (block_timestamp, kind, units, asset, rune), one row per block and kind."""
    member = F.coalesce("rune_addr", "asset_addr")
    log = stakes.filter((member == member_id) & (F.col("pool") == pool)).select(
        "block_timestamp", F.lit("add").alias("kind"), F.col("stake_units").alias("units"), F.col("asset_e8").alias("asset"), F.col("rune_e8").alias("rune")
    )
    taken = unstakes.filter((F.col("from_addr") == member_id) & (F.col("pool") == pool))
    log = log.unionByName(
        taken.select(
            "block_timestamp", F.lit("withdraw").alias("kind"), (-F.col("stake_units")).alias("units"),
            (-F.col("emit_asset_e8")).alias("asset"), (-F.col("emit_rune_e8")).alias("rune"),
        )
    )
    return log.groupBy("block_timestamp", "kind").agg(*[F.sum(c).alias(c) for c in ("units", "asset", "rune")])


def with_block_info(log: DataFrame, depths: DataFrame, block_log: DataFrame) -> DataFrame:
    """LP events with the height of their block and their pool's depths at the end of their five minutes; 0 if unknown.

    depths: depths of the pool, with priceusd. A pool without assets has no price, so the base asset has none by it: 0.
    """
    five = F.call_function("div", F.col("block_timestamp"), F.lit(300 * NANOS))
    info = depths.groupBy(five.alias("five")).agg(F.max_by(F.struct("priceusd", "asset_e8", "rune_e8"), "block_timestamp").alias("d"))
    heights = block_log.select(F.col("timestamp").alias("block_timestamp"), "height")
    rows = log.withColumn("five", five).join(heights, "block_timestamp", "left").join(info, "five", "left")
    zero = F.lit(0).cast("long")
    asset_usd = F.coalesce("d.priceusd", F.lit(0.0))
    price = pricing.asset_price(F.col("d.asset_e8"), F.col("d.rune_e8"))
    return rows.select(
        *log.columns, F.coalesce("height", zero).alias("height"), F.coalesce("d.asset_e8", zero).alias("asset_depth"),
        F.coalesce("d.rune_e8", zero).alias("rune_depth"), asset_usd.alias("asset_price_usd"),
        F.when(F.col("d").isNull() | (price == 0), 0.0).otherwise(ieee_div(asset_usd, price)).alias("rune_price_usd"),
    )


def lp_detail(
    stakes: DataFrame, unstakes: DataFrame, swaps: DataFrame, entries: DataFrame, changes: DataFrame, member_id: str, pool: str, least_units: int = 0
) -> DataFrame:
    """Event log of a member in a pool, with the pool's fees and rewards from each event to the next and the member's share.

    Fees count from after an event up to the next one, inclusive. An event after which the member holds no more than
    least_units, which the caller derives from the smallest value that counts, ends a life: held starts anew, and only
    the events of the last life stay. Sums of fees, rewards and units are running totals of the pool, as of each event.
    """
    log = lp_events(stakes, unstakes, member_id, pool)
    order = Window.partitionBy(F.lit(member_id)).orderBy("block_timestamp", "kind")
    log = log.withColumn("held", F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # units come and go in wholes, so a life that ends at 0 needs no new start of the sum; one that ends above does
    log = log.withColumn("ends", F.col("held") <= least_units)
    closed = F.max(F.when(F.col("ends"), F.struct("block_timestamp", "kind"))).over(Window.partitionBy(F.lit(member_id)))
    left = F.max_by("held", F.when(F.col("ends"), F.struct("block_timestamp", "kind"))).over(Window.partitionBy(F.lit(member_id)))
    log = log.withColumns({"closed": closed, "left": F.coalesce(left, F.lit(0))})
    log = log.filter(F.col("closed").isNull() | (F.struct("block_timestamp", "kind") > F.col("closed")))
    log = log.withColumn("held", F.col("held") - F.col("left")).drop("ends", "closed", "left")
    log = log.withColumn("next", F.lead("block_timestamp").over(order))
    mine, zero = F.col("pool") == pool, F.lit(0).cast("long")

    def flow(df, fees=zero, rewards=zero, units=zero):
        named = [x.alias(n) for x, n in ((fees, "fees"), (rewards, "rewards"), (units, "pool_units"))]
        return df.filter(mine).select("pool", "block_timestamp", F.lit(0).cast("long").alias("event_idx"), *named)

    flows = flow(swaps, fees=F.col("liq_fee_in_rune_e8")).unionByName(flow(entries, rewards=F.col("rune_e8"))).unionByName(flow(changes, units=F.col("units")))
    flows = flows.groupBy("pool", "block_timestamp").agg(*[F.sum(c).alias(c) for c in ("fees", "rewards", "pool_units")])
    totals = running(flows, ["pool"], ["block_timestamp"], ["fees", "rewards", "pool_units"])
    end = F.coalesce("next", F.lit((1 << 63) - 1))
    moments = log.select("kind", F.lit(pool).alias("pool"), F.explode(F.array(F.col("block_timestamp"), end)).alias("block_timestamp"), F.col("block_timestamp").alias("at"))
    then = as_of_join(moments, totals, ["pool"], ["fees", "rewards", "pool_units"])
    first = lambda c: F.coalesce(F.min_by(c, "block_timestamp"), zero)
    last = lambda c: F.coalesce(F.max_by(c, "block_timestamp"), zero)
    sums = then.groupBy(F.col("at").alias("block_timestamp"), "kind").agg(
        first("pool_units").alias("pool_units"), *[(last(c) - first(c)).alias(c) for c in ("fees", "rewards")]
    )
    rows = log.join(sums, ["block_timestamp", "kind"])
    share = F.when(F.col("held") > 0, ieee_div(F.col("held"), F.col("pool_units"))).otherwise(F.lit(0.0))
    return rows.select("block_timestamp", "kind", "units", "asset", "rune", "held", "pool_units", "fees", "rewards", share.alias("share"))


def lp_report(detail: DataFrame) -> DataFrame:
    """What a member earned and staked, from its LP events with block info; one row, without any if there are no events."""
    part = lambda c: F.sum(F.col(c) * F.col("share"))
    usd = (F.col("asset") * F.col("asset_price_usd")).cast("long") + (F.col("rune") * F.col("rune_price_usd")).cast("long")
    return detail.agg(
        F.count(F.when(F.col("kind") == "add", 1)).alias("stakes"), F.count(F.when(F.col("kind") == "withdraw", 1)).alias("withdraws"),
        F.sum("asset").alias("staked_asset"), F.sum("rune").alias("staked_rune"), F.sum(usd).alias("staked_usd"),
        part("fees").alias("rune_earned"), part("rewards").alias("rewards"), F.sum(F.col("fees") * F.col("share") * F.col("rune_price_usd")).alias("usd_earned"),
    ).filter("stakes + withdraws > 0")
