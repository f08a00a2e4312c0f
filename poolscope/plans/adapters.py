"""Domain tables over the supplied star-schema tables, once as DataFrames and once as SQL common table expressions.

The mapping is deterministic and integer-valued, so that results can be held against SQL exactly.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.functions.numeric import NANOS
from poolscope.operators.buckets import Buckets

RUNE = "THOR.RUNE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) * 1000


def e8(x: Column) -> Column:
    return F.rint(x).cast("long")


def within(rows: DataFrame, ts: str, buckets: Buckets | None) -> DataFrame:
    """Rows of the buckets' range, by a condition on the stored column that reaches the scan."""
    if buckets is None:
        return rows
    kind = rows.schema[ts].dataType
    start, end = (F.lit(datetime.fromtimestamp(s, UTC).strftime("%Y-%m-%d %H:%M:%S")).cast(kind) for s in (buckets.start, buckets.end))
    return rows.filter((F.col(ts) >= start) & (F.col(ts) < end))


def swap_events(spark: SparkSession, sf_dir: str, addresses: bool = True, buckets: Buckets | None = None) -> DataFrame:
    """Line items as swaps: pool by return flag and status, direction by line number, in cents.

    The sender is a column of another table; without addresses it is null, and that table is not read. The tables meet by tx,
    so that what goes on by it needs no other exchange.
    """
    rows = within(table(spark, sf_dir, "lineitem"), "l_shipdate", buckets).withColumn("tx", F.col("l_orderkey").cast("string"))
    price = F.col("l_extendedprice")
    if addresses:
        rows = rows.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("tx"), "o_custkey"), "tx")
    else:
        rows = rows.withColumn("o_custkey", F.lit(None).cast("long"))
    direction = (F.col("l_linenumber") % 4).cast("int")
    pool = F.concat("l_returnflag", F.lit("."), "l_linestatus")
    synth = F.concat("l_returnflag", F.lit("/"), "l_linestatus")
    side = F.when(direction < 2, pool).otherwise(synth)
    rune = F.lit(RUNE)
    return rows.select(
        "tx", F.lit("chain").alias("chain"), F.col("o_custkey").cast("string").alias("from_addr"),
        F.col("l_suppkey").cast("string").alias("to_addr"),
        F.when(direction % 2 == 0, rune).otherwise(side).alias("from_asset"), e8(price * 100).alias("from_e8"),
        F.when(direction % 2 == 0, side).otherwise(rune).alias("to_asset"), e8(price * (1 - F.col("l_discount")) * 100).alias("to_e8"),
        F.concat(F.lit("=:"), pool, F.lit(":"), F.col("l_suppkey").cast("string"), F.lit(":0:aff"), (F.col("l_partkey") % 5).cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("memo"),
        pool.alias("pool"), F.lit(0).cast("long").alias("to_e8_min"), e8(F.col("l_discount") * 10000).alias("swap_slip_bp"),
        e8(price * F.col("l_tax")).alias("liq_fee_e8"), e8(price * F.col("l_tax")).alias("liq_fee_in_rune_e8"),
        direction.alias("_direction"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("event_idx"),
        nanos("l_shipdate").alias("block_timestamp"), ((F.col("l_suppkey") % 8) / F.lit(4)).alias("priceusd"),
    )


SWAPS = f"""swap_events AS (
  SELECT l_orderkey::VARCHAR AS tx, o_custkey::VARCHAR AS from_addr, l_suppkey::VARCHAR AS to_addr,
    CASE WHEN l_linenumber % 2 = 0 THEN '{RUNE}' WHEN l_linenumber % 4 < 2 THEN l_returnflag || '.' || l_linestatus
         ELSE l_returnflag || '/' || l_linestatus END AS from_asset,
    CASE WHEN l_linenumber % 2 = 1 THEN '{RUNE}' WHEN l_linenumber % 4 < 2 THEN l_returnflag || '.' || l_linestatus
         ELSE l_returnflag || '/' || l_linestatus END AS to_asset,
    (l_extendedprice * 100)::BIGINT AS from_e8, (l_extendedprice * (1 - l_discount) * 100)::BIGINT AS to_e8,
    '=:' || l_returnflag || '.' || l_linestatus || ':' || l_suppkey || ':0:aff' || (l_partkey % 5) || ':' || l_linenumber AS memo,
    l_returnflag || '.' || l_linestatus AS pool, (l_discount * 10000)::BIGINT AS swap_slip_bp,
    (l_extendedprice * l_tax)::BIGINT AS liq_fee_in_rune_e8, (l_linenumber % 4)::INT AS direction,
    l_partkey * 8 + l_linenumber AS event_idx, epoch_us(l_shipdate) * 1000 AS block_timestamp, (l_suppkey % 8) / 4.0::DOUBLE AS priceusd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def block_pool_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as depth rows of a pool per event type."""
    rows = table(spark, sf_dir, "events")
    asset = e8(F.col("value") * 100)
    return rows.select(
        F.col("event_type").alias("pool"), asset.alias("asset_e8"), (F.col("user_id") * 100 + 1).alias("rune_e8"),
        (F.col("user_id") % 7).alias("synth_e8"), F.col("event_id").alias("event_idx"), nanos("ts").alias("block_timestamp"),
    )


DEPTHS = """depths AS (
  SELECT event_type AS pool, (value * 100)::BIGINT AS asset_e8, user_id * 100 + 1 AS rune_e8, user_id % 7 AS synth_e8,
    event_id AS event_idx, epoch_us(ts) * 1000 AS block_timestamp FROM events
)"""


def _liquidity(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status)
    return rows.select(
        F.col("o_orderpriority").alias("pool"), (F.col("o_custkey") % 300).cast("string").alias("member"),
        e8(F.col("o_totalprice") * 100).alias("units"), F.col("o_orderkey").alias("event_idx"), nanos("o_orderdate").alias("block_timestamp"),
        F.col("o_custkey").alias("k"),
    )


def stake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as adds; every seventh customer has no base-asset address."""
    rows = _liquidity(spark, sf_dir, "O")
    return rows.select(
        "pool", F.col("event_idx").cast("string").alias("asset_tx"), F.concat(F.lit("a"), "member").alias("asset_addr"),
        (F.col("units") * 2).alias("asset_e8"), F.col("units").alias("stake_units"), F.col("event_idx").cast("string").alias("rune_tx"),
        F.when(F.col("k") % 7 != 0, F.concat(F.lit("r"), "member")).alias("rune_addr"), (F.col("units") * 3).alias("rune_e8"),
        F.col("units").alias("_asset_in_rune_e8"), "event_idx", "block_timestamp",
    )


def unstake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as withdraws."""
    rows = _liquidity(spark, sf_dir, "F")
    units = F.col("units")
    return rows.select(
        F.col("event_idx").cast("string").alias("tx"), F.concat(F.lit("r"), "member").alias("from_addr"), F.lit("vault").alias("to_addr"),
        F.col("pool").alias("asset"), F.lit(1).cast("long").alias("asset_e8"), units.alias("emit_asset_e8"), (units * 2).alias("emit_rune_e8"), "pool",
        units.alias("stake_units"), F.lit(5000).cast("long").alias("basis_points"), F.lit(0.5).alias("asymmetry"),
        F.lit(0).cast("long").alias("imp_loss_protection_e8"), units.alias("_emit_asset_in_rune_e8"), "event_idx", "block_timestamp",
    )


def pending_liquidity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in progress as pending adds, every fifth as a pending withdraw."""
    rows = _liquidity(spark, sf_dir, "P")
    return rows.select(
        "pool", F.col("event_idx").cast("string").alias("asset_tx"), F.concat(F.lit("a"), "member").alias("asset_addr"),
        F.col("units").alias("asset_e8"), F.lit(None).cast("string").alias("rune_tx"),
        F.when(F.col("k") % 7 != 0, F.concat(F.lit("r"), "member")).alias("rune_addr"), F.lit(0).cast("long").alias("rune_e8"),
        F.when(F.col("event_idx") % 5 == 0, "withdraw").otherwise("add").alias("pending_type"), "event_idx", "block_timestamp",
    )


LIQUIDITY = """liq AS (
  SELECT o_orderstatus AS st, o_orderpriority AS pool, 'a' || (o_custkey % 300) AS asset_addr,
    CASE WHEN o_custkey % 7 <> 0 THEN 'r' || (o_custkey % 300) END AS rune_addr, 'r' || (o_custkey % 300) AS from_addr,
    (o_totalprice * 100)::BIGINT AS units, o_orderkey AS event_idx, epoch_us(o_orderdate) * 1000 AS block_timestamp FROM orders
),
stake_events AS (
  SELECT pool, asset_addr, rune_addr, units AS stake_units, units * 2 AS asset_e8, units * 3 AS rune_e8, event_idx, block_timestamp
  FROM liq WHERE st = 'O'
),
unstake_events AS (
  SELECT pool, from_addr, units AS stake_units, units AS emit_asset_e8, units * 2 AS emit_rune_e8, event_idx, block_timestamp
  FROM liq WHERE st = 'F'
),
pending_events AS (
  SELECT pool, asset_addr, rune_addr, units AS asset_e8, 0 AS rune_e8, event_idx, block_timestamp,
    CASE WHEN event_idx % 5 = 0 THEN 'withdraw' ELSE 'add' END AS pending_type FROM liq WHERE st = 'P'
)"""


def transfer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transfers from customers to suppliers."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from_addr"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to_addr"),
        F.col("l_returnflag").alias("asset"), e8(F.col("l_quantity") * 100).alias("amount_e8"), nanos("l_shipdate").alias("block_timestamp"),
    )


TRANSFERS = """transfers AS (
  SELECT 'c' || o_custkey AS from_addr, 's' || l_suppkey AS to_addr, l_returnflag AS asset, (l_quantity * 100)::BIGINT AS amount_e8,
    epoch_us(l_shipdate) * 1000 AS block_timestamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def bond_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases, clicks, views and errors as bonds paid, rewarded, returned and charged."""
    kind = F.col("event_type")
    name = F.when(kind == "purchase", "bond_paid").when(kind == "click", "bond_reward").when(kind == "view", "bond_returned").when(kind == "error", "bond_cost")
    rows = table(spark, sf_dir, "events").filter(kind != "signup")
    return rows.select(
        F.concat(F.lit("n"), (F.col("user_id") % 20).cast("string")).alias("from_addr"), name.alias("bond_type"),
        e8(F.col("value") * 100).alias("e8"), F.col("event_id").alias("event_idx"), nanos("ts").alias("block_timestamp"),
    )


BONDS = """bonds AS (
  SELECT 'n' || (user_id % 20) AS from_addr, (value * 100)::BIGINT AS e8, event_id AS event_idx, epoch_us(ts) * 1000 AS block_timestamp,
    CASE event_type WHEN 'purchase' THEN 'bond_paid' WHEN 'click' THEN 'bond_reward' WHEN 'view' THEN 'bond_returned'
         WHEN 'error' THEN 'bond_cost' END AS bond_type FROM events WHERE event_type <> 'signup'
)"""


def node_status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views as nodes that become active or standby."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    active = F.col("event_type") == "click"
    return rows.select(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node_addr"),
        F.when(active, "Standby").otherwise("Active").alias("former"), F.when(active, "Active").otherwise("Standby").alias("current"),
        F.col("event_id").alias("event_idx"), nanos("ts").alias("block_timestamp"),
    )


NODES = """nodes AS (
  SELECT 'n' || user_id AS node_addr, CASE event_type WHEN 'click' THEN 'Standby' ELSE 'Active' END AS former,
    CASE event_type WHEN 'click' THEN 'Active' ELSE 'Standby' END AS current, event_id AS event_idx, epoch_us(ts) * 1000 AS block_timestamp
  FROM events WHERE event_type IN ('click', 'view')
)"""


def reward_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return rows.select(
        F.concat(F.lit("P."), (F.col("user_id") % 3).cast("string")).alias("pool"), e8(F.col("value") * 100).alias("rune_e8"),
        F.col("event_id").alias("event_idx"), nanos("ts").alias("block_timestamp"),
    )


def rewards_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    return rows.select(e8(F.col("value") * 100).alias("bond_e8"), F.col("event_id").alias("event_idx"), nanos("ts").alias("block_timestamp"))


def event_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as swaps, for histories that meet rewards and nodes in one month."""
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return rows.select(
        F.concat(F.lit("P."), (F.col("user_id") % 3).cast("string")).alias("pool"), e8(F.col("value") * 10).alias("liq_fee_in_rune_e8"),
        F.col("event_id").alias("event_idx"), nanos("ts").alias("block_timestamp"),
    )


EVENT_FLOWS = """entries AS (
  SELECT 'P.' || (user_id % 3) AS pool, (value * 100)::BIGINT AS rune_e8, epoch_us(ts) * 1000 AS block_timestamp FROM events
  WHERE event_type = 'purchase'
),
rewards AS (SELECT (value * 100)::BIGINT AS bond_e8, epoch_us(ts) * 1000 AS block_timestamp FROM events WHERE event_type = 'signup'),
eswaps AS (
  SELECT 'P.' || (user_id % 3) AS pool, (value * 10)::BIGINT AS fee, epoch_us(ts) * 1000 AS block_timestamp FROM events
  WHERE event_type = 'error'
)"""


def outbound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items 1 and 2 as outbound transactions of their order."""
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    asset = F.when(F.col("l_linenumber") == 1, F.lit(RUNE)).otherwise(F.concat("l_returnflag", F.lit("."), "l_linestatus"))
    return rows.select(
        F.when(asset != RUNE, F.concat(F.lit("o"), F.col("l_partkey").cast("string"))).alias("tx"), F.lit("vault").alias("from_addr"),
        F.col("l_suppkey").cast("string").alias("to_addr"), asset.alias("asset"), e8(F.col("l_quantity") * 100).alias("asset_e8"),
        F.col("l_orderkey").cast("string").alias("in_tx"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("event_idx"),
        nanos("l_shipdate").alias("block_timestamp"),
    )


def fee_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line item 3 as the fee of its order."""
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber = 3")
    return rows.select(
        F.col("l_orderkey").cast("string").alias("tx"), F.lit(RUNE).alias("asset"), F.col("l_suppkey").alias("asset_e8"),
        F.col("l_suppkey").alias("pool_deduct"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("event_idx"), nanos("l_shipdate").alias("block_timestamp"),
    )


def block_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a block of its own height."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("height"), nanos("ts").alias("timestamp"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))


def name_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as names, roles as chains, turns as time."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        F.concat(F.lit("name"), F.col("conv_id").cast("string")).alias("name"), F.col("role").alias("chain"),
        F.concat(F.lit("addr"), (F.length("text") % 10).cast("string")).alias("address"), (F.col("turn") * 100 + 50).alias("expire"),
        F.concat(F.lit("owner"), (F.col("conv_id") % 5).cast("string")).alias("owner"), F.col("turn").alias("event_idx"),
        (F.col("turn") * NANOS).alias("block_timestamp"),
    )


NAMES = """names AS (
  SELECT 'name' || conv_id AS name, role AS chain, 'addr' || (length(text) % 10) AS address, turn * 100 + 50 AS expire,
    'owner' || (conv_id % 5) AS owner, turn AS event_idx, turn * 1000000000 AS block_timestamp FROM conversations
)"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the props object as attributes."""
    rows = table(spark, sf_dir, "events")
    props = F.map_entries(F.from_json("props", "map<string,string>"))
    pairs = F.concat(
        F.transform(props, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))),
        F.array(F.struct(F.lit("coin").alias("key"), F.concat(e8(F.col("value") * 100).cast("string"), F.lit(" BTC.BTC")).alias("value"))),
        F.array(F.struct(F.lit("id").alias("key"), F.col("user_id").cast("string").alias("value"))),
    )
    return rows.select(
        F.col("event_id").alias("height"), nanos("ts").alias("block_timestamp"), F.lit(0).cast("long").alias("event_idx"),
        F.col("event_type").alias("type"), pairs.alias("attributes"),
    )


def pool_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as swaps in the pools of block_pool_depths."""
    rows = table(spark, sf_dir, "events")
    value, user = F.col("value"), F.col("user_id")
    return rows.select(
        F.col("event_id").cast("string").alias("tx"), F.concat(F.lit("u"), user.cast("string")).alias("from_addr"), F.col("event_type").alias("pool"),
        (user % 4).cast("int").alias("_direction"), e8(value * 100).alias("from_e8"), e8(value * 90).alias("to_e8"), e8(value * 3).alias("liq_fee_in_rune_e8"),
        (user % 50).alias("swap_slip_bp"), ((user % 8) / F.lit(4)).alias("priceusd"), F.col("event_id").alias("event_idx"), nanos("ts").alias("block_timestamp"),
    )


def pool_stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every third user as adds to the pools of block_pool_depths; of every seventh user without a base-asset address."""
    rows = table(spark, sf_dir, "events").filter("user_id % 3 = 0")
    member = (F.col("user_id") % 20).cast("string")
    return rows.select(
        F.col("event_type").alias("pool"), F.concat(F.lit("a"), member).alias("asset_addr"), F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("r"), member)).alias("rune_addr"),
        (F.col("event_id") * 10 + 1_000_000).alias("stake_units"), e8(F.col("value") * 50).alias("asset_e8"), e8(F.col("value") * 70).alias("rune_e8"),
        e8(F.col("value") * 60).alias("_asset_in_rune_e8"), F.col("event_id").alias("event_idx"), nanos("ts").alias("block_timestamp"),
    )


def pool_unstakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of another third of the users as withdraws from those pools."""
    rows = table(spark, sf_dir, "events").filter("user_id % 3 = 1")
    return rows.select(
        F.col("event_type").alias("pool"), F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("from_addr"), F.col("event_id").alias("stake_units"),
        e8(F.col("value") * 10).alias("emit_asset_e8"), e8(F.col("value") * 20).alias("emit_rune_e8"), e8(F.col("value") * 15).alias("_emit_asset_in_rune_e8"),
        F.col("user_id").alias("imp_loss_protection_e8"), F.col("event_id").alias("event_idx"), nanos("ts").alias("block_timestamp"),
    )


def pool_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every fifth user as block rewards of those pools."""
    rows = table(spark, sf_dir, "events").filter("user_id % 5 = 0")
    return rows.select(F.col("event_type").alias("pool"), e8(F.col("value") * 7).alias("rune_e8"), F.col("event_id").alias("event_idx"), nanos("ts").alias("block_timestamp"))


POOLS = """pool_swaps AS (
  SELECT event_id::VARCHAR AS tx, 'u' || user_id AS from_addr, event_type AS pool, (user_id % 4)::INT AS direction, (value * 100)::BIGINT AS from_e8, (value * 90)::BIGINT AS to_e8,
    (value * 3)::BIGINT AS liq_fee_in_rune_e8, user_id % 50 AS swap_slip_bp, (user_id % 8) / 4.0::DOUBLE AS priceusd, event_id AS event_idx, epoch_us(ts) * 1000 AS block_timestamp FROM events
),
pool_stakes AS (
  SELECT event_type AS pool, 'a' || (user_id % 20) AS asset_addr, CASE WHEN user_id % 7 <> 0 THEN 'r' || (user_id % 20) END AS rune_addr, event_id * 10 + 1000000 AS stake_units,
    (value * 50)::BIGINT AS asset_e8, (value * 70)::BIGINT AS rune_e8, (value * 60)::BIGINT AS asset_in_rune, event_id AS event_idx, epoch_us(ts) * 1000 AS block_timestamp FROM events WHERE user_id % 3 = 0
),
pool_unstakes AS (
  SELECT event_type AS pool, 'r' || (user_id % 20) AS from_addr, event_id AS stake_units, (value * 10)::BIGINT AS emit_asset_e8, (value * 20)::BIGINT AS emit_rune_e8,
    (value * 15)::BIGINT AS asset_in_rune, user_id AS imp_loss, event_id AS event_idx, epoch_us(ts) * 1000 AS block_timestamp FROM events WHERE user_id % 3 = 1
),
pool_rewards AS (SELECT event_type AS pool, (value * 7)::BIGINT AS rune_e8, epoch_us(ts) * 1000 AS block_timestamp FROM events WHERE user_id % 5 = 0),
pool_units AS (SELECT pool, stake_units AS u, block_timestamp AS t FROM pool_stakes UNION ALL SELECT pool, -stake_units, block_timestamp FROM pool_unstakes)"""


def switch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as switches of old base assets, some of them of nothing."""
    rows = table(spark, sf_dir, "supplier")
    amount, key = e8(F.col("s_acctbal") * 100), F.col("s_suppkey").cast("string")
    return rows.select(
        F.concat(F.lit("sw"), key).alias("tx"), F.concat(F.lit("bnb"), key).alias("from_addr"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("thor"), key)).alias("to_addr"),
        F.lit("BNB.RUNE-B1A").alias("burn_asset"), amount.alias("burn_e8"), amount.alias("mint_e8"), (F.col("s_suppkey") * 3600 * NANOS).alias("block_timestamp"),
    )


def refund_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as refunds."""
    rows = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    return rows.select(
        F.concat(F.lit("re"), key).alias("tx"), F.concat(F.lit("x"), key).alias("from_addr"), F.lit("vault").alias("to_addr"), F.lit("BTC.BTC").alias("asset"),
        e8(F.col("c_acctbal") * 100).alias("asset_e8"), F.when(F.col("c_custkey") % 2 == 0, "ETH.ETH").alias("asset_2nd"), F.col("c_mktsegment").alias("reason"),
        (F.col("c_custkey") * 60 * NANOS).alias("block_timestamp"),
    )


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as donations to a pool of their nation."""
    rows = table(spark, sf_dir, "customer")
    key, pool = F.col("c_custkey").cast("string"), F.concat(F.lit("D."), F.col("c_nationkey").cast("string"))
    return rows.select(
        F.concat(F.lit("do"), key).alias("tx"), F.concat(F.lit("x"), key).alias("from_addr"), F.lit("vault").alias("to_addr"), pool.alias("asset"), pool.alias("pool"),
        F.col("c_custkey").alias("asset_e8"), (F.col("c_custkey") % 3).alias("rune_e8"), (F.col("c_custkey") * 61 * NANOS).alias("block_timestamp"),
    )


def node_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes of a nation that set their keys."""
    rows = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return rows.select(named("n", F.col("c_nationkey")).alias("node_addr"), named("s", key % 40).alias("secp256k1"), named("e", key % 60).alias("ed25519"), (key * NANOS).alias("block_timestamp"))
