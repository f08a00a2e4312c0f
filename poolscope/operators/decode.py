"""Decoding of raw block events into typed tables.

An event is a type and a list of (key, value) text attributes; of repeated keys the last counts. Each type has a list of
fields: where a field's attribute is present but malformed, the event goes to the dead letters instead of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolscope.functions.assets import folded_address, parse_coin, parse_coin_list, parse_lower_coin, swap_direction
from poolscope.schemas import table_schema

# Per event type its table and `columns=attributes:kind`; kind is text (default), long, bool, coin or
# lowcoin, and several attribute names are alternatives.
FIELDS = {
    "ActiveVault": ("active_vault_events", "add_asgard_addr=add new asgard vault"),
    "InactiveVault": ("inactive_vault_events", "add_asgard_addr=set inactive vault"),
    "UpdateNodeAccountStatus": ("update_node_account_status_events", "node_addr=Address; former=Former:; current=Current:"),
    "donate": ("add_events", "tx=id; chain=chain; from_addr=from; to_addr=to; asset,asset_e8=coin:coin; memo=memo; pool=pool"),
    "asgard_fund_yggdrasil": ("asgard_fund_yggdrasil_events", "tx=tx; asset,asset_e8=coins:coin; vault_key=pubkey"),
    "bond": ("bond_events", "tx=id; chain=chain; from_addr=from; to_addr=to; asset,asset_e8=coin:coin; memo=memo; e8=amount:long; bond_type=bond_type|bound_type"),
    "errata": ("errata_events", "in_tx=in_tx_id; asset=asset; asset_e8=asset_amt:long; rune_e8=rune_amt:long"),
    "fee": ("fee_events", "tx=tx_id; asset,asset_e8=coins:coin; pool_deduct=pool_deduct:long"),
    "gas": ("gas_events", "asset=asset; asset_e8=asset_amt:long; rune_e8=rune_amt:long; tx_count=transaction_count:long"),
    "set_mimir": ("set_mimir_events", "key=key; value=value"),
    "message": ("message_events", "from_addr=sender; action=action"),
    "new_node": ("new_node_events", "node_addr=address"),
    "outbound": ("outbound_events", "tx=id; chain=chain; from_addr=from; to_addr=to; asset,asset_e8=coin:coin; memo=memo; in_tx=in_tx_id"),
    "pool": ("pool_events", "asset=pool; status=pool_status"),
    "refund": ("refund_events", "tx=id; chain=chain; from_addr=from; to_addr=to; memo=memo; code=code:long; reason=reason"),
    "reserve": ("reserve_events", "tx=id; chain=chain; from_addr=from; to_addr=to; asset,asset_e8=coin:coin; memo=memo; addr=contributor_address; e8=amount:long"),
    "rewards": ("rewards_events", "bond_e8=bond_reward:long"),
    "set_ip_address": ("set_ip_address_events", "node_addr=thor_address; ip_addr=address"),
    "set_node_keys": ("set_node_keys_events", "node_addr=node_address; secp256k1=node_secp256k1_pubkey; ed25519=node_ed25519_pubkey; validator_consensus=validator_consensus_pub_key"),
    "set_version": ("set_version_events", "node_addr=thor_address; version=version"),
    "add_liquidity": ("stake_events", "pool=pool; stake_units=liquidity_provider_units:long; rune_addr=rune_address; rune_e8=rune_amount:long; asset_e8=asset_amount:long; asset_addr=asset_address"),
    "pending_liquidity": ("pending_liquidity_events", "pool=pool; rune_addr=rune_address; rune_e8=rune_amount:long; asset_e8=asset_amount:long; asset_addr=asset_address; pending_type=type"),
    "swap": ("swap_events", "tx=id; chain=chain; from_addr=from; to_addr=to; from_asset,from_e8=coin:coin; to_asset,to_e8=emit_asset:coin; memo=memo; pool=pool; to_e8_min=price_target|swap_target:long; swap_slip_bp=trade_slip|swap_slip:long; liq_fee_e8=liquidity_fee:long; liq_fee_in_rune_e8=liquidity_fee_in_rune:long"),
    "switch": ("switch_events", "tx=txid; from_addr=from; to_addr=to; burn_asset,burn_e8=burn:coin; mint_e8=mint:long"),
    "transfer": ("transfer_events", "from_addr=sender; to_addr=recipient; asset,amount_e8=amount:lowcoin"),
    "withdraw": ("unstake_events", "tx=id; chain=chain; from_addr=from; to_addr=to; asset,asset_e8=coin:coin; emit_asset_e8=emit_asset:long; emit_rune_e8=emit_rune:long; memo=memo; pool=pool; stake_units=liquidity_provider_units:long; basis_points=basis_points:long; asymmetry=asymmetry:double; imp_loss_protection_e8=imp_loss_protection:long"),
    "validator_request_leave": ("validator_request_leave_events", "tx=tx; from_addr=signer bnb address|signer; node_addr=destination|node"),
    "pool_balance_change": ("pool_balance_change_events", "asset=asset; rune_amt=rune_amt:long; rune_add=rune_add:bool; asset_amt=asset_amt:long; asset_add=asset_add:bool; reason=reason"),
    "thorname": ("thorname_change_events", "name=name; chain=chain; address=address; registration_fee_e8=registration_fee:long; fund_amount_e8=fund_amount:long; expire=expire:long; owner=owner"),
    "slash_points": ("slash_points", "node_address=node_address; slash_points=slash_points:long; reason=reason"),
    "set_node_mimir": ("set_node_mimir", "address=address; key=value:long; value=key"),
}
#: Types that are known and have no table.
IGNORED = [
    "tx", "coin_spent", "coin_received", "coinbase", "burn", "tss_keygen", "tss_keysign", "create_client", "update_client",
    "connection_open_init", "security", "scheduled_outbound",
]
#: Attributes of rewards and slash events that are no (asset, amount) pair.
NOT_AMOUNTS = {"rewards": ["bond_reward"], "slash": ["pool"]}


def flatten_blocks(blocks: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row per event in block order: begin, transactions, end, extra events; event_idx counts within the block from 0.

    extra: (height, events) of events that belong at the end of their block.
    """
    parts = [F.coalesce("begin", F.array()), F.flatten(F.transform(F.coalesce("txs", F.array()), lambda t: t["events"])), F.coalesce("end", F.array())]
    if extra is not None:
        blocks = blocks.join(extra.select("height", F.col("events").alias("__extra")), "height", "left")
        parts.append(F.coalesce("__extra", F.array()))
    events = F.concat(*parts)
    rows = blocks.select("height", F.col("time_ns").alias("block_timestamp"), F.posexplode(events).alias("event_idx", "event"))
    return rows.select("height", "block_timestamp", F.col("event_idx").cast("long").alias("event_idx"), "event.type", "event.attributes")


def attribute(*keys: str) -> Column:
    """Value of the last attribute with one of the names; null if there is none."""
    hits = F.filter("attributes", lambda a: a["key"].isin(list(keys)))
    return F.try_element_at(hits, F.lit(-1))["value"]


def _field(kind: str, keys: list[str]) -> tuple[list[Column], Column]:
    """Columns of a field, and whether its attribute is there but malformed."""
    raw = attribute(*keys)
    if kind in ("long", "double"):
        value = raw.try_cast(kind)
        return [value], raw.isNotNull() & value.isNull()
    if kind == "bool":
        return [F.when(raw == "true", True).when(raw == "false", False)], raw.isNotNull() & ~raw.isin("true", "false")
    if kind in ("coin", "lowcoin"):
        coin = (parse_coin if kind == "coin" else parse_lower_coin)(raw)
        return [coin["asset"], coin["e8"]], raw.isNotNull() & (coin["asset"].isNull() | coin["e8"].isNull())
    return [raw], F.lit(False)


def _fields(event_type: str) -> tuple[dict[str, Column], Column]:
    """The columns of an event type, and the names of its bad fields."""
    columns, bad = {}, []
    for part in FIELDS[event_type][1].split("; "):
        names, _, source = part.partition("=")
        source, _, kind = source.rpartition(":") if source.rpartition(":")[2] in ("long", "double", "bool", "coin", "lowcoin") else (source, "", "text")
        values, malformed = _field(kind, source.split("|"))
        columns |= dict(zip(names.split(","), values))
        bad.append(F.when(malformed, F.lit(names)))
    if event_type == "swap":
        bad.append(F.when(swap_direction(columns["from_asset"], columns["to_asset"]).isNull(), F.lit("direction")))
    if event_type in ("add_liquidity", "pending_liquidity"):
        bad.append(F.when(F.size(_asset_ids()) > 1, F.lit("txid")))
    return columns, F.array_compact(F.array(*bad))


def _ids() -> Column:
    return F.filter("attributes", lambda a: F.lower(a["key"]).endswith("_txid"))


def _asset_ids() -> Column:
    return F.filter(_ids(), lambda a: F.lower(a["key"]) != "thor_txid")


def decode(events: DataFrame, event_type: str) -> DataFrame:
    """The fields of all events of a type, with `malformed` naming the bad fields (empty if none)."""
    table, _ = FIELDS[event_type]
    rows = events.filter(F.col("type") == event_type)
    columns, malformed = _fields(event_type)
    out = rows.select("*", malformed.alias("malformed"), *[v.alias(k) for k, v in columns.items()])
    out = _extra(out, event_type)
    amounts = [f.name for f in table_schema(table).fields if f.name in columns and f.dataType.simpleString() == "bigint"]
    return out.fillna(0, [c for c in amounts if c not in ("event_idx", "block_timestamp")])


def _extra(rows: DataFrame, event_type: str) -> DataFrame:
    """What a plain field list cannot say."""
    if event_type in ("swap", "outbound", "donate", "refund", "withdraw"):
        for side in ("from_addr", "to_addr"):
            rows = rows.withColumn(side, folded_address(F.col(side), F.col("chain")))
    if event_type == "swap":
        rows = rows.withColumn("_direction", swap_direction(F.col("from_asset"), F.col("to_asset")))
    if event_type == "refund":
        listed = parse_coin_list(attribute("coin"))
        for k, names in enumerate((("asset", "asset_e8"), ("asset_2nd", "asset_2nd_e8"))):
            coin = F.get(listed, F.lit(k))
            rows = rows.withColumn(names[0], coin["asset"]).withColumn(names[1], F.coalesce(coin["e8"], F.lit(0)))
    if event_type in ("add_liquidity", "pending_liquidity"):
        rune = F.filter(_ids(), lambda a: F.lower(a["key"]) == "thor_txid")
        other = _asset_ids()
        rows = rows.withColumn("rune_tx", F.try_element_at(rune, F.lit(-1))["value"])
        rows = rows.withColumn("asset_tx", F.try_element_at(other, F.lit(-1))["value"])
        rows = rows.withColumn("asset_chain", F.upper(F.regexp_replace(F.try_element_at(other, F.lit(-1))["key"], "(?i)_txid$", "")))
        rows = rows.withColumn("asset_addr", folded_address(F.col("asset_addr"), F.col("asset_chain")))
    return rows


def good(decoded: DataFrame, event_type: str) -> DataFrame:
    """Rows of the event's table; columns that are derived later are null."""
    schema = table_schema(FIELDS[event_type][0])
    # as in dead_letters, a filter would make the attributes anew for every field
    rows = decoded.select("*", F.explode(F.filter(F.array("malformed"), lambda bad: F.size(bad) == 0)).alias("__none"))
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def dead_letters(events: DataFrame) -> DataFrame:
    """Events with malformed fields, and of types that are neither known nor ignored, with the reason; one pass."""
    kind = F.col("type")
    reason = F.when(~kind.isin([*FIELDS, "slash", *IGNORED]), F.array(F.lit("unknown type")))
    for event_type in FIELDS:
        reason = reason.when(kind == event_type, _fields(event_type)[1])
    # a generator: a filter on the reason would move below what makes the attributes, and make them anew for every field
    return events.select("*", F.explode(F.filter(F.array(reason), lambda bad: F.size(bad) > 0)).alias("malformed"))


def open_amounts(events: DataFrame, event_type: str) -> DataFrame:
    """(asset, amount) of the attributes of rewards or slash events that are no named field."""
    rows = events.filter(F.col("type") == event_type)
    pairs = F.explode(F.filter("attributes", lambda a: ~a["key"].isin(NOT_AMOUNTS[event_type])))
    pool = attribute("pool").alias("event_pool")
    return rows.select("block_timestamp", "event_idx", pool, pairs.alias("a")).select(
        "block_timestamp", "event_idx", "event_pool", F.col("a.key").alias("asset"), F.col("a.value").try_cast("long").alias("amount")
    )


def rewards_entries(events: DataFrame) -> DataFrame:
    got = open_amounts(events, "rewards").filter("amount is not null")
    return got.select(F.col("asset").alias("pool"), F.col("amount").alias("rune_e8"), "event_idx", "block_timestamp")


def slash_amounts(events: DataFrame) -> DataFrame:
    got = open_amounts(events, "slash").filter("amount is not null")
    return got.select(F.col("event_pool").alias("pool"), "asset", F.col("amount").alias("asset_e8"), "event_idx", "block_timestamp")


def decode_all(events: DataFrame, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Every event table, or those of the given names, lazily; tables that are never read cost only their planning."""
    others = {"rewards_event_entries": rewards_entries, "slash_amounts": slash_amounts}
    wanted = lambda name: tables is None or name in tables
    out = {table: good(decode(events, kind), kind) for kind, (table, _) in FIELDS.items() if wanted(table)}
    return out | {name: make(events) for name, make in others.items() if wanted(name)}


def corrected(
    events: DataFrame,
    extra: DataFrame | None = None,
    discard: DataFrame | None = None,
    patches: DataFrame | None = None,
    times: DataFrame | None = None,
    chain_id: str | None = None,
) -> DataFrame:
    """Apply correction tables: add events, drop (height, type, tx) rows, replace attributes of (height, tx, key), and
    set the time of blocks.

    extra has the columns of events; discard is (height, type, tx); patches is (height, tx, key, value); times is
    (height, block_timestamp). tx is the event's id, tx_id, in_tx_id or tx attribute, the first that it has. Tables with a chain_id column hold the corrections of
    several chains, of which those of the given one are applied; without a chain_id no such row is. events can be a
    stream, but for extra events, which then are a stream too.
    """

    def own(table):
        if table is None or "chain_id" not in table.columns:
            return table
        return table.filter(F.col("chain_id") == F.lit(chain_id)).drop("chain_id")

    extra, discard, patches, times = map(own, (extra, discard, patches, times))
    tx = F.coalesce(*[attribute(name) for name in ("id", "tx_id", "in_tx_id", "tx")])
    if times is not None:
        moved = times.select("height", F.col("block_timestamp").alias("__time"))
        joined = events.join(moved, "height", "left").withColumn("block_timestamp", F.coalesce("__time", "block_timestamp"))
        events = joined.select(*events.columns)
    if discard is not None:
        marked = events.withColumn("tx", tx)
        events = marked.join(discard, ["height", "type", "tx"], "left_anti").select(*events.columns)
    if patches is not None:
        new = patches.groupBy("height", "tx").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("new"))
        joined = events.withColumn("tx", tx).join(new, ["height", "tx"], "left")
        value = lambda a: F.coalesce(F.try_element_at("new", a["key"]), a["value"])
        patched = F.transform("attributes", lambda a: F.struct(a["key"].alias("key"), value(a).alias("value")))
        events = joined.withColumn("attributes", patched).select(*events.columns)
    return events if extra is None else events.unionByName(extra)


# Fixed value: what stands before a text that should be base64 and is not.
NO_BASE64 = "ERROR during base64 decoding: "


def unwrap_base64(value: Column) -> Column:
    """Base64 text decoded; a text that is none is kept behind a mark."""
    decoded = F.try_to_binary(value, F.lit("base64")).cast("string")
    return F.when(value.isNotNull(), F.coalesce(decoded, F.concat(F.lit(NO_BASE64), value)))


def unwrapped(value: Column, kind: T.DataType, names: tuple[str, ...] = ("key", "value", "data")) -> Column:
    """A nested column with every text field of the given names decoded from base64, at any depth of structs and arrays."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: unwrapped(x, kind.elementType, names))
    if not isinstance(kind, T.StructType):
        return value
    fields = []
    for field in kind.fields:
        inner = value[field.name]
        text = field.name in names and isinstance(field.dataType, T.StringType)
        fields.append((unwrap_base64(inner) if text else unwrapped(inner, field.dataType, names)).alias(field.name))
    return F.when(value.isNotNull(), F.struct(*fields))


def squashed_attributes(attributes: Column) -> Column:
    """Attributes as a map if no key repeats, else null."""
    keys = F.transform(attributes, lambda a: a["key"])
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(attributes))
