"""Schemas of the event tables, and their fingerprint.

Amounts are longs scaled by 1e8; block_timestamp is nanoseconds as long. Every table ends with block_timestamp, and
event_idx orders events within a block.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import types as T

# The names and types of each event table's own columns.
_COLUMNS = {
    "active_vault_events": "add_asgard_addr string",
    "add_events": "tx string, chain string, from_addr string, to_addr string, asset string, asset_e8 long, memo string, rune_e8 long, pool string",
    "asgard_fund_yggdrasil_events": "tx string, asset string, asset_e8 long, vault_key string",
    "bond_events": "tx string, chain string, from_addr string, to_addr string, asset string, asset_e8 long, memo string, bond_type string, e8 long",
    "errata_events": "in_tx string, asset string, asset_e8 long, rune_e8 long",
    "fee_events": "tx string, asset string, asset_e8 long, pool_deduct long",
    "gas_events": "asset string, asset_e8 long, rune_e8 long, tx_count long",
    "inactive_vault_events": "add_asgard_addr string",
    "message_events": "from_addr string, action string",
    "new_node_events": "node_addr string",
    "outbound_events": "tx string, chain string, from_addr string, to_addr string, asset string, asset_e8 long, memo string, in_tx string",
    "pending_liquidity_events": "pool string, asset_tx string, asset_chain string, asset_addr string, asset_e8 long, rune_tx string, rune_addr string, rune_e8 long, pending_type string",
    "pool_balance_change_events": "asset string, rune_amt long, rune_add boolean, asset_amt long, asset_add boolean, reason string",
    "pool_events": "asset string, status string",
    "refund_events": "tx string, chain string, from_addr string, to_addr string, asset string, asset_e8 long, asset_2nd string, asset_2nd_e8 long, memo string, code long, reason string",
    "reserve_events": "tx string, chain string, from_addr string, to_addr string, asset string, asset_e8 long, memo string, addr string, e8 long",
    "rewards_event_entries": "pool string, rune_e8 long",
    "rewards_events": "bond_e8 long",
    "set_ip_address_events": "node_addr string, ip_addr string",
    "set_mimir_events": "key string, value string",
    "set_node_keys_events": "node_addr string, secp256k1 string, ed25519 string, validator_consensus string",
    "set_node_mimir": "address string, key long, value string",
    "set_version_events": "node_addr string, version string",
    "slash_amounts": "pool string, asset string, asset_e8 long",
    "slash_points": "node_address string, slash_points long, reason string",
    "stake_events": "pool string, asset_tx string, asset_chain string, asset_addr string, asset_e8 long, stake_units long, rune_tx string, rune_addr string, rune_e8 long, _asset_in_rune_e8 long",
    "swap_events": "tx string, chain string, from_addr string, to_addr string, from_asset string, from_e8 long, to_asset string, to_e8 long, memo string, pool string, to_e8_min long, swap_slip_bp long, liq_fee_e8 long, liq_fee_in_rune_e8 long, _direction int, priceusd double",
    "switch_events": "tx string, from_addr string, to_addr string, burn_asset string, burn_e8 long, mint_e8 long",
    "thorname_change_events": "name string, chain string, address string, registration_fee_e8 long, fund_amount_e8 long, expire long, owner string",
    "transfer_events": "from_addr string, to_addr string, asset string, amount_e8 long",
    "unstake_events": "tx string, chain string, from_addr string, to_addr string, asset string, asset_e8 long, emit_asset_e8 long, emit_rune_e8 long, memo string, pool string, stake_units long, basis_points long, asymmetry double, imp_loss_protection_e8 long, _emit_asset_in_rune_e8 long",
    "update_node_account_status_events": "node_addr string, former string, current string",
    "validator_request_leave_events": "tx string, from_addr string, node_addr string",
}

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _struct(columns: str) -> T.StructType:
    pairs = [c.split() for c in columns.split(", ")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


#: Raw blocks: events of the block's start, of each transaction, and of its end.
EVENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("attributes", T.ArrayType(_struct("key string, value string")))])
BLOCK = _struct("height long, time_ns long, hash string")
BLOCK = BLOCK.add("begin", T.ArrayType(EVENT)).add("txs", T.ArrayType(T.StructType([T.StructField("events", T.ArrayType(EVENT))]))).add("end", T.ArrayType(EVENT))
BLOCK_LOG = _struct("height long, timestamp long, hash string")
POOL_DEPTHS = _struct("pool string, asset_e8 long, rune_e8 long, synth_e8 long, price double, priceusd double, units long, block_timestamp long")


def table_schema(name: str) -> T.StructType:
    return _struct(f"{_COLUMNS[name]}, event_idx long, block_timestamp long")


def table_names() -> list[str]:
    return sorted(_COLUMNS)


def schema_hash() -> str:
    """Fingerprint stored beside the data; a table set with another fingerprint is to be rebuilt."""
    told = "\n".join(f"{name}: {table_schema(name).simpleString()}" for name in table_names())
    return hashlib.md5((told + POOL_DEPTHS.simpleString() + BLOCK.simpleString()).encode()).hexdigest()
