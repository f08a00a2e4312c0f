"""One query over every event type that the others don't meet: the supplied events as chain events of each type in turn.

An event's attributes are given as expressions over u (its user) and e (its number), and so is what its table must hold;
the expressions mean the same to Spark and to the SQL. Every seventh event has its number spoilt and must be left out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from poolscope.operators import decode
from poolscope.plans import adapters as A
from poolscope.registry import query

_TX = {"id": "'t' || u", "chain": "'BTC'", "from": "'F' || u", "to": "'T' || u", "memo": "'m' || e"}
_TX_ROW = {"tx": "'t' || u", "chain": "'BTC'", "from_addr": "'F' || u", "to_addr": "'T' || u", "memo": "'m' || e"}
_COIN, _COIN_ROW = {"coin": "e || ' BTC.BTC'"}, {"asset": "'BTC.BTC'", "asset_e8": "e"}

#: By event type its attributes, its table, and the table's columns.
TYPES: dict[str, tuple[dict[str, str], str, dict[str, str]]] = {
    "ActiveVault": ({"add new asgard vault": "'v' || u"}, "active_vault_events", {"add_asgard_addr": "'v' || u"}),
    "InactiveVault": ({"set inactive vault": "'v' || u"}, "inactive_vault_events", {"add_asgard_addr": "'v' || u"}),
    "UpdateNodeAccountStatus": (
        {"Address": "'n' || u", "Former:": "'Standby'", "Current:": "'Active'"},
        "update_node_account_status_events", {"node_addr": "'n' || u", "former": "'Standby'", "current": "'Active'"},
    ),
    "donate": (
        _TX | _COIN | {"chain": "'ETH'", "pool": "'ETH.ETH'"}, "add_events",
        _TX_ROW | _COIN_ROW | {"chain": "'ETH'", "from_addr": "'f' || u", "to_addr": "'t' || u", "pool": "'ETH.ETH'"},
    ),
    "asgard_fund_yggdrasil": (
        {"tx": "'t' || u", "coins": "e || ' BTC.BTC'", "pubkey": "'k' || u"}, "asgard_fund_yggdrasil_events", _COIN_ROW | {"tx": "'t' || u", "vault_key": "'k' || u"},
    ),
    "bond": (_TX | _COIN | {"amount": "u", "bound_type": "'bond_paid'"}, "bond_events", _TX_ROW | _COIN_ROW | {"e8": "u", "bond_type": "'bond_paid'"}),
    "errata": (
        {"in_tx_id": "'i' || u", "asset": "'BNB.BNB'", "asset_amt": "e", "rune_amt": "u"}, "errata_events",
        {"in_tx": "'i' || u", "asset": "'BNB.BNB'", "asset_e8": "e", "rune_e8": "u"},
    ),
    "fee": ({"tx_id": "'t' || u", "coins": "e || ' BTC.BTC'", "pool_deduct": "u"}, "fee_events", _COIN_ROW | {"tx": "'t' || u", "pool_deduct": "u"}),
    "gas": (
        {"asset": "'BTC.BTC'", "asset_amt": "e", "rune_amt": "u", "transaction_count": "e"}, "gas_events",
        {"asset": "'BTC.BTC'", "asset_e8": "e", "rune_e8": "u", "tx_count": "e"},
    ),
    "set_mimir": ({"key": "'K' || u", "value": "e"}, "set_mimir_events", {"key": "'K' || u", "value": "e"}),
    "message": ({"sender": "'s' || u", "action": "'deposit'"}, "message_events", {"from_addr": "'s' || u", "action": "'deposit'"}),
    "new_node": ({"address": "'n' || u"}, "new_node_events", {"node_addr": "'n' || u"}),
    "pool": ({"pool": "'BTC.BTC'", "pool_status": "'Staged'"}, "pool_events", {"asset": "'BTC.BTC'", "status": "'Staged'"}),
    "refund": (
        _TX | {"coin": "e || ' BTC.BTC, ' || u || ' ETH.ETH'", "code": "u", "reason": "'late'"}, "refund_events",
        _TX_ROW | _COIN_ROW | {"asset_2nd": "'ETH.ETH'", "asset_2nd_e8": "u", "code": "u", "reason": "'late'"},
    ),
    "reserve": (_TX | _COIN | {"contributor_address": "'c' || u", "amount": "u"}, "reserve_events", _TX_ROW | _COIN_ROW | {"addr": "'c' || u", "e8": "u"}),
    "set_ip_address": ({"thor_address": "'n' || u", "address": "'10.0.0.' || u"}, "set_ip_address_events", {"node_addr": "'n' || u", "ip_addr": "'10.0.0.' || u"}),
    "set_node_keys": (
        {"node_address": "'n' || u", "node_secp256k1_pubkey": "'s' || u", "node_ed25519_pubkey": "'e' || u", "validator_consensus_pub_key": "'v' || u"},
        "set_node_keys_events", {"node_addr": "'n' || u", "secp256k1": "'s' || u", "ed25519": "'e' || u", "validator_consensus": "'v' || u"},
    ),
    "set_version": ({"thor_address": "'n' || u", "version": "'1.' || e || '.0'"}, "set_version_events", {"node_addr": "'n' || u", "version": "'1.' || e || '.0'"}),
    "pending_liquidity": (
        {"pool": "'ETH.ETH'", "rune_address": "'r' || u", "rune_amount": "u", "asset_amount": "e", "asset_address": "'0xA' || u", "type": "'add'", "THOR_txid": "'h' || u", "eth_txid": "'a' || u"},
        "pending_liquidity_events",
        {"pool": "'ETH.ETH'", "rune_addr": "'r' || u", "rune_e8": "u", "asset_e8": "e", "asset_addr": "'0xa' || u", "pending_type": "'add'", "rune_tx": "'h' || u", "asset_tx": "'a' || u", "asset_chain": "'ETH'"},
    ),
    "switch": (
        {"txid": "'t' || u", "from": "'F' || u", "to": "'T' || u", "burn": "e || ' BNB.RUNE'", "mint": "u"}, "switch_events",
        {"tx": "'t' || u", "from_addr": "'F' || u", "to_addr": "'T' || u", "burn_asset": "'BNB.RUNE'", "burn_e8": "e", "mint_e8": "u"},
    ),
    "transfer": (
        {"sender": "'s' || u", "recipient": "'r' || u", "amount": "e || 'btc/btc'"}, "transfer_events",
        {"from_addr": "'s' || u", "to_addr": "'r' || u", "asset": "'BTC/BTC'", "amount_e8": "e"},
    ),
    "withdraw": (
        _TX | _COIN | {"emit_asset": "u", "emit_rune": "e", "pool": "'BTC.BTC'", "liquidity_provider_units": "e", "basis_points": "u", "asymmetry": "'0.5'", "imp_loss_protection": "u"},
        "unstake_events",
        _TX_ROW | _COIN_ROW | {"emit_asset_e8": "u", "emit_rune_e8": "e", "pool": "'BTC.BTC'", "stake_units": "e", "basis_points": "u", "asymmetry": "'0.5'", "imp_loss_protection_e8": "u"},
    ),
    "validator_request_leave": (
        {"tx": "'t' || u", "signer bnb address": "'s' || u", "destination": "'n' || u"}, "validator_request_leave_events",
        {"tx": "'t' || u", "from_addr": "'s' || u", "node_addr": "'n' || u"},
    ),
    "pool_balance_change": (
        {"asset": "'BTC.BTC'", "rune_amt": "u", "rune_add": "'true'", "asset_amt": "e", "asset_add": "'false'", "reason": "'fix'"}, "pool_balance_change_events",
        {"asset": "'BTC.BTC'", "rune_amt": "u", "rune_add": "'true'", "asset_amt": "e", "asset_add": "'false'", "reason": "'fix'"},
    ),
    "thorname": (
        {"name": "'n' || u", "chain": "'BTC'", "address": "'a' || u", "registration_fee": "e", "fund_amount": "u", "expire": "e", "owner": "'o' || u"}, "thorname_change_events",
        {"name": "'n' || u", "chain": "'BTC'", "address": "'a' || u", "registration_fee_e8": "e", "fund_amount_e8": "u", "expire": "e", "owner": "'o' || u"},
    ),
    "slash_points": ({"node_address": "'n' || u", "slash_points": "e", "reason": "'slow'"}, "slash_points", {"node_address": "'n' || u", "slash_points": "e", "reason": "'slow'"}),
    "set_node_mimir": ({"address": "'n' || u", "value": "e", "key": "'K' || u"}, "set_node_mimir", {"address": "'n' || u", "key": "e", "value": "'K' || u"}),
}

#: By type the attribute that every seventh event has spoilt, where the type has a number that can be.
NUMBERS = ["amount", "coins", "asset_amt", "code", "rune_amount", "mint", "basis_points", "registration_fee", "slash_points", "coin"]


def spoilt(kind: str) -> str | None:
    return next((a for a in NUMBERS if a in TYPES[kind][0]), None) if kind != "set_node_mimir" else "value"


def sql() -> str:
    parts = []
    for k, (kind, (_, table, row)) in enumerate(TYPES.items()):
        good = "AND e % 7 <> 0" if spoilt(kind) else ""
        for name, value in row.items():
            parts.append(f"SELECT '{table}' AS table_name, e AS event_id, '{name}' AS field, ({value})::VARCHAR AS value FROM ev WHERE e % {len(TYPES)} = {k} {good}")
    return "WITH ev AS (SELECT event_id AS e, user_id AS u FROM events) " + " UNION ALL ".join(parts)


@query("dec1_dec2_rows_of_every_type", sql())
def every_type(spark, d):
    """Each field of each table, as text, of the events that are well-formed."""
    rows = A.table(spark, d, "events").select(F.col("event_id").alias("e"), F.col("user_id").alias("u"), A.nanos("ts").alias("block_timestamp"))
    kind, listed = F.lit(None).cast("string"), F.lit(None).cast("array<struct<key:string,value:string>>")
    for k, (name, (attributes, _, _)) in enumerate(TYPES.items()):
        pairs = []
        for key, value in attributes.items():
            text = F.expr(value).cast("string")
            text = F.when(F.col("e") % 7 == 0, F.lit("x")).otherwise(text) if key == spoilt(name) else text
            pairs.append(F.struct(F.lit(key).alias("key"), text.alias("value")))
        now = F.col("e") % len(TYPES) == k
        kind, listed = F.when(now, name).otherwise(kind), F.when(now, F.array(*pairs)).otherwise(listed)
    events = rows.select(F.col("e").alias("height"), "block_timestamp", F.col("e").alias("event_idx"), kind.alias("type"), listed.alias("attributes"))
    out = None
    tables = decode.decode_all(events, [table for _, table, _ in TYPES.values()])
    for _, table, row in TYPES.values():
        fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in row])
        told = tables[table].select(F.lit(table).alias("table_name"), F.col("event_idx").alias("event_id"), F.explode(fields).alias("f"))
        told = told.select("table_name", "event_id", "f.field", "f.value")
        out = told if out is None else out.unionByName(told)
    return out
