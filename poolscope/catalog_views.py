"""Queries of whole reports: actions, members, pools, statistics and LP details with all their columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolscope import catalog as C
from poolscope.functions.numeric import NANOS
from poolscope.operators import actions, buckets, depths, history, ledger, lookups
from poolscope.plans import adapters as A
from poolscope.registry import query

RUNE = A.RUNE
DAYS, USD_POOLS = C.EVENT_DAYS, C.USD_POOLS


def rounded(rows: DataFrame, places: int, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, places) for n in names})


# --- members ---

#: State of a fold over a member's changes; each field's value in a new life.
BLANK = {
    "units": "0::BIGINT", "aa": "0::BIGINT", "ar": "0::BIGINT", "wa": "0::BIGINT", "wr": "0::BIGINT", "pa": "0::BIGINT", "pr": "0::BIGINT",
    "addr": "NULL::VARCHAR", "rune": "NULL::VARCHAR", "first": "NULL::BIGINT", "last": "NULL::BIGINT",
}


def fold_sql() -> str:
    """A fold of each member's changes in order of time, then kind; a state without units and pendings ends a life."""
    old = {k: f"(CASE WHEN s.alive THEN s.{k} ELSE {v} END)" for k, v in BLANK.items()}
    on = lambda kind, name, value: f"{old[name]} + CASE WHEN c.kind = '{kind}' THEN {value} ELSE 0 END"
    pending = lambda name, value: f"CASE WHEN c.kind IN ('add', 'pending_withdraw') THEN 0 ELSE {on('pending_add', name, value)} END"
    new = {
        "units": f"{old['units']} + c.units", "aa": on("add", "aa", "c.aa"), "ar": on("add", "ar", "c.ar"), "wa": on("withdraw", "wa", "c.aa"),
        "wr": on("withdraw", "wr", "c.ar"), "pa": pending("pa", "c.aa"), "pr": pending("pr", "c.ar"),
        "addr": f"coalesce({old['addr']}, c.addr)", "rune": f"coalesce({old['rune']}, c.rune)",
        "first": f"coalesce({old['first']}, CASE WHEN c.kind = 'add' THEN c.t END)",
        "last": f"CASE WHEN c.kind = 'add' THEN c.t ELSE {old['last']} END",
    }
    alive = f"({new['units']}) <> 0 OR ({new['pa']}) <> 0 OR ({new['pr']}) <> 0"
    fields = ", ".join(f"{k} := {v}" for k, v in new.items())
    start = ", ".join(f"{k} := {v}" for k, v in BLANK.items())
    return f"""{A.LIQUIDITY}, ch AS (
      SELECT coalesce(rune_addr, asset_addr) AS member_id, pool, block_timestamp AS t, 'add' AS kind, event_idx AS i, stake_units AS u, asset_addr AS a, rune_addr AS r, asset_e8 AS ae, rune_e8 AS re FROM stake_events
      UNION ALL SELECT from_addr, pool, block_timestamp, 'withdraw', event_idx, -stake_units, NULL, NULL, emit_asset_e8, emit_rune_e8 FROM unstake_events
      UNION ALL SELECT coalesce(rune_addr, asset_addr), pool, block_timestamp, 'pending_' || pending_type, event_idx, 0, asset_addr, rune_addr, asset_e8, rune_e8 FROM pending_events),
    folded AS (SELECT member_id, pool, list_reduce(
      list(struct_pack(units := u::BIGINT, aa := ae::BIGINT, ar := re::BIGINT, wa := 0::BIGINT, wr := 0::BIGINT, pa := 0::BIGINT, pr := 0::BIGINT, addr := a, rune := r,
        first := NULL::BIGINT, last := NULL::BIGINT, alive := false, kind := kind, t := t) ORDER BY t, kind, i, u),
      lambda s, c: struct_pack({fields}, alive := {alive}, kind := c.kind, t := c.t),
      struct_pack({start}, alive := false, kind := '', t := 0::BIGINT)) AS s FROM ch GROUP BY 1, 2),
    members AS (SELECT member_id, pool, s.addr AS asset_addr, s.rune AS rune_addr, s.units AS units, s.aa AS added_asset, s.ar AS added_rune, s.wa AS withdrawn_asset, s.wr AS withdrawn_rune,
      s.pa AS pending_asset, s.pr AS pending_rune, s.first AS first_added, s.last AS last_added FROM folded WHERE s.alive)"""


MEMBERS = fold_sql()


def members(spark, d) -> DataFrame:
    return ledger.members(ledger.member_changes(A.stake_events(spark, d), A.unstake_events(spark, d), A.pending_liquidity_events(spark, d)))


@query("mv6_q9_members", f"WITH {MEMBERS} SELECT * FROM members")
def mv6(spark, d):
    return members(spark, d)


def member_pools_sql(address: str) -> str:
    return f"""SELECT pool, units, added_asset, added_rune, withdrawn_asset, withdrawn_rune, pending_asset, pending_rune, coalesce(rune_addr, '') AS rune_addr,
    coalesce(asset_addr, '') AS asset_addr, coalesce(first_added // 1000000000, 0) AS first_added, coalesce(last_added // 1000000000, 0) AS last_added
    FROM members WHERE member_id = '{address}' OR asset_addr = '{address}'"""


@query("q9_member_by_id", f"WITH {MEMBERS} {member_pools_sql('r10')}")
def q9_id(spark, d):
    return ledger.member_pools(members(spark, d), "r10")


@query("q9_member_by_asset_address", f"WITH {MEMBERS} {member_pools_sql('a10')}")
def q9_address(spark, d):
    return ledger.member_pools(members(spark, d), "a10")


@query("fil9_lowered_address", f"WITH {MEMBERS} {member_pools_sql('a11')}")
def fil9(spark, d):
    return ledger.exact_or_lowered(lambda address: ledger.member_pools(members(spark, d), address), "A11")


@query("join11_balances_of_slice", f"WITH {C.DELTAS} SELECT addr, asset, sum(delta)::BIGINT AS balance FROM deltas WHERE (addr, asset) IN (SELECT addr, asset FROM deltas WHERE {C.inside(C.WINDOW)}) GROUP BY 1, 2")
def join11(spark, d):
    return ledger.balances_now(A.transfer_events(spark, d), C.WINDOW.holds(F.col("block_timestamp")))


@query("join1_last_activation_height", "SELECT max(event_id) AS height FROM events WHERE event_type = 'signup'")
def join1(spark, d):
    activations = A.table(spark, d, "events").filter("event_type = 'signup'").select(A.nanos("ts").alias("block_timestamp"))
    return lookups.last_activation_height(activations, A.block_log(spark, d))


@query(
    "q16_node_keys",
    """WITH k AS (SELECT 'secp256k1' AS kind, 's' || (c_custkey % 40) AS key, 'n' || c_nationkey AS node_addr, c_custkey AS t FROM customer
    UNION ALL SELECT 'ed25519', 'e' || (c_custkey % 60), 'n' || c_nationkey, c_custkey FROM customer) SELECT kind, key, max_by(node_addr, t) AS node_addr FROM k WHERE t <= 100 GROUP BY 1, 2""",
)
def q16(spark, d):
    return lookups.node_keys(A.node_keys(spark, d), 100 * NANOS)


# --- actions ---


def text_of(transactions):
    """A list of transactions as text: id|address|coins, with - for no coins."""
    empty = F.lit("")
    coins = lambda t: F.array_join(F.transform(t["coins"], lambda c: F.concat(c["asset"], F.lit(":"), c["amount"].cast("string"))), "+")
    one = lambda t: F.concat(F.coalesce(t["tx_id"], empty), F.lit("|"), F.coalesce(t["address"], empty), F.lit("|"), F.coalesce(coins(t), F.lit("-")))
    return F.array_join(F.transform(transactions, one), ";")


def shown(rows: DataFrame) -> DataFrame:
    """Actions with every column as plain values."""
    lists = {c: F.array_join(c, ",") for c in ("addresses", "transactions", "assets")} | {"pools": F.coalesce(F.array_join("pools", ","), F.lit(""))}
    fees = F.array_join(F.transform("fees", lambda f: F.concat(f["asset"], F.lit(":"), f["amount"].cast("string"))), ";")
    out = {"block_timestamp": F.col("block_timestamp"), "type": F.col("type"), "main_ref": F.col("main_ref")} | lists
    out |= {"ins": text_of(F.col("ins")), "outs": text_of(F.col("outs")), "fees": fees}
    out |= {name: F.col("meta")[name] for name in actions.META if name != "status"}
    out |= {name: F.col(name) for name in ("status", "total") if name in rows.columns}
    return rows.select(*[v.alias(k) for k, v in out.items()])


def tx_sql(tx: str, address: str, *coins: tuple[str, str]) -> str:
    listed = f"list_filter([{', '.join(f'CASE WHEN {e} > 0 THEN {a} || chr(58) || {e} END' for a, e in coins)}], lambda x: x IS NOT NULL)"
    return f"coalesce({tx}, '') || '|' || coalesce({address}, '') || '|' || CASE WHEN len({listed}) > 0 THEN array_to_string({listed}, '+') ELSE '-' END"


#: The columns of an action in SQL, with what they are where an action has none.
ACTION = {
    "type": None, "main_ref": "NULL::VARCHAR", "block_timestamp": None, "addresses": None, "transactions": None, "assets": None, "pools": "''", "ins": None, "first_outs": "''",
    "first_amount": "0::BIGINT", "swapSingle": "NULL::BOOLEAN", "liquidityFee": "NULL::BIGINT", "swapTarget": "NULL::BIGINT", "swapSlip": "NULL::BIGINT", "affiliateFee": "NULL::BIGINT",
    "affiliateAddress": "NULL::VARCHAR", "asymmetry": "NULL::DOUBLE", "basisPoints": "NULL::BIGINT", "impermanentLossProtection": "NULL::BIGINT", "liquidityUnits": "NULL::BIGINT",
    "emitAssetE8": "NULL::BIGINT", "emitRuneE8": "NULL::BIGINT", "reason": "NULL::VARCHAR", "told": "NULL::VARCHAR", "order_key": "''",
}


def action_sql(source: str, **given: str) -> str:
    return f"SELECT {', '.join(f'{given.get(k, v)} AS {k}' for k, v in ACTION.items())} FROM {source}"


def present(*values: str) -> str:
    return f"concat_ws(',', {', '.join(values)})"


AFFILIATE = r"'aff' || regexp_extract({m}, ':aff(\d+):', 1)"
AFFILIATE_FEE = r"regexp_extract({m}, ':(\d+)$', 1)::BIGINT"
LIQUIDITY_INS = "array_to_string(list_filter([CASE WHEN {re} > 0 THEN " + tx_sql("{rt}", "rune_addr", (f"'{RUNE}'", "{re}")) + " END, CASE WHEN {ae} > 0 THEN " + tx_sql("{at}", "asset_addr", ("pool", "{ae}")) + " END], lambda x: x IS NOT NULL), ';')"

ACTIONS = f"""{A.SWAPS}, {A.LIQUIDITY}, open_pending AS ({C.OPEN}),
outbounds AS (SELECT l_orderkey::VARCHAR AS in_tx, CASE WHEN l_linenumber <> 1 THEN 'o' || l_partkey END AS tx, l_suppkey::VARCHAR AS to_addr, (l_quantity * 100)::BIGINT AS e8,
  CASE WHEN l_linenumber = 1 THEN '{RUNE}' ELSE l_returnflag || '.' || l_linestatus END AS asset, l_partkey * 8 + l_linenumber AS i, epoch_us(l_shipdate) AS t FROM lineitem WHERE l_linenumber <= 2),
charges AS (SELECT l_orderkey::VARCHAR AS tx, l_suppkey AS amount, l_partkey * 8 + l_linenumber AS i, epoch_us(l_shipdate) AS t FROM lineitem WHERE l_linenumber = 3),
all_actions AS (
{action_sql("supplier", type="'switch'", main_ref="'sw' || s_suppkey", block_timestamp="s_suppkey * 3600 * 1000000000", addresses=present("'bnb' || s_suppkey", "CASE WHEN s_suppkey % 3 <> 0 THEN 'thor' || s_suppkey END"), transactions="'sw' || s_suppkey",
    assets=f"'BNB.RUNE-B1A,{RUNE}'", ins=tx_sql("'sw' || s_suppkey", "'bnb' || s_suppkey", ("'BNB.RUNE-B1A'", "(s_acctbal * 100)::BIGINT")),
    first_outs=tx_sql("NULL", "CASE WHEN s_suppkey % 3 <> 0 THEN 'thor' || s_suppkey END", (f"'{RUNE}'", "(s_acctbal * 100)::BIGINT")))}
UNION ALL {action_sql("customer", type="'refund'", main_ref="'re' || c_custkey", block_timestamp="c_custkey * 60 * 1000000000", addresses="'x' || c_custkey || ',vault'", transactions="'re' || c_custkey",
    assets="CASE c_custkey % 2 WHEN 0 THEN 'BTC.BTC,ETH.ETH' ELSE 'BTC.BTC' END", ins=tx_sql("'re' || c_custkey", "'x' || c_custkey", ("'BTC.BTC'", "(c_acctbal * 100)::BIGINT")), reason="c_mktsegment", first_amount="(c_acctbal * 100)::BIGINT")}
UNION ALL {action_sql("customer", type="'donate'", main_ref="'do' || c_custkey", block_timestamp="c_custkey * 61 * 1000000000", addresses="'x' || c_custkey || ',vault'", transactions="'do' || c_custkey",
    assets=f"CASE WHEN c_custkey % 3 > 0 THEN 'D.' || c_nationkey || ',{RUNE}' ELSE 'D.' || c_nationkey END", pools="'D.' || c_nationkey",
    ins=tx_sql("'do' || c_custkey", "'x' || c_custkey", ("'D.' || c_nationkey", "c_custkey"), (f"'{RUNE}'", "c_custkey % 3")))}
UNION ALL {action_sql("unstake_events", type="'withdraw'", main_ref="event_idx::VARCHAR", block_timestamp="block_timestamp", addresses="from_addr || ',vault'", transactions="event_idx::VARCHAR", assets="pool", pools="pool",
    ins=tx_sql("event_idx::VARCHAR", "from_addr", ("pool", "1")), asymmetry="0.5::DOUBLE", basisPoints="5000", impermanentLossProtection="0", liquidityUnits="-stake_units", emitAssetE8="emit_asset_e8", emitRuneE8="emit_rune_e8")}
UNION ALL {action_sql("(SELECT * FROM swap_events a WHERE NOT EXISTS (SELECT 1 FROM swap_events b WHERE b.tx = a.tx AND b.block_timestamp = a.block_timestamp AND b.from_asset <> a.from_asset))",
    type="'swap'", main_ref="tx", block_timestamp="block_timestamp", addresses="from_addr || ',' || to_addr", transactions="tx", assets="from_asset || ',' || to_asset", pools="pool", ins=tx_sql("tx", "from_addr", ("from_asset", "from_e8")),
    swapSingle="true", liquidityFee="liq_fee_in_rune_e8", swapTarget="0", swapSlip="swap_slip_bp", affiliateFee=AFFILIATE_FEE.format(m="memo"), affiliateAddress=AFFILIATE.format(m="memo"))}
UNION ALL {action_sql(f"swap_events a JOIN swap_events b ON a.tx = b.tx AND a.block_timestamp = b.block_timestamp AND a.to_asset = '{RUNE}' AND b.from_asset = '{RUNE}' AND a.from_asset <> b.to_asset",
    type="'swap'", main_ref="a.tx", block_timestamp="a.block_timestamp", addresses="a.from_addr || ',' || a.to_addr", transactions="a.tx", assets="a.from_asset || ',' || b.to_asset",
    pools="CASE WHEN a.pool <> b.pool THEN a.pool || ',' || b.pool ELSE a.pool END", ins=tx_sql("a.tx", "a.from_addr", ("a.from_asset", "a.from_e8")), swapSingle="false",
    liquidityFee="a.liq_fee_in_rune_e8 + b.liq_fee_in_rune_e8", swapTarget="0", swapSlip="a.swap_slip_bp + b.swap_slip_bp - a.swap_slip_bp * b.swap_slip_bp // 10000",
    affiliateFee=AFFILIATE_FEE.format(m="a.memo"), affiliateAddress=AFFILIATE.format(m="a.memo"))}
UNION ALL {action_sql("stake_events", type="'addLiquidity'", block_timestamp="block_timestamp", addresses=present("rune_addr", "asset_addr"), transactions="event_idx || ',' || event_idx", assets=f"pool || ',{RUNE}'", pools="pool",
    ins=LIQUIDITY_INS.format(rt="event_idx::VARCHAR", at="event_idx::VARCHAR", re="rune_e8", ae="asset_e8"), liquidityUnits="stake_units", told="'success'")}
UNION ALL {action_sql("open_pending", type="'addLiquidity'", main_ref="'PL:' || rune_addr || ':' || pool", block_timestamp="block_timestamp", addresses=present("rune_addr", "asset_addr"), transactions="event_idx::VARCHAR", assets=f"pool || ',{RUNE}'", pools="pool",
    ins=LIQUIDITY_INS.format(rt="NULL::VARCHAR", at="event_idx::VARCHAR", re="rune_e8", ae="asset_e8"), told="'pending'")}),
o AS (SELECT in_tx, string_agg('vault', ',' ORDER BY t, i) AS froms, string_agg(to_addr, ',' ORDER BY t, i) AS tos, string_agg(tx, ',' ORDER BY t, i) AS txs, string_agg(asset, ',' ORDER BY t, i) AS kinds,
  string_agg(coalesce(tx, '') || '|' || to_addr || '|' || asset || ':' || e8, ';' ORDER BY t, i) AS every, string_agg(tx || '|' || to_addr || '|' || asset || ':' || e8, ';' ORDER BY t, i) AS outer_outs,
  max_by(e8, (t, i)) FILTER (asset = '{RUNE}') AS rune_out, max_by(e8, (t, i)) FILTER (asset <> '{RUNE}') AS asset_out FROM outbounds GROUP BY 1),
f AS (SELECT tx, string_agg('{RUNE}:' || amount, ';' ORDER BY t, i) AS fees, max_by(amount, (t, i)) AS rune_fee FROM charges GROUP BY 1),
joined AS (SELECT x.*, o.froms, o.tos, o.txs, o.kinds, o.every, o.outer_outs, o.rune_out, o.asset_out, f.fees AS charged, f.rune_fee, CASE WHEN o.in_tx IS NULL THEN x.first_outs WHEN x.first_outs <> '' THEN x.first_outs || ';' || o.every ELSE o.every END AS all_outs,
  CASE WHEN x.type = 'swap' AND NOT x.swapSingle THEN coalesce(o.outer_outs, '') ELSE coalesce(o.every, '') END AS visible
  FROM all_actions x LEFT JOIN o ON o.in_tx = x.main_ref LEFT JOIN f ON f.tx = x.main_ref),
actions AS (SELECT type, main_ref, block_timestamp, concat_ws(',', addresses, froms, tos) AS addresses, concat_ws(',', transactions, nullif(txs, '')) AS transactions, concat_ws(',', assets, kinds) AS assets, pools, ins,
  coalesce(charged, '') AS fees, swapSingle, liquidityFee, swapTarget, swapSlip, affiliateFee, affiliateAddress, asymmetry, basisPoints, impermanentLossProtection, liquidityUnits, emitAssetE8, emitRuneE8, reason, all_outs, visible, first_outs,
  CASE WHEN type = 'swap' THEN CASE WHEN visible = '' THEN 'pending' ELSE 'success' END WHEN type = 'refund' THEN CASE WHEN first_amount > 0 THEN 'pending' ELSE 'success' END
    WHEN type = 'withdraw' THEN CASE WHEN (emitRuneE8 <= coalesce(rune_fee, 0) OR coalesce(rune_out, 0) <> 0) AND (emitAssetE8 <= 0 OR coalesce(asset_out, 0) <> 0) THEN 'success' ELSE 'pending' END
    ELSE coalesce(told, 'success') END AS status FROM joined)"""
META = "swapSingle, liquidityFee, swapTarget, swapSlip, affiliateFee, affiliateAddress, asymmetry, basisPoints, impermanentLossProtection, liquidityUnits, emitAssetE8, emitRuneE8, reason"
SHOWN = f"block_timestamp, type, main_ref, addresses, transactions, assets, pools, ins, fees, {META}"


def every_table(spark, d) -> dict[str, DataFrame]:
    more = {"switch_events": A.switch_events(spark, d), "refund_events": A.refund_events(spark, d), "add_events": A.donations(spark, d)}
    return C.action_tables(spark, d) | more


def every_action(spark, d) -> DataFrame:
    return actions.build_actions(every_table(spark, d))


@query("mv4_fn7_fn8_actions", f"WITH {ACTIONS} SELECT {SHOWN}, all_outs AS outs FROM actions")
def mv4(spark, d):
    return shown(every_action(spark, d))


VISIBLE = "CASE WHEN type = 'swap' THEN visible ELSE all_outs END AS outs"


@query("q8_actions_with_status", f"WITH {ACTIONS} SELECT {SHOWN}, {VISIBLE}, status FROM actions")
def q8(spark, d):
    return shown(actions.with_status(every_action(spark, d)))


PAGE_ORDER = "block_timestamp DESC, main_ref NULLS LAST, type, ins"


@query("q8_page_of_all_kinds", f"WITH {ACTIONS} SELECT {SHOWN}, {VISIBLE}, status, (SELECT count(*) FROM actions) AS total FROM actions ORDER BY {PAGE_ORDER} LIMIT 50 OFFSET 75")
def q8_page(spark, d):
    tables = every_table(spark, d)
    return shown(actions.page_with_total(actions.base_actions(tables), tables["outbound_events"], tables["fee_events"], 50, 75))


def selected_sql(where: str) -> str:
    return f"WITH {ACTIONS} SELECT type, status, count(*) AS n FROM actions WHERE {where} GROUP BY 1, 2"


def selected(spark, d, **wanted) -> DataFrame:
    rows = actions.with_status(actions.select_actions(every_action(spark, d), **wanted))
    return rows.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


@query("fil6_actions_of_address", selected_sql("list_has_any(string_split(addresses, ','), ['17', 'r17', 'x17'])"))
def fil6(spark, d):
    return selected(spark, d, address="17,r17,x17")


@query("fil7_actions_of_asset", selected_sql(f"list_contains(string_split(assets, ','), '{RUNE}') AND type IN ('swap', 'donate')"))
def fil7(spark, d):
    return selected(spark, d, asset=RUNE, types=["swap", "donate"])


@query("fil8_synth_actions", selected_sql("affiliateAddress = 'aff3' AND assets LIKE '%/%'"))
def fil8(spark, d):
    return selected(spark, d, affiliate_address="aff3", asset_type="synth")


@query("fil8_actions_of_transaction", selected_sql("list_contains(string_split(transactions, ','), '42')"))
def fil8_tx(spark, d):
    return selected(spark, d, txid="42")


@query("join8_action_heights", "SELECT event_id AS main_ref, event_id AS height FROM events UNION ALL SELECT -1, 0")
def join8(spark, d):
    log = lookups.unique_times(A.block_log(spark, d))
    rows = log.select(F.col("height").alias("main_ref"), F.col("timestamp").alias("block_timestamp"))
    rows = rows.unionByName(spark.createDataFrame([(-1, 5)], "main_ref long, block_timestamp long"))
    return actions.with_height(rows, log).select("main_ref", "height")


# --- pools and statistics ---


SYNTH_UNITS = "CASE WHEN {a} = 0 OR 2 * {a} = {s} THEN 0 ELSE trunc({u}::HUGEINT * {s} / (2 * {a} - {s}))::BIGINT END"


def synth(a: str, s: str, u: str) -> str:
    return SYNTH_UNITS.format(a=a, s=s, u=u)


#: The pool history asks for the depths, units and USD price of one pool at the end of each day.
USD_SQL = f"""usd AS (SELECT start_s, arg_max(CASE WHEN v.a = 0 THEN 1.0 ELSE v.a / v.r::DOUBLE END, v.r * 10 - list_position({USD_POOLS}, pool)) AS usd FROM dense
  WHERE pool IN ({", ".join(repr(p) for p in USD_POOLS)}) GROUP BY 1)"""
HISTORY_SQL = f"""{C.dense_sql(DAYS)}, {A.POOLS}, {USD_SQL},
  h AS (SELECT start_s, end_s, coalesce(v.a, 0)::BIGINT AS a, coalesce(v.r, 0)::BIGINT AS r, coalesce(v.s, 0)::BIGINT AS s, usd,
    (SELECT coalesce(sum(u), 0)::BIGINT FROM pool_units WHERE pool = 'signup' AND t < end_s * 1000000000) AS u FROM dense LEFT JOIN usd USING (start_s) WHERE pool = 'signup'),
  x AS (SELECT *, CASE WHEN a = 0 THEN 0 ELSE r / a::DOUBLE END AS price, {synth("a", "s", "u")} AS su FROM h)"""


@query(
    "q3_pool_history",
    f"""WITH {HISTORY_SQL} SELECT start_s, end_s, 'signup' AS pool, a AS asset_e8, r AS rune_e8, s AS synth_e8, round(price, 9) AS asset_price, round(price * usd, 9) AS asset_price_usd,
    u AS lp_units, su AS synth_units, u + su AS units, round(sqrt(a::DOUBLE * r) / (u + su), 9) AS luvi FROM x""",
)
def q3(spark, d):
    rows = A.block_pool_depths(spark, d)
    changes = history.unit_changes(A.pool_stakes(spark, d), A.pool_unstakes(spark, d))
    got = history.pool_history(rows, changes, history.usd_history(rows, DAYS, USD_POOLS), DAYS, "signup")
    return rounded(got, 9, "asset_price", "asset_price_usd", "luvi")


@query(
    "q4_ohlcv",
    f"""WITH {C.dense_sql(DAYS)}, {A.POOLS}, {USD_SQL}, p AS (SELECT {C.start_sql(DAYS)} AS start_s, CASE WHEN asset_e8 = 0 THEN 0 ELSE rune_e8 / asset_e8::DOUBLE END AS p, block_timestamp AS t,
      block_timestamp // 300000000000 * 300 AS five FROM depths WHERE pool = 'click' AND {C.inside(DAYS)}),
    c AS (SELECT start_s, min_by(p, t) AS open, max(p) AS high, min(p) AS low, max_by(p, t) AS close, arg_max(five, struct_pack(p := p, f := -five)) AS high_s, arg_min(five, struct_pack(p := p, f := five)) AS low_s FROM p GROUP BY 1),
    f AS (SELECT g.start_s, g.end_s, last_value(struct_pack(o := open, h := high, l := low, c := close, hs := high_s, ls := low_s) IGNORE NULLS) OVER (ORDER BY g.start_s) AS w FROM grid g LEFT JOIN c ON g.start_s = c.start_s),
    vol AS (SELECT {C.start_sql(DAYS)} AS start_s, sum({C.VOLUME})::BIGINT AS volume FROM pool_swaps WHERE pool = 'click' AND {C.inside(DAYS)} GROUP BY 1)
    SELECT f.start_s, f.end_s, 'click' AS pool, round(w.o, 9) AS open, round(w.h, 9) AS high, round(w.l, 9) AS low, round(w.c, 9) AS close, w.hs::BIGINT AS high_s, w.ls::BIGINT AS low_s, coalesce(volume, 0) AS volume,
      trunc(coalesce(v.a, 0) * w.c + coalesce(v.r, 0) * usd)::BIGINT AS liquidity
    FROM f LEFT JOIN vol USING (start_s) LEFT JOIN usd USING (start_s) LEFT JOIN dense ON dense.start_s = f.start_s AND dense.pool = 'click'""",
)
def q4(spark, d):
    rows = history.ohlcv(A.block_pool_depths(spark, d), A.pool_swaps(spark, d), DAYS, "click", USD_POOLS)
    return rounded(rows, 9, "open", "high", "low", "close")


END, BEFORE = C.EVENTS[1] * NANOS, (C.EVENTS[1] - 15 * 86400) * NANOS
LAST = "max_by(struct_pack(a := asset_e8, r := rune_e8, s := synth_e8), block_timestamp)"


@query(
    "q12_pools",
    f"""WITH {A.DEPTHS}, {A.POOLS}, l AS (SELECT pool, {LAST} FILTER (block_timestamp <= {END}) AS v, {LAST} FILTER (block_timestamp < {BEFORE}) AS w FROM depths GROUP BY 1),
    u AS (SELECT pool, sum(u) FILTER (t < {END})::BIGINT AS u, coalesce(sum(u) FILTER (t < {BEFORE}), 0)::BIGINT AS ou FROM pool_units GROUP BY 1),
    day AS (SELECT pool, sum({C.VOLUME})::BIGINT AS volume FROM pool_swaps WHERE block_timestamp >= {END - 86400 * NANOS} AND block_timestamp < {END} GROUP BY 1),
    x AS (SELECT pool, v.a AS a, v.r AS r, v.s AS s, w.a AS oa, w.r AS orr, w.s AS os, u, ou, {synth("v.a", "v.s", "u")} AS su, {synth("w.a", "w.s", "ou")} AS osu, coalesce(volume, 0) AS volume FROM l JOIN u USING (pool) LEFT JOIN day USING (pool)),
    y AS (SELECT *, (sqrt(a::DOUBLE * r) / (u + su) / (sqrt(oa::DOUBLE * orr) / (ou + osu)) - 1) * (365 / 15.0::DOUBLE) AS apr FROM x)
    SELECT pool, a AS asset_e8, r AS rune_e8, s AS synth_e8, round(CASE WHEN a = 0 THEN 0 ELSE r / a::DOUBLE END, 9) AS asset_price, CASE WHEN pool IN ('click', 'view') THEN 'available' ELSE 'staged' END AS status,
      volume AS volume_24h, u AS lp_units, su AS synth_units, u + su AS units, round(apr, 6) AS apr, round(greatest(apr, 0), 6) AS apy FROM y""",
)
def q12(spark, d):
    rows = A.block_pool_depths(spark, d)
    status = rows.filter(F.col("pool").isin("click", "view")).select(F.col("pool").alias("asset"), F.lit("Available").alias("status"), "block_timestamp", "event_idx")
    changes = history.unit_changes(A.pool_stakes(spark, d), A.pool_unstakes(spark, d))
    got = lookups.pool_summary(rows, A.pool_swaps(spark, d), changes, status, C.EVENTS[1], 15)
    return rounded(rounded(got, 9, "asset_price"), 6, "apr", "apy")


@query(
    "q13_pool_stats",
    f"""WITH {A.DEPTHS}, {A.POOLS}, l AS (SELECT pool, {LAST} AS v FROM depths WHERE block_timestamp < {C.ODD_EVENTS.end * NANOS} GROUP BY 1),
    s AS (SELECT pool, count(*) AS n, sum(CASE WHEN direction % 2 = 1 THEN {C.VOLUME} ELSE 0 END)::BIGINT AS tr, sum(CASE WHEN direction % 2 = 0 THEN {C.VOLUME} ELSE 0 END)::BIGINT AS ta, sum(liq_fee_in_rune_e8)::BIGINT AS fees,
      count(DISTINCT from_addr) AS users FROM pool_swaps WHERE {C.inside(C.ODD_EVENTS)} GROUP BY 1),
    a AS (SELECT pool, count(*) AS n, sum(rune_e8)::BIGINT AS r, count(DISTINCT coalesce(rune_addr, asset_addr)) AS m FROM pool_stakes WHERE {C.inside(C.ODD_EVENTS)} GROUP BY 1),
    w AS (SELECT pool, count(*) AS n, sum(emit_rune_e8)::BIGINT AS r FROM pool_unstakes WHERE {C.inside(C.ODD_EVENTS)} GROUP BY 1)
    SELECT pool, s.n AS swap_count, tr AS to_rune_volume, ta AS to_asset_volume, fees AS total_fees, users AS unique_swappers, a.n AS add_count, a.r AS add_rune, a.m AS unique_members, w.n AS withdraw_count, w.r AS withdraw_rune,
      v.a AS asset_e8, v.r AS rune_e8, v.s AS synth_e8 FROM l JOIN s USING (pool) JOIN a USING (pool) JOIN w USING (pool)""",
)
def q13(spark, d):
    return lookups.pool_stats(A.pool_swaps(spark, d), A.pool_stakes(spark, d), A.pool_unstakes(spark, d), A.block_pool_depths(spark, d), C.ODD_EVENTS)


NOW = C.second("2024-01-25") + 777


@query(
    "q14_q24_stats",
    f"""WITH {A.DEPTHS}, {A.POOLS}, s AS (SELECT *, {C.VOLUME} AS v FROM pool_swaps WHERE block_timestamp < {NOW * NANOS}), l AS (SELECT pool, {LAST} AS v FROM depths WHERE block_timestamp < {NOW * NANOS} GROUP BY 1)
    SELECT sum(v)::BIGINT AS swap_volume, count(*) AS swap_count, count(*) FILTER (block_timestamp >= {(NOW - 86400) * NANOS}) AS swap_count_24h, count(*) FILTER (block_timestamp >= {(NOW - 30 * 86400) * NANOS}) AS swap_count_30d,
      count(*) FILTER (direction = 0) AS to_asset_count, count(*) FILTER (direction = 1) AS to_rune_count, count(*) FILTER (direction = 2) AS synth_mint_count, count(*) FILTER (direction = 3) AS synth_burn_count,
      count(DISTINCT from_addr) FILTER (block_timestamp >= {(NOW - 86400) * NANOS}) AS daily_active_users, count(DISTINCT from_addr) FILTER (block_timestamp >= {(NOW - 30 * 86400) * NANOS}) AS monthly_active_users,
      count(DISTINCT from_addr) AS unique_swapper_count, (SELECT count(*) FROM pool_stakes WHERE block_timestamp < {NOW * NANOS}) AS add_liquidity_count,
      (SELECT sum(asset_in_rune + rune_e8)::BIGINT FROM pool_stakes WHERE block_timestamp < {NOW * NANOS}) AS add_liquidity_volume, (SELECT count(*) FROM pool_unstakes WHERE block_timestamp < {NOW * NANOS}) AS withdraw_count,
      (SELECT sum(asset_in_rune + emit_rune_e8)::BIGINT FROM pool_unstakes WHERE block_timestamp < {NOW * NANOS}) AS withdraw_volume, (SELECT sum(imp_loss)::BIGINT FROM pool_unstakes WHERE block_timestamp < {NOW * NANOS}) AS impermanent_loss_protection_paid,
      (SELECT sum((s_acctbal * 100)::BIGINT)::BIGINT FROM supplier) AS switched_rune, (SELECT sum(v.r)::BIGINT FROM l) AS rune_depth,
      (SELECT round(arg_max(CASE WHEN v.a = 0 THEN 1.0 ELSE v.a / v.r::DOUBLE END, v.r * 10 - list_position({USD_POOLS}, pool)), 9) FROM l WHERE pool IN ({", ".join(repr(p) for p in USD_POOLS)})) AS rune_price_usd FROM s""",
)
def q14(spark, d):
    rows = lookups.global_stats(
        A.pool_swaps(spark, d), A.pool_stakes(spark, d), A.pool_unstakes(spark, d), A.switch_events(spark, d), A.block_pool_depths(spark, d), USD_POOLS, NOW
    )
    return rounded(rows, 9, "rune_price_usd")


@query("q24_switched_rune", "SELECT sum((s_acctbal * 100)::BIGINT)::BIGINT AS switched_rune FROM supplier")
def q24(spark, d):
    return lookups.switched_rune(A.switch_events(spark, d))


NETWORK = ", ".join(f"max({c}) FILTER (status = '{s}') AS {s.lower()}_{c}" for s in ("Active", "Standby") for c in ("total", "minimum", "maximum", "average", "median"))


@query(
    "q15_network",
    f"""WITH {C.METRICS}, {A.DEPTHS}, t AS (SELECT sum(v)::BIGINT AS pooled FROM (SELECT max_by(rune_e8, block_timestamp) AS v FROM depths GROUP BY pool)), w AS (SELECT {NETWORK} FROM m),
    x AS (SELECT *, CASE WHEN active_total > pooled THEN (active_total - pooled) / (active_total + pooled)::DOUBLE ELSE 0 END AS share, 1e9 / (2 * 520.0) AS block FROM w, t),
    y AS (SELECT *, trunc(block)::BIGINT AS block_reward, trunc((1 - share) * block)::BIGINT AS bond_reward, trunc(block - (1 - share) * block)::BIGINT AS pool_reward FROM x)
    SELECT active_total, active_minimum, active_maximum, active_average, active_median, standby_total, standby_minimum, standby_maximum, standby_average, standby_median, pooled, round(share, 9) AS pool_share,
      block_reward, bond_reward, pool_reward, round(bond_reward * 520 / active_total::DOUBLE, 9) AS bonding_yield, round(pool_reward * 520 / (2 * pooled)::DOUBLE, 9) AS liquidity_yield FROM y""",
)
def q15(spark, d):
    rows = lookups.network(A.block_pool_depths(spark, d), C.node_bonds(spark, d), 10**9, 2, 520, 100000)
    return rounded(rows, 9, "pool_share", "bonding_yield", "liquidity_yield")


# --- LP details ---

MEMBER, POOL, LEAST = "r9", "click", 1_300_000
#: A member's log; an event that leaves no more than LEAST units ends a life.
LOG = f"""{A.POOLS}, l0 AS (
    SELECT block_timestamp AS t, 'add' AS kind, sum(stake_units)::BIGINT AS units, sum(asset_e8)::BIGINT AS asset, sum(rune_e8)::BIGINT AS rune FROM pool_stakes WHERE coalesce(rune_addr, asset_addr) = '{MEMBER}' AND pool = '{POOL}' GROUP BY 1
    UNION ALL SELECT block_timestamp, 'withdraw', sum(-stake_units)::BIGINT, sum(-emit_asset_e8)::BIGINT, sum(-emit_rune_e8)::BIGINT FROM pool_unstakes WHERE from_addr = '{MEMBER}' AND pool = '{POOL}' GROUP BY 1),
  l1 AS (SELECT *, sum(units) OVER (ORDER BY t, kind)::BIGINT AS total FROM l0),
  cut AS (SELECT max(t) AS t, max_by(total, t) AS total FROM l1 WHERE total <= {LEAST}),
  log AS (SELECT l1.*, l1.total - coalesce(cut.total, 0) AS held, lead(l1.t) OVER (ORDER BY l1.t, l1.kind) AS nx FROM l1, cut WHERE cut.t IS NULL OR l1.t > cut.t),
  detail AS (SELECT t AS block_timestamp, kind, units, asset, rune, held, (SELECT coalesce(sum(u), 0)::BIGINT FROM pool_units p WHERE p.pool = '{POOL}' AND p.t <= log.t) AS pool_units,
    (SELECT coalesce(sum(liq_fee_in_rune_e8), 0)::BIGINT FROM pool_swaps p WHERE p.pool = '{POOL}' AND p.block_timestamp > log.t AND (nx IS NULL OR p.block_timestamp <= nx)) AS fees,
    (SELECT coalesce(sum(rune_e8), 0)::BIGINT FROM pool_rewards p WHERE p.pool = '{POOL}' AND p.block_timestamp > log.t AND (nx IS NULL OR p.block_timestamp <= nx)) AS rewards FROM log),
  shared AS (SELECT *, CASE WHEN held > 0 THEN held / pool_units::DOUBLE ELSE 0 END AS share FROM detail)"""


def lp_detail(spark, d) -> DataFrame:
    stakes, unstakes = A.pool_stakes(spark, d), A.pool_unstakes(spark, d)
    changes = history.unit_changes(stakes, unstakes)
    return lookups.lp_detail(stakes, unstakes, A.pool_swaps(spark, d), A.pool_rewards(spark, d), changes, MEMBER, POOL, LEAST)


@query("q11_lp_detail", f"WITH {LOG} SELECT block_timestamp, kind, units, asset, rune, held, pool_units, fees, rewards, round(share, 12) AS share FROM shared")
def q11(spark, d):
    return rounded(lp_detail(spark, d), 12, "share")


INFO = f"""info AS (SELECT block_timestamp // 300000000000 AS five, max_by(struct_pack(u := (user_id % 8) / 4.0::DOUBLE, a := asset_e8, r := rune_e8), block_timestamp) AS d FROM
    (SELECT event_type AS pool, user_id, (value * 100)::BIGINT AS asset_e8, user_id * 100 + 1 AS rune_e8, epoch_us(ts) * 1000 AS block_timestamp FROM events) WHERE pool = '{POOL}' GROUP BY 1),
  known AS (SELECT s.*, e.event_id AS height, coalesce(d.a, 0) AS asset_depth, coalesce(d.r, 0) AS rune_depth, coalesce(d.u, 0) AS asset_price_usd,
    CASE WHEN d IS NULL THEN 0 ELSE d.u / (d.r / d.a::DOUBLE) END AS rune_price_usd FROM shared s LEFT JOIN info ON five = s.block_timestamp // 300000000000 LEFT JOIN events e ON epoch_us(e.ts) * 1000 = s.block_timestamp)"""


def lp_with_info(spark, d) -> DataFrame:
    rows = A.block_pool_depths(spark, d).filter(F.col("pool") == POOL)
    usd = A.pool_swaps(spark, d).select("event_idx", "priceusd")
    return lookups.with_block_info(lp_detail(spark, d), rows.join(usd, "event_idx"), A.block_log(spark, d))


@query("join15_lp_block_info", f"WITH {LOG}, {INFO} SELECT block_timestamp, kind, units, height, asset_depth, rune_depth, round(asset_price_usd, 9) AS asset_price_usd, round(rune_price_usd, 9) AS rune_price_usd FROM known")
def join15(spark, d):
    rows = lp_with_info(spark, d).select("block_timestamp", "kind", "units", "height", "asset_depth", "rune_depth", "asset_price_usd", "rune_price_usd")
    return rounded(rows, 9, "asset_price_usd", "rune_price_usd")


@query(
    "q11_lp_report",
    f"""WITH {LOG}, {INFO} SELECT count(*) FILTER (kind = 'add') AS stakes, count(*) FILTER (kind = 'withdraw') AS withdraws, sum(asset)::BIGINT AS staked_asset, sum(rune)::BIGINT AS staked_rune,
    sum(trunc(asset * asset_price_usd)::BIGINT + trunc(rune * rune_price_usd)::BIGINT)::BIGINT AS staked_usd, round(sum(fees * share), 4) AS rune_earned, round(sum(rewards * share), 4) AS rewards,
    round(sum(fees * share * rune_price_usd), 4) AS usd_earned FROM known HAVING count(*) > 0""",
)
def q11_report(spark, d):
    return rounded(lookups.lp_report(lp_with_info(spark, d)), 4, "rune_earned", "rewards", "usd_earned")


@query(
    "fold3_swap_usd_prices",
    """WITH x AS (SELECT event_id AS event_idx, event_type AS pool, value, lag(CASE WHEN (value * 100)::BIGINT = 0 THEN 0 ELSE (user_id * 100 + 1) / (value * 100)::BIGINT::DOUBLE END) OVER w AS before, lag(value) OVER w AS usd
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)) SELECT event_idx, pool, CASE WHEN before IS NULL THEN 0 ELSE round(usd / before, 6) END AS priceusd FROM x""",
)
def fold3(spark, d):
    swaps, rows = A.pool_swaps(spark, d), A.block_pool_depths(spark, d)
    prices = A.table(spark, d, "events").select(F.col("event_type").alias("pool"), A.nanos("ts").alias("block_timestamp"), F.col("value").alias("priceusd"))
    return rounded(depths.swap_usd_prices(swaps, rows, prices).select("event_idx", "pool", "priceusd"), 6, "priceusd")
