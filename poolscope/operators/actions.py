"""Actions: one row per user-visible operation, with its outbound transactions, fees and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.functions.assets import RUNE, affiliate, coins, transaction, transaction_list
from poolscope.functions.numeric import int_div
from poolscope.operators.buckets import BadRequest

COIN = "struct<asset:string,amount:long>"
TX = f"struct<tx_id:string,address:string,coins:array<{COIN}>>"
# The names and types of what an action tells beside its transactions.
META = {
    "status": "string", "swapSingle": "boolean", "liquidityFee": "long", "swapTarget": "long", "swapSlip": "long",
    "affiliateFee": "long", "affiliateAddress": "string", "asymmetry": "double", "basisPoints": "long",
    "impermanentLossProtection": "long", "liquidityUnits": "long", "emitAssetE8": "long", "emitRuneE8": "long", "reason": "string",
}
COLUMNS = ["block_timestamp", "type", "main_ref", "addresses", "transactions", "assets", "pools", "ins", "outs", "fees", "meta"]
MAX_PAGE = 50


def _present(*values: Column) -> Column:
    return F.array_compact(F.array(*[v.cast("string") for v in values]))


def _action(df: DataFrame, kind: str, main_ref: Column, addresses, transactions, assets, pools, ins, outs=None, meta=None) -> DataFrame:
    meta = meta or {}
    packed = F.struct(*[meta.get(k, F.lit(None)).cast(t).alias(k) for k, t in META.items()])
    none = F.array().cast(f"array<{TX}>")
    return df.select(
        "block_timestamp", F.lit(kind).alias("type"), main_ref.cast("string").alias("main_ref"), addresses.alias("addresses"),
        transactions.alias("transactions"), assets.alias("assets"), pools.cast("array<string>").alias("pools"),
        ins.cast(f"array<{TX}>").alias("ins"), (none if outs is None else outs.cast(f"array<{TX}>")).alias("outs"),
        F.array().cast(f"array<{COIN}>").alias("fees"), packed.alias("meta"),
    )


def _both(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def switch_actions(switches: DataFrame) -> DataFrame:
    tx, source, target, burnt, e8 = _both("tx", "from_addr", "to_addr", "burn_asset", "burn_e8")
    return _action(
        switches, "switch", tx, _present(source, target), _present(tx), F.array(burnt, F.lit(RUNE)), F.lit(None),
        F.array(transaction(tx, source, coins((burnt, e8)))),
        F.array(transaction(F.lit(None), target, coins((F.lit(RUNE), e8)))),
    )


def refund_actions(refunds: DataFrame) -> DataFrame:
    tx, source, target, asset, e8, second = _both("tx", "from_addr", "to_addr", "asset", "asset_e8", "asset_2nd")
    return _action(
        refunds, "refund", tx, _present(source, target), F.array(tx), _present(asset, second), F.lit(None),
        F.array(transaction(tx, source, coins((asset, e8)))), meta={"reason": F.col("reason")},
    )


def donate_actions(adds: DataFrame) -> DataFrame:
    tx, source, target, asset, e8, rune = _both("tx", "from_addr", "to_addr", "asset", "asset_e8", "rune_e8")
    assets = F.when(rune > 0, F.array(asset, F.lit(RUNE))).otherwise(F.array(asset))
    paid = coins((asset, e8), (F.lit(RUNE), rune))
    return _action(adds, "donate", tx, _present(source, target), F.array(tx), assets, F.array("pool"), F.array(transaction(tx, source, paid)))


def withdraw_actions(unstakes: DataFrame) -> DataFrame:
    tx, source, target, asset, e8 = _both("tx", "from_addr", "to_addr", "asset", "asset_e8")
    meta = {
        "asymmetry": F.col("asymmetry"), "basisPoints": F.col("basis_points"), "liquidityUnits": -F.col("stake_units"),
        "impermanentLossProtection": F.col("imp_loss_protection_e8"), "emitAssetE8": F.col("emit_asset_e8"), "emitRuneE8": F.col("emit_rune_e8"),
    }
    ins = F.array(transaction(tx, source, coins((asset, e8))))
    return _action(unstakes, "withdraw", tx, _present(source, target), F.array(tx), F.array("pool"), F.array("pool"), ins, meta=meta)


def _marked(swaps: DataFrame) -> DataFrame:
    """Swaps with whether all rows of their tx and block pay the same asset.

    What is made of it shares one exchange; it is by tx alone, so that a join by reference goes on from it.
    """
    same = Window.partitionBy("tx", "block_timestamp")
    return swaps.repartition("tx").withColumn("__one", F.min("from_asset").over(same) == F.max("from_asset").over(same))


def single_swaps(swaps: DataFrame) -> DataFrame:
    """Swaps with no row of the same tx and block that pays another asset."""
    return _marked(swaps).filter("__one").drop("__one")


def double_swaps(swaps: DataFrame) -> DataFrame:
    """Both legs of swaps through the base asset, columns prefixed with a_ and b_.

    The legs pay different assets, so they are no single swaps; of one tx and block there are a few at most.
    """
    leg = F.struct(*swaps.columns)
    legs = lambda hit: F.collect_list(F.when(hit, leg))
    groups = _marked(swaps).filter("not __one").groupBy("tx", "block_timestamp")
    groups = groups.agg(legs(F.col("to_asset") == RUNE).alias("a"), legs(F.col("from_asset") == RUNE).alias("b"))
    pairs = groups.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b")).filter("a.from_asset <> b.to_asset")
    return pairs.select(*[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("a", "b") for c in swaps.columns])


def swap_actions(swaps: DataFrame) -> DataFrame:
    """Actions of single swaps, and of double swaps: of each first leg with each second one it goes on with.

    Both come out of one pass, and lie by reference. A row has the second legs of its tx and block only if these are no
    single swaps.
    """
    tx, source, target, asset, pool, slip, fee = _both("tx", "from_addr", "to_addr", "from_asset", "pool", "swap_slip_bp", "liq_fee_in_rune_e8")
    same = Window.partitionBy("tx", "block_timestamp")
    second = F.struct("to_asset", "pool", "to_e8_min", "swap_slip_bp", "liq_fee_in_rune_e8")
    marked = _marked(swaps).withColumn("__b", F.collect_list(F.when(~F.col("__one") & (asset == RUNE), second)).over(same))
    alone = F.slice(F.array(F.lit(None), second), 1, 1)  # one second leg that is null
    legs = F.when(F.col("__one"), alone).when(~F.col("__one") & (F.col("to_asset") == RUNE), F.filter("__b", lambda b: b["to_asset"] != asset))
    rows = marked.withColumn("__b", F.explode(legs))
    single, b = F.col("__b").isNull(), F.col("__b")
    of_both = lambda one, two: F.when(single, one).otherwise(two)
    aff = affiliate(F.col("memo"), target)
    meta = {
        "swapSingle": single, "liquidityFee": of_both(fee, fee + b["liq_fee_in_rune_e8"]), "swapTarget": of_both(F.col("to_e8_min"), b["to_e8_min"]),
        "swapSlip": of_both(slip, slip + b["swap_slip_bp"] - int_div(slip * b["swap_slip_bp"], 10000)),
        "affiliateFee": aff["fee"], "affiliateAddress": aff["address"],
    }
    ins = F.array(transaction(tx, source, coins((asset, F.col("from_e8")))))
    assets = F.array(asset, of_both(F.col("to_asset"), b["to_asset"]))
    pools = F.when(pool != b["pool"], F.array(pool, b["pool"])).otherwise(F.array(pool))
    return _action(rows, "swap", tx, _present(source, target), F.array(tx), assets, pools, ins, meta=meta)


def _adds(adds: DataFrame, main_ref: Column, meta: dict[str, Column]) -> DataFrame:
    rune_tx, rune_addr, asset_tx, asset_addr = _both("rune_tx", "rune_addr", "asset_tx", "asset_addr")
    ins = transaction_list(
        transaction(rune_tx, rune_addr, coins((F.lit(RUNE), F.col("rune_e8")))),
        transaction(asset_tx, asset_addr, coins((F.col("pool"), F.col("asset_e8")))),
    )
    assets = F.array(F.col("pool"), F.lit(RUNE))
    return _action(adds, "addLiquidity", main_ref, _present(rune_addr, asset_addr), _present(rune_tx, asset_tx), assets, F.array("pool"), ins, meta=meta)


def pending_ref() -> Column:
    """The reference of pending adds of an address and pool."""
    return F.concat(F.lit("PL:"), F.col("rune_addr"), F.lit(":"), F.col("pool"))


def done_adds(stakes: DataFrame) -> DataFrame:
    """Successful adds. They have no reference."""
    return _adds(stakes, F.lit(None), {"status": F.lit("success"), "liquidityUnits": F.col("stake_units")})


def pending_adds(pending: DataFrame) -> DataFrame:
    """Pending adds, under a reference made of address and pool."""
    return _adds(pending.filter("pending_type = 'add'"), pending_ref(), {"status": F.lit("pending")})


def add_liquidity_actions(stakes: DataFrame, pending: DataFrame) -> DataFrame:
    """Successful adds, and pending adds."""
    return done_adds(stakes).unionByName(pending_adds(pending))


def settled_refs(stakes: DataFrame, pending: DataFrame) -> DataFrame:
    """(ref, settled_at): when a stake or a pending withdraw last settled a reference's pending adds."""
    ref = pending_ref()
    settled = stakes.select(ref.alias("ref"), "block_timestamp").unionByName(
        pending.filter("pending_type = 'withdraw'").select(ref.alias("ref"), "block_timestamp")
    )
    return settled.filter("ref is not null").groupBy("ref").agg(F.max("block_timestamp").alias("settled_at"))


def trim_pending(actions: DataFrame, stakes: DataFrame, pending: DataFrame) -> DataFrame:
    """Drop pending adds that a stake or a pending withdraw at or after them has settled."""
    newest = settled_refs(stakes, pending)
    joined = actions.join(newest, actions["main_ref"] == newest["ref"], "left")
    gone = F.coalesce(F.col("block_timestamp") <= F.col("settled_at"), F.lit(False))
    return joined.filter(~gone).select(*actions.columns)


def outbounds_by_ref(outbounds: DataFrame, fees: DataFrame) -> DataFrame:
    """(ref, o, f): the outbound transactions and the fees of each reference, in order of time; null where there are none."""
    idx = lambda df: F.col("event_idx") if "event_idx" in df.columns else F.lit(0).cast("long")
    one = F.struct(
        F.col("block_timestamp").alias("t"), idx(outbounds).alias("i"), F.col("tx").cast("string").alias("tx"), "from_addr", "to_addr", "asset",
        F.col("asset_e8").alias("e8"),
    )
    fee = F.struct(F.col("block_timestamp").alias("t"), idx(fees).alias("i"), "asset", F.col("asset_e8").alias("amount"))
    sent = outbounds.select(F.col("in_tx").alias("ref"), one.alias("o"))
    both = sent.unionByName(fees.select(F.col("tx").alias("ref"), fee.alias("f")), allowMissingColumns=True)
    listed = lambda c: F.array_sort(F.collect_list(c))
    some = lambda c: F.when(F.size(listed(c)) > 0, listed(c)).alias(c)
    return both.groupBy("ref").agg(some("o"), some("f"))  # one exchange, by reference


def with_outbounds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Base actions with their outbounds (o, f) told in their columns."""
    have = F.col("o").isNotNull()
    more = lambda name, extra: F.when(have, F.concat(F.col(name), extra)).otherwise(F.col(name)).alias(name)
    each = lambda name: F.transform("o", lambda x: x[name])
    sent = F.transform("o", lambda x: transaction(x["tx"], x["to_addr"], coins((x["asset"], x["e8"])))).cast(f"array<{TX}>")
    charged = F.transform("f", lambda x: F.struct(x["asset"].alias("asset"), x["amount"].alias("amount")))
    changed = {
        "addresses": more("addresses", F.concat(each("from_addr"), each("to_addr"))),
        "transactions": more("transactions", F.array_compact(each("tx"))),
        "assets": more("assets", each("asset")),
        "outs": more("outs", sent),
        "fees": F.when(F.col("f").isNotNull(), F.concat("fees", charged)).otherwise(F.col("fees")).alias("fees"),
    }
    return rows.select(*[changed.get(c, F.col(c)) for c in columns])


def attach_outbounds(actions: DataFrame, outbounds: DataFrame, fees: DataFrame) -> DataFrame:
    """Add the outbound transactions and fees of each reference, in order of time."""
    extras = outbounds_by_ref(outbounds, fees)
    rows = actions.join(extras, actions["main_ref"] == extras["ref"], "left")
    return with_outbounds(rows, actions.columns)


def with_height(actions: DataFrame, block_log: DataFrame) -> DataFrame:
    """The block height of each action; 0 if its block is unknown. A time names one block (lookups.unique_times); of several
    that share one the highest counts, so that no action comes twice."""
    log = block_log.groupBy(F.col("timestamp").alias("block_timestamp")).agg(F.max("height").alias("height"))
    return actions.join(log, "block_timestamp", "left").withColumn("height", F.coalesce("height", F.lit(0).cast("long")))


def base_parts(tables: dict[str, DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """All actions from the event tables that are given, without their outbound transactions and fees: those without a
    reference, and the others.

    These in parts: swaps lie by reference, so that they need no exchange for a join by it.
    """
    stakes, pending = tables["stake_events"], tables["pending_liquidity_events"]
    makers = {"switch_events": switch_actions, "refund_events": refund_actions, "add_events": donate_actions, "unstake_events": withdraw_actions}
    actions = trim_pending(pending_adds(pending), stakes, pending)
    for name, make in makers.items():
        if name in tables:
            actions = actions.unionByName(make(tables[name]))
    return done_adds(stakes), [actions, *([swap_actions(tables["swap_events"])] if "swap_events" in tables else [])]


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def base_actions(tables: dict[str, DataFrame]) -> DataFrame:
    first, parts = base_parts(tables)
    return union([first, *parts])


def with_extras(first: DataFrame | None, parts: list[DataFrame], extras: DataFrame) -> DataFrame:
    """What base_parts gives, together, with the outbounds and fees (o, f) of each reference."""
    joined = [part.join(extras, part["main_ref"] == extras["ref"], "left").select(*COLUMNS, "o", "f") for part in parts]
    if first is None:
        return union(joined)
    none = [F.lit(None).cast(extras.schema[c].dataType).alias(c) for c in ("o", "f")]
    return union([*joined, first.select(*COLUMNS, *none)])


def build_actions(tables: dict[str, DataFrame]) -> DataFrame:
    """All actions, whole."""
    extras = outbounds_by_ref(tables["outbound_events"], tables["fee_events"])
    actions = with_outbounds(with_extras(*base_parts(tables), extras), COLUMNS)
    return with_height(actions, tables["block_log"]) if "block_log" in tables else actions


def _amounts(transactions: Column) -> Column:
    return F.flatten(F.transform(F.filter(transactions, lambda t: t["coins"].isNotNull()), lambda t: t["coins"]))


def _last_amount(coin_list: Column, wanted) -> Column:
    """Amount of the last coin that meets a condition, else 0."""
    return F.aggregate(coin_list, F.lit(0).cast("long"), lambda acc, c: F.when(wanted(c), c["amount"]).otherwise(acc))


def with_status(actions: DataFrame) -> DataFrame:
    """Hide the inner base-asset outbound of double swaps, then derive the status."""
    double = (F.col("type") == "swap") & ~F.coalesce(F.col("meta.swapSingle"), F.lit(False))
    synth = lambda t: F.coalesce(F.contains(t["coins"][0]["asset"], F.lit("/")), F.lit(False))
    hidden = lambda t: double & (F.coalesce(t["tx_id"], F.lit("")) == "") & ~synth(t)
    rows = actions.withColumn("outs", F.filter("outs", lambda t: ~hidden(t)))
    ins, outs, fees = _amounts(F.col("ins")), _amounts(F.col("outs")), F.col("fees")
    open_coin = F.exists(
        ins,
        lambda c: (c["amount"] > _last_amount(fees, lambda f: f["asset"] == c["asset"]))
        & (_last_amount(outs, lambda o: o["asset"] == c["asset"]) == 0),
    )
    rune, other = lambda c: c["asset"] == RUNE, lambda c: c["asset"] != RUNE
    side = lambda emitted, which: (
        F.coalesce(emitted, F.lit(0)) <= _last_amount(fees, which)
    ) | (_last_amount(outs, which) != 0)
    paid = side(F.col("meta.emitRuneE8"), rune) & side(F.col("meta.emitAssetE8"), other)
    status = (
        F.when((F.col("type") == "swap") & (F.size("outs") == 0), "pending")
        .when(F.col("type") == "refund", F.when(open_coin, "pending").otherwise("success"))
        .when(F.col("type") == "withdraw", F.when(paid, "success").otherwise("pending"))
        .otherwise(F.coalesce("meta.status", F.lit("success")))
    )
    return rows.withColumn("status", status)


def select_actions(
    actions: DataFrame,
    address: str | None = None,
    txid: str | None = None,
    asset: str | None = None,
    types: list[str] | None = None,
    affiliate_address: str | None = None,
    asset_type: str | None = None,
) -> DataFrame:
    """Actions that meet all given conditions; asset_type is synth or native."""
    conditions = []
    if address:
        conditions.append(F.arrays_overlap("addresses", F.lit(address.split(","))))
    if txid:
        conditions.append(F.array_contains("transactions", txid.upper()))
    if asset:
        conditions.append(F.array_contains("assets", asset))
    if types:
        conditions.append(F.col("type").isin(types))
    if affiliate_address:
        conditions.append(F.col("meta.affiliateAddress") == affiliate_address)
    if asset_type:
        if asset_type not in ("synth", "native"):
            raise BadRequest(f"assetType is synth or native, not {asset_type}")
        has_synth = F.exists("assets", lambda x: x.like("%/%"))
        conditions.append(has_synth if asset_type == "synth" else ~has_synth)
    for condition in conditions:
        actions = actions.filter(condition)
    return actions


def page(actions: DataFrame, limit: int = MAX_PAGE, offset: int = 0) -> DataFrame:
    """Newest actions first; ties by reference and type, so that pages are stable."""
    if not 1 <= limit <= MAX_PAGE:
        raise BadRequest(f"limit out of range: {limit}, allowed [1..{MAX_PAGE}]")
    ordered = actions.orderBy(F.desc("block_timestamp"), F.asc_nulls_last("main_ref"), "type", F.to_json("ins"))
    return ordered.offset(offset).limit(limit)


def page_with_total(actions: DataFrame, outbounds: DataFrame, fees: DataFrame, limit: int = MAX_PAGE, offset: int = 0) -> DataFrame:
    """A page of base actions, whole and with their status, each row with the number of all actions.

    The order of a page rests on the actions alone, so outbound transactions and fees are looked up for the page only.
    """
    rows = page(actions, limit, offset)
    refs = F.broadcast(rows.select("main_ref").distinct())
    own = lambda df, ref: df.join(refs, F.col(ref) == F.col("main_ref"), "left_semi")
    whole = with_status(attach_outbounds(rows, own(outbounds, "in_tx"), own(fees, "tx")))
    return whole.join(F.broadcast(actions.agg(F.count(F.lit(1)).alias("total"))))
