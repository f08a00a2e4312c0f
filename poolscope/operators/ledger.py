"""Balances and liquidity members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.operators.asof import SLICE_NANOS, as_of, running


def _sides(transfers: DataFrame) -> DataFrame:
    """Double entry in one scan: the receiver gains, the sender loses."""
    sides = F.explode(
        F.array(
            F.struct(F.col("to_addr").alias("addr"), F.col("amount_e8").alias("delta")),
            F.struct(F.col("from_addr").alias("addr"), (-F.col("amount_e8")).alias("delta")),
        )
    )
    return transfers.select("asset", "block_timestamp", sides.alias("x")).select("x.addr", "asset", "block_timestamp", "x.delta")


def balance_deltas(transfers: DataFrame) -> DataFrame:
    """Change of each (address, asset) by each block."""
    return _sides(transfers).groupBy("addr", "asset", "block_timestamp").agg(F.sum("delta").alias("delta"))


#: Keys are counted by so many buckets; those of a bucket with more changes are ordered within slices of time.
BUSY_BUCKETS, BUSY_ROWS = 1 << 14, 1_000_000


def balances(transfers: DataFrame, busy_rows: int = BUSY_ROWS) -> DataFrame:
    """Balance of each (address, asset) after each block that changes it.

    Most keys have few rows, which are ordered as they are, in one exchange. Only keys of a busy bucket are spread over
    slices of a month, and for them alone a sum per slice is carried on.
    """
    key, rows = ["addr", "asset"], _sides(transfers)
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUSY_BUCKETS)).alias("__bucket")
    busy = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > busy_rows).select("__bucket", F.lit(True).alias("__busy"))
    rows = rows.select("*", bucket).join(F.broadcast(busy), "__bucket", "left")
    cut = F.col("__busy") & F.col("addr").isNotNull() & F.col("asset").isNotNull()
    month = F.call_function("div", F.col("block_timestamp"), F.lit(30 * SLICE_NANOS))
    rows = rows.select(*key, "block_timestamp", "delta", F.when(cut, month).alias("__slice"))
    order = Window.partitionBy(*key, "__slice").orderBy("block_timestamp")
    sums = rows.withColumns({"balance": F.sum("delta").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__next": F.lead("block_timestamp").over(order)})
    sums = sums.filter("__next is null or __next > block_timestamp")
    totals = rows.filter("__slice is not null").groupBy(*key, "__slice").agg(F.sum("delta").alias("total"))
    before = Window.partitionBy(*key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(*key, "__slice", F.sum("total").over(before).alias("opening"))
    joined = sums.join(opening, [*key, "__slice"], "left")
    return joined.select(*key, "block_timestamp", (F.coalesce("balance", F.lit(0)) + F.coalesce("opening", F.lit(0))).alias("balance"))


def balances_at(transfers: DataFrame, moment: int, address: str | None = None) -> DataFrame:
    """Balance of each (address, asset) at a moment: one partial sum, without the history."""
    rows = transfers.filter(F.col("block_timestamp") <= moment)
    if address is not None:
        rows = rows.filter((F.col("from_addr") == address) | (F.col("to_addr") == address))
    out = balance_deltas(rows).groupBy("addr", "asset").agg(F.sum("delta").alias("balance"))
    return out if address is None else out.filter(F.col("addr") == address)


def balances_now(transfers: DataFrame, changed: Column | None = None) -> DataFrame:
    """Current balance of each (address, asset), of those with a transfer that meets a condition if one is given.

    The newest balance is the sum of all changes: one partial sum a key, without the history.
    """
    hit = F.lit(True) if changed is None else changed
    sides = [F.struct(F.col(c).alias("addr"), (F.col("amount_e8") * sign).alias("delta")) for c, sign in (("to_addr", 1), ("from_addr", -1))]
    rows = transfers.select("asset", hit.alias("hit"), F.explode(F.array(*sides)).alias("x"))
    sums = rows.groupBy(F.col("x.addr").alias("addr"), "asset").agg(F.sum("x.delta").alias("balance"), F.max("hit").alias("hit"))
    return sums.filter("hit").drop("hit")


def current_balances(log: DataFrame) -> DataFrame:
    """Latest balance of each key of a balance log."""
    return log.groupBy("addr", "asset").agg(F.max_by("balance", "block_timestamp").alias("balance"))


def balances_of_slice(log: DataFrame, slice_rows: DataFrame) -> DataFrame:
    """Current balances of the keys that occur in a slice of a balance log."""
    return current_balances(log.join(slice_rows.select("addr", "asset").distinct(), ["addr", "asset"], "left_semi"))


def balance_as_of(log: DataFrame, moment: int | Column) -> DataFrame:
    return as_of(log, ["addr", "asset"], moment, ["balance"]).select("addr", "asset", "balance")


def bond_replay(bonds: DataFrame, block_log: DataFrame) -> DataFrame:
    """Each bond event with its block's height and the address's bond after it; of blocks of one time the highest counts."""
    sign = F.when(F.col("bond_type").isin("bond_paid", "bond_reward"), F.col("e8")).otherwise(-F.col("e8"))
    log = block_log.groupBy(F.col("timestamp").alias("block_timestamp")).agg(F.max("height").alias("height"))
    rows = bonds.join(log, "block_timestamp").withColumn("bond", sign)
    return running(rows, ["from_addr"], ["block_timestamp", "event_idx"], ["bond"]).drop("slice", "opening")


CHANGE = (
    "t long, kind string, idx long, units long, asset_addr string, rune_addr string, "
    "asset_e8 long, rune_e8 long, pending_asset long, pending_rune long"
)


def member_changes(stakes: DataFrame, unstakes: DataFrame, pending: DataFrame) -> DataFrame:
    """All changes of members in one shape: (member_id, pool, change). Ethereum-like pools use lower-case addresses."""
    none_s, none_l = F.lit(None).cast("string"), F.lit(None).cast("long")
    idx = lambda df: F.col("event_idx") if "event_idx" in df.columns else F.lit(0).cast("long")

    def change(df, kind, units, asset_addr, rune_addr, asset, rune, p_asset, p_rune):
        fields = [F.col("block_timestamp"), kind, idx(df), units, asset_addr, rune_addr, asset, rune, p_asset, p_rune]
        names = [x.split()[0] for x in CHANGE.split(", ")]
        return F.struct(*[f.alias(n) for f, n in zip(fields, names)]).alias("change")

    member = F.coalesce("rune_addr", "asset_addr").alias("member_id")
    a, r = F.col("asset_addr"), F.col("rune_addr")
    added = stakes.select(
        member, "pool", change(stakes, F.lit("add"), F.col("stake_units"), a, r, F.col("asset_e8"), F.col("rune_e8"), none_l, none_l)
    )
    taken = unstakes.select(
        F.col("from_addr").alias("member_id"),
        "pool",
        change(
            unstakes, F.lit("withdraw"), -F.col("stake_units"), none_s, none_s, -F.col("emit_asset_e8"), -F.col("emit_rune_e8"), none_l, none_l
        ),
    )
    kind = F.concat(F.lit("pending_"), F.col("pending_type"))
    sign = F.when(F.col("pending_type") == "add", 1).otherwise(-1)
    waiting = pending.select(
        member, "pool",
        change(pending, kind, F.lit(0).cast("long"), a, r, none_l, none_l, sign * F.col("asset_e8"), sign * F.col("rune_e8")),
    )
    rows = added.unionByName(taken).unionByName(waiting)
    eth = F.col("pool").like("ETH.%")
    low = F.lower("change.asset_addr")
    member_id = F.when(eth & (F.lower("member_id") == low), F.lower("member_id")).otherwise(F.col("member_id"))
    fixed = F.col("change").withField("asset_addr", F.when(eth, low).otherwise(F.col("change.asset_addr")))
    return rows.select(member_id.alias("member_id"), "pool", fixed.alias("change"))


#: What a living member brings along beside its units and pendings.
KEPT = ["added_asset", "added_rune", "withdrawn_asset", "withdrawn_rune", "first_added", "last_added"]


def _as_changes(carried: DataFrame) -> DataFrame:
    """Living members as the first change of what is to come."""
    none = F.lit(None).cast("long")
    values = {
        "t": F.lit(-(1 << 63)).cast("long"), "kind": F.lit("carried"), "idx": F.lit(0).cast("long"), "units": F.col("units"), "asset_addr": F.col("asset_addr"),
        "rune_addr": F.col("rune_addr"), "asset_e8": none, "rune_e8": none, "pending_asset": F.col("pending_asset"), "pending_rune": F.col("pending_rune"),
    }
    return carried.select("member_id", "pool", F.struct(*[v.alias(k) for k, v in values.items()]).alias("change"), F.struct(*KEPT).alias("old"))


def members(changes: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Living members per pool: each member's changes in order of time, then kind of change.

    carried are living members that earlier changes have led to; their lives go on, whether they have changes or not.

    A state without units and pendings ends a life, and the next change starts a new one. Running sums find the lives:
    units and pendings are zero at the end of each, so the sums need not start anew. The windows can spill, and only
    one pre-aggregated row per (member, pool, life) is kept.
    """
    key = ["member_id", "pool"]
    zero = F.lit(0).cast("long")
    order = Window.partitionBy(*key).orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    add, withdraw = F.col("kind") == "add", F.col("kind") == "withdraw"
    resets = (add | (F.col("kind") == "pending_withdraw")).cast("long")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("change"))
    if carried is not None:
        changes = changes.withColumn("old", F.lit(None).cast(carried.select(F.struct(*KEPT)).schema[0].dataType)).unionByName(_as_changes(carried))
    else:
        changes = changes.withColumn("old", F.lit(None).cast(f"struct<{', '.join(f'{c}:bigint' for c in KEPT)}>"))
    rows = changes.withColumn("n", nth).select(*key, "n", "change.*", "old")
    rows = rows.withColumn("running", F.sum(F.coalesce("units", zero)).over(upto)).withColumn("reset", F.sum(resets).over(upto))
    since = Window.partitionBy(*key, "reset").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    waiting = lambda name: F.sum(F.when(F.col("kind").isin("pending_add", "carried"), F.coalesce(name, zero)).otherwise(zero)).over(since)
    rows = rows.withColumns({"open_asset": waiting("pending_asset"), "open_rune": waiting("pending_rune")})
    alive = (F.col("running") != 0) | (F.col("open_asset") != 0) | (F.col("open_rune") != 0)
    rows = rows.withColumn("alive", alive)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("life", F.coalesce(F.sum((~F.col("alive")).cast("long")).over(before), zero))
    first = lambda name: F.min_by(name, F.when(F.col(name).isNotNull(), F.col("n")))
    last = lambda name: F.max_by(name, "n")
    total = lambda hit, value, old: F.sum(F.when(hit, value).otherwise(F.coalesce(f"old.{old}", zero)))
    lives = rows.groupBy(*key, "life").agg(
        last("alive").alias("alive"),
        first("asset_addr").alias("asset_addr"),
        first("rune_addr").alias("rune_addr"),
        last("running").alias("units"),
        total(add, F.col("asset_e8"), "added_asset").alias("added_asset"),
        total(add, F.col("rune_e8"), "added_rune").alias("added_rune"),
        total(withdraw, -F.col("asset_e8"), "withdrawn_asset").alias("withdrawn_asset"),
        total(withdraw, -F.col("rune_e8"), "withdrawn_rune").alias("withdrawn_rune"),
        last("open_asset").alias("pending_asset"),
        last("open_rune").alias("pending_rune"),
        F.min(F.when(add, F.col("t")).otherwise(F.col("old.first_added"))).alias("first_added"),
        F.max(F.when(add, F.col("t")).otherwise(F.col("old.last_added"))).alias("last_added"),
    )
    return lives.filter("alive").drop("life", "alive")


def member_pools(members: DataFrame, address: str) -> DataFrame:
    """The pools of a member, found by id or asset address; times in whole seconds, absent ones 0."""
    rows = members.filter((F.col("member_id") == address) | (F.col("asset_addr") == address))
    seconds = [F.coalesce(F.call_function("div", F.col(c), F.lit(10**9)), F.lit(0)).alias(c) for c in ("first_added", "last_added")]
    kept = [c for c in rows.columns if c not in ("member_id", "rune_addr", "asset_addr", "first_added", "last_added")]
    return rows.select(*kept, *[F.coalesce(c, F.lit("")).alias(c) for c in ("rune_addr", "asset_addr")], *seconds).orderBy("pool")


def exact_or_lowered(find, address: str) -> DataFrame:
    """find(address), or where that has no rows find(address in lower case)."""
    lower = address.lower()
    exact = find(address)
    if lower == address:
        return exact
    found = exact.agg(F.count(F.lit(1)).alias("n"))
    return exact.unionByName(find(lower).join(F.broadcast(found.filter("n = 0")), how="cross").drop("n"))


def member_units(stakes: DataFrame, unstakes: DataFrame) -> DataFrame:
    """Simple check: units per (member, pool) as added minus withdrawn."""
    member = F.coalesce("rune_addr", "asset_addr").alias("member_id")
    rows = stakes.select(member, "pool", F.col("stake_units").alias("units"))
    rows = rows.unionByName(unstakes.select(F.col("from_addr").alias("member_id"), "pool", (-F.col("stake_units")).alias("units")))
    return rows.groupBy("member_id", "pool").agg(F.sum("units").alias("units"))


def clustered_units(stakes: DataFrame, unstakes: DataFrame) -> DataFrame:
    """Units where members known by their asset address alone are merged into the base-asset address that first used it."""
    both = stakes.filter("rune_addr is not null and asset_addr is not null")
    owner = both.groupBy("pool", F.col("asset_addr").alias("member_id")).agg(F.min_by("rune_addr", F.struct("block_timestamp", "rune_addr")).alias("owner"))
    units = member_units(stakes, unstakes).join(owner, ["pool", "member_id"], "left")
    return units.groupBy("pool", F.coalesce("owner", "member_id").alias("member_id")).agg(F.sum("units").alias("units"))


def open_pending(pending: DataFrame, stakes: DataFrame) -> DataFrame:
    """Pending adds with no stake and no pending withdraw of the same address and pool at or after them.

    Later events are reduced to the newest per key first, so the anti-join meets one row per key.
    """
    adds = pending.filter("pending_type = 'add'")
    later = stakes.select("rune_addr", "pool", "block_timestamp").unionByName(
        pending.filter("pending_type = 'withdraw'").select("rune_addr", "pool", "block_timestamp")
    )
    newest = later.filter("rune_addr is not null").groupBy("rune_addr", "pool").agg(F.max("block_timestamp").alias("newest"))
    joined = adds.join(newest, ["rune_addr", "pool"], "left")
    return joined.filter("newest is null or block_timestamp > newest").select(*adds.columns)


def full_member(stakes: DataFrame, unstakes: DataFrame, pending: DataFrame) -> DataFrame:
    """Per (member, pool): units, amounts added and withdrawn and open pendings, from plain sums of the events."""
    member = F.coalesce("rune_addr", "asset_addr").alias("member_id")
    zero = F.lit(0).cast("long")
    names = ["units", "added_asset", "added_rune", "withdrawn_asset", "withdrawn_rune", "pending_asset", "pending_rune"]

    def shaped(df, key, **given):
        return df.select(key, "pool", *[given.get(n, zero).cast("long").alias(n) for n in names])

    rows = shaped(stakes, member, units=F.col("stake_units"), added_asset=F.col("asset_e8"), added_rune=F.col("rune_e8"))
    rows = rows.unionByName(
        shaped(
            unstakes, F.col("from_addr").alias("member_id"), units=-F.col("stake_units"),
            withdrawn_asset=F.col("emit_asset_e8"), withdrawn_rune=F.col("emit_rune_e8"),
        )
    )
    rows = rows.unionByName(shaped(open_pending(pending, stakes), member, pending_asset=F.col("asset_e8"), pending_rune=F.col("rune_e8")))
    return rows.groupBy("member_id", "pool").agg(*[F.sum(n).alias(n) for n in names])
