"""Assets, coins, addresses and memos as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the base asset.
RUNE = "THOR.RUNE"
RUNE_ASSETS = ["THOR.RUNE", "BNB.RUNE-67C", "BNB.RUNE-B1A"]

#: Directions of swaps; even ones pay in the base asset.
RUNE_TO_ASSET, ASSET_TO_RUNE, RUNE_TO_SYNTH, SYNTH_TO_RUNE = range(4)


def is_rune(asset: Column) -> Column:
    return asset.isin(RUNE_ASSETS)


def coin_type(asset: Column) -> Column:
    """rune, synth (has a slash), native (has a dot) or unknown."""
    return (
        F.when(is_rune(asset), "rune")
        .when(F.contains(asset, F.lit("/")), "synth")
        .when(F.contains(asset, F.lit(".")), "native")
        .otherwise("unknown")
    )


def native_asset(asset: Column) -> Column:
    """The pool asset of a synth; other assets as they are."""
    return F.when(coin_type(asset) == "synth", F.regexp_replace(asset, "/", ".")).otherwise(asset)


def asset_parts(asset: Column) -> Column:
    """struct(chain, ticker, id): chain.ticker-id, where chain and id may be missing (empty)."""
    parts = F.split(asset, F.when(F.contains(asset, F.lit("/")), F.lit("/")).otherwise(F.lit(r"\.")))
    symbol = F.split(F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0]), "-", 2)
    return F.struct(
        F.when(F.size(parts) > 1, parts[0]).otherwise("").alias("chain"),
        symbol[0].alias("ticker"),
        F.coalesce(F.get(symbol, F.lit(1)), F.lit("")).alias("id"),
    )


def address_is_rune(address: Column) -> Column:
    return address.rlike("^[ts]?thor")


def swap_direction(from_asset: Column, to_asset: Column) -> Column:
    """0..3, or null unless exactly one side is the base asset and the other a pool asset or synth."""
    a, b = coin_type(from_asset), coin_type(to_asset)
    return (
        F.when((a == "rune") & (b == "native"), RUNE_TO_ASSET)
        .when((a == "native") & (b == "rune"), ASSET_TO_RUNE)
        .when((a == "rune") & (b == "synth"), RUNE_TO_SYNTH)
        .when((a == "synth") & (b == "rune"), SYNTH_TO_RUNE)
    )


def parse_coin(text: Column) -> Column:
    """'123 BTC.BTC' as struct(asset, e8); e8 is null where the number is malformed."""
    parts = F.split(text, " ", 2)
    return F.struct(F.get(parts, F.lit(1)).alias("asset"), parts[0].try_cast("long").alias("e8"))


def parse_coin_list(text: Column) -> Column:
    """Up to two coins separated by ', '."""
    return F.transform(F.filter(F.split(text, ", ", 2), lambda x: x != ""), parse_coin)


def parse_lower_coin(text: Column) -> Column:
    """'123btc/btc' as struct(asset in capitals, e8); 'rune' is the base asset."""
    name = F.upper(F.trim(F.regexp_extract(text, r"^([0-9]+)(.*)$", 2)))
    asset = F.when(name == "RUNE", RUNE).otherwise(name)
    return F.struct(asset.alias("asset"), F.regexp_extract(text, r"^([0-9]+)(.*)$", 1).try_cast("long").alias("e8"))


def folded_address(address: Column, chain: Column, case_insensitive: tuple[str, ...] = ("ETH",)) -> Column:
    return F.when(chain.isin(*case_insensitive), F.lower(address)).otherwise(address)


def sanitised(raw: Column) -> Column:
    """Binary as text; invalid UTF-8 and texts with NUL as marked base64."""
    text = F.try_validate_utf8(raw.cast("string"))
    return F.when(text.isNull() | F.contains(text, F.lit("\0")), F.concat(F.lit("BASE64:"), F.base64(raw))).otherwise(text)


# The affiliate's address is the fifth part of a memo, its fee the sixth, of one to five digits.
_ADDRESS, _FEE = r"(?s):.*:.*:.*:(.*):.*", r"(?s):.*:.*:.*:.*:(\d{1,5})(:|$)"


def affiliate(memo: Column, to_addr: Column) -> Column:
    """struct(address, fee) of a swap memo; both null if there is none or it is the receiver's own."""
    matched = memo.rlike(_ADDRESS)
    address = F.when(matched, F.regexp_extract(memo, _ADDRESS, 1))
    own = F.coalesce(address == to_addr, F.lit(False))
    fee = F.regexp_extract(memo, _FEE, 1)
    return F.struct(
        F.when(~own & (address != ""), address).alias("address"), F.when(~own & (fee != ""), fee.try_cast("long")).alias("fee")
    )


def like_any(memo: Column, at: Column, patterns: list[tuple[str, int | None]]) -> Column:
    """Whether a memo is like one of the patterns, each valid before a time in nanoseconds, or always."""
    out = F.lit(False)
    for pattern, before in patterns:
        hit = memo.like(pattern)
        out = out | (hit if before is None else hit & (at < before))
    return out


def coins(*pairs: tuple[Column, Column]) -> Column:
    """Coins with a positive amount as array<struct<asset, amount>>, or null if there is none."""
    listed = F.filter(
        F.array(*[F.struct(a.cast("string").alias("asset"), e.cast("long").alias("amount")) for a, e in pairs]),
        lambda c: c["amount"] > 0,
    )
    return F.when(F.size(listed) > 0, listed)


def transaction(tx: Column, address: Column, coin_list: Column) -> Column:
    return F.struct(tx.cast("string").alias("tx_id"), address.cast("string").alias("address"), coin_list.alias("coins"))


def transaction_list(*transactions: Column) -> Column:
    """Transactions that have coins."""
    return F.filter(F.array(*transactions), lambda t: t["coins"].isNotNull())
