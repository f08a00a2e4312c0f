"""Registry of the engine's queries over the supplied tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F

from poolscope.functions import assets, pricing
from poolscope.functions.numeric import NANOS, exact_sum, ieee_div
from poolscope.operators import actions, asof, buckets, checks, decode, depths, history, ledger, lookups
from poolscope.operators.buckets import Buckets
from poolscope.plans import adapters as A
from poolscope.registry import oracle_sql, queries, query
from poolscope.streaming import views

__all__ = ["oracle_sql", "queries"]

def second(text: str) -> int:
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())


#: Newest and oldest moments of the supplied tables, and the ranges that the queries ask for.
LINES = (second("1995-01-01"), second("2001-12-31"))
EVENTS = (second("2024-01-01"), second("2024-01-31"))
DAYS = buckets.resolve(*LINES, "day", start=second("1996-03-01"), until=second("1996-06-09"))
MONTHS = buckets.resolve(*LINES, "month", start=second("1995-01-01"), until=second("2001-12-01"))
EVENT_DAYS = buckets.resolve(*EVENTS, "day", start=second("2024-01-03"), until=second("2024-01-29"))
EVENT_HOURS = buckets.resolve(*EVENTS, "hour", start=second("2024-01-10"), count=48)
ODD = Buckets((second("1996-03-05") + 5000, second("1999-07-11") + 77))
ODD_EVENTS = Buckets((second("2024-01-05") + 1234, second("2024-01-20") + 4321))
MIDDLE = second("2024-01-16") * NANOS
USD_POOLS = ["click", "view", "purchase"]
WINDOW = Buckets((second("1997-01-01"), second("1998-01-01")))


def grid(b: Buckets) -> str:
    rows = ", ".join(f"({x}::BIGINT, {y}::BIGINT)" for x, y in zip(b.timestamps, b.timestamps[1:]))
    return f"grid(start_s, end_s) AS (VALUES {rows})"


def start_sql(b: Buckets, t: str = "block_timestamp") -> str:
    if b.interval is None:
        return f"{b.start}::BIGINT"
    if b.interval in buckets.EXACT:
        width = buckets.INTERVALS[b.interval][0]
        return f"{t} // 1000000000 // {width} * {width}"
    return f"epoch(date_trunc('{b.interval}', make_timestamp({t} // 1000)))::BIGINT"


def inside(b: Buckets, t: str = "block_timestamp") -> str:
    return f"{t} >= {b.start * NANOS} AND {t} < {b.end * NANOS}"


VOLUME = "CASE WHEN direction % 2 = 1 THEN to_e8 + liq_fee_in_rune_e8 ELSE from_e8 END"


def swap_history_sql(b: Buckets, where: str = "true") -> str:
    parts = []
    for d, name in [*history.DIRECTIONS.items(), (None, "total")]:
        only = "" if d is None else f" FILTER (direction = {d})"
        count = f"coalesce(count(direction){only}, 0)"
        parts += [
            f"{count}::BIGINT AS {name}_swap_count", f"coalesce(sum(v){only}, 0)::BIGINT AS {name}_volume_e8",
            f"coalesce(sum(usd){only}, 0)::BIGINT AS {name}_volume_usd", f"coalesce(sum(liq_fee_in_rune_e8){only}, 0)::BIGINT AS {name}_fees_e8",
            f"CASE WHEN {count} > 0 THEN sum(swap_slip_bp){only} / {count} ELSE 0 END::DOUBLE AS {name}_average_slip",
        ]
    return f"""WITH {A.SWAPS}, {grid(b)},
    s AS (SELECT *, {start_sql(b)} AS start_s, {VOLUME} AS v, (from_e8 * priceusd)::BIGINT AS usd FROM swap_events WHERE {inside(b)} AND {where})
    SELECT g.start_s, g.end_s, {", ".join(parts)} FROM grid g LEFT JOIN s USING (start_s) GROUP BY 1, 2"""


# --- swaps ---


@query("q1_swap_history_day", swap_history_sql(DAYS))
def q1_day(spark, d):
    return history.swap_history(A.swap_events(spark, d, False, DAYS), DAYS)


@query("q1_swap_history_month_pool", swap_history_sql(MONTHS, "pool = 'N.O'"))
def q1_month(spark, d):
    return history.swap_history(A.swap_events(spark, d, False, MONTHS), MONTHS, "N.O")


@query("agg4_swap_history_odd_range", swap_history_sql(ODD))
def q1_odd(spark, d):
    return history.swap_history(A.swap_events(spark, d, False, ODD), ODD)


MARKS = [("%:aff1:%", None), ("%:aff3:%", second("1997-01-01") * NANOS)]


@query("q2_marked_swap_history", swap_history_sql(MONTHS, f"(memo LIKE '%:aff1:%' OR (memo LIKE '%:aff3:%' AND block_timestamp < {MARKS[1][1]}))"))
def q2(spark, d):
    return history.swap_history(history.marked_swaps(A.swap_events(spark, d, False, MONTHS), MARKS), MONTHS)


@query(
    "agg3_quarter_rollup",
    f"""WITH {A.SWAPS} SELECT epoch(date_trunc('quarter', make_timestamp(block_timestamp // 1000)))::BIGINT AS start_s, pool, direction AS _direction,
    count(*) AS swap_count, sum({VOLUME})::BIGINT AS volume_e8, sum((from_e8 * priceusd)::BIGINT)::BIGINT AS volume_usd,
    sum(liq_fee_in_rune_e8)::BIGINT AS fees_e8, sum(swap_slip_bp)::BIGINT AS slip_bp FROM swap_events GROUP BY 1, 2, 3""",
)
def agg3(spark, d):
    agg = history.swaps_aggregate()
    return agg.final(agg.rollup(A.swap_events(spark, d, False), "quarter"))


@query(
    "agg15_swap_meta",
    f"""WITH {A.SWAPS} SELECT {DAYS.start}::BIGINT AS start_s, {DAYS.end}::BIGINT AS end_s, count(*) AS total_swap_count,
    sum({VOLUME})::BIGINT AS total_volume_e8 FROM swap_events WHERE {inside(DAYS)}""",
)
def agg15(spark, d):
    return history.history_meta(history.swap_history(A.swap_events(spark, d, False, DAYS), DAYS), ["total_swap_count", "total_volume_e8"])


@query("agg7_q24_unique_swappers", f"WITH {A.SWAPS} SELECT count(DISTINCT from_addr) AS unique_swappers FROM swap_events WHERE {inside(WINDOW)}")
def q24(spark, d):
    return lookups.unique_swappers(A.swap_events(spark, d, True, WINDOW), WINDOW)


@query(
    "q24_liquidity_fees",
    f"""WITH {A.SWAPS} SELECT pool, count(*) AS n, sum(liq_fee_in_rune_e8)::BIGINT AS liq_fee_in_rune_e8
    FROM swap_events WHERE {inside(WINDOW)} GROUP BY pool""",
)
def q24_fees(spark, d):
    return lookups.window_sums(A.swap_events(spark, d, False, WINDOW), WINDOW, ["liq_fee_in_rune_e8"], keys=["pool"])


NOW = second("1998-08-01")


@query(
    "q14_global_stats",
    f"""WITH {A.SWAPS}, s AS (SELECT *, {VOLUME} AS v FROM swap_events) SELECT direction AS _direction, count(*) AS swap_count,
    sum(v)::BIGINT AS volume_e8, count(*) FILTER (block_timestamp >= {(NOW - 86400) * NANOS}) AS swap_count_24h,
    coalesce(sum(v) FILTER (block_timestamp >= {(NOW - 86400) * NANOS}), 0)::BIGINT AS volume_24h,
    count(*) FILTER (block_timestamp >= {(NOW - 30 * 86400) * NANOS}) AS swap_count_30d,
    coalesce(sum(v) FILTER (block_timestamp >= {(NOW - 30 * 86400) * NANOS}), 0)::BIGINT AS volume_30d FROM s GROUP BY 1""",
)
def q14(spark, d):
    return lookups.global_swap_stats(A.swap_events(spark, d, False), NOW)


@query(
    "join3_single_swaps",
    f"""WITH {A.SWAPS} SELECT tx, event_idx, pool, from_asset FROM swap_events a WHERE NOT EXISTS (SELECT 1 FROM swap_events b
    WHERE b.tx = a.tx AND b.block_timestamp = a.block_timestamp AND b.from_asset <> a.from_asset)""",
)
def join3(spark, d):
    return actions.single_swaps(A.swap_events(spark, d)).select("tx", "event_idx", "pool", "from_asset")


@query(
    "join2_double_swaps",
    f"""WITH {A.SWAPS} SELECT a.tx, a.event_idx AS first_idx, b.event_idx AS second_idx,
    a.swap_slip_bp + b.swap_slip_bp - a.swap_slip_bp * b.swap_slip_bp // 10000 AS slip_bp FROM swap_events a JOIN swap_events b
    ON a.tx = b.tx AND a.block_timestamp = b.block_timestamp
    WHERE a.to_asset = '{A.RUNE}' AND b.from_asset = '{A.RUNE}' AND a.from_asset <> b.to_asset""",
)
def join2(spark, d):
    pairs = actions.double_swaps(A.swap_events(spark, d))
    slips = F.col("a_swap_slip_bp") + F.col("b_swap_slip_bp") - F.call_function("div", F.col("a_swap_slip_bp") * F.col("b_swap_slip_bp"), F.lit(10000))
    return pairs.select(F.col("a_tx").alias("tx"), F.col("a_event_idx").alias("first_idx"), F.col("b_event_idx").alias("second_idx"), slips.alias("slip_bp"))


@query(
    "fn2_affiliate_memo",
    rf"""WITH {A.SWAPS} SELECT tx, event_idx, 'aff' || regexp_extract(memo, ':aff(\d+):', 1) AS address,
    regexp_extract(memo, ':(\d+)$', 1)::BIGINT AS fee FROM swap_events""",
)
def fn2(spark, d):
    got = assets.affiliate(F.col("memo"), F.col("to_addr"))
    return A.swap_events(spark, d).select("tx", "event_idx", got["address"].alias("address"), got["fee"].alias("fee"))


@query(
    "dec10_dec13_coin_types",
    f"""WITH {A.SWAPS} SELECT direction AS _direction, CASE WHEN from_asset = '{A.RUNE}' THEN 'rune' WHEN from_asset LIKE '%/%' THEN 'synth' ELSE 'native' END AS from_type,
    replace(CASE WHEN from_asset = '{A.RUNE}' THEN to_asset ELSE from_asset END, '/', '.') AS native, count(*) AS n FROM swap_events GROUP BY ALL""",
)
def dec10(spark, d):
    rows = A.swap_events(spark, d)
    side = F.when(assets.is_rune(F.col("from_asset")), F.col("to_asset")).otherwise(F.col("from_asset"))
    direction = assets.swap_direction(F.col("from_asset"), F.col("to_asset"))
    rows = rows.select(direction.alias("_direction"), assets.coin_type(F.col("from_asset")).alias("from_type"), assets.native_asset(side).alias("native"))
    return rows.groupBy("_direction", "from_type", "native").agg(F.count(F.lit(1)).alias("n"))


# --- depths ---


def last_before(b: Buckets) -> str:
    return f"SELECT pool, max_by(struct_pack(a := asset_e8, r := rune_e8, s := synth_e8), block_timestamp) AS v FROM depths WHERE block_timestamp < {b.start * NANOS} GROUP BY pool"


def dense_sql(b: Buckets) -> str:
    return f"""{A.DEPTHS}, {grid(b)}, pools AS (SELECT DISTINCT pool FROM depths WHERE block_timestamp < {b.end * NANOS}),
    dense AS (SELECT g.start_s, g.end_s, p.pool, max_by(struct_pack(a := asset_e8, r := rune_e8, s := synth_e8), block_timestamp) AS v
      FROM grid g CROSS JOIN pools p LEFT JOIN depths d ON d.pool = p.pool AND d.block_timestamp < g.end_s * 1000000000 GROUP BY 1, 2, 3)"""


DENSE_COLUMNS = "coalesce(v.a, 0)::BIGINT AS asset_e8, coalesce(v.r, 0)::BIGINT AS rune_e8, coalesce(v.s, 0)::BIGINT AS synth_e8"


@query("q3_win11_depth_history", f"WITH {dense_sql(EVENT_DAYS)} SELECT start_s, end_s, pool, {DENSE_COLUMNS} FROM dense")
def q3(spark, d):
    return history.depth_history(A.block_pool_depths(spark, d), EVENT_DAYS)


@query("q3_depth_history_hours", f"WITH {dense_sql(EVENT_HOURS)} SELECT start_s, end_s, pool, {DENSE_COLUMNS} FROM dense")
def q3_hours(spark, d):
    return history.depth_history(A.block_pool_depths(spark, d), EVENT_HOURS)


@query("q7_tvl_history", f"WITH {dense_sql(EVENT_DAYS)} SELECT start_s, end_s, (2 * sum(coalesce(v.r, 0)))::BIGINT AS total_pooled FROM dense GROUP BY 1, 2")
def q7(spark, d):
    return history.tvl_history(A.block_pool_depths(spark, d), EVENT_DAYS)


@query(
    "fn10_usd_price_history",
    f"""WITH {dense_sql(EVENT_DAYS)} SELECT start_s, round(arg_max(CASE WHEN v.a = 0 THEN 1.0 ELSE v.a / v.r::DOUBLE END,
    v.r * 10 - list_position({USD_POOLS}, pool)), 9) AS rune_price_usd FROM dense WHERE pool IN ({", ".join(repr(p) for p in USD_POOLS)}) GROUP BY 1""",
)
def fn10(spark, d):
    return history.usd_history(A.block_pool_depths(spark, d), EVENT_DAYS, USD_POOLS).withColumn("rune_price_usd", F.round("rune_price_usd", 9))


@query(
    "q4_win15_candles",
    f"""WITH {A.DEPTHS}, {grid(EVENT_DAYS)}, p AS (SELECT {start_sql(EVENT_DAYS)} AS start_s, CASE WHEN asset_e8 = 0 THEN 0 ELSE rune_e8 / asset_e8::DOUBLE END AS p,
      block_timestamp AS t, block_timestamp // 300000000000 * 300 AS five FROM depths WHERE pool = 'click' AND {inside(EVENT_DAYS)}),
    c AS (SELECT start_s, min_by(p, t) AS open, max(p) AS high, min(p) AS low, max_by(p, t) AS close,
      arg_max(five, struct_pack(p := p, f := -five)) AS high_s, arg_min(five, struct_pack(p := p, f := five)) AS low_s FROM p GROUP BY 1),
    f AS (SELECT g.start_s, g.end_s, last_value(struct_pack(o := open, h := high, l := low, c := close, hs := high_s, ls := low_s) IGNORE NULLS) OVER (ORDER BY g.start_s) AS v
      FROM grid g LEFT JOIN (SELECT *, 1 AS one FROM c) c ON g.start_s = c.start_s)
    SELECT start_s, end_s, 'click' AS pool, round(coalesce(v.o, 0), 9) AS open, round(coalesce(v.h, 0), 9) AS high, round(coalesce(v.l, 0), 9) AS low,
      round(coalesce(v.c, 0), 9) AS close, coalesce(v.hs, 0)::BIGINT AS high_s, coalesce(v.ls, 0)::BIGINT AS low_s FROM f""",
)
def q4(spark, d):
    rows = history.candles(A.block_pool_depths(spark, d), EVENT_DAYS, "click")
    return rows.select("start_s", "end_s", "pool", *[F.round(c, 9).alias(c) for c in ("open", "high", "low", "close")], "high_s", "low_s")


@query(
    "agg8_first_last_depths",
    f"""WITH {A.DEPTHS} SELECT {start_sql(EVENT_DAYS)} AS start_s, pool, max_by(asset_e8, block_timestamp) AS last_asset, min_by(asset_e8, block_timestamp) AS first_asset,
    max(rune_e8) AS max_rune, min(rune_e8) AS min_rune FROM depths GROUP BY 1, 2""",
)
def agg8(spark, d):
    from poolscope.operators.rollup import Aggregate

    agg = Aggregate("ends", ["pool"]).last("last_asset", F.col("asset_e8")).first("first_asset", F.col("asset_e8"))
    agg = agg.max("max_rune", F.col("rune_e8")).min("min_rune", F.col("rune_e8"))
    return agg.final(agg.rollup(A.block_pool_depths(spark, d), "day"))


@query(
    "agg3_compat_calendar_ohlc",
    f"""WITH {A.DEPTHS}, days AS (SELECT block_timestamp // 86400000000000 * 86400 AS day, pool, max_by(asset_e8, block_timestamp) AS close, max(block_timestamp) AS t
      FROM depths GROUP BY 1, 2)
    SELECT epoch(date_trunc('week', make_timestamp(day * 1000000)))::BIGINT AS start_s, pool, min_by(close, t) AS open, max(close) AS high, min(close) AS low,
      max_by(close, t) AS close FROM days GROUP BY 1, 2""",
)
def agg3_compat(spark, d):
    from poolscope.operators.rollup import Aggregate

    c = F.col("asset_e8")
    agg = Aggregate("ohlc", ["pool"]).first("open", c).max("high", c).min("low", c).last("close", c)
    return agg.final(agg.rollup(A.block_pool_depths(spark, d), "week", compat_calendar=True))


@query(
    "fn12_synth_units",
    f"""WITH {A.DEPTHS} SELECT event_idx, CASE WHEN asset_e8 = 0 OR 2 * asset_e8 = synth_e8 THEN 0 ELSE trunc(rune_e8 * 1000::HUGEINT * synth_e8 / (2 * asset_e8 - synth_e8))::BIGINT END AS units
    FROM depths""",
)
def fn12(spark, d):
    units = pricing.synth_units(F.col("asset_e8"), F.col("synth_e8"), F.col("rune_e8") * 1000)
    return A.block_pool_depths(spark, d).select("event_idx", units.alias("units"))


@query(
    "fn13_luvi_and_loss",
    f"""WITH {A.DEPTHS} SELECT event_idx, round(sqrt(asset_e8::DOUBLE * rune_e8) / (user_units + 1), 6) AS luvi,
    CASE WHEN asset_e8 = 0 THEN NULL ELSE round(2 * sqrt((rune_e8 / asset_e8::DOUBLE) / 2) / (1 + (rune_e8 / asset_e8::DOUBLE) / 2), 9) END AS loss
    FROM (SELECT *, synth_e8 AS user_units FROM depths) WHERE asset_e8 > 0""",
)
def fn13(spark, d):
    rows = A.block_pool_depths(spark, d).filter("asset_e8 > 0")
    a, r = F.col("asset_e8"), F.col("rune_e8")
    return rows.select(
        "event_idx", F.round(pricing.luvi(a, r, F.col("synth_e8") + 1), 6).alias("luvi"),
        F.round(pricing.price_shift_loss(F.lit(1), F.lit(2), a, r), 9).alias("loss"),
    )


EFFECTS = f"""{A.SWAPS}, {A.LIQUIDITY}, fx AS (
  SELECT pool, CASE direction WHEN 0 THEN -to_e8 WHEN 1 THEN from_e8 ELSE 0 END AS asset, CASE WHEN direction % 2 = 0 THEN from_e8 ELSE -to_e8 END AS rune,
    CASE direction WHEN 2 THEN to_e8 WHEN 3 THEN -from_e8 ELSE 0 END AS synth, block_timestamp FROM swap_events
  UNION ALL SELECT pool, asset_e8, rune_e8, 0, block_timestamp FROM stake_events
  UNION ALL SELECT pool, -emit_asset_e8, -emit_rune_e8, 0, block_timestamp FROM unstake_events
), ends AS (SELECT pool, block_timestamp, sum(asset) AS a, sum(rune) AS r, sum(synth) AS s FROM fx GROUP BY 1, 2),
run AS (SELECT pool, block_timestamp, sum(a) OVER w AS a, sum(r) OVER w AS r, sum(s) OVER w AS s FROM ends WINDOW w AS (PARTITION BY pool ORDER BY block_timestamp)),
lagged AS (SELECT *, coalesce(lag(a) OVER w, 0) AS la, coalesce(lag(r) OVER w, 0) AS lr, coalesce(lag(s) OVER w, 0) AS ls FROM run
  WINDOW w AS (PARTITION BY pool ORDER BY block_timestamp))"""


@query(
    "fold1_fold2_block_depths",
    f"WITH {EFFECTS} SELECT pool, block_timestamp, a::BIGINT AS asset_e8, r::BIGINT AS rune_e8, s::BIGINT AS synth_e8 FROM lagged WHERE a <> la OR r <> lr OR s <> ls",
)
def fold1(spark, d):
    tables = {"swap_events": A.swap_events(spark, d, False), "stake_events": A.stake_events(spark, d), "unstake_events": A.unstake_events(spark, d)}
    return depths.block_depths(depths.depth_effects(tables))


@query(
    "join7_state_at_height",
    f"""WITH {A.DEPTHS} SELECT pool, max_by(asset_e8, block_timestamp) AS asset_e8, max_by(rune_e8, block_timestamp) AS rune_e8 FROM depths
    WHERE block_timestamp <= (SELECT epoch_us(ts) * 1000 FROM events WHERE event_id = 500) GROUP BY pool""",
)
def join7(spark, d):
    rows = lookups.pool_state_at_height(A.block_pool_depths(spark, d), A.block_log(spark, d), 500)
    return rows.select("pool", "asset_e8", "rune_e8")


@query(
    "asof_join_previous_depth",
    f"""WITH {A.DEPTHS}, q AS (SELECT event_type AS pool, event_id, epoch_us(ts) * 1000 - 1 AS block_timestamp FROM events)
    SELECT q.pool, q.event_id, q.block_timestamp, d.asset_e8 FROM q ASOF LEFT JOIN depths d ON q.pool = d.pool AND q.block_timestamp >= d.block_timestamp""",
)
def asof_join(spark, d):
    rows = A.table(spark, d, "events")
    left = rows.select(F.col("event_type").alias("pool"), "event_id", (A.nanos("ts") - 1).alias("block_timestamp"))
    return asof.as_of_join(left, A.block_pool_depths(spark, d), ["pool"], ["asset_e8"])


# --- earnings, liquidity, bonds, nodes ---


ACTIVE = f"(SELECT count(*) FROM (SELECT node_addr, max_by(current, event_idx) AS c FROM (SELECT node_addr, current, block_timestamp AS event_idx FROM nodes WHERE block_timestamp <= {EVENT_DAYS.start * NANOS}) GROUP BY 1) WHERE c = 'Active')"
NODE_SQL = f"""{A.NODES}, {grid(EVENT_DAYS)},
  ch AS (SELECT block_timestamp // 1000000000 AS s, sum(CASE current WHEN 'Active' THEN 1 ELSE 0 END - CASE former WHEN 'Active' THEN 1 ELSE 0 END) AS delta FROM nodes
    WHERE block_timestamp > {EVENT_DAYS.start * NANOS} AND block_timestamp < {EVENT_DAYS.end * NANOS} GROUP BY 1),
  pts AS (SELECT s, sum(delta) AS delta FROM (SELECT * FROM ch UNION ALL SELECT start_s, 0 FROM grid) GROUP BY 1),
  seg AS (SELECT s, sum(delta) OVER (ORDER BY s) + {ACTIVE} AS n, coalesce(lead(s) OVER (ORDER BY s), {EVENT_DAYS.end}) AS nx FROM pts),
  w AS (SELECT s // 86400 * 86400 AS start_s, sum(n * (nx - s)) AS weighted FROM seg GROUP BY 1)"""


def active_before(spark, d):
    return lookups.active_node_count(A.node_status_events(spark, d), EVENT_DAYS.start * NANOS).scalar()


@query("win14_weighted_node_count", f"WITH {NODE_SQL} SELECT start_s, end_s, weighted::BIGINT AS weighted_sum, weighted / (end_s - start_s)::DOUBLE AS average FROM grid JOIN w USING (start_s)")
def win14(spark, d):
    changes = lookups.active_node_changes(A.node_status_events(spark, d))
    rows = asof.weighted_average(changes, active_before(spark, d), EVENT_DAYS)
    return rows.select("start_s", "end_s", F.col("weighted_sum").cast("long").alias("weighted_sum"), "average")


@query(
    "q5_earnings_history",
    f"""WITH {NODE_SQL}, {A.EVENT_FLOWS},
    f AS (SELECT {start_sql(EVENT_DAYS)} AS start_s, sum(fee) AS fees FROM eswaps WHERE {inside(EVENT_DAYS)} GROUP BY 1),
    p AS (SELECT {start_sql(EVENT_DAYS)} AS start_s, sum(rune_e8) AS pr FROM entries WHERE {inside(EVENT_DAYS)} GROUP BY 1),
    b AS (SELECT {start_sql(EVENT_DAYS)} AS start_s, sum(bond_e8) AS br FROM rewards WHERE {inside(EVENT_DAYS)} GROUP BY 1),
    a AS (SELECT start_s, end_s, coalesce(fees, 0) AS fees, coalesce(pr, 0) AS pr, coalesce(br, 0) AS br, weighted FROM grid LEFT JOIN f USING (start_s) LEFT JOIN p USING (start_s)
      LEFT JOIN b USING (start_s) LEFT JOIN w USING (start_s))
    SELECT start_s, end_s, fees::BIGINT AS liquidity_fees, br::BIGINT AS bonding_earnings, (pr + br)::BIGINT AS block_rewards, (pr + fees)::BIGINT AS liquidity_earnings,
      (pr + fees + br)::BIGINT AS earnings, round(weighted / (end_s - start_s)::DOUBLE, 6) AS avg_node_count FROM a""",
)
def q5(spark, d):
    changes = lookups.active_node_changes(A.node_status_events(spark, d))
    rows = history.earnings_history(
        A.event_swaps(spark, d), A.rewards_events(spark, d), A.reward_entries(spark, d), changes, active_before(spark, d), EVENT_DAYS
    )
    return rows.withColumn("avg_node_count", F.round("avg_node_count", 6))


@query(
    "q5_pool_earnings",
    f"""WITH {A.EVENT_FLOWS}, {grid(EVENT_DAYS)}, x AS (SELECT {start_sql(EVENT_DAYS)} AS start_s, pool, fee AS fees, 0 AS rewards FROM eswaps WHERE {inside(EVENT_DAYS)}
      UNION ALL SELECT {start_sql(EVENT_DAYS)}, pool, 0, rune_e8 FROM entries WHERE {inside(EVENT_DAYS)}),
    pools AS (SELECT DISTINCT pool FROM x)
    SELECT g.start_s, g.end_s, p.pool, coalesce(sum(fees), 0)::BIGINT AS fees, coalesce(sum(rewards), 0)::BIGINT AS rewards, coalesce(sum(fees + rewards), 0)::BIGINT AS earnings
    FROM grid g CROSS JOIN pools p LEFT JOIN x ON x.start_s = g.start_s AND x.pool = p.pool GROUP BY 1, 2, 3""",
)
def q5_pools(spark, d):
    return history.pool_earnings(A.event_swaps(spark, d), A.reward_entries(spark, d), EVENT_DAYS)


@query(
    "q6_liquidity_history",
    f"""WITH {A.LIQUIDITY}, {grid(MONTHS)},
    a AS (SELECT {start_sql(MONTHS)} AS start_s, count(*) AS n, sum(asset_e8) AS av, sum(stake_units) AS inrune, sum(rune_e8) AS rv FROM stake_events WHERE {inside(MONTHS)} GROUP BY 1),
    w AS (SELECT {start_sql(MONTHS)} AS start_s, count(*) AS n, sum(stake_units) AS inrune, sum(emit_rune_e8) AS rv FROM unstake_events WHERE {inside(MONTHS)} GROUP BY 1)
    SELECT g.start_s, g.end_s, coalesce(a.n, 0)::BIGINT AS add_count, coalesce(a.inrune, 0)::BIGINT AS add_asset_volume, coalesce(a.rv, 0)::BIGINT AS add_rune_volume,
      coalesce(w.n, 0)::BIGINT AS withdraw_count, coalesce(w.inrune, 0)::BIGINT AS withdraw_asset_volume, coalesce(w.rv, 0)::BIGINT AS withdraw_rune_volume,
      (coalesce(a.inrune, 0) + coalesce(a.rv, 0) - coalesce(w.inrune, 0) - coalesce(w.rv, 0))::BIGINT AS net
    FROM grid g LEFT JOIN a USING (start_s) LEFT JOIN w USING (start_s)""",
)
def q6(spark, d):
    return history.liquidity_history(A.stake_events(spark, d), A.unstake_events(spark, d), MONTHS)


@query(
    "win13_unit_history",
    f"""WITH {A.LIQUIDITY}, {grid(MONTHS)}, c AS (SELECT pool, stake_units AS u, block_timestamp AS t FROM stake_events UNION ALL SELECT pool, -stake_units, block_timestamp FROM unstake_events),
    pools AS (SELECT DISTINCT pool FROM c WHERE t < {MONTHS.end * NANOS})
    SELECT start_s, end_s, p.pool, coalesce(sum(u), 0)::BIGINT AS units FROM grid CROSS JOIN pools p LEFT JOIN c ON c.pool = p.pool AND c.t < end_s * 1000000000 GROUP BY 1, 2, 3""",
)
def win13(spark, d):
    return history.unit_history(history.unit_changes(A.stake_events(spark, d), A.unstake_events(spark, d)), MONTHS)


SIGN = "CASE WHEN bond_type IN ('bond_paid', 'bond_reward') THEN e8 ELSE -e8 END"


@query(
    "q22_bond_history",
    f"""WITH {A.BONDS}, {grid(EVENT_DAYS)} SELECT start_s, end_s, coalesce(sum({SIGN}), 0)::BIGINT AS bond FROM grid
    LEFT JOIN bonds ON block_timestamp < end_s * 1000000000 GROUP BY 1, 2""",
)
def q22(spark, d):
    return history.bond_history(A.bond_events(spark, d), EVENT_DAYS)


@query(
    "join12_bond_replay",
    f"""WITH {A.BONDS} SELECT from_addr, event_idx, sum({SIGN}) OVER (PARTITION BY from_addr ORDER BY block_timestamp, event_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS bond FROM bonds""",
)
def join12(spark, d):
    return ledger.bond_replay(A.bond_events(spark, d), A.block_log(spark, d)).select("from_addr", "event_idx", "bond")


@query("agg10_active_nodes", f"WITH {A.NODES} SELECT count(*) AS active_nodes FROM (SELECT node_addr, max_by(current, block_timestamp) AS c FROM nodes WHERE block_timestamp <= {MIDDLE} GROUP BY 1) WHERE c = 'Active'")
def agg10(spark, d):
    return lookups.active_node_count(A.node_status_events(spark, d), MIDDLE)


@query(
    "q27_node_status",
    f"""WITH {A.NODES}, born AS (SELECT DISTINCT 'n' || user_id AS node_addr FROM events WHERE event_type = 'signup' AND epoch_us(ts) * 1000 <= {MIDDLE}),
    c AS (SELECT node_addr, max_by(current, block_timestamp) AS s FROM nodes WHERE block_timestamp <= {MIDDLE} GROUP BY 1)
    SELECT node_addr, coalesce(s, '') AS status FROM (SELECT node_addr FROM born UNION SELECT node_addr FROM c) LEFT JOIN c USING (node_addr)""",
)
def q27(spark, d):
    born = A.table(spark, d, "events").filter("event_type = 'signup'")
    born = born.select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node_addr"), A.nanos("ts").alias("block_timestamp"))
    return lookups.node_status(born, A.node_status_events(spark, d), MIDDLE)


NODE_BONDS = "nb AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'Standby' ELSE 'Active' END AS status, (c_acctbal * 100)::BIGINT AS bond FROM customer)"


def node_bonds(spark, d):
    rows = A.table(spark, d, "customer")
    return rows.select(F.when(F.col("c_custkey") % 3 == 0, "Standby").otherwise("Active").alias("status"), A.e8(F.col("c_acctbal") * 100).alias("bond"))


METRICS = f"""{NODE_BONDS}, r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY bond) - 1 AS pos, count(*) OVER (PARTITION BY status) AS n FROM nb),
  m AS (SELECT status, sum(bond)::BIGINT AS total, CASE WHEN status = 'Standby' THEN coalesce(min(bond) FILTER (bond >= 100000), min(bond)) ELSE min(bond) END AS minimum,
    max(bond) AS maximum, trunc(sum(bond) / count(*))::BIGINT AS average, max(bond) FILTER (pos = n // 2) AS median FROM r GROUP BY status)"""


@query("agg16_bond_metrics", f"WITH {METRICS} SELECT * FROM m")
def agg16(spark, d):
    return pricing.bond_metrics(node_bonds(spark, d), 100000)


# --- balances and members ---


DELTAS = f"""{A.TRANSFERS}, sides AS (SELECT to_addr AS addr, asset, block_timestamp, amount_e8 AS delta FROM transfers
  UNION ALL SELECT from_addr, asset, block_timestamp, -amount_e8 FROM transfers),
  deltas AS (SELECT addr, asset, block_timestamp, sum(delta)::BIGINT AS delta FROM sides GROUP BY 1, 2, 3)"""


@query("set3_balance_deltas", f"WITH {DELTAS} SELECT * FROM deltas")
def set3(spark, d):
    return ledger.balance_deltas(A.transfer_events(spark, d))


@query("win1_mv5_balances", f"WITH {DELTAS} SELECT addr, asset, block_timestamp, sum(delta) OVER (PARTITION BY addr, asset ORDER BY block_timestamp)::BIGINT AS balance FROM deltas")
def win1(spark, d):
    return ledger.balances(A.transfer_events(spark, d))


@query("mv5_current_balances", f"WITH {DELTAS} SELECT addr, asset, sum(delta)::BIGINT AS balance FROM deltas GROUP BY 1, 2")
def mv5(spark, d):
    return ledger.balances_now(A.transfer_events(spark, d))


BALANCE_AT = second("1997-06-01") * NANOS


@query("q19_balances_at", f"WITH {DELTAS} SELECT addr, asset, sum(delta)::BIGINT AS balance FROM deltas WHERE block_timestamp <= {BALANCE_AT} GROUP BY 1, 2")
def q19(spark, d):
    return ledger.balances_at(A.transfer_events(spark, d), BALANCE_AT)


@query("join5_balance_as_of", f"WITH {DELTAS} SELECT addr, asset, sum(delta)::BIGINT AS balance FROM deltas WHERE block_timestamp <= {BALANCE_AT} AND addr = 's1' GROUP BY 1, 2")
def join5(spark, d):
    log = ledger.balances(A.transfer_events(spark, d).filter("from_addr = 's1' or to_addr = 's1'")).filter("addr = 's1'")
    return ledger.balance_as_of(log, BALANCE_AT)


MEMBER = "coalesce(rune_addr, asset_addr)"
OPEN = """SELECT * FROM pending_events p WHERE pending_type = 'add' AND NOT EXISTS (SELECT 1 FROM stake_events s WHERE s.rune_addr = p.rune_addr AND s.pool = p.pool AND p.block_timestamp <= s.block_timestamp)
  AND NOT EXISTS (SELECT 1 FROM pending_events w WHERE w.pending_type = 'withdraw' AND w.rune_addr = p.rune_addr AND w.pool = p.pool AND p.block_timestamp <= w.block_timestamp)"""


@query("join4_open_pending", f"WITH {A.LIQUIDITY}, o AS ({OPEN}) SELECT pool, asset_addr, rune_addr, asset_e8, event_idx FROM o")
def join4(spark, d):
    rows = ledger.open_pending(A.pending_liquidity_events(spark, d), A.stake_events(spark, d))
    return rows.select("pool", "asset_addr", "rune_addr", "asset_e8", "event_idx")


@query(
    "q32_member_units",
    f"""WITH {A.LIQUIDITY} SELECT member_id, pool, sum(u)::BIGINT AS units FROM (SELECT {MEMBER} AS member_id, pool, stake_units AS u FROM stake_events
    UNION ALL SELECT from_addr, pool, -stake_units FROM unstake_events) GROUP BY 1, 2""",
)
def q32(spark, d):
    return ledger.member_units(A.stake_events(spark, d), A.unstake_events(spark, d))


@query(
    "fold6_clustered_units",
    f"""WITH {A.LIQUIDITY}, m AS (SELECT member_id, pool, sum(u)::BIGINT AS units FROM (SELECT {MEMBER} AS member_id, pool, stake_units AS u FROM stake_events
      UNION ALL SELECT from_addr, pool, -stake_units FROM unstake_events) GROUP BY 1, 2),
    o AS (SELECT pool, asset_addr, min(rune_addr) AS owner FROM stake_events WHERE rune_addr IS NOT NULL GROUP BY 1, 2)
    SELECT m.pool, coalesce(owner, member_id) AS member_id, sum(units)::BIGINT AS units FROM m LEFT JOIN o ON o.pool = m.pool AND o.asset_addr = m.member_id GROUP BY 1, 2""",
)
def fold6(spark, d):
    return ledger.clustered_units(A.stake_events(spark, d), A.unstake_events(spark, d))


@query(
    "q10_full_member",
    f"""WITH {A.LIQUIDITY}, o AS ({OPEN}), x AS (
      SELECT {MEMBER} AS member_id, pool, stake_units AS u, asset_e8 AS aa, rune_e8 AS ar, 0 AS wa, 0 AS wr, 0 AS pa, 0 AS pr FROM stake_events
      UNION ALL SELECT from_addr, pool, -stake_units, 0, 0, emit_asset_e8, emit_rune_e8, 0, 0 FROM unstake_events
      UNION ALL SELECT {MEMBER}, pool, 0, 0, 0, 0, 0, asset_e8, rune_e8 FROM o)
    SELECT member_id, pool, sum(u)::BIGINT AS units, sum(aa)::BIGINT AS added_asset, sum(ar)::BIGINT AS added_rune, sum(wa)::BIGINT AS withdrawn_asset,
      sum(wr)::BIGINT AS withdrawn_rune, sum(pa)::BIGINT AS pending_asset, sum(pr)::BIGINT AS pending_rune FROM x GROUP BY 1, 2""",
)
def q10(spark, d):
    return ledger.full_member(A.stake_events(spark, d), A.unstake_events(spark, d), A.pending_liquidity_events(spark, d))


@query(
    "mv6_members_units",
    f"""WITH {A.LIQUIDITY}, u AS (SELECT member_id, pool, sum(u)::BIGINT AS units FROM (SELECT {MEMBER} AS member_id, pool, stake_units AS u FROM stake_events
    UNION ALL SELECT from_addr, pool, -stake_units FROM unstake_events) GROUP BY 1, 2) SELECT * FROM u WHERE units <> 0""",
)
def mv6_units(spark, d):
    rows = ledger.members(ledger.member_changes(A.stake_events(spark, d), A.unstake_events(spark, d), A.pending_liquidity_events(spark, d)))
    return rows.filter("units <> 0").select("member_id", "pool", "units")


@query(
    "q9_member_ids",
    f"""WITH {A.LIQUIDITY}, u AS (SELECT member_id, pool, sum(u) AS units FROM (SELECT {MEMBER} AS member_id, pool, stake_units AS u FROM stake_events
    UNION ALL SELECT from_addr, pool, -stake_units FROM unstake_events) GROUP BY 1, 2) SELECT DISTINCT member_id FROM u WHERE units > 0""",
)
def q9(spark, d):
    rows = ledger.members(ledger.member_changes(A.stake_events(spark, d), A.unstake_events(spark, d), A.pending_liquidity_events(spark, d)))
    return rows.filter("units > 0").select("member_id").distinct()


# --- actions ---


def action_tables(spark, d):
    return {
        "swap_events": A.swap_events(spark, d), "stake_events": A.stake_events(spark, d), "unstake_events": A.unstake_events(spark, d),
        "pending_liquidity_events": A.pending_liquidity_events(spark, d), "outbound_events": A.outbound_events(spark, d), "fee_events": A.fee_events(spark, d),
    }


@query(
    "mv4_action_counts",
    f"""WITH {A.SWAPS}, {A.LIQUIDITY}, single AS (SELECT * FROM swap_events a WHERE NOT EXISTS (SELECT 1 FROM swap_events b WHERE b.tx = a.tx AND b.block_timestamp = a.block_timestamp AND b.from_asset <> a.from_asset)),
    double AS (SELECT 1 FROM swap_events a JOIN swap_events b ON a.tx = b.tx AND a.block_timestamp = b.block_timestamp WHERE a.to_asset = '{A.RUNE}' AND b.from_asset = '{A.RUNE}' AND a.from_asset <> b.to_asset),
    o AS ({OPEN})
    SELECT 'swap' AS type, (SELECT count(*) FROM single) + (SELECT count(*) FROM double) AS n UNION ALL SELECT 'withdraw', count(*) FROM unstake_events
    UNION ALL SELECT 'addLiquidity', (SELECT count(*) FROM stake_events) + (SELECT count(*) FROM o)""",
)
def mv4(spark, d):
    return actions.base_actions(action_tables(spark, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join10_action_outbounds",
    f"""WITH {A.LIQUIDITY} SELECT main_ref, event_idx, count(l_orderkey) FILTER (l_linenumber <= 2) AS n_outs, count(l_orderkey) FILTER (l_linenumber = 3) AS n_fees,
      coalesce(sum(l_suppkey) FILTER (l_linenumber = 3), 0)::BIGINT AS fees
    FROM (SELECT event_idx::VARCHAR AS main_ref, event_idx FROM unstake_events) LEFT JOIN lineitem ON l_orderkey = event_idx GROUP BY 1, 2""",
)
def join10(spark, d):
    rows = actions.withdraw_actions(A.unstake_events(spark, d))
    rows = actions.attach_outbounds(rows, A.outbound_events(spark, d), A.fee_events(spark, d))
    return rows.select(
        "main_ref", F.col("main_ref").cast("long").alias("event_idx"), F.size("outs").cast("long").alias("n_outs"), F.size("fees").cast("long").alias("n_fees"),
        F.aggregate("fees", F.lit(0).cast("long"), lambda acc, f: acc + f["amount"]).alias("fees"),
    )


@query(
    "q8_action_status",
    f"""WITH {A.SWAPS}, single AS (SELECT * FROM swap_events a WHERE NOT EXISTS (SELECT 1 FROM swap_events b WHERE b.tx = a.tx AND b.block_timestamp = a.block_timestamp AND b.from_asset <> a.from_asset))
    SELECT tx AS main_ref, event_idx, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey::VARCHAR = tx AND l_linenumber <= 2) THEN 'success' ELSE 'pending' END AS status FROM single""",
)
def q8_status(spark, d):
    swaps = actions.single_swaps(A.swap_events(spark, d))
    rows = actions.swap_actions(swaps).filter("meta.swapSingle")
    rows = actions.with_status(actions.attach_outbounds(rows, A.outbound_events(spark, d), A.fee_events(spark, d)))
    kept = rows.select("main_ref", "status").distinct()
    return swaps.select(F.col("tx").alias("main_ref"), "event_idx").join(kept, "main_ref")


@query(
    "q8_srt1_action_page",
    f"""WITH {A.LIQUIDITY} SELECT event_idx::VARCHAR AS main_ref, block_timestamp FROM unstake_events ORDER BY block_timestamp DESC, event_idx::VARCHAR LIMIT 50 OFFSET 100""",
)
def q8_page(spark, d):
    rows = actions.select_actions(actions.withdraw_actions(A.unstake_events(spark, d)), types=["withdraw"])
    return actions.page(rows, 50, 100).select("main_ref", "block_timestamp")


@query(
    "srt2_fil6_action_total",
    f"""WITH {A.SWAPS} SELECT count(*) AS n FROM swap_events a WHERE ('17' IN (from_addr, to_addr)) AND from_asset NOT LIKE '%/%' AND to_asset NOT LIKE '%/%'
    AND NOT EXISTS (SELECT 1 FROM swap_events b WHERE b.tx = a.tx AND b.block_timestamp = a.block_timestamp AND b.from_asset <> a.from_asset)""",
)
def srt2(spark, d):
    rows = actions.swap_actions(A.swap_events(spark, d)).filter("meta.swapSingle")
    return actions.select_actions(rows, address="17", asset_type="native").agg(F.count(F.lit(1)).alias("n"))


# --- pools, names, constants, blocks ---


ENTRIES = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, chain ORDER BY block_timestamp DESC) AS r FROM names) WHERE r = 1)"


@query("agg12_name_entries", f"WITH {A.NAMES}, {ENTRIES} SELECT name, chain, address, expire FROM e")
def agg12(spark, d):
    return lookups.name_entries(A.name_changes(spark, d)).select("name", "chain", "address", "expire")


@query(
    "q17_lookup_name",
    f"""WITH {A.NAMES}, {ENTRIES}, o AS (SELECT name, max_by(owner, block_timestamp) AS owner, max_by(expire, block_timestamp) AS expire FROM names GROUP BY 1)
    SELECT name, o.owner, o.expire, chain, address FROM o JOIN e USING (name) WHERE name = 'name3' AND o.expire > 100""",
)
def q17(spark, d):
    return lookups.lookup_name(A.name_changes(spark, d), "name3", 100)


@query("q18_names_of_address", f"WITH {A.NAMES}, {ENTRIES} SELECT DISTINCT name FROM e WHERE address = 'addr4' AND expire > 100")
def q18(spark, d):
    return lookups.names_of_address(A.name_changes(spark, d), "addr4", 100)


@query("q18_names_of_owner", f"WITH {A.NAMES} SELECT name FROM (SELECT name, max_by(owner, block_timestamp) AS o, max_by(expire, block_timestamp) AS x FROM names GROUP BY 1) WHERE o = 'owner2' AND x > 100")
def q18_owner(spark, d):
    return lookups.names_of_owner(A.name_changes(spark, d), "owner2", 100)


@query(
    "q20_pool_status",
    f"""WITH {A.NODES}, p AS (SELECT DISTINCT 'n' || user_id AS pool FROM events) SELECT pool, coalesce(lower(max_by(current, block_timestamp)), 'staged') AS status
    FROM p LEFT JOIN nodes ON node_addr = pool GROUP BY 1""",
)
def q20(spark, d):
    pools = A.table(spark, d, "events").select(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("pool")).distinct()
    status = A.node_status_events(spark, d).select(F.col("node_addr").alias("asset"), F.col("current").alias("status"), "block_timestamp", "event_idx")
    return lookups.pool_status(status, pools)


@query("q21_fil5_constant", "SELECT 'CLICK' AS key, coalesce(max_by(user_id, ts), 7)::BIGINT AS value FROM events WHERE event_type ILIKE 'CLICK'")
def q21(spark, d):
    rows = A.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value"), A.nanos("ts").alias("block_timestamp"))
    return lookups.constant_value(rows, "CLICK", 7)


@query(
    "q23_window_sums",
    f"""WITH {A.EVENT_FLOWS} SELECT pool, count(*) AS n, sum(rune_e8)::BIGINT AS rune_e8, round(avg(rune_e8), 6) AS avg_rune_e8 FROM entries
    WHERE {inside(ODD_EVENTS)} GROUP BY 1""",
)
def q23(spark, d):
    rows = lookups.window_sums(A.reward_entries(spark, d), ODD_EVENTS, ["rune_e8"], ["rune_e8"], ["pool"])
    return rows.withColumn("avg_rune_e8", F.round("avg_rune_e8", 6))


@query("q25_health", "SELECT max(event_id) AS height, max(epoch_us(ts) * 1000) AS timestamp, true AS in_sync FROM events")
def q25(spark, d):
    return lookups.health(A.block_log(spark, d), EVENTS[1] * NANOS, EVENTS[1] + 5)


@query("q26_block_by_id", "SELECT event_id AS height, epoch_us(ts) * 1000 AS timestamp FROM events WHERE event_id = 42")
def q26(spark, d):
    return lookups.block_by_id(A.block_log(spark, d), 42).select("height", "timestamp")


@query("join1_join6_newest_block", f"SELECT event_id AS height, epoch_us(ts) * 1000 AS timestamp FROM events WHERE epoch_us(ts) * 1000 <= {MIDDLE} ORDER BY ts DESC LIMIT 1")
def join6(spark, d):
    return lookups.newest_block(A.block_log(spark, d), MIDDLE).select("height", "timestamp")


@query("fn15_next_churn_height", "SELECT event_id, CASE WHEN event_id < user_id + 100 THEN user_id + 100 ELSE user_id + 100 + 10 * ((event_id - user_id - 100) // 10 + 1) END AS next_height FROM events")
def fn15(spark, d):
    nxt = pricing.next_churn_height(F.col("event_id"), F.col("user_id"), F.lit(100), F.lit(10))
    return A.table(spark, d, "events").select("event_id", nxt.alias("next_height"))


@query("fn16_compounding", "SELECT event_id, round(CASE WHEN user_id % 5 > 1 THEN pow(1 + value / 1e5, user_id % 5) - 1 ELSE value / 1e5 * (user_id % 5) END, 9) AS apy FROM events")
def fn16(spark, d):
    apy = pricing.compound(F.col("value") / 1e5, F.col("user_id") % 5)
    return A.table(spark, d, "events").select("event_id", F.round(apy, 9).alias("apy"))


@query("fn6_ieee_division", "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN (CASE WHEN value = 0 THEN 'nan' WHEN value > 0 THEN 'inf' ELSE '-inf' END) ELSE 'finite' END AS kind FROM events")
def fn6(spark, d):
    x = ieee_div(F.col("value"), F.col("user_id") % 4)
    kind = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise("finite")
    return A.table(spark, d, "events").select("event_id", kind.alias("kind"))


@query("agg6_exact_totals", f"WITH {A.SWAPS} SELECT pool, sum(from_e8::HUGEINT)::BIGINT AS total, min(from_e8) AS least, max(from_e8) AS most, count(*) AS n FROM swap_events GROUP BY pool")
def agg6(spark, d):
    return A.swap_events(spark, d, False).groupBy("pool").agg(exact_sum(F.col("from_e8")).alias("total"), F.min("from_e8").alias("least"), F.max("from_e8").alias("most"), F.count(F.lit(1)).alias("n"))


# --- decoding, checks, streams ---


@query(
    "dec2_dec3_decode_outbound",
    "SELECT event_id AS height, user_id::VARCHAR AS tx, 'BTC.BTC' AS asset, (value * 100)::BIGINT AS asset_e8 FROM events",
)
def dec2(spark, d):
    events = A.raw_events(spark, d).withColumn("type", F.lit("outbound"))
    return decode.decode(events, "outbound").select("height", "tx", "asset", "asset_e8")


@query("dec6_open_amounts", """SELECT epoch_us(ts) * 1000 AS block_timestamp, 'k' AS asset, (props->>'$.k')::BIGINT AS amount FROM events""")
def dec6(spark, d):
    events = A.raw_events(spark, d).withColumn("type", F.lit("rewards"))
    return decode.open_amounts(events, "rewards").filter("asset = 'k'").select("block_timestamp", "asset", "amount")


@query(
    "src10_flatten_blocks",
    """SELECT o_orderkey AS height, row_number() OVER (PARTITION BY o_orderkey ORDER BY k) - 1 AS event_idx, type FROM (
      SELECT o_orderkey, 0 AS k, 'begin' AS type FROM orders UNION ALL SELECT o_orderkey, 1, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 2, o_orderpriority FROM orders
      UNION ALL SELECT o_orderkey, 3, 'end' FROM orders)""",
)
def src10(spark, d):
    none = F.array().cast("array<struct<key:string,value:string>>")
    event = lambda kind: F.struct(kind.alias("type"), none.alias("attributes"))
    rows = A.table(spark, d, "orders")
    txs = F.array(*[F.struct(F.array(event(F.col(c))).alias("events")) for c in ("o_orderstatus", "o_orderpriority")])
    blocks = rows.select(
        F.col("o_orderkey").alias("height"), A.nanos("o_orderdate").alias("time_ns"), F.lit("").alias("hash"),
        F.array(event(F.lit("begin"))).alias("begin"), txs.alias("txs"), F.array(event(F.lit("end"))).alias("end"),
    )
    return decode.flatten_blocks(blocks).select("height", "event_idx", "type")


@query(
    "join14_state_diff",
    """WITH a AS (SELECT l_suppkey AS k, sum(l_quantity)::BIGINT AS v FROM lineitem WHERE l_suppkey % 10 <> 3 GROUP BY 1),
    b AS (SELECT l_suppkey AS k, sum(l_quantity + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS v FROM lineitem WHERE l_suppkey % 10 <> 4 GROUP BY 1)
    SELECT k, a.v AS our_v, b.v AS their_v FROM a FULL JOIN b USING (k) WHERE a.v IS DISTINCT FROM b.v""",
)
def join14(spark, d):
    rows = A.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "k")
    ours = rows.filter("k % 10 <> 3").groupBy("k").agg(F.sum("l_quantity").cast("long").alias("v"))
    more = F.col("l_quantity") + F.when(F.col("k") % 7 == 0, 1).otherwise(0)
    theirs = rows.filter("k % 10 <> 4").groupBy("k").agg(F.sum(more).cast("long").alias("v"))
    return checks.state_diff(ours, theirs, ["k"], ["v"])


@query("q29_first_divergence", "SELECT event_type AS pool, min(event_id) AS first_height FROM events WHERE user_id % 50 = 7 GROUP BY 1")
def q29(spark, d):
    rows = A.table(spark, d, "events").select(F.col("event_type").alias("pool"), F.col("event_id").alias("height"), F.col("value").alias("v"), "user_id")
    theirs = rows.withColumn("v", F.when(F.col("user_id") % 50 == 7, F.lit(-1.0)).otherwise(F.col("v")))
    return checks.first_divergence(rows, theirs, ["pool"], ["v"])


@query("src6_missing_heights", "SELECT event_id AS height FROM events e WHERE user_id % 9 <> 4 AND event_id < (SELECT max(event_id) FROM events WHERE user_id % 9 <> 4) AND NOT EXISTS (SELECT 1 FROM events n WHERE n.event_id = e.event_id + 1 AND n.user_id % 9 <> 4)")
def src6(spark, d):
    log = A.table(spark, d, "events").filter("user_id % 9 <> 4").select(F.col("event_id").alias("height"))
    return checks.missing_heights(log)


@query("q30_trim", f"WITH {A.EVENT_FLOWS} SELECT pool, count(*) AS n FROM entries WHERE block_timestamp < {MIDDLE} GROUP BY 1")
def q30(spark, d):
    return checks.trimmed(A.reward_entries(spark, d), MIDDLE).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query("set2_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT l_suppkey FROM lineitem")
def set2(spark, d):
    return A.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(A.table(spark, d, "lineitem").select("l_suppkey")).distinct()


KEYED = "SELECT event_type AS pool, 'rewards' AS kind, (props->>'$.k')::BIGINT AS rune_e8, event_id AS height FROM events"


def keyed_events(spark, d):
    rows = A.raw_events(spark, d)
    k = F.filter("attributes", lambda a: a["key"] == "k")[0]["value"]
    pair = F.array(F.struct(F.col("type").alias("key"), k.alias("value")))
    return views.pool_events(rows.withColumn("attributes", pair).withColumn("type", F.lit("rewards")))


@query("str1_str2_pool_totals", f"WITH k AS ({KEYED}) SELECT pool, count(*) AS n, 0::BIGINT AS asset_e8, sum(rune_e8)::BIGINT AS rune_e8, max(height) AS height, 0::BIGINT AS event_idx FROM k GROUP BY 1")
def str2(spark, d):
    return views.pool_stats_batch(keyed_events(spark, d))


@query("str4_kind_totals", f"WITH k AS ({KEYED}) SELECT kind, count(*) AS n, sum(rune_e8)::BIGINT AS rune_e8 FROM k GROUP BY 1")
def str4(spark, d):
    return views.kind_totals(keyed_events(spark, d))


from poolscope import catalog_events, catalog_stores, catalog_types, catalog_views  # noqa: E402, F401 - they register more queries
