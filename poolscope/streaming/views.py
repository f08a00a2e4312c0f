"""Incremental views and stateful streams.

Input is totally ordered by (height, event_idx), so state is keyed by pool and old indexes are dropped; event-time
watermarks only bound state where a query asks for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from poolscope.functions.numeric import NANOS
from poolscope.operators.rollup import Aggregate

DAY_NANOS = 86_400 * NANOS


class WatermarkedView:
    """A table of results up to a watermark, read together with the live tail.

    build(source) must map rows to rows or to results of time slices that never meet. Refreshing is idempotent: a slice
    is written under its own bounds, and only slices up to the recorded watermark are read.
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.build = spark, path, build

    def watermark(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/watermark").agg(F.max("watermark")).first()[0] or 0
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return 0
            raise

    def refresh(self, source: DataFrame, until: int) -> None:
        """Materialise [watermark, until); going backwards is refused."""
        low = self.watermark()
        if until < low:
            raise ValueError(f"the view is materialised up to {low}; {until} lies before it")
        if until == low:
            return
        t = F.col("block_timestamp")
        self.build(source.filter((t >= low) & (t < until))).write.mode("overwrite").parquet(f"{self.path}/data/slice={low}-{until}")
        mark = self.spark.createDataFrame([(until, f"{low}-{until}")], "watermark long, slice string")
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/watermark")

    def read(self, source: DataFrame) -> DataFrame:
        low = self.watermark()
        live = self.build(source.filter(F.col("block_timestamp") >= low))
        if not low:
            return live
        slices = [r["slice"] for r in self.spark.read.parquet(f"{self.path}/watermark").select("slice").distinct().collect()]
        stored = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/slice={s}" for s in slices])
        return stored.drop("slice").select(live.columns).unionByName(live)


def refresh_rollup(source: DataFrame, aggregate: Aggregate, path: str, changed_from_ns: int = 0) -> None:
    """Recompute the day partitions of a five-minute rollup from a time on, and overwrite only those."""
    first = changed_from_ns // DAY_NANOS
    rows = source.filter(F.col("block_timestamp") >= first * DAY_NANOS)
    day = F.call_function("div", F.col("start_s"), F.lit(86_400))
    rollup = aggregate.rollup(rows, "5min").withColumn("day", day)
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rollup.repartition(n, "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def coarser(rollup: DataFrame, aggregate: Aggregate, interval: str) -> DataFrame:
    """A stored rollup merged to a longer interval."""
    from poolscope.operators.buckets import bucket_start

    return aggregate.merge(rollup, bucket_start(F.col("start_s") * NANOS, interval))


def stream_tables(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, decode: Callable[[DataFrame], dict[str, DataFrame]]):
    """Decode a stream of events and hand each micro-batch's tables to their sinks; one pass over what has arrived."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        try:
            tables = decode(rows)
            for name, handle in handlers.items():
                handle(tables[name], epoch)
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: a repeated epoch replaces its own rows."""

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def pool_events(events: DataFrame) -> DataFrame:
    """Events re-keyed by pool: rewards are split into one per pool; (pool, kind, asset_e8, rune_e8, height, event_idx)."""
    pool = F.filter("attributes", lambda a: a["key"].isin("pool", "asset"))[0]["value"]
    get = lambda k: F.coalesce(F.try_element_at(F.filter("attributes", lambda a: a["key"] == k), F.lit(-1))["value"].try_cast("long"), F.lit(0))
    single = F.array(F.struct(pool.alias("pool"), get("asset_amount").alias("asset_e8"), get("rune_amount").alias("rune_e8")))
    split = F.transform(
        F.filter("attributes", lambda a: a["key"] != "bond_reward"),
        lambda a: F.struct(a["key"].alias("pool"), F.lit(0).cast("long").alias("asset_e8"), F.coalesce(a["value"].try_cast("long"), F.lit(0)).alias("rune_e8")),
    )
    parts = F.explode(F.when(F.col("type") == "rewards", split).otherwise(single))
    rows = events.select(F.col("type").alias("kind"), "height", "event_idx", parts.alias("p"))
    return rows.select("p.pool", "kind", "p.asset_e8", "p.rune_e8", "height", "event_idx").filter("pool is not null")


POOL_STATE = "n long, asset_e8 long, rune_e8 long, height long, event_idx long"
POOL_STATS = f"pool string, {POOL_STATE}"


def fold_pool(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts and balances of a pool; events at or before the last index seen are dropped."""
    n, asset, rune, height, idx = state.get if state.exists else (0, 0, 0, -1, -1)
    rows = pd.concat(list(batches)).sort_values(["height", "event_idx"])
    fresh = rows[(rows["height"] > height) | ((rows["height"] == height) & (rows["event_idx"] > idx))]
    fresh = fresh.drop_duplicates(["height", "event_idx"])
    if len(fresh):
        last = fresh.iloc[-1]
        n, asset, rune = n + len(fresh), asset + int(fresh["asset_e8"].sum()), rune + int(fresh["rune_e8"].sum())
        height, idx = int(last["height"]), int(last["event_idx"])
    state.update((n, asset, rune, height, idx))
    yield pd.DataFrame([(key[0], n, asset, rune, height, idx)], columns=["pool", "n", "asset_e8", "rune_e8", "height", "event_idx"])


def pool_stats_stream(keyed: DataFrame) -> DataFrame:
    """Running state of every pool as an update stream; on a batch DataFrame, use pool_stats_batch."""
    return keyed.groupBy("pool").applyInPandasWithState(fold_pool, POOL_STATS, POOL_STATE, "update", GroupStateTimeout.NoTimeout)


def pool_stats_batch(keyed: DataFrame) -> DataFrame:
    """The same as one aggregate."""
    rows = keyed.dropDuplicates(["pool", "height", "event_idx"])
    last = F.max(F.struct("height", "event_idx"))
    out = rows.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n"), F.sum("asset_e8").alias("asset_e8"), F.sum("rune_e8").alias("rune_e8"), last.alias("l")
    )
    return out.select("pool", "n", "asset_e8", "rune_e8", "l.height", "l.event_idx")


def kind_totals(keyed: DataFrame) -> DataFrame:
    """Second-level aggregate by kind of event; works on batches and streams."""
    return keyed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("rune_e8").alias("rune_e8"))


def price_updates(depths: DataFrame, send: Callable[[list], None], checkpoint: str):
    """Push the newest price of each pool in every micro-batch; bursts between triggers are sent once."""
    from poolscope.functions.pricing import asset_price

    def batch(rows: DataFrame, epoch: int) -> None:
        newest = rows.groupBy("pool").agg(F.max_by(F.struct("asset_e8", "rune_e8"), "block_timestamp").alias("d"))
        prices = newest.select("pool", asset_price(F.col("d.asset_e8"), F.col("d.rune_e8")).alias("price"))
        send([(r["pool"], r["price"]) for r in prices.toLocalIterator()])

    return depths.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_views(events: DataFrame, decode: Callable[[DataFrame], dict[str, DataFrame]], path: str, views: dict[str, WatermarkedView], checkpoint: str):
    """Append the tables of every micro-batch under path, and bring each table's view up to the batch's newest block.

    views names a table's view. The stream must come in order of blocks, with whole blocks; a repeated batch replaces
    its own rows and leaves views that are already there.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        rows = rows.persist()
        try:
            newest = rows.agg(F.max("block_timestamp")).first()[0]
            if newest is None:
                return
            tables = decode(rows)
            for name, view in views.items():
                append_once(f"{path}/{name}")(tables[name], epoch)
                if view.watermark() <= newest:
                    view.refresh(rows.sparkSession.read.parquet(f"{path}/{name}").drop("epoch"), newest + 1)
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
