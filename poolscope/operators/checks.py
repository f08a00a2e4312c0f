"""Consistency checks between states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_diff(ours: DataFrame, theirs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose values differ or that one side lacks; columns carry both sides."""
    a = ours.select(*keys, *[F.col(v).alias(f"our_{v}") for v in values], F.lit(True).alias("__a"))
    b = theirs.select(*keys, *[F.col(v).alias(f"their_{v}") for v in values], F.lit(True).alias("__b"))
    joined = a.join(b, keys, "full_outer")
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    for v in values:
        same = same & F.col(f"our_{v}").eqNullSafe(F.col(f"their_{v}"))
    return joined.filter(~same).drop("__a", "__b")


def first_divergence(ours: DataFrame, theirs: DataFrame, keys: list[str], values: list[str], order: str = "height") -> DataFrame:
    """Smallest order value of each key at which two histories differ: one pass instead of a search."""
    diff = state_diff(ours, theirs, [order, *keys], values)
    return diff.groupBy(*keys).agg(F.min(order).alias(f"first_{order}"))


#: Children of a node of a digest tree, and its levels above the leaves.
FAN, LEVELS = 16, 4


def digest_tree(history: DataFrame, keys: list[str], values: list[str], leaf: int, order: str = "height") -> DataFrame:
    """(level, keys, node, n, sum) of a history: for every key a tree over slices of `leaf` heights.

    A node's digest is the number of its rows and the sum of their hashes, so neither the order of rows nor their
    partitions matter, and a parent is the sum of its children. Level 0 are the leaves. Write it by level, sorted by node.
    """
    row = F.xxhash64(order, *keys, *values).cast("decimal(38,0)")
    node = F.call_function("div", F.col(order), F.lit(leaf))
    level = history.groupBy(*keys, node.alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum(row).cast("decimal(38,0)").alias("sum"))
    leaves, out = level, level.select(F.lit(0).alias("level"), "*")
    for k in range(1, LEVELS + 1):
        level = leaves.groupBy(*keys, F.call_function("div", F.col("node"), F.lit(FAN**k)).alias("node"))
        level = level.agg(F.sum("n").alias("n"), F.sum("sum").cast("decimal(38,0)").alias("sum"))
        out = out.unionByName(level.select(F.lit(k).alias("level"), "*"))
    return out


def write_tree(tree: DataFrame, path: str) -> None:
    tree.repartition("level").sortWithinPartitions("level", "node").write.partitionBy("level").parquet(path)


def first_divergence_by_tree(
    ours: DataFrame, theirs: DataFrame, our_tree: DataFrame, their_tree: DataFrame, keys: list[str], values: list[str], leaf: int, order: str = "height"
) -> DataFrame:
    """first_divergence, reading of the trees only children of the first differing node of each key, and of the histories
    only the slices below. Levels are compared from the top; a range of nodes, which scans can use, bounds each read.
    """
    spark, first = ours.sparkSession, f"first_{order}"
    found = None
    for level in range(LEVELS, -1, -1):
        a, b = (t.filter(F.col("level") == level) for t in (our_tree, their_tree))
        if found is not None:
            low, high = found.agg(F.min("node"), F.max("node")).first()
            above = found.withColumnRenamed("node", "parent")
            within = (F.col("node") >= low * FAN) & (F.col("node") < (high + 1) * FAN)
            a, b = (t.filter(within).withColumn("parent", F.call_function("div", F.col("node"), F.lit(FAN))).join(above, [*keys, "parent"], "left_semi") for t in (a, b))
        differing = state_diff(a, b, [*keys, "node"], ["n", "sum"]).groupBy(*keys).agg(F.min("node").alias("node"))
        rows = differing.collect()  # a row for each key that differs
        if not rows:
            return spark.createDataFrame([], differing.select(*keys, F.col("node").alias(first)).schema)
        found = spark.createDataFrame(rows, differing.schema)
    low, high = found.agg(F.min("node"), F.max("node")).first()
    within = (F.col(order) >= low * leaf) & (F.col(order) < (high + 1) * leaf)
    node = F.call_function("div", F.col(order), F.lit(leaf))
    a, b = (t.filter(within).withColumn("node", node).join(found, [*keys, "node"], "left_semi").drop("node") for t in (ours, theirs))
    return first_divergence(a, b, keys, values, order)


def corrections(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What must be added to our values to reach theirs."""
    diff = state_diff(ours, theirs, keys, [value])
    zero = F.lit(0)
    return diff.select(*keys, (F.coalesce(f"their_{value}", zero) - F.coalesce(f"our_{value}", zero)).alias("correction"))


def trimmed(table: DataFrame, timestamp: int) -> DataFrame:
    """The table without rows at or after a time."""
    return table.filter(F.col("block_timestamp") < timestamp)


def missing_heights(block_log: DataFrame) -> DataFrame:
    """Heights after which the next block is not the following one."""
    pairs = block_log.select(F.col("height").alias("height")).distinct()
    follows = block_log.select((F.col("height") - 1).alias("height")).distinct()
    last = block_log.agg(F.max("height").alias("last"))
    gaps = pairs.join(follows, "height", "left_anti")
    return gaps.join(F.broadcast(last)).filter("height < last").select("height")


def pool_events_in_block(tables: dict[str, DataFrame], pool: str, timestamp: int) -> DataFrame:
    """All rows of the event tables for a pool in a block, as (table, row as JSON)."""
    out = None
    for name, df in sorted(tables.items()):
        column = next((c for c in ("pool", "asset") if c in df.columns), None)
        if column is None:
            continue
        rows = df.filter((F.col(column) == pool) & (F.col("block_timestamp") == timestamp))
        rows = rows.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out
