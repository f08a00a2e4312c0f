"""As-of lookups, gap filling and time-weighted averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.functions.numeric import NANOS
from poolscope.operators.buckets import Buckets


def as_of(table: DataFrame, keys: list[str], moment: int | Column, values: list[str], inclusive: bool = True) -> DataFrame:
    """Newest row of each key at (or before) a moment; a partial aggregate, so only one row per key is shuffled a task."""
    t = F.col("block_timestamp")
    order = F.struct(t, F.col("event_idx")) if "event_idx" in table.columns else t
    rows = table.filter(t <= moment if inclusive else t < moment)
    return rows.groupBy(*keys).agg(F.max_by(F.struct("block_timestamp", *values), order).alias("r")).select(*keys, "r.*")


#: Length of the slices of time in which running values are ordered.
SLICE_NANOS = 86_400 * NANOS


def running(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    reset: Column | None = None,
    steady: list[str] | None = None,
    slice_nanos: int = SLICE_NANOS,
) -> DataFrame:
    """Replace values by their running sums per key in order of time; a row where reset holds starts the sums anew after it.

    steady are values whose sums run on over resets.

    Rows are ordered within slices of time only, and what is carried from slice to slice is one row each, so a hot key
    is spread over as many tasks as it has slices. Adds slice, and opening: the struct of sums at the slice's start.
    order starts with block_timestamp.
    """
    marks = rows.withColumn("slice", F.call_function("div", F.col("block_timestamp"), F.lit(slice_nanos)))
    inner = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(reset.cast("long"), F.lit(0)) if reset is not None else F.lit(0).cast("long")
    marks = marks.withColumn("__life", F.sum(hit).over(inner) if reset is not None else hit)
    life = Window.partitionBy(*keys, "slice", "__life").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    anew = (hit == 1) if reset is not None else F.lit(False)
    steady = steady or []
    sums = {v: F.sum(F.when(anew, 0).otherwise(F.coalesce(v, F.lit(0)))).over(life).cast("long") for v in values}
    marks = marks.withColumns(sums | {v: F.sum(F.coalesce(v, F.lit(0))).over(inner).cast("long") for v in steady})
    ends = marks.groupBy(*keys, "slice").agg(F.max_by(F.struct("__life", *values, *steady), F.struct(*order)).alias("e"))
    ends = ends.select(*keys, "slice", "e.*")
    upto = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("__age", F.sum("__life").over(upto))
    aged = Window.partitionBy(*keys, "__age").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    totals = [F.sum(v).over(aged).cast("long").alias(v) for v in values] + [F.sum(v).over(upto).cast("long").alias(v) for v in steady]
    closing = ends.select(*keys, "slice", F.struct(*totals).alias("c"))
    before = F.lag("c").over(Window.partitionBy(*keys).orderBy("slice"))
    zero = F.struct(*[F.lit(0).cast("long").alias(v) for v in [*values, *steady]])
    opening = closing.select(*keys, "slice", F.coalesce(before, zero).alias("opening"))
    joined = marks.join(opening, [*keys, "slice"])
    carried = {v: F.col(v) + F.when(F.col("__life") == 0, F.col("opening")[v]).otherwise(0) for v in values}
    carried |= {v: F.col(v) + F.col("opening")[v] for v in steady}
    return joined.withColumns(carried).drop("__life")


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Each row with the value of the row before it, per key in order of time; ordered within slices of time only."""
    marked = rows.withColumn("__slice", F.call_function("div", F.col("block_timestamp"), F.lit(SLICE_NANOS))).withColumn("__v", F.struct(F.col(value).alias("v")))
    ends = marked.groupBy(*keys, "__slice").agg(F.max_by("__v", F.struct(*order)).alias("__end"))
    opening = ends.select(*keys, "__slice", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__slice")).alias("__open"))
    before = F.lag("__v").over(Window.partitionBy(*keys, "__slice").orderBy(*order))
    joined = marked.withColumn("__v", before).join(opening, [*keys, "__slice"])
    return joined.select(*rows.columns, F.coalesce("__v", "__open")["v"].alias(name))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the newest right values at or before its block_timestamp (strict: before it), per key; no range join.

    Rows are ordered within slices of time; from slice to slice one row a key is carried.
    """
    marked = left.withColumn("__left", F.lit(True)).withColumn("__v", F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema[0].dataType))
    other = right.select(*keys, "block_timestamp", F.struct(*values).alias("__v")).withColumn("__left", F.lit(False))
    both = marked.unionByName(other, allowMissingColumns=True)
    both = both.withColumn("__slice", F.call_function("div", F.col("block_timestamp"), F.lit(SLICE_NANOS)))
    inner = Window.partitionBy(*keys, "__slice").orderBy("block_timestamp", F.desc("__left") if strict else "__left").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(*keys, "__slice").agg(F.max_by("__v", F.when(~F.col("__left"), F.col("block_timestamp"))).alias("__end"))
    older = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = ends.select(*keys, "__slice", F.last("__end", ignorenulls=True).over(older).alias("__open"))
    filled = both.withColumn("__v", F.last("__v", ignorenulls=True).over(inner)).filter("__left").join(opening, [*keys, "__slice"])
    filled = filled.withColumn("__v", F.coalesce("__v", "__open"))
    return filled.select(*left.columns, *[F.col("__v")[v].alias(v) for v in values])


def every_bucket(keys: DataFrame, buckets: Buckets) -> DataFrame:
    """Each key row once per bucket: (start_s, end_s, keys)."""
    edges = F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in zip(buckets.timestamps, buckets.timestamps[1:])])
    spread = keys.withColumn("__b", F.explode(edges))
    return spread.select(F.col("__b.s").cast("long").alias("start_s"), F.col("__b.e").cast("long").alias("end_s"), *keys.columns)


def locf(series: DataFrame, seed: DataFrame, buckets: Buckets, keys: list[str], values: list[str]) -> DataFrame:
    """Last value of each bucket and key, carried forward over empty buckets, seeded by the values before the range.

    series: (start_s, keys, values), one row per bucket that has any; seed: (keys, values). Keys of either appear in
    every bucket, with nulls before their first value.
    """
    names = series.select(*keys).unionByName(seed.select(*keys)).distinct()
    grid = every_bucket(names, buckets)
    packed = series.select("start_s", *keys, F.struct(*values).alias("v"))
    before = seed.select(*keys, F.struct(*values).alias("seed"))
    rows = grid.join(packed, ["start_s", *keys], "left").join(before, keys, "left")
    order = Window.partitionBy(*keys).orderBy("start_s").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("v", F.coalesce(F.last("v", ignorenulls=True).over(order), F.col("seed")))
    return filled.select("start_s", "end_s", *keys, "v.*")


def zero_fill(sums: DataFrame, buckets: Buckets, values: list[str], keys: DataFrame | None = None) -> DataFrame:
    """Sums of every bucket (of each key row), zero where there is none."""
    grid = buckets.frame(sums.sparkSession).drop("idx")
    names: list[str] = []
    if keys is not None:
        names = keys.columns
        grid = every_bucket(keys, buckets)
    joined = grid.join(sums, ["start_s", *names], "left")
    return joined.select("start_s", "end_s", *names, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def running_total(changes: DataFrame, before: DataFrame, buckets: Buckets, value: str, keys: list[str]) -> DataFrame:
    """Total at the end of each bucket: the total before the range plus the bucket changes so far.

    changes: (start_s, keys, value); before: (keys, value).
    """
    names = changes.select(*keys).unionByName(before.select(*keys)).distinct()
    dense = zero_fill(changes, buckets, [value], names)
    upto = Window.partitionBy(*keys).orderBy("start_s").rowsBetween(Window.unboundedPreceding, 0)
    seeded = dense.join(before.withColumnRenamed(value, "__seed"), keys, "left")
    total = F.sum(value).over(upto) + F.coalesce("__seed", F.lit(0))
    return seeded.withColumn(value, total).drop("__seed")


def weighted_average(deltas: DataFrame, at_start: int | Column, buckets: Buckets) -> DataFrame:
    """Time-weighted sum and average of a counter per bucket.

    deltas: (block_timestamp, delta) of changes inside the range; at_start is the counter at the range's start. A change
    counts from its whole second to the bucket's end, and the count at a bucket's start for its whole length, so one sum
    per bucket does and no order within buckets is needed.
    """
    t = F.col("block_timestamp")
    inside = deltas.filter((t > buckets.start * NANOS) & (t < buckets.end * NANOS))
    second = F.call_function("div", t, F.lit(NANOS))
    sums = inside.groupBy(buckets.start_of(t).alias("start_s")).agg(F.sum("delta").alias("delta"), F.sum(F.col("delta") * second).alias("moment"))
    dense = zero_fill(sums, buckets, ["delta", "moment"])
    earlier = Window.orderBy("start_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    base = F.coalesce(F.sum("delta").over(earlier), F.lit(0)) + at_start
    weighted = base * (F.col("end_s") - F.col("start_s")) + F.col("delta") * F.col("end_s") - F.col("moment")
    sums = dense.select("start_s", "end_s", weighted.alias("weighted_sum"))
    return sums.withColumn("average", F.col("weighted_sum") / (F.col("end_s") - F.col("start_s")))
