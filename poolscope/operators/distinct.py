"""Exact distinct counts that roll up: numbered values, and bitmaps of their numbers by slice of time.

A dictionary gives every value a number once; numbers are dense within what one task numbered. A slice keeps, for every
32,768 numbers of which it holds any, one bitmap. Slices of any range merge by OR, so a range reads raw rows for its two
ends only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.sources.commits import DAY_NANOS, CommitLog


class DistinctStore:
    """Distinct values of a column of a table in time, kept as bitmaps by day under a commit log."""

    def __init__(self, log: CommitLog, name: str, value: Column):
        self.log, self.value = log, value
        self.numbers, self.bitmaps = f"{name}_numbers", f"{name}_bitmaps"
        self.tables = (self.numbers, self.bitmaps)

    def _known(self) -> DataFrame | None:
        return self.log.read_parts(self.numbers, self.log.parts(self.numbers)) if self.log.parts(self.numbers) else None

    def append(self, rows: DataFrame, epoch: str | None = None) -> bool:
        """Count a batch of rows; days may come in any order and more than once. Null values aren't counted."""
        if epoch is not None and epoch in self.log.epochs:
            return False
        named = rows.select(self.value.cast("string").alias("value"), F.col("block_timestamp")).filter("value is not null")
        fresh, known = named.select("value").distinct(), self._known()
        least = 0
        if known is not None:
            fresh = fresh.join(known, "value", "left_anti")
            least = (known.agg(F.max("number")).first()[0] + 1 + 32_767) // 32_768 * 32_768
        add = self.log.stage(self.numbers, fresh.select("value", (F.monotonically_increasing_id() + least).alias("number")), F.lit(0))
        written = [p.path for p in add if p.rows]
        numbers = self.log.spark.read.schema(add[0].schema_type()).parquet(*written) if written else known
        if numbers is not None:
            numbers = numbers if known is None or not written else numbers.unionByName(known)
            day = F.call_function("div", F.col("block_timestamp"), F.lit(DAY_NANOS)).alias("day")
            add += self.log.stage(self.bitmaps, bitmaps(named.select("value", day), numbers, ["day"]), self.log.slice_of(F.col("day") * DAY_NANOS))
        self.log.commit(add, epoch=epoch)
        return True

    def count(self, rows: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
        """The number of distinct values in [start, end), in one row; `rows` is the raw table, read for parts of days only."""
        t = F.col("block_timestamp")
        low, high = -(-start_ns // DAY_NANOS), end_ns // DAY_NANOS
        known = self._known()
        if low >= high or known is None:
            return rows.filter((t >= start_ns) & (t < end_ns)).agg(F.count_distinct(self.value).alias("n"))
        width = self.log.days
        parts = self.log.parts(self.bitmaps, low // width, (high - 1) // width)
        whole = self.log.read_parts(self.bitmaps, parts).filter((F.col("day") >= low) & (F.col("day") < high)).select("bucket", "bits")
        ends = rows.filter(((t >= start_ns) & (t < low * DAY_NANOS)) | ((t >= high * DAY_NANOS) & (t < end_ns)))
        ends = bitmaps(ends.select(self.value.cast("string").alias("value")).filter("value is not null"), known, [])
        merged = whole.unionByName(ends.select("bucket", "bits")).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return merged.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def bitmaps(rows: DataFrame, numbers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, bits) of the numbers of the rows' values."""
    numbered = rows.distinct().join(numbers, "value").select(*keys, "number")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    return numbered.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket")).agg(bits)
