"""Declarative aggregates with rollups.

An Aggregate lists keys and measures of a source table. Every measure has a partial and a merge form, so that partial
results of any time slices combine: five-minute, hour and day rollups come from the source, calendar rollups from the
day rollup, and a range that meets no bucket edge from raw ends and an hourly middle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.functions.numeric import NANOS
from poolscope.operators.buckets import EXACT, HOUR, Buckets, bucket_start


@dataclass(frozen=True)
class Measure:
    """One result column: kind is sum, last, first, min or max; value is over the source's columns."""

    name: str
    kind: str
    value: Column


@dataclass
class Aggregate:
    """Keys and measures over a source with block_timestamp; event_idx, where present, breaks ties of first and last."""

    name: str
    keys: list[str]
    measures: list[Measure] = field(default_factory=list)

    def add(self, name: str, kind: str, value: Column | None = None) -> Aggregate:
        self.measures.append(Measure(name, kind, F.col(name) if value is None else value))
        return self

    def sum(self, name: str, value: Column | None = None) -> Aggregate:
        return self.add(name, "sum", value)

    def last(self, name: str, value: Column | None = None) -> Aggregate:
        return self.add(name, "last", value)

    def first(self, name: str, value: Column | None = None) -> Aggregate:
        return self.add(name, "first", value)

    def min(self, name: str, value: Column | None = None) -> Aggregate:
        return self.add(name, "min", value)

    def max(self, name: str, value: Column | None = None) -> Aggregate:
        return self.add(name, "max", value)

    def _order(self, source: DataFrame) -> Column:
        tie = F.col("event_idx") if "event_idx" in source.columns else F.lit(0).cast("long")
        return F.struct(F.col("block_timestamp").alias("t"), tie.alias("i"))

    def partial(self, source: DataFrame, start: Column) -> DataFrame:
        """Rows of the source to (start_s, keys, measures); first and last are structs that carry their time."""
        order, out = self._order(source), []
        for m in self.measures:
            if m.kind in ("last", "first"):
                pair = F.struct(order.alias("at"), m.value.alias("v"))
                out.append((F.max if m.kind == "last" else F.min)(pair).alias(m.name))
            else:
                out.append({"sum": F.sum, "min": F.min, "max": F.max}[m.kind](m.value).alias(m.name))
        return source.groupBy(start.alias("start_s"), *self.keys).agg(*out)

    def merge(self, partials: DataFrame, start: Column) -> DataFrame:
        """Partial results to coarser partial results."""
        out = []
        for m in self.measures:
            how = {"sum": F.sum, "min": F.min, "max": F.max, "last": F.max, "first": F.min}[m.kind]
            out.append(how(m.name).alias(m.name))
        return partials.groupBy(start.alias("start_s"), *self.keys).agg(*out)

    def final(self, partials: DataFrame) -> DataFrame:
        shown = [F.col(m.name)["v"].alias(m.name) if m.kind in ("last", "first") else F.col(m.name) for m in self.measures]
        return partials.select("start_s", *self.keys, *shown)

    def rollup(self, source: DataFrame, interval: str, compat_calendar: bool = False) -> DataFrame:
        """Partial results per interval. Calendar intervals merge days.

        With compat_calendar, first, min and max of a calendar interval are taken over the days' last values of the
        column that each measure names, as the system whose semantics this follows does.
        """
        if interval in EXACT:
            return self.partial(source, bucket_start(F.col("block_timestamp"), interval))
        days = self.partial(source, bucket_start(F.col("block_timestamp"), "day"))
        if compat_calendar:
            closes = [m for m in self.measures if m.kind == "last"]
            if closes:
                close = F.col(closes[0].name)
                for m in self.measures:
                    if m.kind == "first":
                        days = days.withColumn(m.name, close)
                    elif m.kind in ("min", "max"):
                        days = days.withColumn(m.name, close["v"])
        return self.merge(days, bucket_start(F.col("start_s") * NANOS, interval))

    def between(self, source: DataFrame, start_ns: int, end_ns: int, hourly: DataFrame | None = None) -> DataFrame:
        """One partial row per key for an arbitrary range: raw up to the first full hour, hours, raw after the last."""
        t, width = F.col("block_timestamp"), HOUR * NANOS
        start = F.lit(start_ns // NANOS).cast("long")
        low, high = -(-start_ns // width) * width, end_ns // width * width
        if low >= high:
            return self.partial(source.filter((t >= start_ns) & (t < end_ns)), start)
        if hourly is None:
            hourly = self.rollup(source.filter((t >= low) & (t < high)), "hour")
        s = F.col("start_s")
        parts = self.partial(source.filter((t >= start_ns) & (t < low)), start)
        parts = parts.unionByName(self.partial(source.filter((t >= high) & (t < end_ns)), start))
        body = hourly.filter((s >= low // NANOS) & (s < high // NANOS)).withColumn("start_s", start)
        return self.merge(parts.unionByName(body.select(parts.columns)), start)

    def query(self, source: DataFrame, buckets: Buckets, rollups: dict[str, DataFrame] | None = None, **options) -> DataFrame:
        """Final rows (start_s, keys, measures) of the buckets; rollups holds stored partial results by interval."""
        rollups = rollups or {}
        if buckets.interval is None:
            return self.final(self.between(source, buckets.start * NANOS, buckets.end * NANOS, rollups.get("hour")))
        s = F.col("start_s")
        stored = rollups.get(buckets.interval)
        if stored is None:
            stored = self.rollup(source.filter(buckets.holds(F.col("block_timestamp"))), buckets.interval, **options)
        return self.final(stored.filter((s >= buckets.start) & (s < buckets.end)))

    def explain(self, source: DataFrame, buckets: Buckets) -> DataFrame:
        """The physical plan of a bucketed query, as one row of text."""
        name = f"__explained_{self.name}"
        self.query(source, buckets).createOrReplaceTempView(name)
        try:
            return source.sparkSession.sql(f"EXPLAIN FORMATTED SELECT * FROM {name}")
        finally:
            source.sparkSession.catalog.dropTempView(name)
