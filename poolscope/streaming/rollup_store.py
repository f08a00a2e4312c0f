"""Stored rollups with a log of the buckets that new rows have made stale.

Rows and the five-minute buckets they fall into become visible in one commit. A refresh computes these buckets anew from
the rows of their slices of time, merges their hours and days, and leaves all other slices alone. Until then readers
take stale buckets from the rows, so an answer is the same before and after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.functions.numeric import NANOS
from poolscope.operators.buckets import bucket_start
from poolscope.operators.rollup import Aggregate
from poolscope.sources.commits import CommitLog, Part

INTERVALS = ("5min", "hour", "day")


class RollupStore:
    """The rollups of an aggregate over a table of the log."""

    def __init__(self, log: CommitLog, aggregate: Aggregate, source: str):
        self.log, self.aggregate, self.source = log, aggregate, source
        self.dirty = f"{source}_stale_{aggregate.name}"
        self.tables = (self.dirty, *(self._name(i) for i in INTERVALS))

    def _name(self, interval: str) -> str:
        return f"{self.source}_{self.aggregate.name}_{interval}"

    def _stage(self, interval: str, rows: DataFrame) -> list[Part]:
        return self.log.stage(self._name(interval), rows, self.log.slice_of(F.col("start_s") * NANOS), ["start_s", *self.aggregate.keys])

    def staged(self, rows: DataFrame) -> list[Part]:
        """The note of which buckets a batch of rows makes stale, to be committed with the rows."""
        start = bucket_start(F.col("block_timestamp"), "5min")
        return self.log.stage(self.dirty, rows.select(start.alias("start_s")).distinct(), self.log.slice_of(F.col("start_s") * NANOS))

    def append(self, rows: DataFrame, epoch: str | None = None) -> bool:
        """Add rows, early or late, to the source table."""
        if epoch is not None and epoch in self.log.epochs:
            return False
        self.log.commit(self.log.stage(self.source, rows) + self.staged(rows), epoch=epoch)
        return True

    def _stale(self) -> tuple[DataFrame, DataFrame, list[int]]:
        """The stale buckets, the rows of the source in them, and their slices."""
        parts = self.log.parts(self.dirty)
        slices = sorted({p.key for p in parts})
        stale = self.log.read_parts(self.dirty, parts).distinct()
        held = set(slices)
        rows = self.log.read_parts(self.source, [p for p in self.log.parts(self.source) if p.key in held])
        rows = rows.withColumn("__start", bucket_start(F.col("block_timestamp"), "5min"))
        return stale, rows.join(stale, F.col("__start") == F.col("start_s"), "left_semi").drop("__start"), slices

    def refresh(self) -> list[int]:
        """Bring the rollups up to date; returns the slices of time that were written anew."""
        noted = self.log.parts(self.dirty)
        if not noted:
            return []
        stale, rows, slices = self._stale()
        add, remove = self._rewritten(slices, stale, self.aggregate.rollup(rows, "5min"))
        self.log.commit(add, remove + noted)
        return slices

    def _rewritten(self, slices: list[int], stale: DataFrame, fresh: DataFrame) -> tuple[list[Part], list[Part]]:
        held = set(slices)
        of = lambda interval: [p for p in self.log.parts(self._name(interval)) if p.key in held]
        old = of("5min")
        if old:
            fresh = self.log.read_parts(self._name("5min"), old).join(stale, "start_s", "left_anti").unionByName(fresh)
        finest = self._stage("5min", fresh)
        add, remove, below = [*finest], [*old], finest
        for interval in INTERVALS[1:]:  # hours come from the five minutes of these slices, days from their hours
            if not any(p.rows for p in below):
                remove += of(interval)
                continue
            rows = self.log.spark.read.schema(below[0].schema_type()).parquet(*(p.path for p in below if p.rows))
            below = self._stage(interval, self.aggregate.merge(rows, bucket_start(F.col("start_s") * NANOS, interval)))
            remove += of(interval)
            add += below
        return add, remove

    def read(self, interval: str) -> DataFrame:
        """The rollup, with stale buckets computed from the rows."""
        name = self._name(interval)
        stored = self.log.read_parts(name, self.log.parts(name)) if any(p.table == name for p in self.log.live.values()) else None
        if not self.log.parts(self.dirty):
            return stored if stored is not None else self.aggregate.rollup(self.log.read(self.source), interval)
        stale, rows, slices = self._stale()
        fresh = self.aggregate.rollup(rows, "5min")
        if stored is None:
            return self.aggregate.merge(fresh, bucket_start(F.col("start_s") * NANOS, interval))
        if interval == "5min":
            return stored.join(stale, "start_s", "left_anti").unionByName(fresh)
        parents = stale.select(bucket_start(F.col("start_s") * NANOS, interval).alias("start_s")).distinct()
        finest = self._name("5min")
        held = set(slices)
        rest = self.log.read_parts(finest, [p for p in self.log.parts(finest) if p.key in held]).join(stale, "start_s", "left_anti")
        rest = rest.withColumn("__parent", bucket_start(F.col("start_s") * NANOS, interval))
        rest = rest.join(parents.withColumnRenamed("start_s", "__stale"), F.col("__parent") == F.col("__stale"), "left_semi").drop("__parent")
        again = self.aggregate.merge(rest.unionByName(fresh), bucket_start(F.col("start_s") * NANOS, interval))
        return stored.join(parents, "start_s", "left_anti").unionByName(again)

    def rollups(self) -> dict[str, DataFrame]:
        """For Aggregate.query."""
        return {interval: self.read(interval) for interval in INTERVALS}

    def trimmed(self, timestamp: int) -> tuple[list[Part], list[Part]]:
        """Slices after the time go; that which holds it loses its later buckets, and the one the time cuts is computed anew."""
        if self.log.parts(self.dirty):
            raise ValueError("refresh the rollups before a trim")
        at = timestamp // (self.log.days * 86_400 * NANOS)
        add, remove = [], [p for i in INTERVALS for p in self.log.parts(self._name(i), at + 1)]
        finest = self.log.parts(self._name("5min"), at, at)
        if finest:
            cut = timestamp // (300 * NANOS) * 300
            late = self.log.read_parts(self._name("5min"), finest).filter(F.col("start_s") >= cut).select("start_s").distinct()
            rows = self.log.read(self.source, cut * NANOS, timestamp)
            more, less = self._rewritten([at], late, self.aggregate.rollup(rows, "5min"))
            add, remove = add + more, remove + less
        return add, remove
