"""One transaction over many tables.

Rows are staged as Parquet under names that nobody reads. A commit is one small file that names the parts (a table's
files of one key, such as a day) that come and go; readers resolve the newest commit, so a flush of all tables, views
and dead letters is seen whole or not at all. Parts are never changed in place: an update or a trim writes new parts
and drops the old ones in the same commit. Every BASE_EVERY commits the whole list is written, so that opening a log
doesn't read all its history. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import NamedTuple, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_NANOS = 86_400 * 10**9
BASE_EVERY = 16
#: A key with more parts than this is merged by compact().
MOST_PARTS = 8
#: So many tables are staged at the same time.
AT_ONCE = 4
#: Whether the shuffle files of a query go when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOG = "action string, table string, key long, folder string, rows long, least long, most long, schema string, epoch string"


@contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries within leave no shuffle files, so that of a long run of writes only one a time takes disk."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Part(NamedTuple):
    """A table's files of one key, a slice of time unless the table is kept otherwise: where they are, their rows, and the least and greatest block_timestamp."""

    table: str
    key: int
    folder: str
    rows: int
    least: int | None
    most: int | None
    schema: str

    @property
    def path(self) -> str:
        return f"{self.folder}/key={self.key}"

    def schema_type(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class View(Protocol):
    """What is kept beside event tables and follows from them."""

    tables: tuple[str, ...]

    def trimmed(self, timestamp: int) -> tuple[list[Part], list[Part]]:
        """Parts to add and to remove so that the view is as it was before the events at or after a time."""


class CommitLog:
    """The tables under a folder, as of the newest commit when it was opened or last refreshed.

    A part of a table in time holds `days` days; it should have enough rows for a file.
    """

    def __init__(self, spark: SparkSession, path: str, days: int = 1):
        self.spark, self.path, self.days = spark, path, days
        self.refresh()

    def slice_of(self, t: Column) -> Column:
        return F.call_function("div", t, F.lit(self.days * DAY_NANOS))

    def refresh(self) -> CommitLog:
        commits = self._commits()
        self.version, self.live, self.epochs = 0, {}, set()
        if commits is None:
            return self
        seen = sorted((r["version"], r["base"]) for r in commits.select("version", "base").distinct().collect())
        base = max((v for v, whole in seen if whole), default=0)
        rows = commits.filter(F.col("version") >= base).collect()
        for r in sorted(rows, key=lambda r: (r["version"], r["action"] != "remove")):
            if r["version"] == base and not r["base"]:
                continue
            part = Part(r["table"], r["key"], r["folder"], r["rows"], r["least"], r["most"], r["schema"])
            if r["action"] == "epoch":
                self.epochs.add(r["epoch"])
            elif r["action"] == "forget":
                self.epochs.clear()
            elif r["action"] == "remove":
                self.live.pop((part.table, part.path), None)
            elif r["action"] == "add":
                self.live[part.table, part.path] = part
        self.version = seen[-1][0]
        return self

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{LOG}, version long, base boolean").parquet(f"{self.path}/commits")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def parts(self, table: str, low: int | None = None, high: int | None = None) -> list[Part]:
        """The table's parts with rows and keys from low to high, newest key first."""
        found = [p for p in self.live.values() if p.table == table and p.rows]
        found = [p for p in found if (low is None or p.key >= low) and (high is None or p.key <= high)]
        return sorted(found, key=lambda p: (-p.key, p.folder))

    def stage(self, table: str, rows: DataFrame, key: Column | None = None, order: list | None = None, bloom: str | None = None, shape: Callable[[DataFrame], DataFrame] | None = None, exchange: bool = True) -> list[Part]:
        """Write rows by key (the slice of time unless given) without making them visible. Large keys are spread over several files.

        shape makes the rows that are stored of those that are exchanged, one by one. Without exchange, rows are written by the
        task that has them: a key has up to as many files as there are tasks.
        """
        with clean_shuffles(self.spark):
            return self._stage(table, rows, key, order, bloom, shape, exchange)

    def _stage(self, table, rows, key, order, bloom, shape, exchange) -> list[Part]:
        folder = f"{self.path}/data/{table}/{uuid.uuid4().hex}"
        keyed = rows.withColumn("key", (self.slice_of(F.col("block_timestamp")) if key is None else key).cast("long"))
        keyed = (keyed.hint("rebalance", "key") if exchange else keyed).sortWithinPartitions("key", *(order or []))
        if shape:
            keyed = shape(keyed)
            rows = keyed.drop("key")
        writer = keyed.write.partitionBy("key")
        if bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")  # as large as its values need
        writer.parquet(folder)
        time = F.col("block_timestamp") if "block_timestamp" in rows.columns else F.lit(None).cast("long")
        written = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())])).parquet(folder)
        counts = written.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("least"), F.max(time).alias("most")).collect()
        schema = rows.schema.json()
        parts = [Part(table, r["key"], folder, r["rows"], r["least"], r["most"], schema) for r in counts]
        return parts or [Part(table, 0, folder, 0, None, None, schema)]  # an empty part still tells the columns

    def stage_all(self, tables: Mapping[str, DataFrame]) -> list[Part]:
        """Stage tables in time, several at once."""
        with clean_shuffles(self.spark), ThreadPoolExecutor(AT_ONCE) as pool:
            return [p for parts in pool.map(lambda table: self.stage(*table), tables.items()) for p in parts]

    def commit(self, add: Iterable[Part] = (), remove: Iterable[Part] = (), epoch: str | None = None, forget: bool = False) -> int:
        """Make parts visible and invisible, together. Fails if another commit came in between.

        An epoch that is named counts as done; forget takes back all that were.
        """
        version, none = self.version + 1, [None] * 7
        rows = [("add", *p, None) for p in add] + [("remove", *p, None) for p in remove]
        rows += [("forget", *none, None)] if forget else []
        rows += [("epoch", *none, epoch)] if epoch is not None else []
        self._publish(rows, version, base=False)
        self.refresh()
        if version % BASE_EVERY == 0:
            whole = [("add", *p, None) for p in self.live.values()] + [("epoch", *none, e) for e in sorted(self.epochs)]
            self._publish(whole, version, base=True)
        return version

    def _publish(self, rows: list[tuple], version: int, base: bool) -> None:
        manifest = self.spark.createDataFrame(rows or [("none", *[None] * 8)], LOG).coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.path}/commits/version={version}/base={str(base).lower()}")

    def flush(self, tables: Mapping[str, DataFrame], epoch: str | None = None) -> bool:
        """Append rows to many tables in one commit; an epoch that is already there changes nothing."""
        if epoch is not None and epoch in self.epochs:
            return False
        self.commit(self.stage_all(tables), epoch=epoch)
        return True

    def schema(self, table: str) -> T.StructType:
        part = next((p for p in self.live.values() if p.table == table), None)
        if part is None:
            raise KeyError(f"no commit holds a table called {table}")
        return part.schema_type()

    def read_parts(self, table: str, parts: Iterable[Part], files: Iterable[str] = ()) -> DataFrame:
        """The rows of some parts, or of some of their files."""
        schema = self.schema(table)
        paths = [*(p.path for p in parts), *files]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, table: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        """A table in time, limited to [start, end): parts without rows there aren't opened."""
        parts = [p for p in self.parts(table) if (start_ns is None or p.most is None or p.most >= start_ns) and (end_ns is None or p.least is None or p.least < end_ns)]
        rows, t = self.read_parts(table, parts), F.col("block_timestamp")
        rows = rows if start_ns is None else rows.filter(t >= start_ns)
        return rows if end_ns is None else rows.filter(t < end_ns)

    def trim(self, timestamp: int, views: Iterable[View] = ()) -> int:
        """Delete all rows at or after a time from every table in time and bring the views back to it, in one commit.

        Parts that lie wholly after are dropped, those that hold the time are written anew without its later rows. Epochs
        may come again.
        """
        views = list(views)
        derived = {table for view in views for table in view.tables}
        add, remove, cut = [], [], {}
        for table in sorted({p.table for p in self.live.values()} - derived):
            if "block_timestamp" not in self.schema(table).names:
                continue
            late = [p for p in self.parts(table) if p.most >= timestamp]
            kept = [p for p in late if p.least < timestamp]
            if kept:
                cut[table] = self.read_parts(table, kept).filter(F.col("block_timestamp") < timestamp)
            elif late and len(late) == len(self.parts(table)):
                add.append(late[0]._replace(key=0, rows=0, least=None, most=None))  # tells the columns of an empty table
            remove += late
        with clean_shuffles(self.spark), ThreadPoolExecutor(1) as pool:
            beside = pool.submit(self.stage_all, cut)
            for view in views:
                more, less = view.trimmed(timestamp)
                add, remove = add + more, remove + less
            add += beside.result()
        return self.commit(add, remove, forget=True)

    def compact(self, table: str, order: list | None = None, bloom: str | None = None) -> int:
        """Merge the parts of keys that have many, so that readers open fewer files. Returns the number of merged parts."""
        by_key: dict[int, list[Part]] = {}
        for p in self.parts(table):
            by_key.setdefault(p.key, []).append(p)
        many = [p for parts in by_key.values() if len(parts) > MOST_PARTS for p in parts]
        if many:
            key = F.regexp_extract("_metadata.file_path", r"/key=(-?\d+)/[^/]*$", 1)
            self.commit(self.stage(table, self.read_parts(table, many), key, order, bloom), many)
        return len(many)
