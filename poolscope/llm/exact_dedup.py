"""Exact deduplication by a stateful stream.

A digest table (digest, id, size, locator) is streamed through a keyed aggregate whose state is kept on disk by the
RocksDB state store and never expires. A digest's state holds the number of rows, the stable identifier of the row that
stays and the locator of its content: the file and the row in it. Rows whose digest was met more than once are hits:
their full normalised bytes are compared with the content at the locator, and rows that differ are regrouped by the
bytes themselves. With a state folder, the state and the contents outlive a run, and the next run streams only its own
rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.llm.common import WHITE_SPACE, delete_folder, materialize, new_folder

#: Disk-backed state; without fallocate, since many partitions with small stores would each reserve megabytes.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
DIGESTS = "text_sha256 string, doc_id long, n_points long, file string, row long"
#: Rows of a group that are compared with one copy of the content that stays.
GROUP_ROWS = 256


def normalised(text: str = "text"):
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), WHITE_SPACE, "")


def located(docs: DataFrame, folder: str | None) -> DataFrame:
    """(doc_id, text, file, row): each row with the place of its content.

    Rows of Parquet files stay where they are; those of other sources, and all if a folder is given, are written first.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    narrow = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if folder is None:
        try:
            return docs.select(*narrow, *place)
        except AnalysisException:
            return materialize(docs.select(*narrow), "dedup-contents").select("doc_id", "text", *place)
    docs.select(*narrow).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema("doc_id long, text string").parquet(folder).select("doc_id", "text", *place)


def digests(rows: DataFrame) -> DataFrame:
    """(text_sha256, doc_id, n_points, file, row) per located row."""
    return rows.select(
        F.sha2(normalised().cast("binary"), 256).alias("text_sha256"),
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        "file",
        "row",
    )


def stream_state(spark: SparkSession, folder: str, max_files: int | None) -> DataFrame:
    """Feed the new digest files of a folder through the keyed state; the newest state of each digest."""
    target = f"{folder}/decided"
    reader = spark.readStream.schema(DIGESTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg_id"), "file", "row"))
    state = (
        reader.parquet(f"{folder}/digests/*")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        .select("text_sha256", "group_size", (-F.col("best.neg_id")).alias("keep_id"), "best.file", "best.row")
    )

    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/epoch={epoch}")

    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(append)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    states = spark.read.schema("text_sha256 string, group_size long, keep_id long, file string, row long, epoch int").parquet(target)
    if states.agg(F.max("epoch")).first()[0] == 0:
        return states.drop("epoch")
    newest = F.max_by(F.struct("group_size", "keep_id", "file", "row"), "epoch")
    return states.groupBy("text_sha256").agg(newest.alias("s")).select("text_sha256", "s.*")


def exact_dedup(docs: DataFrame, max_files: int | None = None, state_dir: str | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal if their texts are, white space aside. The longest original text stays, then the smallest id. Null
    text counts as empty; empty texts are one group. Rows that repeat an id share its decision, and all are counted. A
    null id loses every tie and is kept only where its group has no other. An empty table gives no rows. Extra columns
    are ignored.

    state_dir is a folder of earlier runs: their rows count, and a row of theirs can be the one that stays. Each run
    adds its rows once, so a run that failed must not be repeated with the same folder.
    """
    spark = docs.sparkSession
    folder, run = state_dir or new_folder(spark, "dedup-state"), uuid.uuid4().hex
    rows = located(docs, f"{folder}/contents/{run}" if state_dir else None)
    own = f"{folder}/digests/{run}"
    digests(rows).write.option("compression", "zstd").parquet(own)
    state = stream_state(spark, folder, max_files)
    decided = spark.read.schema(DIGESTS).parquet(own).select("text_sha256", "doc_id")
    decided = decided.join(state.select("text_sha256", "group_size", "keep_id"), "text_sha256")
    everything = rows
    if state_dir:
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
        everything = spark.read.schema("doc_id long, text string").parquet(f"{folder}/contents/*").select("doc_id", "text", *place)
    else:
        delete_folder(spark, f"{folder}/checkpoint")
    if mismatches(everything, state).limit(1).count():
        decided = regrouped(rows, everything)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return decided.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def mismatches(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Hits whose full normalised bytes differ from the content at the place that the state names.

    Large groups are dealt out: the content that stays is there once for each GROUP_ROWS of them.
    """
    hits = state.filter("group_size > 1").select(
        F.col("text_sha256").alias("sha"),
        F.ceil(F.col("group_size") / GROUP_ROWS).cast("int").alias("parts"),
        F.col("file").alias("at_file"),
        F.col("row").alias("at_row"),
    )
    texts = rows.select(F.sha2(normalised().cast("binary"), 256).alias("sha"), "doc_id", "file", "row", normalised().alias("body"))
    held = materialize(texts.join(hits, "sha"), "dedup-hits")
    stays = (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))
    content = held.filter(stays).select("sha", F.col("body").alias("content"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    others = held.filter(~stays).withColumn("part", F.pmod(F.xxhash64("file", "row"), F.col("parts")).cast("int"))
    return others.join(content, ["sha", "part"]).filter("body <> content").select("doc_id")


def regrouped(rows: DataFrame, everything: DataFrame) -> DataFrame:
    """The exact way for digests that different texts share: group by the bytes themselves."""
    columns = (
        "doc_id",
        normalised().alias("body"),
        F.sha2(normalised().cast("binary"), 256).alias("text_sha256"),
        F.length(F.coalesce("text", F.lit(""))).alias("n_points"),
    )
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg_id")))
    groups = everything.select(*columns).groupBy("text_sha256", "body").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = groups.select("text_sha256", "body", "group_size", (-F.col("best.neg_id")).alias("keep_id"))
    return rows.select(*columns).join(groups, ["text_sha256", "body"]).select("text_sha256", "doc_id", "group_size", "keep_id")
