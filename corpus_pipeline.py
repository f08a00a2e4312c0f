"""Corpus pipeline, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet into the
shared folder and hands the reread table to the next. All but the last return the columns of `documents`, whatever their
names, with their values. An empty table stays empty in every stage; what becomes of null, empty, very long and repeated
texts is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from poolscope.llm.common import materialize

#: The stages train models and break hash ties, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go.

    Null and empty texts are clean; rows that repeat an id or text, and rows without an id, are judged each by its text.
    """
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder != 2)
    field = toxicity.train(docs, labels)
    return toxicity.keep_clean(docs, field).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest stays, then the smallest id; of rows that repeat id and text, one.

    Null, empty and blank texts are one group. A row without an id stays only where its group has no row with one.
    """
    decided = exact_dedup.exact_dedup(docs).filter("kept")
    # grouped by a struct, so that a large group is not held together up to here
    key = F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("body")).alias("key")
    kept = decided.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).select("key.*", "rows")
    body = F.sha2(exact_dedup.normalised().cast("binary"), 256)
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]) & (body == kept["body"]), "left_semi")
    if kept.filter("rows > 1").limit(1).count():
        out = out.withColumn("__body", body).dropDuplicates(["doc_id", "__body"]).drop("__body")
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that with the smallest id.

    Null and empty texts and rows without an id are linked with nothing and stay; rows that share an id share its fate.
    """
    kept = near_dedup.near_dedup(docs).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]), "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson count says, in global random order.

    A null source is a source; rows without an id share one count; repeated rows are repeated each. Columns keep their
    values even where mixing adds ones of the same name.
    """
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("row"))
    return mixing.mix(rows).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences. Null and empty texts are one token, the separator."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
