"""Importance resampling of documents towards a target distribution, on hashed n-grams.

Higher-order functions turn each text into the array of its features' buckets, which is written once. Every task counts
the buckets of its arrays, and only these totals are shuffled. The log ratios of target and corpus, one for each of the
fixed number of buckets, become a literal array; a document's weight is an aggregate over its own array, without
explode. Gumbel noise, hashed from the document id, turns the highest scores into a draw without replacement. Ranks come
out of a global sort of the narrow scores: a row's place in its partition plus the rows of the partitions before.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import materialize

BUCKETS, MAX_GRAM = 10_000, 3
SEED, MIN_WORDS, PERCENT = 42, 20, 5
#: What stands between words, which are runs of ASCII letters, digits and all characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Row numbers of monotonically_increasing_id() are below this in each partition.
ROWS = 1 << 33


def words_of(text: Column) -> Column:
    """The words of a text as binaries; A-Z are lower-cased and no other letters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN), "").cast("array<binary>")


def with_buckets(rows: DataFrame, buckets: int = BUCKETS, max_gram: int = MAX_GRAM) -> DataFrame:
    """rows (with text) with n_words and the array `buckets` of all runs of 1 to max_gram words instead of the text.

    buckets: at most 32,767.
    """
    kept = [c for c in rows.columns if c != "text"]
    hashed = lambda x: (F.crc32(x) % buckets).cast("smallint")
    rows = rows.select(*kept, words_of(F.col("text")).alias("g1"))
    found = [F.transform("g1", hashed)]
    for k in range(2, max_gram + 1):
        n = F.greatest(F.size("g1") - (k - 1), F.lit(0))
        before, last = F.slice(f"g{k - 1}", F.lit(1), n), F.slice("g1", F.lit(k), n)
        run = lambda a, b: F.concat(a, F.lit(b" "), b)
        if k < max_gram:
            rows = rows.select("*", F.zip_with(before, last, run).alias(f"g{k}"))
            found.append(F.transform(f"g{k}", hashed))
        else:  # the longest runs are needed for nothing else
            found.append(F.zip_with(before, last, lambda a, b: hashed(run(a, b))))
    return rows.select(*kept, F.size("g1").alias("n_words"), F.concat(*found).alias("buckets"))


def bucket_totals(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all rows' arrays; a task sends one row a bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(run, "bucket long, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket: floor(1000 ln) of the target's smoothed share over the corpus's. Totals as bucket_totals."""
    s, t = ({r["bucket"]: r["n"] for r in totals.collect()} for totals in (corpus, target))  # a row a bucket at most
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(buckets)]


def weight(gain: list[int]) -> Column:
    """The sum of the gains of a row's buckets; the gains are a literal array."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    return F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))


def gumbel(seed: int, doc_id: Column) -> Column:
    """floor(1000 g) of a Gumbel number g hashed from the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank, their place from 1 in the global order. The sorted rows are written, so that a lost task can't move one."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = materialize(placed, "ranked")
    part, at = F.floor(F.col("__place") / ROWS).cast("long"), F.col("__place") % ROWS
    counts = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before, starts = 0, []
    for part_no, n in counts:
        starts.append((part_no, before))
        before += n
    starts = spark.createDataFrame(starts, "__part long, __before long")
    out = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return out.withColumn("rank", F.col("__before") + at + 1).drop("__part", "__before", "__place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_features, weight, score and rank; rank is null for those that are not drawn.

    docs: (doc_id, text, ...), target: (text, ...); other columns are not read. Null and empty texts have no feature and
    weight 0. Documents of at least min_words words take part in the draw of floor(percent / 100) of them. Of equal scores
    the smaller doc_id comes first, then a null id; rows that share an id share its noise. A null id's noise is that of an
    empty one. An empty table gives no rows; an empty target draws towards even features.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    corpus = materialize(with_buckets(docs), "buckets", "none")  # bit-packed hashes don't compress
    gain = gains(bucket_totals(corpus), bucket_totals(with_buckets(target.select("text"))))
    noise = gumbel(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    scored = corpus.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(gain).alias("weight"), noise.alias("noise"))
    scored = scored.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))
    takes_part = F.col("n_words") >= min_words
    scored = materialize(scored, "scores")
    n_drawn = percent * scored.filter(takes_part).count() // 100
    own = ["doc_id", "n_features", "weight", "score"]
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    drawn = ranked(scored.filter(takes_part).select(*own), order)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    return drawn.select(*own, "rank").unionByName(scored.filter(~takes_part).select(*own, F.lit(None).cast("long").alias("rank")))
