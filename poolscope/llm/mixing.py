"""Mixing sources to target weights by Poisson replication.

Each source has a target repetition rate: its share of the output over its share of the input. A document's number of
copies inverts the Poisson distribution with that mean at a uniform number hashed from the seed and the document id;
the copies are exploded and shuffled globally by a hash. Every decision depends on (seed, doc_id) alone, so a lost task
recomputes the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20240601
TEMPERATURE = 0.5
#: Up to so many sources the table of rates is broadcast; with more it is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def unit_hash(*parts: Column | str) -> Column:
    """A uniform number in (0, 1) from the md5 of the parts."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (number + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. as array, to beyond the reach of a 52-bit uniform number."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int")
    step = lambda acc, k: F.struct(
        (acc["logp"] + F.log(rate) - F.log(k.cast("double"))).alias("logp"),
        F.concat(
            acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(acc["logp"] + F.log(rate) - F.log(k.cast("double"))))
        ).alias("cdf"),
    )
    start = F.struct((-rate).alias("logp"), F.array(F.exp(-rate)).alias("cdf"))
    folded = F.aggregate(F.sequence(F.lit(1), last), start, step)
    return F.when(rate > 0, folded["cdf"])


def repetition_rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE
) -> DataFrame:
    """Per source: its rows n and the mean number of copies of each.

    Without weights, a source's target share is proportional to n ** temperature. With weights, sources that have none
    get rate 0. The expected number of output rows equals the number of input rows. A null source is a source.
    """
    counts = docs.groupBy(F.col("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        share = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    counts = counts.withColumn("share", share)
    total, shares = counts.agg(F.sum("n"), F.sum("share")).first()
    scale = total / shares if shares else 0.0
    return counts.select("source", "n", (F.lit(float(scale)) * F.col("share") / F.col("n")).alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
) -> DataFrame:
    """The input's rows, each as often as its count says, plus copy (from 1), n_copies and shuffle_key, in hashed order.

    Rows with a null id share one uniform number; repeated rows get the same count each; an empty table gives none.
    Columns named like the added ones are replaced.
    """
    names = [c for c in docs.columns if c not in ("copy", "n_copies", "shuffle_key")]
    rates = repetition_rates(docs, weights, temperature)
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = rates.select(F.col("source").alias("of"), poisson_cdf(F.col("rate")).alias("cdf"))
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*names).alias("row"), F.col("source").alias("source"), doc_id.alias("id"), unit_hash(str(seed), doc_id).alias("u"))
    counted = rows.join(F.broadcast(rates) if small else rates, rows["source"].eqNullSafe(rates["of"]))
    copies = F.when(F.col("cdf").isNull(), 0).otherwise(F.size(F.filter("cdf", lambda c: c < F.col("u"))))
    counted = counted.select("row", "id", copies.alias("n_copies")).filter("n_copies > 0")
    out = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = unit_hash(str(seed), "order", F.col("id"), F.col("copy").cast("string"))
    out = out.select("row", "copy", "n_copies", key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select("row.*", "copy", "n_copies", "shuffle_key")
