"""Exact top-k search by inner product, with distributed histogram selection.

Queries and vectors are dealt into blocks; each pair of blocks is one unit of work, scored by one matrix product. No
scores are kept. Instead each pass counts, for every query, how many scores fall into each bin of the interval that
holds its k-th highest score, and the summed counts narrow the interval until it is one integer. A last pass keeps the
scores above that value, and the smallest ids among those equal to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolscope.llm.common import materialize

K = 20
SCALE = 64.0
BINS = 64
#: Vectors and queries in a block.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024

ROWS = "d int, q int, dim int, is_query boolean, vec_id long, vec binary, lo long, hi long"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec array<double>, dim) of the vectors that take part: without null ids, null vectors, and null or non-finite components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(good)
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"), F.size("embedding").alias("dim"))


def packed(rows: DataFrame) -> DataFrame:
    """The same rows with floor(SCALE * x) of each component x, as binary little-endian doubles."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            values = [np.floor(SCALE * np.asarray(v.values if v.values is not None else [], "<f8")).tobytes() for v in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary()), batch.column(2)], ["vec_id", "vec", "dim"])

    return rows.select("vec_id", "vec", "dim").mapInArrow(run, "vec_id long, vec binary, dim int")


def dealt(vectors: DataFrame, queries: DataFrame, n_d: int, n_q: int) -> DataFrame:
    """Rows of every pair of blocks, next to each other."""
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    none = F.lit(None).cast("long")
    a = vectors.select(
        block(n_d).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), "dim",
        F.lit(False).alias("is_query"), "vec_id", "vec", none.alias("lo"), none.alias("hi"),
    )
    b = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))).alias("d"), block(n_q).alias("q"), "dim",
        F.lit(True).alias("is_query"), "vec_id", "vec", "lo", "hi",
    )
    return a.unionByName(b).repartition("d", "q", "dim").sortWithinPartitions("d", "q", "dim", "is_query")


def per_block(rows: DataFrame, work, schema: str) -> DataFrame:
    """Apply work(vector ids, vector matrix, query ids, query matrix, lo, hi) to every pair of blocks."""

    def finish(held):
        table = pa.Table.from_batches(held)
        dim = table.column("dim")[0].as_py()
        asked = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("vec_id").to_numpy()
        matrix = np.frombuffer(b"".join(table.column("vec").to_pylist()), "<f8").reshape(len(ids), dim)
        if asked.any() and not asked.all():
            chosen = table.filter(pa.array(asked))
            bounds = (chosen.column(name).fill_null(0).to_numpy() for name in ("lo", "hi"))
            yield work(ids[~asked], matrix[~asked], ids[asked], matrix[asked], *bounds)

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if key is not None and tuple(keys[a]) != key:
                    yield from finish(held)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish(held)

    return rows.select(*[c.split()[0] for c in ROWS.split(", ")]).mapInArrow(run, schema)


#: Up to here a double holds every integer; longer vectors are multiplied in extended precision, which holds 64 bits.
EXACT = 1 << 53


def inner_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole numbers, as long; none of them leaves 64 bits."""
    longest = float(np.sqrt((queries**2).sum(1).max(initial=0)) * np.sqrt((vectors**2).sum(1).max(initial=0)))
    if longest * queries.shape[1] >= EXACT:
        queries, vectors = queries.astype(np.longdouble), vectors.astype(np.longdouble)
    return (queries @ vectors.T).astype(np.int64)


def count_bins(ids, matrix, query_ids, query_matrix, lo, hi) -> pa.RecordBatch:
    """(query_id, bin, n): scores per bin of each query's interval."""
    scores = inner_products(query_matrix, matrix)
    width = -(-(hi - lo) // BINS)
    at = (scores - lo[:, None]) // width[:, None]
    inside = (at >= 0) & (scores < hi[:, None]) & (ids[None, :] != query_ids[:, None])
    flat = (np.arange(len(query_ids))[:, None] * BINS + at)[inside]
    n = np.bincount(flat, minlength=len(query_ids) * BINS)
    full = np.flatnonzero(n)
    columns = [pa.array(query_ids[full // BINS]), pa.array((full % BINS).astype(np.int32)), pa.array(n[full].astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["query_id", "bin", "n"])


def select_scores(k: int):
    def work(ids, matrix, query_ids, query_matrix, lo, hi) -> pa.RecordBatch:
        scores = inner_products(query_matrix, matrix)
        order = np.argsort(ids, kind="stable")
        out = []
        for i, query in enumerate(query_ids):
            row = scores[i][order]
            other = ids[order] != query
            above, equal = np.flatnonzero((row > lo[i]) & other), np.flatnonzero((row == lo[i]) & other)[:k]
            kept = np.concatenate([above, equal])
            out.append((np.full(len(kept), query), ids[order][kept], row[kept]))
        columns = [pa.array(np.concatenate([o[j] for o in out]).astype(np.int64)) for j in range(3)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return work


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query, ties to the smaller id.

    is_query is a condition on vec_id. Vectors of different lengths are not compared. Rows that repeat an id are
    candidates each; of repeated queries one is asked; a query never meets rows of its own id. Vectors that are null or hold
    null or non-finite components take no part; an empty table gives no rows; extra columns are ignored. Scores have to
    fit into a long: vectors so long that a score might not are an error.
    """
    vectors = materialize(packed(quantised(vectors)), "topk-vectors")
    asked = vectors.filter(is_query)
    queries = asked.groupBy("vec_id", "dim").agg(F.min("vec").alias("vec"))
    norms = vectors.agg(F.count(F.lit(1))).first()[0]
    n_queries = queries.count()
    out = "query_id long, rank int, vec_id long, score long"
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], out)
    n_d, n_q = math.ceil(norms / VECTOR_BLOCK), math.ceil(n_queries / QUERY_BLOCK)
    bound = max_score(vectors) + 1
    if 2 * bound >= 1 << 62:
        raise ValueError("scores of these vectors do not fit into 64 bits")
    state = queries.select("vec_id", "dim", "vec", F.lit(-bound).alias("lo"), F.lit(bound).alias("hi"), F.lit(k).cast("long").alias("need"))
    width = 2 * bound
    while width > 1:
        counted = per_block(dealt(vectors, state, n_d, n_q), count_bins, "query_id long, bin int, n long")
        counted = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        counted = counted.withColumn("reached", F.sum("n").over(from_top))
        rows = state.join(counted, state["vec_id"] == counted["query_id"], "left")
        first = F.max_by(F.struct("bin", "n", "reached"), F.when(F.col("reached") >= F.col("need"), F.col("bin")))
        rows = rows.groupBy("vec_id", "dim", "vec", "lo", "hi", "need").agg(first.alias("at"))
        step = F.call_function("div", F.col("hi") - F.col("lo") + (BINS - 1), F.lit(BINS))  # on longs, as count_bins has it
        lo = F.col("lo") + F.col("at.bin") * step
        found = F.col("at").isNotNull()
        state = materialize(
            rows.select(
                "vec_id", "dim", "vec",
                F.when(found, lo).otherwise(F.col("lo")).alias("lo"),
                F.when(found, F.least(lo + step, F.col("hi"))).otherwise(F.col("lo") + 1).alias("hi"),
                F.when(found, F.col("need") - (F.col("at.reached") - F.col("at.n"))).otherwise(F.col("need")).alias("need"),
            ),
            "topk-state",
        )
        width = -(-width // BINS)
    chosen = per_block(dealt(vectors, state, n_d, n_q), select_scores(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = chosen.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def max_score(vectors: DataFrame) -> int:
    """A bound of every score: the largest squared length, and what its sum in doubles may lack."""

    def run(batches):
        for batch in batches:
            longest = 0.0
            for vec in batch.column(0).to_pylist():
                v = np.frombuffer(vec, "<f8")
                longest = max(longest, float(v @ v) * (1 + (len(v) + 1) * 2.0**-51))
            yield pa.RecordBatch.from_arrays([pa.array([longest])], ["longest"])

    longest = vectors.select("vec").mapInArrow(run, "longest double").agg(F.max("longest")).first()[0]
    return math.ceil(min(longest or 0.0, 2.0**63))
