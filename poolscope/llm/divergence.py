"""How the sources of a language differ in their use of words.

Terms of every (lang, source) group are counted within tasks and summed by a shuffle. A language keeps the terms of at
least MIN_DOCS of its documents. A term's smoothed share p in a group, and q in the language, are integers in billionths.

* Terms that a group overuses, by upper-bound search: a group's terms are bucketed by their count, and the greatest p
  minus the least q of a bucket bounds p - q of all its terms. Rounds evaluate the buckets with the greatest bounds
  first, and a group is done when the bounds of its unseen buckets are strictly below its k-th value.
* Distances between sources: postings (term -> sources that have it, with p) are dealt by pairs of blocks of sources
  and slices of terms. A task sums |p - p'| over the terms of its postings; terms that neither source has add a constant
  each, which needs no posting.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolscope.llm.common import materialize, text_slices

MIN_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of a term once A-Z are lower-cased: ASCII letters and all beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Terms of all groups that a task holds before it sends them on.
FLUSH_TERMS = 1_500_000
#: Sources of a block, postings of a slice of terms, and terms that are compared at a time.
BLOCK, SLICE_POSTINGS, DENSE_TERMS = 256, 25_000, 2048
#: Count buckets for each doubling of the count.
PER_DOUBLING = 4
#: Terms that the first round of the search evaluates for each group, as a multiple of k, and the growth from round to round.
GROWTH = 8


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences of each term in a group, and documents that hold it."""

    def run(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            for (lang, source), (times, docs) in found.items():
                terms = list(times)
                columns = [pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
                for at in range(0, len(terms), 50_000):
                    some = [c.slice(at, 50_000) for c in columns]
                    group = [pa.repeat(pa.scalar(x, pa.string()), len(some[0])) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*group, *some], ["lang", "source", "term", "n", "n_docs"])
            found.clear()

        held = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in text_slices(batch.column(2)):
                for lang, source, text in zip(langs[a:b], sources[a:b], texts):
                    words = TERM.findall(text.encode().lower())
                    times, docs = found.setdefault((lang, source), (Counter(), Counter()))
                    held -= len(times)
                    times.update(words)
                    docs.update(set(words))
                    held += len(times)
                if held > FLUSH_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()

    schema = "lang string, source string, term string, n long, n_docs long"
    return docs.select("lang", "source", "text").mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exactly; null where nothing is kept."""
    big = lambda c: c.cast("decimal(20,0)")
    whole = F.nullif(big(total + PRIOR * kept), F.lit(0).cast("decimal(20,0)"))
    return F.lit(1).cast("long") + F.call_function("div", big(n + PRIOR) * F.lit(SCALE), whole)


def postings_and_groups(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Postings (lang, source, no, term, n, p, q) of the kept terms, and all groups (lang, source, no, kept, p0).

    no numbers the sources of a language; p0 is the share of a term that the group doesn't have.
    """
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("in_docs", F.sum("n_docs").over(by_term)).withColumn("n_lang", F.sum("n").over(by_term))
    postings = materialize(counts.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "n_lang"), "postings")
    kept = postings.groupBy("lang", "term").agg(F.max("n_lang").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("all_lang"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs")).join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "all_lang"])
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    p0 = share(F.lit(0), F.col("total"), F.col("kept"))
    groups = materialize(groups.select("lang", "source", "no", "total", "kept", "all_lang", F.coalesce(p0, F.lit(0)).alias("p0")), "groups")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("n_lang"), F.col("all_lang"), F.col("kept"))
    postings = postings.join(groups, ["lang", "source"]).select("lang", "source", "no", "term", "n", p.alias("p"), q.alias("q"))
    return postings, groups.select("lang", "source", "no", "kept", "p0")


def overused(postings: DataFrame, k: int) -> DataFrame:
    """(lang, source, item, value, rank): each group's k terms with the greatest p - q above 0, ties to the smaller term."""
    own = ["lang", "source"]
    rows = postings.withColumn("bucket", F.floor(F.log2("n") * PER_DOUBLING).cast("int"))
    buckets = rows.groupBy(*own, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count(F.lit(1)).alias("terms"))
    by_bound = Window.partitionBy(*own).orderBy(F.desc("bound"), "bucket")
    buckets = materialize(buckets.filter("bound > 0").withColumn("place", F.row_number().over(by_bound)), "term-buckets")
    state = buckets.select(*own).distinct().select(*own, F.lit(0).alias("upto"), F.lit(1).cast("long").alias("least"))
    best, quota = None, k
    while True:
        unseen = buckets.join(state, own).filter("place > upto and bound >= least")
        before = F.sum("terms").over(Window.partitionBy(*own).orderBy("place")) - F.col("terms")
        chosen = materialize(unseen.withColumn("before", before).filter(F.col("before") < quota).select(*own, "bucket", "place"), "term-chosen")
        if not chosen.limit(1).count():
            break
        found = rows.join(chosen, [*own, "bucket"]).filter("p > q").select(*own, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        found = found if best is None else found.unionByName(best.drop("rank"))
        by_value = Window.partitionBy(*own).orderBy(F.desc("value"), "item")
        best = materialize(found.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= k), "term-best")
        kth = best.groupBy(*own).agg(F.max(F.when(F.col("rank") == k, F.col("value"))).alias("kth"))
        reached = chosen.groupBy(*own).agg(F.max("place").alias("upto"))
        # groups without chosen buckets are done
        state = reached.join(kth, own, "left").select(*own, "upto", F.coalesce("kth", F.lit(1)).alias("least"))
        quota *= GROWTH
    return best


def distances(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of each ordered pair of sources of a language; value sums |p - p'| over kept terms."""
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumn("blocks", F.floor(F.max("no").over(of_lang) / BLOCK).cast("int"))
    sizes = postings.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    slices = int((sizes.agg(F.max("n")).first()[0] or 0) // SLICE_POSTINGS) + 1
    block = F.floor(F.col("no") / BLOCK).cast("int")
    units = F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("other")
    key = ["lang", "a", "b", "slice"]

    def dealt(rows: DataFrame, *columns) -> DataFrame:
        rows = rows.select("*", units).withColumn("block", block)
        return rows.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "slice", "no", *columns)

    # a block's sources come with each of its slices, before the postings, which have terms
    heads = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    heads = dealt(heads, F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    bodies = postings.join(groups.select("lang", "source", "blocks"), ["lang", "source"]).withColumn("slice", F.pmod(F.hash("term"), F.lit(slices)))
    dealt_rows = heads.unionByName(dealt(bodies, "term", "p")).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_first("term"))

    def run(batches):
        unit = None
        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            keys = list(zip(*(c.to_pylist() for c in columns[:4])))
            nos, terms, p = columns[4].to_numpy(), columns[5].to_pylist(), columns[6].to_numpy()
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if unit is None or unit.key != keys[at]:
                    if unit is not None:
                        yield unit.result()
                    unit = Unit(keys[at], BLOCK, DENSE_TERMS)
                unit.add(nos[at:to], terms[at:to], p[at:to])
                at = to
        if unit is not None:
            yield unit.result()

    sums = dealt_rows.mapInArrow(run, "lang string, x int, y int, value long, covered long")
    sums = sums.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered"))
    one = groups.select("lang", F.col("no").alias("x"), F.col("source").alias("of_x"), F.col("p0").alias("p0_x"), "kept")
    two = groups.select("lang", F.col("no").alias("y"), F.col("source").alias("of_y"), F.col("p0").alias("p0_y"))
    value = F.col("value") + (F.col("kept") - F.col("covered")) * F.abs(F.col("p0_x") - F.col("p0_y"))
    pairs = sums.join(one, ["lang", "x"]).join(two, ["lang", "y"]).select("lang", "of_x", "of_y", value.alias("value"))
    ways = F.explode(F.array(F.struct(F.col("of_x").alias("source"), F.col("of_y").alias("item")), F.struct(F.col("of_y").alias("source"), F.col("of_x").alias("item"))))
    out = pairs.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


class Unit:
    """Sums of |p - p'| between the sources of two blocks over the terms of one slice, which come in order."""

    def __init__(self, key: tuple[str, int, int, int], sources: int, terms: int):
        self.key, self.sources, self.terms = key, sources, terms
        self.nos: list[int] = []
        self.p0: list[int] = []
        self.place: dict[int, int] = {}
        self.sums: np.ndarray | None = None
        self.covered, self.row, self.last = 0, -1, None

    def add(self, nos, terms, p) -> None:
        for no, term, value in zip(nos.tolist(), terms, p.tolist()):
            if term is None:
                self.place[no] = len(self.nos)
                self.nos.append(no)
                self.p0.append(value)
                continue
            if self.sums is None:
                self.begin()
            if term != self.last:
                self.last = term
                self.row += 1
                if self.row == self.terms:
                    self.compare()
            self.dense[self.row, self.place[no]] = value

    def begin(self) -> None:
        block = np.array(self.nos) // self.sources
        one, two = (np.flatnonzero(block == b) for b in self.key[1:3])
        self.one, self.two = one, two
        self.sums = np.zeros((len(one), len(two)), np.int64)
        self.even = np.array(self.p0, np.int64)
        self.dense = np.tile(self.even, (self.terms, 1))

    def compare(self) -> None:
        some = self.dense[: self.row]
        right = some[:, self.two]
        for k, x in enumerate(self.one):
            self.sums[k] += np.abs(right - some[:, x : x + 1]).sum(0)
        self.covered += self.row
        self.dense[:] = self.even
        self.row = 0

    def result(self) -> pa.RecordBatch:
        if self.sums is None:
            self.begin()
        self.row += 1
        self.compare()
        nos = np.array(self.nos)
        x, y = (a.ravel() for a in np.meshgrid(nos[self.one], nos[self.two], indexing="ij"))
        once = x < y if self.key[1] == self.key[2] else np.ones(len(x), bool)
        lang = pa.repeat(pa.scalar(self.key[0], pa.string()), int(once.sum()))
        numbers = [pa.array(a[once], k) for a, k in ((x, pa.int32()), (y, pa.int32()), (self.sums.ravel(), pa.int64()))]
        covered = pa.array(np.full(len(lang), self.covered), pa.int64())
        return pa.RecordBatch.from_arrays([lang, *numbers, covered], ["lang", "x", "y", "value", "covered"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP) -> DataFrame:
    """Per (lang, source): part `pair` with its distance to every other source of the language, and part `term` with the
    up to k terms that it overuses most. Columns lang, source, part, item, value, rank.

    docs: (text, lang, source, ...); nulls are read as empty strings, other columns are not read. Empty texts have no
    terms; a language without kept terms has distances 0 and no rows of terms. Repeated rows count each. Ties go to the
    smaller item by its bytes. An empty table gives no rows.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    postings, groups = postings_and_groups(docs, min_docs)
    pairs = distances(postings, groups).withColumn("part", F.lit("pair"))
    terms = overused(postings, k)
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns) if terms is None else pairs.select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
