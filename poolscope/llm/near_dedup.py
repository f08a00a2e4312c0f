"""Near-duplicate detection with HyperMinHash sketches.

1. Every text becomes a set of word shingles and a sketch: per bucket the smallest shingle hash, kept as the number of
   its leading zeros and a few mantissa bits. Texts with equal sets form a class, represented by its smallest id.
2. Bands of compressed registers are hashed; classes that share a band are compared by the collision-corrected Jaccard
   estimate, and those that may reach the threshold are joined into coarse groups.
3. Within a coarse group the full sets are intersected, and links that hold exactly give the components.

Groups of any size are cut into blocks, and each pair of blocks is one unit of work, so no task holds an unbounded
group; a unit returns a spanning star of each component that it finds, never all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import BASE, INVERSE, byte_chunks, materialize, mix64, powers, prefix_hash
from poolscope.llm.components import connected_components

SHINGLE_WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
BUCKETS, MANTISSA_BITS = 128, 10
BANDS, BAND_REGISTERS = 25, 5
EMPTY = 0xFFFF
#: An estimate passes if it is within so many standard errors of the threshold.
MARGIN = 5.0
#: Members of a block, and bytes of their sets or sketches, about; larger groups are cut.
BLOCK, BLOCK_BYTES = 512, 8 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers that tell a shingle's words apart by position.
PLACES = mix64(np.arange(11, 11 + SHINGLE_WORDS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array):
    """The sorted set of 64-bit shingle hashes of each text of a column, in order.

    Words are runs of other than ASCII white space, A-Z lower-cased. Texts of fewer words than a shingle are one
    shingle; texts without a word have an empty set.
    """
    for _, offsets, data in byte_chunks(column):
        data = _lower[data]
        space = _space[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        full = np.flatnonzero(np.diff(offsets))
        before[offsets[full]] = True
        after[offsets[full + 1] - 1] = True
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        sums = prefix_hash(data)
        words = (sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts]
        words = mix64(words + (ends - starts).astype(np.uint64) * np.uint64(BASE))
        bounds = np.searchsorted(starts, offsets)
        n = max(0, len(words) - SHINGLE_WORDS + 1)
        mixed = np.zeros(n, np.uint64)
        for k in range(SHINGLE_WORDS):
            mixed += words[k : k + n] * PLACES[k]
        mixed = mix64(mixed)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE_WORDS:
                yield np.unique(mixed[a : b - SHINGLE_WORDS + 1])
            elif b > a:
                short = (words[a:b] * PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix64(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash sketches, one row per set: leading zeros and mantissa of each bucket's smallest hash."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    bucket = (values & np.uint64(BUCKETS - 1)).astype(np.int64) + np.repeat(np.arange(len(sets)) * BUCKETS, lengths)
    least = np.full(len(sets) * BUCKETS, 1 << 53, np.int64)
    np.minimum.at(least, bucket, (values >> np.uint64(11)).astype(np.int64))
    bits = np.frexp(least.astype(np.float64))[1]
    bits = np.where(least == 0, 0, bits).astype(np.int64)
    mantissa = (least >> np.maximum(bits - 1 - MANTISSA_BITS, 0)) & ((1 << MANTISSA_BITS) - 1)
    out = ((53 - bits) << MANTISSA_BITS) | mantissa
    return np.where(least == 1 << 53, EMPTY, out).astype(np.uint16).reshape(len(sets), BUCKETS)


def chance_matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Expected number of equal registers of two disjoint sets of these sizes.

    A bucket's smallest hash is about exponential; two of them meet in a cell of width 2**-(i+1+MANTISSA_BITS) with the
    product of their densities.
    """
    x, y = np.asarray(a, float) / BUCKETS, np.asarray(b, float) / BUCKETS
    rate = np.maximum(x + y, 1e-12)
    edge = 2.0 ** -np.arange(41)
    decay = np.exp(-rate[..., None] * edge)
    cells = ((decay[..., 1:] - decay[..., :-1]) * edge[1:]).sum(-1) * 2.0**-MANTISSA_BITS
    return BUCKETS * cells * x * y / rate


#: Pairs of a group that are compared at once.
SLICE = 4096


def may_link(sketches: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs' corrected Jaccard estimates reach the threshold, allowing for their error."""
    n, threshold = len(sketches), PERCENT / 100
    held, out = sketches != EMPTY, np.zeros((n, n), bool)
    step = max(1, SLICE // n)
    for at in range(0, n, step):
        rows = slice(at, at + step)
        equal = ((sketches[rows, None] == sketches[None]) & held[rows, None]).sum(-1)
        union = np.maximum((held[rows, None] | held[None]).sum(-1), 1)
        estimate = (equal - chance_matches(sizes[rows, None], sizes[None])) / union
        out[rows] = estimate >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / union)
    return out


def links(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets are linked exactly, from all pairwise intersections by blocked matrix products."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        shared = np.array([[0, 1], [1, 0]]) * len(np.intersect1d(*sets, assume_unique=True))
    else:
        values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        common = counts > 1
        place = np.cumsum(common) - 1
        owner, at = owner[common[where]], place[where[common[where]]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        shared, width = np.zeros((len(sets), len(sets)), np.float32), 4096
        for low in range(0, int(common.sum()), width):
            a, b = np.searchsorted(at, [low, low + width])
            dense = np.zeros((len(sets), width), np.float32)
            dense[owner[a:b], at[a:b] - low] = 1
            shared += dense @ dense.T
        shared = shared.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - shared
    return 100 * shared >= PERCENT * union


def stars(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each component's smallest id to its other ids."""
    label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    linked = linked | np.eye(len(ids), dtype=bool)
    while True:
        least = np.where(linked, label[None, :], len(ids)).min(1)
        if (least == label).all():
            break
        label = least
    centre = np.sort(ids, kind="stable")[label]
    far = centre != ids
    return ids[far], centre[far]


def in_blocks(members: DataFrame, key: str, count: str, size: str) -> DataFrame:
    """Rows of every pair of blocks of a group, next to each other: adds i and j; groups of one block get (0, 0).

    count and size are columns with the group's members and their bytes.
    """
    blocks = F.ceil(F.greatest(F.col(count) / BLOCK, F.col(size) / BLOCK_BYTES)).cast("int")
    blocks = F.when(blocks > 2, F.least(blocks, F.col(count))).otherwise(1).cast("int")
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return members.drop("own", "other", count, size).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def find_edges(blocks: DataFrame, key: str, columns: list[str], linked) -> DataFrame:
    """Apply linked(columns of a unit) to each pair of blocks; edges (a, b) of the components in it."""

    def finish(held, out):
        table = pa.Table.from_batches(held)
        if table.num_rows > 1:
            a, b = stars(table.column("node").to_numpy(), linked(*(table.column(c) for c in columns)))
            out.append((a, b))

    def run(batches):
        held, before = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list = []
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                now = tuple(keys[a])
                if before is not None and now != before:
                    finish(held, out)
                    held = []
                before = now
                held.append(batch.slice(a, b - a))
            yield as_batch(out)
        out = []
        if held:
            finish(held, out)
        yield as_batch(out)

    def as_batch(out):
        edges = [np.concatenate([e[k] for e in out]) if out else np.zeros(0, np.int64) for k in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in edges], ["a", "b"])

    return blocks.select(key, "i", "j", "node", *columns).mapInArrow(run, "a long, b long").distinct()


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, digest of the set or null if empty, registers) per row."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            rows = [r.tobytes() for r in registers(sets)]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [batch.column(0), sizes, pa.array(digests, pa.binary()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "registers"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, node): a hash of each band of registers that has a value."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            nodes, keys = batch.column(0).to_numpy(), []
            owners = []
            for band in range(BANDS):
                some = values[:, band * BAND_REGISTERS : (band + 1) * BAND_REGISTERS]
                hashed = np.full(len(some), band + 1, np.uint64)
                for k in range(BAND_REGISTERS):
                    hashed = mix64(hashed * np.uint64(BASE) + some[:, k])
                full = (some != EMPTY).any(1)
                keys.append(hashed[full].view(np.int64))
                owners.append(nodes[full])
            columns = [pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node"])

    return classes.select("node", "registers").mapInArrow(run, "key long, node long")


def _estimated(sketches: pa.ChunkedArray, sizes: pa.ChunkedArray) -> np.ndarray:
    values = np.frombuffer(b"".join(sketches.to_pylist()), np.uint16).reshape(-1, BUCKETS)
    return may_link(values, sizes.to_numpy().astype(float))


def _verified(sets: pa.ChunkedArray) -> np.ndarray:
    return links([np.frombuffer(s, np.uint64) for s in sets.to_pylist()])


def coarse_groups(classes: DataFrame) -> DataFrame:
    """(node, component): classes joined by estimates of pairs that share a band."""
    keys = band_keys(classes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keys.join(shared, "key").join(classes.select("node", "n_shingles", "registers"), "node")
    members = members.withColumn("size", F.lit(2 * BUCKETS) * F.col("n"))
    edges = find_edges(in_blocks(members, "key", "n", "size"), "key", ["registers", "n_shingles"], _estimated)
    return connected_components(edges)


#: Bits of the filter of candidate ids: its size is fixed, whatever the input.
FILTER_BITS = 1 << 25


def _filter_place(node):
    return F.pmod(F.xxhash64(node), F.lit(FILTER_BITS))


def candidate_filter(nodes: DataFrame) -> np.ndarray:
    """A bit per hashed id, packed; other ids may share a bit, none is missed. At most FILTER_BITS / 64 rows are collected."""
    place = _filter_place(F.col("node"))
    words = nodes.groupBy(F.call_function("div", place, F.lit(64)).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")
    )
    got, out = words.toPandas(), np.zeros(FILTER_BITS // 64, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def with_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members with the shingles of each; texts that cannot be members are dropped where they are read."""
    bits = docs.sparkSession.sparkContext.broadcast(candidate_filter(members))

    def run(batches):
        known = bits.value
        for batch in batches:
            place = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "shingles"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))
    narrow = narrow.filter("node is not null").withColumn("place", _filter_place(F.col("node")))
    return members.join(narrow.mapInArrow(run, "node long, shingles binary"), "node")


def near_dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links), kept (doc_id = component_id).

    Null and empty texts have no shingles and stay alone. Rows that share an id are one node. Rows with a null id are
    linked with nothing, and kept. Extra columns are ignored.
    """
    sketches = materialize(sketch(docs), "sketches")
    known = sketches.filter("digest is not null and doc_id is not null")
    first = F.min_by(F.struct("n_shingles", "registers"), "doc_id").alias("s")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("node"), first).select("digest", "node", "s.*")
    classes = materialize(classes, "classes")
    coarse = coarse_groups(classes)
    coarse = coarse.join(classes.select("node", "n_shingles"), "node")
    sizes = coarse.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.col("n_shingles")).alias("size"))
    members = coarse.drop("n_shingles").join(sizes, "component")
    held = in_blocks(with_sets(docs, materialize(members, "members")), "component", "n", "size")
    found = connected_components(find_edges(held, "component", ["shingles"], _verified))
    labels = classes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = sketches.join(labels, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
