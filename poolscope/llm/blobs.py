"""Arrays that travel as compressed blobs, one for each task and bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(data, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def dealt(arrays: list[np.ndarray], n_buckets: int, by: np.ndarray | None = None):
    """The arrays' rows by bucket of the hash, which is the first of them unless given; order within a bucket kept."""
    bucket = ((arrays[0] if by is None else by) >> np.uint64(20)) % np.uint64(n_buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), [a[order[cuts[k] : cuts[k + 1]]] for a in arrays]


def by_bucket(rows: DataFrame, finish, schema: str, n_buckets: int) -> DataFrame:
    """Apply finish(blobs) to each bucket; rows: (bucket, kind, blob)."""
    columns = rows.columns

    def run(batches):
        held, now = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and row[0] != now:
                    yield from finish(held)
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield from finish(held)

    return rows.select(*columns).repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, schema)
