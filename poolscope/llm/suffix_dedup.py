"""Removal of byte strings that repeat across a corpus, by a collection Burrows-Wheeler transform built column by column.

A repeat is a string of `length` bytes that also starts earlier. Every window of that length has an anchor: its leftmost
byte run of ANCHOR bytes with the smallest hash. Equal windows have equal anchors, so consecutive windows with one
anchor form a piece, and only pieces with the same anchor can hold equal windows.

1. Tasks deal the anchors of all texts into buckets; a bucket finds the anchors that occur more than once. An anchor
   that a task meets twice needs no answer: its pieces are known to be wanted, and one row stands for all of them.
2. The pieces of those anchors are cut from the texts and dealt into buckets by anchor, or where an anchor is frequent by
   the anchor and CONTEXT bytes beside it: a window has at least so many on one side of its anchor, and equal windows have
   the same. Which anchors are frequent is settled beforehand over all tasks, and every task goes by the same list. Of pieces that are equal byte for byte the earliest goes on; all windows of the others repeat it.
3. A bucket takes anchors with different pieces as a collection of documents, aligned at their anchors, and builds the
   collection's Burrows-Wheeler transform column by column: each round inserts one symbol per piece, from the last
   column to the first, and updates the order of the suffixes and their common prefixes, which pass from round to round
   through sequential files in the shared folder. Suffixes that begin in different columns cannot agree over `length` bytes, so each round
   keeps its own column's suffixes only. Suffixes next to each other with a common prefix of `length` bytes are equal
   windows; all but the earliest of them are removed.
4. Removed ranges go back to their documents.

Anchors and pieces travel as compressed blobs, one per task and bucket. A task sends equal pieces only once, so a
passage that a third of all documents hold arrives at its bucket once per task. The number of buckets follows the bytes
of the input.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.blobs import by_bucket, dealt, pack, unpack
from poolscope.llm.common import BASE, INVERSE, byte_chunks, materialize, mix64, new_folder, powers, prefix_hash
from poolscope.llm.warc import open_folder

LENGTH = 100
ANCHOR = 20
#: Anchors and bytes of pieces that a task gathers before it sends them on.
FLUSH_ANCHORS, FLUSH_BYTES = 3_000_000, 96 << 20
#: Symbols of a collection; a bucket works through its anchors in collections of about this size.
COLLECTION_SYMBOLS = 16_000_000
#: Bytes of text for each bucket, about.
BUCKET_BYTES = 12 << 20
#: An anchor with about so many occurrences in all is dealt by its context of so many bytes, too. Of very large inputs it
#: is those with more than 1 / MOST_FREQUENT of all occurrences, so that the list of them has a bound.
FREQUENT, CONTEXT, MOST_FREQUENT = 2000, 40, 1 << 20
#: An anchor that a task meets so rarely, among those it gathers, isn't reported as frequent.
LEAST_COUNT = 4
#: Repeated ranges that a task gathers before it sends them on.
FLUSH_RANGES = 500_000
POSITION_BITS = 24


def anchors_of(offsets: np.ndarray, data: np.ndarray, length: int):
    """(row, first window, number of windows, anchor's place in the piece, anchor hash) of each piece of a chunk's texts."""
    n = len(data)
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    if n < length:
        return none
    sums = prefix_hash(data)
    grams = mix64((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(INVERSE, n - ANCHOR + 1))
    low = np.uint64((1 << POSITION_BITS) - 1)
    window = length - ANCHOR + 1
    least = np.empty(0, np.uint64)
    out_row, out_first, out_count, out_lead, out_hash = [], [], [], [], []
    step = 1 << 22  # positions must fit into POSITION_BITS
    for base in range(0, n - length + 1, step):
        part = grams[base : base + step + window - 1]
        least = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        size, total = 1, len(part)
        while 2 * size <= window:
            least = np.minimum(least[: total - 2 * size + 1], least[size : total - size + 1])
            size *= 2
        least = np.minimum(least[: total - window + 1], least[window - size : window - size + total - window + 1])
        place = (least & low).astype(np.int64) + base
        starts = np.arange(base, base + len(place))
        row = np.searchsorted(offsets, starts, "right") - 1
        valid = starts + length <= offsets[row + 1]
        place, starts, row = place[valid], starts[valid], row[valid]
        if not len(place):
            continue
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
        out_row.append(row[cut])
        out_first.append(starts[cut] - offsets[row[cut]])
        out_count.append(np.diff(np.concatenate([cut, [len(place)]])))
        out_lead.append(place[cut] - starts[cut])
        out_hash.append(grams[place[cut]])
    if not out_row:
        return none
    return [np.concatenate(x) for x in (out_row, out_first, out_count, out_lead, out_hash)]


ANCHOR_KINDS = ("<u8", "<i8", "<i4", "<i4", "<i4")  # hash, document, first window, windows, anchor's place
PIECE_KINDS = (*ANCHOR_KINDS, "u1")  # and the bytes, end to end
DIRECT_KINDS = ("<i8", "<i4", "<i4")  # document, first and last + 1 removed byte


def frequent_anchors(docs: DataFrame, length: int, size: int) -> np.ndarray:
    """The sorted hashes of the anchors with more than FREQUENT occurrences in texts of `size` bytes.

    A task reports those that make more than a share of its own anchors; a sum lacks at most that share of all, so an
    anchor with clearly more than twice as many is never missed. Results don't depend on the list, only bucket sizes do.
    """
    share = max(FREQUENT * (length - ANCHOR + 2) / (2 * max(size, 1)), 1 / MOST_FREQUENT)

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            hashed = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            found, n = np.unique(hashed, return_counts=True)
            often = n > max(share * len(hashed), LEAST_COUNT)
            arrays = [pa.array(found[often].view(np.int64)), pa.array(n[often], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["hash", "n"])

        for batch in batches:
            for _, offsets, data in byte_chunks(batch.column(0)):
                held.append(anchors_of(offsets, data, length)[4])
            if sum(map(len, held)) > FLUSH_ANCHORS:
                yield from flush()
        yield from flush()

    counts = docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    least = max(FREQUENT, 2 * size / (length - ANCHOR + 2) / MOST_FREQUENT)
    return np.sort(np.array([r["hash"] for r in counts.filter(F.col("n") > least).collect()], np.int64).view(np.uint64))


def is_in(hashed: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the hashes are in the sorted array."""
    if not len(known):
        return np.zeros(len(hashed), bool)
    return known[np.minimum(np.searchsorted(known, hashed), len(known) - 1)] == hashed


def send_anchors(docs: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """(bucket, sure, blob) of all anchors. Those that a task meets more than once are sure to be wanted: they are dealt by
    document, and one row without windows stands for them.
    """

    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            if not held:
                return
            arrays = [np.concatenate(a).astype(k) for a, k in zip(zip(*held), ANCHOR_KINDS)]
            held.clear()
            _, one, where, n = np.unique(arrays[0], return_index=True, return_inverse=True, return_counts=True)
            sure = n[where] > 1
            alone = [np.concatenate([a[~sure], a[one[n > 1]]]) for a in arrays]
            alone[3][(~sure).sum() :] = 0
            rows = [(k, False, pack(*some)) for k, some in dealt(alone, n_buckets)]
            known = [a[sure] for a in arrays]
            rows += [(k, True, pack(*some)) for k, some in dealt(known, n_buckets, mix64(known[1].view("<u8")))]
            kinds, names = [pa.int32(), pa.bool_(), pa.binary()], ["bucket", "sure", "blob"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, offsets, data in byte_chunks(batch.column(1)):
                row, first, count, lead, hashed = anchors_of(offsets, data, length)
                held.append([hashed, ids[at + row], first, count, lead])
            if sum(len(h[0]) for h in held) > FLUSH_ANCHORS:
                yield from flush()
        yield from flush()

    return docs.select("uid", "text").mapInArrow(run, "bucket int, sure boolean, blob binary")


def repeated_anchors(sent: DataFrame, n_buckets: int, frequent: np.ndarray) -> DataFrame:
    """(bucket, blob) by document of the pieces whose anchor occurs more than once."""

    def finish(held):
        asked = [unpack(b, *ANCHOR_KINDS) for sure, b in held if not sure]
        for sure, blob in held:
            if sure:
                yield from answers(*unpack(blob, *ANCHOR_KINDS))
        if asked:
            hashed, uid, first, count, lead = (np.concatenate(a) for a in zip(*asked))
            stands = count == 0  # for two pieces or more
            _, where = np.unique(hashed, return_inverse=True)
            keep = (np.bincount(where, np.where(stands, 2, 1))[where] > 1) & ~stands
            yield from answers(*(a[keep] for a in (hashed, uid, first, count, lead)))

    def answers(hashed, uid, first, count, lead):
        arrays = [uid, hashed, first, count.astype("u1"), lead.astype("u1"), is_in(hashed, frequent).astype("u1")]
        rows = [(k, pack(*some)) for k, some in dealt(arrays, n_buckets, mix64(uid.view("<u8")))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    return by_bucket(sent, finish, "bucket int, blob binary", n_buckets)


ANSWER_KINDS = ("<i8", "<u8", "<i4", "u1", "u1", "u1")  # document, hash, first window, windows, anchor's place, frequent
ANSWER = np.dtype([("hash", "<u8"), ("first", "<i4"), ("count", "<u1"), ("lead", "<u1"), ("frequent", "?")])


def pieces_by_document(answers: DataFrame, n_buckets: int) -> DataFrame:
    """(uid, blob of ANSWER), one row for each document that has pieces to look at."""

    def finish(held):
        uid, *piece = (np.concatenate(a) for a in zip(*(unpack(b, *ANSWER_KINDS) for (b,) in held)))
        by = np.argsort(uid, kind="stable")
        uid, rows = uid[by], np.rec.fromarrays([a[by] for a in piece], dtype=ANSWER)
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]])), [len(uid)]])
        for at in range(0, len(cuts) - 1, 20_000):
            some = cuts[at : at + 20_001]
            blobs = pa.array([rows[a:b].tobytes() for a, b in zip(some[:-1], some[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(uid[some[:-1]], pa.int64()), blobs], ["uid", "blob"])

    return by_bucket(answers, finish, "uid long, blob binary", n_buckets)


def in_contexts(data: bytes, hashed: int, first: int, count: int, lead: int):
    """(hash, first window, windows, anchor's place) of the parts of a frequent anchor's piece: windows with CONTEXT bytes
    before the anchor, and those with as many after it.
    """
    at = first + lead
    before = min(max(lead - CONTEXT + 1, 0), count)
    sides = ((before, 0, data[at - CONTEXT : at]), (count - before, before, data[at + ANCHOR : at + ANCHOR + CONTEXT]))
    for side, (windows, skip, context) in enumerate(sides):
        if windows:
            own = int.from_bytes(hashlib.blake2b(context, digest_size=8, person=bytes([side])).digest(), "little")
            yield (hashed * BASE + own) % (1 << 64), first + skip, windows, lead - skip


def send_pieces(asked: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """(bucket, direct, blob): the different pieces of each task, and directly the ranges that repeat one of them."""

    def run(batches):
        seen: dict[bytes, tuple[int, int, int, int, int]] = {}
        direct: list[tuple[int, int, int]] = []

        def flush():
            keys = list(seen)
            rows = list(seen.values())
            out = []
            if rows:
                hashed = np.array([r[2] for r in rows], "<u8")
                lengths = np.fromiter(map(len, keys), np.int64, len(keys))
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                arrays = [hashed, np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i4")]
                arrays += [np.array([r[k] for r in rows], "<i4") for k in (3, 4)] + [np.arange(len(rows))]
                text = np.frombuffer(b"".join(keys), np.uint8)
                for k, (*some, at) in dealt(arrays, n_buckets):
                    body = np.concatenate([text[starts[i] : starts[i] + lengths[i]] for i in at])
                    out.append((k, False, pack(*some, body)))
            if direct:
                columns = [np.array(c, k) for c, k in zip(zip(*direct), DIRECT_KINDS)]
                out += [(k, True, pack(*some)) for k, some in dealt(columns, n_buckets, mix64(columns[0].view("<u8")))]
            seen.clear()
            direct.clear()
            kinds = [pa.int32(), pa.bool_(), pa.binary()]
            names = ["bucket", "direct", "blob"]
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out[at : at + 64]], t) for k, t in enumerate(kinds)], names)

        def take(data, uid, hashed, first, count, lead) -> int:
            piece = data[first : first + count + length - 1]
            old = seen.get(piece)
            if old is None:
                seen[piece] = (uid, first, hashed, count, lead)
                return len(piece)
            if (uid, first) > old[:2]:
                direct.append((uid, first, first + len(piece)))
            elif (uid, first) < old[:2]:
                direct.append((old[0], old[1], old[1] + len(piece)))
                seen[piece] = (uid, first, hashed, count, lead)
            return 0

        size = 0
        for batch in batches:
            for uid, text, blob in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode() if blob else b""
                for hashed, first, count, lead, frequent in np.frombuffer(blob or b"", ANSWER).tolist():
                    if frequent and length >= 2 * CONTEXT + ANCHOR:
                        size += sum(take(data, uid, *part) for part in in_contexts(data, hashed, first, count, lead))
                    else:
                        size += take(data, uid, hashed, first, count, lead)
                if size > FLUSH_BYTES or len(direct) > FLUSH_RANGES:
                    yield from flush()
                    size = 0
        yield from flush()

    return asked.select("uid", "text", "blob").mapInArrow(run, "bucket int, direct boolean, blob binary")


class SequentialFile:
    """An array in the shared folder, written and read from its beginning to its end."""

    def __init__(self, folder: str, kind):
        self.fs, path = open_folder(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.kind = f"{path}/{uuid.uuid4().hex}", kind

    def write(self, array: np.ndarray) -> None:
        with self.fs.open_output_stream(self.path, compression=None) as out:
            out.write(array.astype(self.kind).tobytes())

    def read(self) -> np.ndarray:
        with self.fs.open_input_stream(self.path, compression=None) as file:
            return np.frombuffer(file.read(), self.kind)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.fs.delete_file(self.path)


def columns_of(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, anchors: np.ndarray, most: int, folder: str):
    """Round by round: the column, the pieces whose text has a symbol there in the order of their suffixes, the symbols
    in that order, and each suffix's common prefix with the one before, up to `most`.

    starts, ends and anchors are places in text; a column is a place relative to the anchor. A round sorts the order of
    the column after it stably by the new symbols. The common prefix of two neighbours with the same symbol is one more
    than the least common prefix between their tails; pieces that begin or end on the way drop out or come in first.
    """
    left, right = starts - anchors, ends - anchors
    entering = np.argsort(-right, kind="stable")
    arrived = 0
    with SequentialFile(folder, np.int32) as order_file, SequentialFile(folder, np.uint8) as common_file:
        order_file.write(np.zeros(0))
        common_file.write(np.zeros(0))
        for column in range(int(right.max(initial=0)) - 1, int(left.min(initial=0)) - 1, -1):
            upto = int(np.searchsorted(-right[entering], -column, "left"))
            fresh = entering[arrived:upto].astype(np.int32)
            arrived = upto
            order = np.concatenate([fresh, order_file.read()])
            common = np.concatenate([np.zeros(len(fresh), np.uint8), common_file.read()])
            if len(fresh) < len(common):
                common[len(fresh)] = 0
            can = np.flatnonzero(left[order] <= column)
            symbols = text[anchors[order[can]] + column]
            moved = np.argsort(symbols, kind="stable")
            tails, symbols = can[moved], symbols[moved]
            now = np.zeros(len(tails), np.int64)
            at = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
            if len(at):
                bounds = np.stack([tails[at - 1] + 1, tails[at] + 1], 1).ravel()
                now[at] = 1 + np.minimum.reduceat(np.append(common, 0), bounds)[::2].astype(np.int64)
            order, common = order[tails], np.minimum(now, most).astype(np.uint8)
            order_file.write(order)
            common_file.write(common)
            yield column, order, symbols, common


def repeats_in(text, starts, lengths, anchors, uid, first, length: int, folder: str) -> np.ndarray:
    """For each place of a collection's text, whether the window there repeats an earlier one of the collection."""
    removed = np.zeros(len(text), bool)
    for column, order, _, common in columns_of(text, starts, starts + lengths, anchors, length, folder):
        close = common >= length
        if not close.any():
            continue
        inside = close | np.append(close[1:], False)
        group, piece = np.cumsum(~close)[inside], order[inside]
        place = anchors[piece] + column
        at = first[piece] + (place - starts[piece])
        by = np.lexsort((at, uid[piece], group))
        head = np.concatenate([[True], group[by][1:] != group[by][:-1]])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
        same = (uid[piece][by] == uid[piece][by][lead]) & (at[by] == at[by][lead])
        removed[place[by][~same]] = True
    return removed


def removed_ranges(sent: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """(uid, start, stop) byte ranges that repeat an earlier string."""
    folder = new_folder(sent.sparkSession, "suffix-columns")

    def ranges(uid, start, stop):
        kinds = [pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip((uid, start, stop), kinds)], ["uid", "start", "stop"])

    def finish(held):
        blobs = []
        for direct, blob in held:
            if direct:
                yield ranges(*unpack(blob, *DIRECT_KINDS))
            else:
                blobs.append(unpack(blob, *PIECE_KINDS))
        if not blobs:
            return
        hashed, uid, first, count, lead = (np.concatenate([b[k] for b in blobs]) for k in range(5))
        text = np.concatenate([b[5] for b in blobs])
        lengths = count.astype(np.int64) + length - 1
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.lexsort((first, uid, hashed))
        data, pending, size = text.tobytes(), [], 0
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(hashed[order]) != 0])), [len(order)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            different: dict[bytes, int] = {}
            out = []
            for i in order[a:b].tolist():
                piece = data[starts[i] : starts[i] + lengths[i]]
                earlier = different.setdefault(piece, i)
                if earlier != i and (uid[earlier], first[earlier]) != (uid[i], first[i]):
                    out.append(i)
            if out:
                yield ranges(uid[out], first[out].astype(np.int64), first[out] + lengths[out])
            if len(different) > 1:
                pending += different.values()
                size += sum(map(len, different))
            if size > COLLECTION_SYMBOLS:
                yield from collection(pending, text, starts, lengths, lead, uid, first)
                pending, size = [], 0
        if pending:
            yield from collection(pending, text, starts, lengths, lead, uid, first)

    def collection(pieces, text, starts, lengths, lead, uid, first):
        some = np.array(pieces)
        body = np.concatenate([text[starts[i] : starts[i] + lengths[i]] for i in pieces])
        own = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
        gone = repeats_in(body, own, lengths[some], own + lead[some], uid[some], first[some].astype(np.int64), length, folder)
        place = np.flatnonzero(gone)
        if len(place):
            owner = np.searchsorted(own, place, "right") - 1
            run = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(owner) != 0)])
            head = np.flatnonzero(run)
            tail = np.append(head[1:], len(place)) - 1
            low = first[some][owner[head]] + place[head] - own[owner[head]]
            yield ranges(uid[some][owner[head]], low, low + (place[tail] - place[head]) + length)

    return by_bucket(sent, finish, "uid long, start long, stop long", n_buckets)


def merged(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that sorted or unsorted (start, stop) rows cover."""
    out: list[list[int]] = []
    for start, stop in sorted(map(tuple, ranges)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def with_uids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(uid, text) and (uid, doc_id): uid is the id itself, or where ids repeat or are null, a number in their order.

    Rows that share an id and a text are one document; texts that share an id follow each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if not repeated.limit(1).count():
        return docs.select(F.col("doc_id").alias("uid"), "text"), None
    docs = docs.withColumn("body", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    numbered = docs.select("doc_id", "body").distinct().orderBy("doc_id", "body").withColumn("uid", F.monotonically_increasing_id())
    numbered = materialize(numbered, "uids").withColumnsRenamed({"doc_id": "__id", "body": "__body"})
    joined = docs.join(numbered, docs["doc_id"].eqNullSafe(numbered["__id"]) & (docs["body"] == numbered["__body"]))
    return joined.select("uid", "text"), numbered.select(F.col("uid"), F.col("__id").alias("doc_id"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte ranges).

    Texts are UTF-8 bytes, null is empty; texts shorter than `length` lose nothing. A string is removed if the same
    string starts earlier, in a smaller id or before it in the same text, judged on the input. A null id comes first.
    """
    if not ANCHOR <= length < ANCHOR + 256:
        raise ValueError(f"a string has {ANCHOR} to {ANCHOR + 255} bytes")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n_buckets = max(1, math.ceil(size / BUCKET_BYTES))
    rows, names = with_uids(docs)
    frequent = frequent_anchors(rows, length, size)
    answers = repeated_anchors(send_anchors(rows, length, n_buckets), n_buckets, frequent)
    asked = rows.join(pieces_by_document(answers, n_buckets), "uid", "left")
    ranges = removed_ranges(send_pieces(asked, length, n_buckets), length, n_buckets)
    spans = ranges.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                gone = merged([(s["start"], s["stop"]) for s in spans or []])
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                runs = [{"start": a, "stop": b} for a, b in gone]
                out.append((doc_id, len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), runs))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
    # both joins take the texts dealt by uid, so the second reuses the first one's exchange
    out = rows.join(spans, "uid", "left").select("uid", "text", "spans").mapInArrow(run, schema)
    if names is None:
        return out
    names = names.withColumnRenamed("doc_id", "__id")
    return out.join(names, out["doc_id"] == names["uid"]).withColumn("doc_id", F.col("__id")).select(*out.columns)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
