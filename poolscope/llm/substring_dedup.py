"""Removal of word sequences that repeat an earlier document, by suffix trees partitioned by variable-length prefixes.

A window is `length` consecutive words; a document loses the windows that also start in a document with a smaller id.

1. A window's anchor is its run of ANCHOR words with the smallest hash, so equal windows have equal anchors. Consecutive
   windows with one anchor form a piece; pieces whose anchor is met in one document only can't repeat and go no further.
2. Suffixes are dealt by the words from their anchor on, since so the windows of a piece travel together (shipped one by
   one, each with its words, they took over three times as much). Tasks count the prefixes of these sequences, longer ones
   only where the shorter is frequent, and prefixes with more than a fixed share of all are extended by one word: groups
   fit into a task's memory, whatever the words. Where all words of an anchor are still too frequent, each window goes on
   its own, by all of its words.
3. Of equal pieces a task sends those in its smallest document; the others are known to repeat.
4. A group sorts the suffixes of its windows, cut at `length` words, and takes the common prefixes of neighbours: the
   subtree's internal nodes at a depth of `length` words are the repeats. All their suffixes but those in the smallest
   document are removed.
5. Removed ranges go back to their documents.

Within a task words are told apart by a hash of 64 bits, in a group by their bytes. A passage that very many documents
share reaches its group once per task.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.blobs import by_bucket, dealt, pack, unpack
from poolscope.llm.common import BASE, INVERSE, WHITE_SPACE, byte_chunks, materialize, mix64, powers, prefix_hash
from poolscope.llm.suffix_dedup import with_uids

LENGTH, ANCHOR = 13, 7
#: Bytes of text for each bucket of anchors and each group of suffixes, about.
BUCKET_BYTES = 24 << 20
#: Prefixes with more than this part of a bucket's pieces are extended; at most 2**22 prefixes of each length are.
PART, MOST_PREFIXES = 4, 1 << 22
#: A prefix that a task meets so rarely, among the words it holds, isn't reported.
LEAST_COUNT = 4
#: Words and anchors that a task gathers before it sends them on.
FLUSH_WORDS, FLUSH_ANCHORS = 3_000_000, 2_000_000
POSITION_BITS, HASH_BITS = 24, 48
SPACE = np.zeros(256, bool)
SPACE[[ord(c) for c in WHITE_SPACE]] = True


def words_in(offsets: np.ndarray, data: np.ndarray):
    """(start, end, row) of the words of a chunk's texts, and a 64-bit hash of each."""
    space = SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = ~space[cuts], ~space[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    sums = prefix_hash(data)
    return starts, ends, row, mix64((sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts])


def extended(hashed: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a prefix that goes on with one more word."""
    return mix64(hashed * np.uint64(BASE) + code)


def anchors_of(row: np.ndarray, code: np.ndarray, length: int):
    """(first word, windows, place of the anchor, its hash) of each piece; words are counted from the chunk's first."""
    size = min(ANCHOR, length)
    n, span = len(code) - length + 1, length - size + 1
    if n < 1:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    gram = np.zeros(len(code) - size + 1, np.uint64)
    for k in range(size):
        gram = gram * np.uint64(BASE) + code[k : k + len(gram)]
    gram = mix64(gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    firsts, counts, places = [], [], []
    step = 1 << 22  # positions must fit into POSITION_BITS
    for base in range(0, n, step):
        least = gram[base : base + step + span - 1] & ~low
        least |= np.arange(len(least), dtype=np.uint64)
        wide, total = 1, len(least)
        while 2 * wide <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        total -= span - 1
        least = np.minimum(least[:total], least[span - wide : span - wide + total])
        start = np.arange(base, base + total)
        valid = row[start] == row[start + length - 1]
        start, place = start[valid], (least[valid] & low).astype(np.int64) + base
        if not len(start):
            continue
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        firsts.append(start[cut])
        counts.append(np.diff(np.append(cut, len(start))))
        places.append(place[cut])
    if not firsts:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    first, count, place = (np.concatenate(a) for a in (firsts, counts, places))
    return first, count, place, gram[place] >> np.uint64(64 - HASH_BITS) << np.uint64(64 - HASH_BITS)


def prefix_counts(docs: DataFrame, length: int, share: float) -> DataFrame:
    """(size, hash, n) of prefixes at more than `share` of a task's anchors; size 0 counts all anchors."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            before = np.cumsum([0, *(len(h[0]) for h in held)])
            at = np.concatenate([h[1] + b for h, b in zip(held, before)])
            code = np.concatenate([h[0] for h in held])
            held.clear()
            least = max(share * len(at), LEAST_COUNT)
            sizes, hashes, counts = [np.zeros(1)], [np.zeros(1, np.uint64)], [np.full(1, len(at))]
            hashed = np.zeros(len(at), np.uint64)
            for size in range(1, min(ANCHOR, length) + 1):
                if not len(at):
                    break
                hashed = extended(hashed, code[at + size - 1])
                found, where, n = np.unique(hashed, return_inverse=True, return_counts=True)
                often = n > least
                sizes.append(np.full(often.sum(), size))
                hashes.append(found[often])
                counts.append(n[often])
                go_on = often[where]
                at, hashed = at[go_on], hashed[go_on]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts), pa.int64())],
                ["size", "hash", "n"],
            )

        total = 0
        for batch in batches:
            for _, offsets, data in byte_chunks(batch.column(0)):
                _, _, row, code = words_in(offsets, data)
                held.append((code, anchors_of(row, code, length)[2]))
                total += len(row)
                if total > FLUSH_WORDS:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    counts = docs.select("text").mapInArrow(run, "size int, hash long, n long")
    return counts.groupBy("size", "hash").agg(F.sum("n").alias("n"))


def heavy_prefixes(docs: DataFrame, length: int, share: float) -> dict[int, np.ndarray]:
    """By length the sorted hashes of the prefixes at more than `share` of all anchors: at most 1 / share a length.

    A sum lacks at most that share, and LEAST_COUNT for each report, so no prefix with clearly more than twice the
    share is missed.
    """
    counts = materialize(prefix_counts(docs, length, share), "prefixes")
    total = counts.filter("size = 0").agg(F.sum("n")).first()[0] or 0
    heavy: dict[int, list[int]] = {}
    for r in counts.filter((F.col("size") > 0) & (F.col("n") > share * total)).collect():
        heavy.setdefault(r["size"], []).append(r["hash"])
    return {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in heavy.items()}


ANCHOR_KINDS = ("<u8", "<i8", "<i8", "<i4", "u1", "u1")  # anchor, document, its place in the order less its number, first word, windows, anchor's place
RANGE = np.dtype([("first", "<i4"), ("count", "u1"), ("lead", "u1")])


def send_anchors(docs: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """(bucket, sure, blob) of all anchors. Those that a task meets in two documents are sure to be wanted: they are dealt
    by document, and one row with 0 windows stands for them.
    """

    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            arrays = [np.concatenate(a).astype(k) for a, k in zip(zip(*held), ANCHOR_KINDS)]
            held.clear()
            if not arrays or not len(arrays[0]):
                return
            order = np.lexsort((arrays[1] + arrays[2], arrays[0]))
            arrays = [a[order] for a in arrays]
            place = arrays[1] + arrays[2]
            head = np.flatnonzero(np.concatenate([[True], arrays[0][1:] != arrays[0][:-1]]))
            tail = np.append(head[1:], len(order)) - 1
            several = place[head] != place[tail]
            sure = np.repeat(several, tail - head + 1)
            alone = [np.concatenate([a[~sure], a[head[several]]]) for a in arrays]
            alone[4][(~sure).sum() :] = 0
            rows = [(k, False, pack(*some)) for k, some in dealt(alone, n_buckets)]
            known = [a[sure] for a in arrays]
            rows += [(k, True, pack(*some)) for k, some in dealt(known, n_buckets, mix64(known[1].view("<u8")))]
            kinds, names = [pa.int32(), pa.bool_(), pa.binary()], ["bucket", "sure", "blob"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            uid, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, offsets, data in byte_chunks(batch.column(2)):
                _, _, row, code = words_in(offsets, data)
                first, count, spot, anchor = anchors_of(row, code, length)
                own = row[first]
                begin = np.searchsorted(row, np.arange(len(offsets)))[own]
                held.append([anchor, uid[at + own], place[at + own] - uid[at + own], first - begin, count, spot - first])
            if sum(len(h[0]) for h in held) > FLUSH_ANCHORS:
                yield from flush()
        yield from flush()

    return docs.select("uid", "place", "text").mapInArrow(run, "bucket int, sure boolean, blob binary")


PIECE_KINDS = ("<i8", "<i4", "u1", "u1")  # document, first word, windows, anchor's place


def repeated_anchors(sent: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, blob) by document of the pieces whose anchor is met in more than one document."""

    def finish(held):
        asked = [unpack(b, *ANCHOR_KINDS) for sure, b in held if not sure]
        for sure, blob in held:
            if sure:
                _, uid, _, *piece = unpack(blob, *ANCHOR_KINDS)
                yield from answers(uid, *piece)
        if asked:
            anchor, uid, place, first, count, lead = (np.concatenate(a) for a in zip(*asked))
            place = uid + place
            order = np.lexsort((place, anchor))
            head = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
            ends = np.append(head[1:], len(order))
            several = (place[order][head] != place[order][ends - 1]) | (np.minimum.reduceat(count[order], head) == 0)
            keep = order[np.repeat(several, ends - head)]
            keep = keep[count[keep] > 0]
            yield from answers(uid[keep], first[keep], count[keep], lead[keep])

    def answers(*arrays):
        rows = [(k, pack(*some)) for k, some in dealt(list(arrays), n_buckets, mix64(arrays[0].view("<u8")))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "blob"])

    return by_bucket(sent, finish, "bucket int, blob binary", n_buckets)


def pieces_by_document(answers: DataFrame, n_buckets: int) -> DataFrame:
    """(uid, blob of RANGE), one row for each document that has pieces to look at."""

    def finish(held):
        uid, first, count, lead = (np.concatenate(a) for a in zip(*(unpack(b, *PIECE_KINDS) for (b,) in held)))
        by = np.argsort(uid, kind="stable")
        uid, rows = uid[by], np.rec.fromarrays([first[by], count[by], lead[by]], dtype=RANGE)
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]])), [len(uid)]])
        for at in range(0, len(cuts) - 1, 20_000):
            some = cuts[at : at + 20_001]
            blobs = pa.array([rows[a:b].tobytes() for a, b in zip(some[:-1], some[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(uid[some[:-1]], pa.int64()), blobs], ["uid", "blob"])

    return by_bucket(answers, finish, "uid long, blob binary", n_buckets)


def group_hash(code: np.ndarray, at: np.ndarray, length: int, heavy: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the shortest prefix of each sequence that isn't to be extended, and whether all `length` words are."""
    out, left, hashed = np.zeros(len(at), np.uint64), np.arange(len(at)), np.zeros(len(at), np.uint64)
    for size in range(1, length + 1):
        hashed = extended(hashed, code[at[left] + size - 1])
        out[left] = hashed
        known = heavy.get(size, np.zeros(0, np.uint64))
        longer = known[np.minimum(np.searchsorted(known, hashed), len(known) - 1)] == hashed if len(known) else np.zeros(len(left), bool)
        left, hashed = left[longer], hashed[longer]
    too_often = np.zeros(len(at), bool)
    too_often[left] = True
    return out, too_often


SUFFIX_KINDS = ("<u4", "<i8", "<i8", "<i4", "u1", "<i4", "u1")  # words, document, place less it, first word, windows, lengths and bytes of the words
REMOVED_KINDS = ("<i8", "<i4", "<i4")  # document, first and last + 1 removed word


def send_suffixes(asked: DataFrame, length: int, n_buckets: int, heavy: dict[int, np.ndarray]) -> DataFrame:
    """(bucket, direct, blob): a task's pieces of its smallest documents, and directly the ranges that repeat one of them."""

    def run(batches):
        words: list[list[np.ndarray]] = []
        pieces: list[list[np.ndarray]] = []

        def flush():
            if not pieces:
                return
            at_word = np.cumsum([0, *(len(w[1]) for w in words)])
            at_byte = np.cumsum([0, *(len(w[0]) for w in words)])
            text = np.concatenate([w[0] for w in words])
            code = np.concatenate([w[1] for w in words])
            starts, ends = (np.concatenate([w[k] + b for w, b in zip(words, at_byte)]) for k in (2, 3))
            begin = np.concatenate([p[0] + b for p, b in zip(pieces, at_word)])
            uid, place, first, count, lead = (np.concatenate([p[k] for p in pieces]).astype(np.int64) for k in range(1, 6))
            words.clear()
            pieces.clear()
            group, often = group_hash(code, begin + lead, min(ANCHOR, length), heavy)
            if often.any():  # window by window
                each = count[often]
                step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                alone = [np.repeat(a[often], each) for a in (uid, place)]
                begin_alone, first_alone = (np.repeat(a[often], each) + step for a in (begin, first))
                own = np.zeros(len(step), np.uint64)
                for k in range(length):
                    own = extended(own, code[begin_alone + k])
                uid, place = (np.concatenate([a[~often], b]) for a, b in zip((uid, place), alone))
                begin, first, count = np.append(begin[~often], begin_alone), np.append(first[~often], first_alone), np.append(count[~often], np.ones(len(step), np.int64))
                group = np.append(group[~often], own)
            n_words = count + length - 1
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * powers(BASE, len(code)))])
            same = mix64((sums[begin + n_words] - sums[begin]) * powers(INVERSE, len(code) + 1)[begin]) + n_words.astype(np.uint64)
            _, kind = np.unique(same, return_inverse=True)
            least = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, kind, place)
            go_on = place == least[kind]
            out = []
            if not go_on.all():
                columns = [uid[~go_on].astype("<i8"), first[~go_on].astype("<i4"), (first + n_words)[~go_on].astype("<i4")]
                out += [(k, True, pack(*some)) for k, some in dealt(columns, n_buckets, mix64(columns[0].view("<u8")))]
            kept = np.flatnonzero(go_on)
            kept = kept[np.argsort(group[kept], kind="stable")]
            for k, (some,) in dealt([kept], n_buckets, group[kept]):
                n = n_words[some]
                spread = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                _, one, word = np.unique(code[spread], return_index=True, return_inverse=True)
                where = spread[one]
                lengths = ends[where] - starts[where]
                body = text[np.repeat(starts[where] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
                arrays = (word, uid[some], place[some] - uid[some], first[some], count[some], lengths)
                out.append((k, False, pack(*(a.astype(kind) for a, kind in zip(arrays, SUFFIX_KINDS)), body)))
            kinds, names = [pa.int32(), pa.bool_(), pa.binary()], ["bucket", "direct", "blob"]
            for a in range(0, len(out), 32):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out[a : a + 32]], t) for k, t in enumerate(kinds)], names)

        total = 0
        for batch in batches:
            uid, place, blobs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for a, offsets, data in byte_chunks(batch.column(2)):
                ranges = [(k, np.frombuffer(blobs[a + k], RANGE)) for k in range(len(offsets) - 1) if blobs[a + k]]
                if not ranges:
                    continue
                starts, ends, row, code = words_in(offsets, data)
                base = np.searchsorted(row, np.arange(len(offsets)))
                own = np.repeat([k for k, _ in ranges], [len(r) for _, r in ranges])
                some = np.concatenate([r for _, r in ranges])
                words.append([data, code, starts, ends])
                pieces.append([base[own] + some["first"], uid[a + own], place[a + own], some["first"], some["count"], some["lead"]])
                # chunks are counted from their first word, so a flush takes whole chunks
                total += len(row)
                if total > FLUSH_WORDS:
                    yield from flush()
                    total = 0
        yield from flush()

    return asked.select("uid", "place", "text", "blob").mapInArrow(run, "bucket int, direct boolean, blob binary")


def sorted_suffixes(words: np.ndarray, n_words: int) -> np.ndarray:
    """The order of suffixes (columns of words) by their words; several words go into one sort key."""
    bits = max(1, int(n_words).bit_length())
    each = 63 // bits
    keys = []
    for at in range(0, len(words), each):
        key = np.zeros(words.shape[1], np.int64)
        for column in words[at : at + each]:
            key = key << bits | column
        keys.append(key)
    return np.lexsort(keys[::-1])


def common_prefixes(words: np.ndarray) -> np.ndarray:
    """The words that each sorted suffix shares with the one before; 0 for the first."""
    out = np.zeros(words.shape[1], np.int64)
    same = np.ones(words.shape[1] - 1, bool)
    for column in words:
        same &= column[1:] == column[:-1]
        out[1:] += same
    return out


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the sorted suffixes below each internal node of the subtree that is the highest of at least `depth`."""
    deep = common >= depth
    edge = np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)


def removed_ranges(sent: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """(uid, start, stop) ranges of words that repeat an earlier document."""

    def ranges(uid, start, stop):
        kinds = [pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip((uid, start, stop), kinds)], ["uid", "start", "stop"])

    def finish(held):
        known: dict[bytes, int] = {}
        columns = []
        for direct, blob in held:
            if direct:
                yield ranges(*(a.astype(np.int64) for a in unpack(blob, *REMOVED_KINDS)))
                continue
            word, uid, place, first, count, lengths, body = unpack(blob, *SUFFIX_KINDS)
            body, ends = body.tobytes(), np.cumsum(lengths).tolist()
            ids = np.array([known.setdefault(body[a:b], len(known)) for a, b in zip([0, *ends], ends)], np.int32)
            count = count.astype(np.int64)
            window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(np.cumsum(count + length - 1) - (count + length - 1), count) + window
            suffixes = ids[word][start[None, :] + np.arange(length)[:, None]]
            columns.append((suffixes, np.repeat(uid, count), np.repeat(uid + place, count), np.repeat(first, count) + window))
        if not columns:
            return
        words, uid, place, index = (np.concatenate(a, axis=-1) for a in zip(*columns))
        order = sorted_suffixes(words, len(known))
        first, last = deep_nodes(common_prefixes(words[:, order]), length)
        if not len(first):
            return
        below = order[np.repeat(first - np.concatenate([[0], np.cumsum(last - first)[:-1]]), last - first) + np.arange((last - first).sum())]
        least = np.minimum.reduceat(place[below], np.concatenate([[0], np.cumsum(last - first)[:-1]]))
        gone = below[place[below] > np.repeat(least, last - first)]
        gone = gone[np.lexsort((index[gone], uid[gone]))]
        if not len(gone):
            return
        cut = np.flatnonzero(np.concatenate([[True], (uid[gone[1:]] != uid[gone[:-1]]) | (np.diff(index[gone]) > 1)]))
        stop = gone[np.append(cut[1:], len(gone)) - 1]
        yield ranges(uid[gone[cut]], index[gone[cut]].astype(np.int64), index[stop].astype(np.int64) + length)

    return by_bucket(sent, finish, "uid long, start long, stop long", n_buckets)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def cut_texts(rows: DataFrame) -> DataFrame:
    """The report of rows (doc_id, text, spans, ...), whose spans are ranges of words that go."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            for a, offsets, data in byte_chunks(batch.column(1)):
                n = len(offsets) - 1
                starts, ends, row, _ = words_in(offsets, data)
                base = np.searchsorted(row, np.arange(n + 1))
                some = lists.slice(a, n)
                owner, flat = pc.list_parent_indices(some).to_numpy(), pc.list_flatten(some)
                mark = np.zeros(len(row) + 1, np.int32)
                np.add.at(mark, base[owner] + flat.field("start").to_numpy(), 1)
                np.add.at(mark, base[owner] + flat.field("stop").to_numpy(), -1)
                gone = np.cumsum(mark[:-1]) > 0
                kept = np.flatnonzero(~gone)
                edge = np.zeros(len(data) + 1, np.int8)
                edge[starts[kept]] += 1
                edge[ends[kept]] -= 1
                copy, mask = data.copy(), np.cumsum(edge[:-1], dtype=np.int8) > 0
                between = ends[kept[:-1][row[kept[1:]] == row[kept[:-1]]]]
                copy[between], mask[between] = 32, True
                cuts = np.concatenate([[0], np.cumsum(mask)])[offsets]
                body = copy[mask].tobytes()
                hashes = [hashlib.sha256(body[i:j]).hexdigest() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                lost = np.flatnonzero(gone)
                head = np.flatnonzero(np.concatenate([[True], (np.diff(lost) != 1) | (row[lost[1:]] != row[lost[:-1]])])) if len(lost) else lost
                first, last = lost[head], lost[np.append(head[1:], len(lost)) - 1] if len(lost) else lost
                spans = pa.StructArray.from_arrays([pa.array(first - base[row[first]]), pa.array(last - base[row[first]] + 1)], ["start", "stop"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(n + 1)), pa.int32()), spans)
                n_removed = np.bincount(row[gone], minlength=n)
                arrays = [ids.slice(a, n), pa.array(np.diff(base)), pa.array(n_removed), pa.array(hashes, pa.string()), spans.cast(SPANS)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return rows.mapInArrow(run, REPORT)


def substring_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the words that stay, and the removed spans (ranges of words).

    docs: (doc_id, text, ...); words are runs without ASCII white space, taken as they are; a null text has none, and texts
    of fewer than `length` words lose nothing. Windows are judged on the input, and only against documents with a smaller
    id: repeats within a document stay, as do those between rows that share an id. A null id is the smallest. Rows that
    share id and text are one document, reported for each. Other columns are not read. An empty table gives no rows.
    """
    if not 2 <= length <= 255:
        raise ValueError("a window has 2 to 255 words")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n_buckets = max(1, math.ceil(size / BUCKET_BYTES))
    share = max(1 / (PART * n_buckets), 1 / MOST_PREFIXES)
    rows, names = with_uids(docs)
    heavy = heavy_prefixes(rows, length, share)
    if names is None:
        rows = rows.select("uid", F.col("uid").alias("place"), "text")
    else:  # rows of one id have one place in the order
        least = names.groupBy("doc_id").agg(F.min("uid").alias("place"))
        places = names.join(least, names["doc_id"].eqNullSafe(least["doc_id"])).select("uid", "place")
        rows = rows.join(places, "uid").select("uid", "place", "text")
    sent = send_anchors(rows, length, n_buckets)
    asked = rows.join(pieces_by_document(repeated_anchors(sent, n_buckets), n_buckets), "uid", "left")
    ranges = removed_ranges(send_suffixes(asked, length, n_buckets, heavy), length, n_buckets)
    spans = ranges.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    # both joins take the same columns dealt by uid, so the second reuses the first one's exchange of the texts
    out = cut_texts(rows.join(spans, "uid", "left").select(F.col("uid").alias("doc_id"), "text", "spans", "place"))
    if names is None:
        return out
    names = names.withColumnRenamed("doc_id", "__id")
    return out.join(names, out["doc_id"] == names["uid"]).withColumn("doc_id", F.col("__id")).select(*out.columns)
