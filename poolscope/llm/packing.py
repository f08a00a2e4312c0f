"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit: every packing task keeps at most `open_bins` open bins, indexed by a bitset over free
space. A piece goes into the open bin with the least sufficient free space; when a bin too many would be open, the
fullest one closes. Texts are tokenised where they are read; what travels from there to the packing tasks is one narrow
row per piece. The number of packing tasks follows the number of tokens, so that the bins each leaves open are few
beside those it has filled, however many tasks read the texts.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolscope.llm.common import byte_chunks, materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = f"{PIECES}, sequence_id long, offset long"
CAPACITY = 2048
OPEN_BINS = 1024
#: Tokens that one packing task takes, about.
TASK_TOKENS = 1 << 25
#: Bytes of texts that are tokenised at once.
SLICE_BYTES = 4_000_000
#: A byte-level tokenizer first splits a text into words: runs of letters, of digits or of other characters, each with a space
#: before it at most, short forms like 't, and white space. So the ids of a text are those of its parts, one after the other,
#: if it is cut only where such a word ends for certain. That is told by kinds of bytes: white space, ASCII letters, digits and
#: other visible characters, the apostrophe, all others.
SPACE, LETTER, DIGIT, MARK, QUOTE, OTHER = range(6)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[0x21:0x7F] = MARK
KINDS[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = SPACE
KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = LETTER
KINDS[0x30:0x3A] = DIGIT
KINDS[0x27] = QUOTE
#: The pairs of kinds, six times the former plus the latter, between which a text is cut.
CUTS = np.zeros((6, 6), bool)
CUTS[1:, SPACE] = CUTS[LETTER, DIGIT:OTHER] = CUTS[MARK, [LETTER, DIGIT]] = CUTS[DIGIT, [LETTER, MARK, QUOTE]] = True
CUTS = CUTS.ravel()
#: What only some libraries take for white space: a text with any of it, or with an added token, is cut before white space that
#: follows an ASCII character and nowhere else.
UNCLEAR_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")
#: Parts that a worker remembers, twice so many at most, those met last: parts that don't end in white space, of so many bytes
#: at most.
REMEMBERED, WORD_BYTES = 200_000, 64


class Encoder:
    """The ids of texts as little-endian 32-bit bytes, by a file of the tokenizers library; Spark's tasks are the parallelism.

    Added tokens in a text count as such, none is put in.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        pre = told.get("pre_tokenizer") or {}
        self.byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not told.get("normalizer")
        # bytes that each id stands for: a byte-level vocabulary writes a byte as a character
        self.sizes = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(word)
        for t in told["added_tokens"]:
            self.sizes[t["id"]] = len(t["content"].encode())
        # an added token may hold white space or take that around it
        self.byte_level &= not any(t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in told["added_tokens"])
        self.odd = "|".join([UNCLEAR_SPACE.pattern, *(re.escape(t["content"]) for t in told["added_tokens"])])

    def forget(self) -> None:
        """Leave no words in a worker that goes on to other work."""
        self.known, self.older = {}, {}

    def _cut(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, bool]:
        """Where the parts of texts begin, and the end; whether any text holds unclear white space or an added token."""
        if not self.byte_level:
            return np.unique(offsets), False
        kinds = KINDS[data]
        pairs = kinds[:-1] * np.uint8(6) + kinds[1:]
        cut = CUTS[pairs]
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        for k in odd.tolist():
            inside = slice(offsets[k], offsets[k + 1] - 1)
            cut[inside] &= (kinds[1:][inside] == SPACE) & (kinds[:-1][inside] != OTHER)
        ends = offsets[(offsets > 0) & (offsets < len(data))]
        cut[ends - 1] = True
        return np.concatenate([[0], np.flatnonzero(cut) + 1, [len(data)]]), len(odd) > 0

    def parts(self, text: str) -> list[str]:
        data = np.frombuffer(text.encode(), np.uint8)
        at = self._cut(np.array([0, len(data)]), data)[0].tolist() if len(data) else [0]
        return [data[i:j].tobytes().decode() for i, j in zip(at, at[1:])]

    def _each(self, texts: list[bytes]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _together(self, spaced: list[bytes], bare: list[bytes]) -> list[bytes]:
        """The ids of words that end without white space, read as one text and cut by their bytes.

        The first ones begin with white space. Each of the others gets a line feed before it, which is a word of its own there.
        """
        text = b"".join([*spaced, *(b"\n" + w for w in bare)]).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        added = np.arange(len(spaced) + len(bare)) >= len(spaced)
        ends = np.cumsum(np.array([*map(len, spaced), *map(len, bare)], np.int64) + added)
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 1
        starts = np.concatenate([[0], cuts[:-1]]) + added
        data = ids.tobytes()
        return [data[i:j] for i, j in zip((4 * starts).tolist(), (4 * cuts).tolist())]

    def _read(self, parts: pa.Array, any_odd: bool) -> list[bytes]:
        """The ids of different parts: remembered, or read now."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        words = parts.to_pylist()
        known, older = self.known, self.older
        out, new = list(map(known.get, words)), []
        for k in [k for k, got in enumerate(out) if got is None]:
            got = older.get(words[k])
            if got is None:
                new.append(k)
            else:
                out[k] = known[words[k]] = got
        at = np.array(new, np.int64)
        offsets, data = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1), np.frombuffer(parts.buffers()[2], np.uint8)
        starts, ends = offsets[at], offsets[at + 1]
        word = (ends - starts <= WORD_BYTES) & (KINDS[data[ends - 1]] != SPACE) & self.byte_level
        if any_odd:
            odd = re.compile(self.odd)
            word &= np.array([not odd.search(words[k].decode()) for k in new], bool)
        space = KINDS[data[starts]] == SPACE
        spaced, bare, others = (at[some].tolist() for some in (word & space, word & ~space, ~word))
        if spaced or bare:
            for k, ids in zip(spaced + bare, self._together([words[k] for k in spaced], [words[k] for k in bare])):
                out[k] = known[words[k]] = ids
        if others:
            for k, ids in zip(others, self._each([words[k] for k in others])):
                out[k] = ids
        return out

    def read(self, offsets: np.ndarray, data: np.ndarray) -> list[bytes]:
        """The ids of each of the texts that lie in data one after the other."""
        if not len(data):
            return [b""] * (len(offsets) - 1)
        at, any_odd = self._cut(offsets, data)
        every = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self._read(every.dictionary, any_odd), pa.large_binary()).take(every.indices)
        cuts = np.frombuffer(ids.buffers()[1], np.int64, len(at))[np.searchsorted(at, offsets)].tolist()
        got = memoryview(ids.buffers()[2] or b"")
        return [bytes(got[i:j]) for i, j in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        slices = byte_chunks(pa.array(texts, pa.large_string()), SLICE_BYTES)
        return [ids for _, offsets, data in slices for ids in self.read(offsets, data)]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class OpenBins:
    """Open bins keyed by free space; bit f of `bits` is set if some open bin has f places free."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.bits, self.count = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        ids = self.by_free[free]
        got = ids.pop()
        if not ids:
            self.bits &= ~(1 << free)
        self.count -= 1
        return got

    def place(self, length: int) -> tuple[int, int]:
        """The sequence and the offset in it where a piece of this length goes."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.next_id
            self.next_id += 1
            if length < free and self.count >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        left = free - length
        if left:
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.count += 1
        return sequence, self.capacity - free


def pieces(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: only longer documents are cut, and the remainder comes first."""
    head = n_ids % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n_ids, capacity)]


def tokenised(docs: DataFrame, tokenizer_path: str | None, capacity: int, separator_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        encoder = encoder_of(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"))
        end = array("I", [separator_id]).tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, offsets, data in byte_chunks(batch.column(1), SLICE_BYTES):
                rows = []
                for doc_id, got in zip(ids[at:], encoder.read(offsets, data)):
                    got += end
                    for k, (start, length) in enumerate(pieces(len(got) // 4, capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(got[4 * start : 4 * (start + length)])))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        encoder.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    separator_id: int = 0,
) -> DataFrame:
    """One row per piece with its sequence and offset.

    Null or empty texts are the separator alone; texts of any length and make are tokenised whole; repeated rows are
    packed once each; rows with a null id are packed like others; other columns are ignored; an empty table gives no
    rows. Sequences never span packing tasks. Pieces come to them dealt and ordered by hash, so a task that is repeated
    makes the same sequences.
    """
    cut = materialize(tokenised(docs, tokenizer_path, capacity, separator_id), "packing-pieces")
    n_tasks = math.ceil((cut.agg(F.sum("length")).first()[0] or 1) / TASK_TOKENS)

    def run(batches):
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(3).to_pylist()]
            columns = [*batch.columns, pa.array([s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "offset"])

    row = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cut.repartition(n_tasks, row).sortWithinPartitions(row, "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, SCHEMA)
