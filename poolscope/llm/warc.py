"""WARC archives in seekable Zstandard bundles.

Each writing task makes one bundle in the shared folder: records are grouped into independent frames, and a skippable
frame at the end holds the seek table (compressed and plain size of every frame). An index table maps record ids to
(bundle, frame, offset in the frame, length). Reading starts from the seek tables: every frame is a unit of work of its
own. A task that is repeated writes a bundle under a new name; the index names only bundles of committed tasks.
"""

from __future__ import annotations

import base64
import hashlib
import math
import struct

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.llm.common import materialize, new_folder

FRAME_BYTES = 1 << 20
#: Plain bytes that a reading task takes, about.
READ_BYTES = 32 << 20
LEVEL = 3
#: Format values of seekable Zstandard (fixed values): skippable frame's magic, seek table's magic.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, bundle string, frame int, offset long, length long"
FRAMES = "bundle string, frame int, start long, stored long, plain long"
RECORDS = "page_id long, record_type string, refers_to long, payload_digest string, body_bytes long, intact boolean"


def open_folder(uri: str):
    """File system and path of a URI, for the shared folder only."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response, or where refers_to is given a revisit without the payload."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>")
    lines.append(f"WARC-Date: {DATE}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    http = b""
    if refers_to is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    else:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + http + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0):
    """(headers, payload, next position) of the record at a position of a plain frame."""
    end = data.index(b"\r\n\r\n", at)
    head = data[at:end].decode().split("\r\n")
    if not head[0].startswith("WARC/"):
        raise ValueError("no WARC record at this position")
    headers = dict(line.split(": ", 1) for line in head[1:])
    size = int(headers["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if headers["WARC-Type"] == "response":
        block = block.split(b"\r\n\r\n", 1)[1]
    return headers, block, end + 4 + size + 4


def page_of(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix(ID_PREFIX)
    return int(number) if number else None


#: Sizes are 32-bit in the table. A frame is at most frame_bytes or one record, and Spark's strings end at 2 GiB.
def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", stored, plain) for stored, plain in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(file) -> list[tuple[int, int]]:
    """(compressed size, plain size) of each frame, from the footer at the end of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    entry = 12 if descriptor & 0x80 else 8
    file.seek(size - 9 - n * entry)
    table = file.read(n * entry)
    return [struct.unpack_from("<II", table, k * entry) for k in range(n)]


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write (page_id, url, payload, refers_to) rows as bundles under folder; returns the written index table."""
    spark = records.sparkSession

    def run(batches):
        import zstandard

        task = TaskContext.get()
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        name = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        sizes: list[tuple[int, int]] = []
        out, plain = None, bytearray()

        def close_frame():
            stored = compressor.compress(bytes(plain))
            out.write(stored)
            sizes.append((len(stored), len(plain)))
            plain.clear()

        for batch in batches:
            rows = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                got = record(page_id, url, (payload or "").encode(), refers_to)
                if plain and len(plain) + len(got) > frame_bytes:
                    close_frame()
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                rows.append((page_id, name, len(sizes), len(plain), len(got)))
                plain += got
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            names = ["page_id", "bundle", "frame", "offset", "length"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
        if out is not None:
            if plain:
                close_frame()
            out.write(seek_table(sizes))
            out.close()

    index = f"{folder}/index"
    records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def list_frames(index: DataFrame, folder: str) -> DataFrame:
    """One row per frame of the bundles that the index names, from their seek tables."""

    def run(batches):
        fs, path = open_folder(folder)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{path}/{name}") as file:
                    start = 0
                    for frame, (stored, plain) in enumerate(read_seek_table(file)):
                        rows.append((name, frame, start, stored, plain))
                        start += stored
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["bundle", "frame", "start", "stored", "plain"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return index.select("bundle").distinct().mapInArrow(run, FRAMES)


def read_frame(file, start: int, stored: int) -> bytes:
    import zstandard

    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(stored))


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles, parsed; `intact` tells whether a response's payload has the digest that it names."""

    def run(batches):
        fs, path = open_folder(folder)
        for batch in batches:
            for name, _, start, stored, _ in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{path}/{name}") as file:
                    data = read_frame(file, start, stored)
                rows, at = [], 0
                while at < len(data):
                    headers, payload, at = parse(data, at)
                    kind = headers["WARC-Type"]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers = page_of(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None
                    intact = kind == "revisit" or payload_digest(payload) == digest
                    rows.append((page_of(headers["WARC-Record-ID"]), kind, refers, digest, len(payload), intact))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                names = ["page_id", "record_type", "refers_to", "payload_digest", "body_bytes", "intact"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    frames = materialize(list_frames(index, folder), "warc-frames")
    n_tasks = math.ceil((frames.agg(F.sum("plain")).first()[0] or 1) / READ_BYTES)  # a given number is not coalesced
    return frames.repartition(n_tasks, "bundle", "frame").mapInArrow(run, RECORDS)


def read_record(spark: SparkSession, index: DataFrame, folder: str, page_id: int):
    """Headers and payload of one record by id: one index lookup, one range read, one frame decompressed."""
    row = index.filter(F.col("page_id") == page_id).first()
    if row is None:
        return None
    fs, path = open_folder(folder)
    with fs.open_input_file(f"{path}/{row['bundle']}") as file:
        sizes = read_seek_table(file)
        data = read_frame(file, sum(s for s, _ in sizes[: row["frame"]]), sizes[row["frame"]][0])
    headers, payload, _ = parse(data, row["offset"])
    return headers, payload


def archive(pages: DataFrame, min_revisit_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages as WARC bundles and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of pages with equal payloads of at least min_revisit_bytes, the one with the largest id is the response and the
    others revisit it. Null html is an empty payload; a null url has no target line; a null id loses to any other and
    is a response where its group has no other; rows that repeat an id and payload are alike. Extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("key", F.sha2(F.col("payload").cast("binary"), 256))
    newest = rows.groupBy("key").agg(F.max("page_id").alias("response_id"))
    large = F.octet_length("payload") >= min_revisit_bytes
    same = F.coalesce(F.col("page_id") == F.col("response_id"), F.col("response_id").isNull())
    records = rows.join(newest, "key").withColumn("refers_to", F.when(large & ~same, F.col("response_id")))
    index = write_bundles(records, folder)
    read = read_bundles(index, folder)
    responses = read.filter("record_type = 'response'")
    held = responses.groupBy(F.col("page_id").alias("response_id"), F.col("payload_digest").alias("held_digest")).agg(
        F.max("body_bytes").alias("held_bytes"), F.min("intact").alias("held_intact")
    )
    # the frames' contents are unknown to the planner, which would take them for few rows and broadcast them
    revisits = read.filter("record_type = 'revisit'").join(
        held.hint("merge"), (F.col("refers_to") == F.col("response_id")) & (F.col("payload_digest") == F.col("held_digest")), "left"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    out = responses.withColumn("payload_bytes", F.col("body_bytes")).select(*columns)
    return out.unionByName(
        revisits.withColumn("payload_bytes", F.col("held_bytes"))
        .withColumn("intact", F.coalesce("held_intact", F.lit(False)))
        .select(*columns)
    )
