"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A shard holds the records of a range of ids in ascending order. A record is

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

and its payload i64 id | u8 bytes per token id (2 where the vocabulary allows, else 4; NO_ID more where the id is null) | ids. All
are little-endian; a crc is rotated right by 15 bits and increased by a constant, so that a crc
over bytes that hold crcs stays sound. The index of a shard is one u64 per record: where it begins.
Tasks write under names of their own, and the manifest, written last, lists those that count, so
a repeated or lost attempt leaves no trace in what is read.

Defined results: a null or empty text is the end id alone; null ids come first and are read back as null; rows of equal id are ordered by a hash of
their text; equal rows are records of their own; a very long text is one record; an empty table gives no shard;
other input columns are not read. The manifest has one row per shard, and there are as many shards as SHARD bytes
of text go into the table (more of a table that is small for the executors at hand); a task holds one block of text and index at a time.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, text_buffer, tidy
from .tokens import BLOCK, encoder

END_ID = 2
#: Bytes of text of a shard, the least that a table is cut for, and what a row counts beside its text.
SHARD, LEAST_SHARD, ROW = 64 << 20, 1 << 20, 32
# Fixed value: flag of a null id.
NO_ID = 0x80
# Fixed value: what is added to a rotated crc.
MASK = 0xA282EAD8
MANIFEST = "shard long, path string, records long, tokens long, low long, high long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<qB", doc_id or 0, width | (NO_ID if doc_id is None else 0)) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked_crc(head)) + payload + struct.pack("<I", masked_crc(payload))


def read_frame(data: memoryview | bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """(id, token ids, where the next record begins); ValueError if a checksum is wrong."""
    head = bytes(data[at : at + 8])
    (n,) = struct.unpack("<Q", head)
    if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked_crc(head):
        raise ValueError(f"bad length at byte {at}")
    payload = bytes(data[at + 12 : at + 12 + n])
    if struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0] != masked_crc(payload):
        raise ValueError(f"bad record at byte {at}")
    doc_id, width = struct.unpack_from("<qB", payload)
    return None if width & NO_ID else doc_id, np.frombuffer(payload, f"<u{width & ~NO_ID}", offset=9).astype("<u4"), at + 16 + n


def write_records(docs: DataFrame, path: str, id_col: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write shards, indexes and the manifest under `path`, a URI that all executors can write to."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + ROW)).first()[0] or 0
    n = max(1, -(-size // SHARD), min(2 * spark.sparkContext.defaultParallelism, -(-size // LEAST_SHARD)))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        where, root = fs.FileSystem.from_uri(path)
        name, out, index = "", None, None
        at = records = tokens = 0
        low = high = None
        try:
            for batch in batches:
                if batch.num_rows and out is None:
                    name = f"part-{uuid.uuid4().hex}"
                    where.create_dir(root, recursive=True)
                    out, index = (where.open_output_stream(f"{root}/{name}.{kind}") for kind in ("records", "index"))
                data, offsets = text_buffer(batch.column("text"))
                names = batch.column("doc_id").to_pylist()
                for i, j in slices(offsets, BLOCK):
                    ids, cut = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    block, begins = [], []
                    for k in range(j - i):
                        record = frame(names[i + k], np.append(ids[cut[k] : cut[k + 1]], np.uint32(end_id)), width)
                        begins.append(at)
                        at += len(record)
                        block.append(record)
                    out.write(b"".join(block))
                    index.write(np.asarray(begins, "<u8").tobytes())
                    tokens += len(ids) + j - i
                if names:
                    records += len(names)
                    low = next((x for x in names if x is not None), None) if low is None else low
                    high = names[-1]
        finally:
            for stream in (out, index):
                if stream is not None:
                    stream.close()
        if records:
            yield pa.RecordBatch.from_pylist([{"shard": 0, "path": name, "records": records, "tokens": tokens, "low": low, "high": high}], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))

    # the partitions' order is that of the ids; which attempt of a task counts is settled when its row is committed
    manifest = rows.mapInArrow(tidy(write), MANIFEST).withColumn("shard", F.spark_partition_id().cast("long"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per record, read from the files; start counts the ids of all records before."""
    shards = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    listed = shards.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")).repartition(max(1, shards.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with where.open_input_file(f"{root}/{name}.index") as f:
                    index = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with where.open_input_file(f"{root}/{name}.records") as f:
                    ends = np.append(index[1:], f.size())
                    i = 0
                    while i < len(index):
                        j = max(i + 1, int(np.searchsorted(ends, index[i] + BLOCK, side="right")))
                        f.seek(int(index[i]))
                        data = f.read(int(ends[j - 1] - index[i]))
                        out: list[list] = [[], [], [], []]
                        for k in range(i, j):
                            doc_id, ids, _ = read_frame(data, int(index[k] - index[i]))
                            for column, value in zip(out, (doc_id, start, len(ids), ids.tobytes()), strict=True):
                                column.append(value)
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        i = j

    return listed.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids binary")


def read_one(path: str, shard: str, i: int) -> tuple[int, np.ndarray]:
    """Record i of a shard by its index alone: two small reads, for shuffled access."""
    where, root = fs.FileSystem.from_uri(path)
    with where.open_input_file(f"{root}/{shard}.index") as f:
        f.seek(8 * i)
        ends = np.frombuffer(f.read(16), "<u8")
    with where.open_input_file(f"{root}/{shard}.records") as f:
        f.seek(int(ends[0]))
        data = f.read(int(ends[1] - ends[0])) if len(ends) > 1 else f.read()
    doc_id, ids, _ = read_frame(data, 0)
    return doc_id, ids
