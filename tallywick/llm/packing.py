"""Packing by power-of-two decomposition.

A document's ids (with an end id) are cut into pieces whose lengths are powers of two: as many of
the longest as fit, then one for each set bit of the rest, longest first. Every piece is a sequence
of its own, in the bucket of its length, so no sequence crosses documents and none needs padding;
a batch takes sequences of one bucket, as many as give it the same number of ids.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by one;
an empty table gives an empty table; other input columns are not read. There is no shuffle, and a
task holds one block of text at a time (a longer single text stands alone).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, slices, text_buffer, tidy
from .tokens import BLOCK, encoder, vocabulary_path

LONGEST = 1024
END_ID = 0


def decompose(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start, length) of the pieces of documents of these lengths, in order. `longest` is a power of two."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    bits = range(longest.bit_length() - 2, -1, -1)
    counts = np.stack([lengths // longest, *((lengths >> b) & 1 for b in bits)], 1)
    sizes = np.array([longest, *(1 << b for b in bits)])
    flat = counts.ravel()
    length = np.repeat(np.tile(sizes, len(lengths)), flat)
    doc = np.repeat(np.arange(len(lengths)), counts.sum(1))
    upto = np.cumsum(length)
    before = np.append(0, np.cumsum(lengths))[doc]
    return doc, upto - length - before, length


def pack_documents(docs: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None, longest: int = LONGEST, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset) per piece; ids are little-endian unsigned 32-bit."""
    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("string").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, BLOCK):
                ids, at = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                lengths = np.diff(at) + 1
                doc, start, length = decompose(lengths, longest)
                bounds = np.append(0, np.cumsum(length) * 4).astype(np.int64)
                blob = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc + i)), pa.array(start), pa.array(length), blob, pa.array(lengths[doc]), pa.array(np.log2(length).astype(np.int32))],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"],
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(tidy(pack), f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, bucket int")
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def batches_of(pieces: DataFrame, batch_tokens: int = 8192) -> DataFrame:
    """Which batch of its bucket each sequence belongs to, by hash, so that batches of a bucket hold about batch_tokens ids."""
    sizes = pieces.groupBy("bucket").agg(F.count("*").alias("n"))  # at most as many rows as there are powers of two
    per = F.expr(f"greatest(1, {batch_tokens} >> bucket)")
    sizes = sizes.select("bucket", F.ceil(F.col("n") / per).alias("n_batches"))
    return pieces.join(F.broadcast(sizes), "bucket").withColumn("batch", F.pmod(F.xxhash64("sequence_id"), F.col("n_batches")))


__all__ = ["END_ID", "LONGEST", "batches_of", "decompose", "pack_documents", "vocabulary_path"]
