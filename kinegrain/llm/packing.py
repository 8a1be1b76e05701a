"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two:
whole pieces of the longest length first, then the binary digits of the rest.
Pieces of one length form a bucket, and each piece is a sequence of its own,
so no sequence crosses documents and none needs padding; a batch is drawn from
one bucket, with as many sequences as its length allows. A sequence's number
is made of its bucket, its task and its place there, so it is known where the
piece is made and nothing is moved or counted twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.llm import scratch
from kinegrain.llm import textkernel as tk
from kinegrain.llm.tokenmemo import encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, batch_id bigint, ids binary"
#: Bits of a sequence id under the bucket, and under the task: 2**24 tasks, 2**32 sequences of one length in each.
BUCKET_SHIFT, TASK_SHIFT = 56, 32


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to ``n``, none over ``longest``, longest first."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 2048, batch_tokens: int = 1 << 16) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, batch_id, ids.

    ``ids`` are little-endian unsigned 32-bit integers. ``sequence_id`` is
    unique; ids of longer sequences are smaller, so a bucket is a range of them,
    with gaps between the tasks' parts. ``batch_id`` numbers alike the batches
    of at most ``batch_tokens`` (one sequence at least) of a task's part of a
    bucket. A null or empty text has the end id alone, hence one piece of length
    1. Repeated rows and null doc_ids are documents like others; other columns
    are ignored. An empty table gives no rows. ``longest`` must be a power of
    two. Nothing is shuffled, written between or broadcast.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    scratch.bound_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer, False)
        ranks = np.zeros(longest.bit_length(), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sub = batch.slice(at, 1000)
                ids, first = enc.encode(sub.column(1), end_id)
                sizes = np.diff(first)
                lengths = [piece_lengths(n, longest) for n in sizes.tolist()]
                doc = np.repeat(np.arange(len(sizes)), [len(x) for x in lengths])
                length = np.array([x for y in lengths for x in y], np.int64)
                begin = np.cumsum(length) - length
                bucket = longest.bit_length() - 1 - np.log2(length).astype(np.int64)
                rank = np.zeros(len(length), np.int64)
                for k in np.unique(bucket):
                    own = np.flatnonzero(bucket == k)
                    rank[own] = ranks[k] + np.arange(len(own))
                    ranks[k] += len(own)
                high = (bucket << BUCKET_SHIFT) | (part << TASK_SHIFT)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * i: 4 * (i + n)]) for i, n in zip(begin.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([
                    sub.column(0).take(pa.array(doc)), pa.array(begin - first[doc]), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc]),
                    pa.array(high | rank), pa.array(np.zeros(len(doc), np.int64)), pa.array(high | (rank // np.maximum(batch_tokens // length, 1))),
                    pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.append(begin, len(ids)).astype(np.int64) * 4), pa.py_buffer(raw)]).cast(pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "batch_id", "ids"])
        tk.trim()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
