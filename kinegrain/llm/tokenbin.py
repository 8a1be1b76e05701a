"""Token ids of documents as shard files, and reading them back.

Documents are range-partitioned and sorted by doc_id, encoded, and written as
Re-Pair shards of a bounded number of tokens. A shard's name is made of its
partition and its place in it, and a file appears under that name only when
whole, so a task that runs again writes the same files again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrain.llm import repair, scratch
from kinegrain.llm import textkernel as tk
from kinegrain.llm.tokenmemo import encoder

#: Tokens after which a shard is closed; one longer document makes a longer shard.
SHARD_TOKENS = 1 << 20
SUFFIX = ".kgr"


def put(folder: str, name: str, data: bytes) -> str:
    """Write a file whole or not at all; the same name again is the same content."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    context = TaskContext.get()
    part = f"{root}/_{name}.{context.taskAttemptId() if context else os.getpid()}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{root}/{name}")
    return f"{folder}/{name}"


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Encode (doc_id, text) and write shard files; gives one row per file.

    Order is (doc_id, text), nulls first; repeated rows stay. A null or empty
    text has the end id alone. A null doc_id is kept as null. Other columns are
    ignored. The manifest (part, seq, path, n_docs, n_tokens, n_bytes) is a
    written table. ``folder`` is a URI that driver and executors share. An
    empty table writes no file.
    """
    scratch.bound_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer, True)
        seq, size = 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # doc_ids, ids, token counts

        def close() -> pa.RecordBatch:
            nonlocal seq, size
            doc_ids = pa.concat_arrays([h[0] for h in held])
            first = np.concatenate(([0], np.cumsum(np.concatenate([h[2] for h in held]))))
            null = doc_ids.is_null().to_numpy(zero_copy_only=False)
            data = repair.write_shard(doc_ids.fill_null(0).to_numpy(), null, np.concatenate([h[1] for h in held]), first)
            path = put(folder, f"{part:08d}-{seq:06d}{SUFFIX}", data)
            row = pa.RecordBatch.from_pydict({
                "part": [part], "seq": [seq], "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [int(first[-1])], "n_bytes": [len(data)]})
            held.clear()
            seq, size = seq + 1, 0
            return row

        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            ids, first = enc.encode(batch.column(1), end_id)
            a, n = 0, batch.num_rows
            while a < n:
                b = int(np.searchsorted(first, first[a] + shard_tokens - size, side="right")) - 1
                if b <= a:
                    if size:
                        yield close()
                        continue
                    b = a + 1
                held.append((batch.column(0).slice(a, b - a), ids[first[a]: first[b]], np.diff(first[a: b + 1])))
                size += int(first[b] - first[a])
                a = b
        if held:
            yield close()
        tk.trim()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or scratch.partitions_for(docs, 16)
    dealt = rows.repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    done = dealt.mapInArrow(run, "part bigint, seq bigint, path string, n_docs bigint, n_tokens bigint, n_bytes bigint")
    return scratch.keep(done, "shards")


def read_token_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the shard files: doc_id, start, n_tokens, ids (little-endian u32 bytes).

    ``start`` counts the ids of all documents in files before, and in the file
    before the document; it comes from the manifest's counts, one row per file.
    """
    sums = manifest.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the writer
    base = sums.select("part", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("in_part")).join(base, "part")
    starts = starts.select(
        F.concat(F.lpad(F.col("part").cast("string"), 8, "0"), F.lit("-"), F.lpad(F.col("seq").cast("string"), 6, "0"), F.lit(SUFFIX)).alias("name"),
        (F.col("part_start") + F.col("in_part")).alias("file_start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = repair.Shard(content.as_py())
                first = shard.first
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                for a in range(0, len(shard.doc_ids), 256):
                    b = min(a + 256, len(shard.doc_ids))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * (b - a)), pa.array(shard.doc_ids[a:b], mask=shard.null[a:b]), pa.array(first[a:b]),
                        pa.array(first[a + 1: b + 1] - first[a:b]), pa.array([bytes(raw[4 * x: 4 * y]) for x, y in zip(first[a:b], first[a + 1: b + 1])], pa.binary())],
                        names=["name", "doc_id", "in_file", "n_tokens", "ids"])
                del shard, raw
        tk.trim()

    read = files.mapInArrow(run, "name string, doc_id bigint, in_file bigint, n_tokens bigint, ids binary")
    return read.join(starts, "name").select("doc_id", (F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids")
