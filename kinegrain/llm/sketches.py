"""Tables of fixed size that every task adds to: counts and membership bits.

Their size is a parameter, not a function of the data, which is what makes it
safe to bring the sum to the driver and to send it to every worker.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.llm import textkernel as tk

CHUNK = 1 << 16
SCHEMA = "chunk bigint, counts binary"


def _deflated(data: bytes) -> bytes:
    # Bits and counts have no strings to find, only runs and uneven bytes.
    out = zlib.compressobj(1, zlib.DEFLATED, zlib.MAX_WBITS, zlib.DEF_MEM_LEVEL, zlib.Z_RLE)
    return out.compress(data) + out.flush()


def pack_counts(part: np.ndarray) -> bytes:
    """Byte counts as the bits of the slots that have one, then the counts of these.

    A table grows with the input and a task's share of it does not, so most
    slots of a task are empty in a large table; a bit each is what they cost.
    """
    some = part > 0
    return _deflated(np.packbits(some).tobytes()) + _deflated(part[some].tobytes())


def unpack_counts(data: bytes, size: int) -> np.ndarray:
    """The ``size`` counts that `pack_counts` has packed."""
    first = zlib.decompressobj()
    some = np.unpackbits(np.frombuffer(first.decompress(data), np.uint8), count=size).astype(bool)
    part = np.zeros(size, np.uint8)
    part[some] = np.frombuffer(zlib.decompress(first.unused_data), np.uint8)
    return part


class Counter:
    """Saturating byte counts in ``1 << bits`` slots."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.table = np.zeros(1 << bits, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        slots = np.sort(slots_of(hashes, self.bits))
        edge = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1], [True])))
        at, n = slots[edge[:-1]], np.diff(edge)
        self.table[at] = np.minimum(self.table[at].astype(np.int64) + n, 255)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.table), CHUNK):
            part = self.table[k: k + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK]), pa.array([pack_counts(part)], pa.binary())], names=["chunk", "counts"])


class Bits:
    """Look-ups in a packed bit table, which stays packed."""

    def __init__(self, data: bytes, bits: int) -> None:
        self.data, self.bits = np.frombuffer(data, np.uint8), bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = slots_of(hashes, self.bits)
        return (self.data[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def slots_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _sums(rows: DataFrame, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first slot, sums) of every chunk that any task has counted in.

    Tasks' rows are added up where a chunk is dealt to, one at a time, so a
    worker holds the chunks of its partition and no more; the driver sees one
    chunk at a time.
    """
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k not in sums:
                    sums[k] = np.zeros(size, np.int64)
                sums[k] += unpack_counts(part.as_py(), size)
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], names=["chunk", "counts"])
        tk.trim()

    chunks, size = max(1, (1 << bits) // CHUNK), min(1 << bits, CHUNK)
    for r in rows.repartition(min(chunks, 64), "chunk").mapInArrow(add, SCHEMA).toLocalIterator():
        yield r.chunk * size, np.frombuffer(r.counts, "<u4")


def gather(rows: DataFrame, bits: int, form: Callable[[np.ndarray], np.ndarray] = lambda x: x, kind: type = np.uint32) -> np.ndarray:
    """The slot-wise sum of all tasks' tables, each chunk put into its ``form`` as it comes; ``form`` leaves 0 at 0."""
    out = np.zeros(1 << bits, kind)
    for at, part in _sums(rows, bits):
        out[at: at + len(part)] = form(part)
    return out


def gather_bits(rows: DataFrame, bits: int) -> bytes:
    """Which slots any task has counted in, packed: ``1 << bits - 3`` bytes."""
    out = np.zeros(max(1 << bits >> 3, 1), np.uint8)
    for at, part in _sums(rows, bits):
        out[at >> 3: at + len(part) >> 3] = np.packbits(part > 0)
    return out.tobytes()


def bits_for(size_in_bytes: int, each: int, least: int = 16, most: int = 26) -> int:
    """log2 of the slots for about one item in ``each`` bytes of input, within fixed bounds."""
    return int(min(max(int(np.ceil(np.log2(max(size_in_bytes // each, 1)))), least), most))


def member_bits(ids: DataFrame, bits: int) -> bytes:
    """Packed bits set for the ids of a one-column bigint relation; the table's size is fixed by ``bits``."""
    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(bits)
        for batch in batches:
            counter.add(tk.mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        yield from counter.rows()

    return gather_bits(ids.mapInArrow(mark, SCHEMA), bits)


def without(rows: DataFrame, key: str, ids: DataFrame, bits: int = 22) -> DataFrame:
    """The rows whose bigint ``key`` is not among ``ids`` (one column, no nulls); null keys stay.

    Most rows are cleared by a bit table of fixed size and stay where they are;
    only those that it cannot clear meet the ids in an exact anti-join, for
    which the rows are read a second time.
    """
    table = member_bits(ids, bits)
    sent = rows.sparkSession.sparkContext.broadcast(table)
    at = rows.columns.index(key)

    def cleared(want: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Bits(sent.value, bits)
            for batch in batches:
                column = batch.column(at).cast(pa.int64())
                null = column.is_null().to_numpy(zero_copy_only=False)
                hit = known.has(tk.mix(column.fill_null(0).to_numpy().view(np.uint64))) & ~null
                yield batch.filter(pa.array(hit != want))
            tk.trim()

        return run

    name = ids.columns[0]
    unsure = rows.mapInArrow(cleared(False), rows.schema)
    left = unsure.join(ids.withColumnRenamed(name, "__gone"), unsure[key] == F.col("__gone"), "left_anti")
    return rows.mapInArrow(cleared(True), rows.schema).unionByName(left)
