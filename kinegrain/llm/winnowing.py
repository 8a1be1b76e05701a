"""Document fingerprints by winnowing.

Every k-gram of characters gets a rolling hash; every window of ``window``
consecutive hashes keeps its smallest, the rightmost of equal ones. Two texts
that share ``k + window - 1`` characters keep a common hash there, and each
kept hash has its position, so a match can be located.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrain.llm import scratch
from kinegrain.llm import textkernel as tk

K, WINDOW = 12, 40
#: Characters hashed at once.
SLICE_CHARS = 1 << 19
#: Bits of a hash that a fingerprint keeps.
BITS = 32


def fingerprints(texts: list[str], k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of each text, by position.

    A text shorter than k has one hash, of all of it, at position 0; one with
    fewer k-grams than a window keeps the smallest; an empty text has none.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    for a, b in tk.slices(offsets, SLICE_CHARS):
        out.extend(_slice("".join(texts[a:b]), offsets[a: b + 1] - offsets[a], k, window))
    return out


def _slice(joined: str, offsets: np.ndarray, k: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tk.mix(codes.astype(np.uint64) + np.uint64(1)) * tk.powers(tk.BASE, n), out=total[1:])
    back = tk.powers(tk.BASE_INV, n + 1)
    m = n - k + 1
    if m > 0:
        hashes = tk.mix((total[k:] - total[:m]) * back[:m]) >> np.uint64(64 - BITS)
        # Smaller is better, then further right: the position counts down in the low bits.
        keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(m, dtype=np.uint64))
        low = keys
        width = 1
        while width < window:
            step = min(width, window - width)
            if len(low) <= step:
                break
            low = np.minimum(low[:-step], low[step:])
            width += step
        full = width == window
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b == a:
            yield none
        elif b - a < k:
            h = tk.mix((total[b: b + 1] - total[a: a + 1]) * back[a: a + 1] + np.uint64(b - a)) >> np.uint64(64 - BITS)
            yield h.astype(np.uint32), np.zeros(1, np.int64)
        else:
            last = b - k + 1
            if full and last - a >= window:
                kept = low[a: last - window + 1]
                kept = kept[np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1])))]
            else:
                kept = keys[a:last].min(keepdims=True)
            at = (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64) - a
            yield (kept >> np.uint64(32)).astype(np.uint32), at


def text_form(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash:position`` in hexadecimal, comma-joined; the empty string for an empty text."""
    return ",".join([f"{h:x}:{p:x}" for h, p in zip(print_[0].tolist(), print_[1].tolist())])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two hash sets; of two empty ones 1."""
    x, y = set(a.tolist()), set(b.tolist())
    both = len(x & y)
    union = len(x) + len(y) - both
    return both / union if union else 1.0


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last third of the text gives way to as much of the next one's beginning."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare(ids: list, texts: list[str], k: int, window: int) -> pa.RecordBatch:
    """Rows for all texts but the last, each with the one after it as its next."""
    changed = [edited(t, n) for t, n in zip(texts[:-1], texts[1:])]
    own, new = fingerprints(texts, k, window), fingerprints(changed, k, window)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
        pa.array([text_form(x) for x in own[:-1]]), pa.array([text_form(x) for x in new]),
        pa.array([likeness(a[0], b[0]) for a, b in zip(own, new)]),
        pa.array([likeness(a[0], b[0]) for a, b in zip(own[:-1], own[1:])])], names=COLUMNS)


def fingerprint_and_edit(docs: DataFrame, k: int = K, window: int = WINDOW, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Documents are ordered by (doc_id, text) descending, nulls last; each one's
    next is the one after it, the last one's is the first. A null text is
    empty. Repeated rows stay, and are each other's next. Other columns are
    ignored; an empty table gives no rows; a single row is its own next.

    Documents are range-partitioned once. Within a partition the next document
    is the next row; for a partition's last row it is the first row of the next
    partition that has any, which a table of one row per partition supplies.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scratch.bound_batches(docs)
    n = partitions or scratch.partitions_for(docs, 16)
    order = [F.desc_nulls_last("doc_id"), F.desc("text")]
    dealt = docs.repartitionByRange(n, order[0]).sortWithinPartitions(*order)

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids += part.column(0).to_pylist()
                texts += part.column(1).to_pylist()
                if len(texts) > 1:
                    yield compare(ids[:-1], texts, k, window)
                    ids, texts = ids[-1:], texts[-1:]
        tk.trim()

    def ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), *last.columns, first.column(1)], names=["part", "doc_id", "text", "head"])

    # One row per partition, so one window over all of them is small.
    edge = dealt.mapInArrow(ends, "part bigint, doc_id bigint, text string, head string")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = edge.select("doc_id", "text", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(whole)).alias("following"))

    def outer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield compare([batch.column(0)[i].as_py()], [batch.column(1)[i].as_py(), batch.column(2)[i].as_py()], k, window)

    return dealt.mapInArrow(inner, SCHEMA).unionByName(edge.mapInArrow(outer, SCHEMA))
