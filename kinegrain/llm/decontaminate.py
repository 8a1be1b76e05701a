"""Benchmark decontamination by winnowed fingerprints.

Benchmark and documents are fingerprinted alike: of every ``window - gram + 1``
consecutive word grams the smallest hash is kept, the rightmost of equal ones.
A span of ``window`` words that both share holds one such group of grams, so
both keep the same gram of it and no shared span is missed. Where a document's
fingerprint is one of the benchmark's, the hit is extended to all windows that
cover it; windows whose own hash the benchmark has are joined into runs of
words. Distinct runs are then matched to benchmark windows by their words, and
the outcome goes back to the documents that hold the run, so a passage that a
third of the corpus repeats is matched once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.llm import scratch, sketches
from kinegrain.llm import textkernel as tk

WINDOW, GRAM = 10, 5


def _salted(hashes: np.ndarray, length: int) -> np.ndarray:
    return tk.mix(hashes + np.uint64(length))


def winnow(grams: np.ndarray, group: int) -> np.ndarray:
    """Position kept by each run of ``group`` grams: the smallest, of equal ones the rightmost."""
    n = len(grams) - group + 1
    if n < 1:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, group):
        other = grams[j: j + n]
        better = other <= best
        best[better] = other[better]
        at[better] = np.flatnonzero(better) + j
    return at


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch: rows [a, b), lowered bytes, word starts, ends, first words, hashes."""
    raw, offsets = tk.utf8_buffer(column)
    for a, b in tk.slices(offsets):
        part = tk.LOWER[raw[offsets[a]: offsets[b]]]
        starts, ends, first = tk.word_spans(part, offsets[a: b + 1] - offsets[a], tk.ALNUM_WORD)
        yield a, b, part, starts, ends, first, tk.span_hashes(part, starts, ends)


def _joined(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, j: int) -> str:
    return " ".join(part[s:e].tobytes().decode() for s, e in zip(starts[i:j], ends[i:j]))


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, length, hash, words) of every window of the benchmark."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, part, starts, ends, first, words in _words(batch.column(1)):
                out: list[list] = [[], [], [], []]
                for d in range(a, b):
                    i, j = int(first[d - a]), int(first[d - a + 1])
                    size = min(window, j - i)
                    if not size:
                        continue
                    hashes = _salted(tk.gram_hashes(words[i:j], size), size).view(np.int64).tolist()
                    for k, h in enumerate(hashes):
                        for c, v in zip(out, (ids[d], size, h, _joined(part, starts, ends, i + k, i + k + size))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["item_id", "length", "hash", "words"])

    return items.mapInArrow(run, "item_id string, length bigint, hash bigint, words string")


def _item_prints(items: DataFrame, window: int, gram: int, bits: int) -> DataFrame:
    """Bit table of the benchmark: winnowed grams, and windows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = sketches.Counter(bits)
        for batch in batches:
            for a, b, _, _, _, first, words in _words(batch.column(1)):
                for d in range(b - a):
                    own = words[first[d]: first[d + 1]]
                    size = min(window, len(own))
                    if size:
                        counter.add(_salted(tk.gram_hashes(own, size), size))
                    if size == window:
                        grams = tk.gram_hashes(own, gram)
                        counter.add(_salted(grams[winnow(grams, window - gram + 1)], gram))
        yield from counter.rows()

    return items.mapInArrow(run, sketches.SCHEMA)


def _document_runs(docs: DataFrame, window: int, gram: int, bits: int, table: bytes, short: list[int]) -> DataFrame:
    """(row, doc_id, n_words, runs array<struct<at, words>>) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sketches.Bits(sent.value, bits)
        row = TaskContext.get().partitionId() << 40
        run_type = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.string())]))

        def has(hashes: np.ndarray, length: int) -> np.ndarray:
            return known.has(_salted(hashes, length))

        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, b, part, starts, ends, first, words in _words(batch.column(1)):
                counts[a:b] = np.diff(first)
                n = len(words)
                end_of = np.repeat(first[1:], np.diff(first))  # where the word's document ends
                cover = np.zeros(n + 1, np.int64)

                def mark(at: np.ndarray, length: int, cover: np.ndarray = cover) -> None:
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + length, -1)

                grams = tk.gram_hashes(words, gram)
                kept = winnow(grams, window - gram + 1)
                place = np.arange(len(kept))
                kept = np.unique(kept[place + window <= end_of[: len(kept)]])
                hit = kept[has(grams[kept], gram)]
                if len(hit):
                    at = np.unique((hit[:, None] - np.arange(window - gram, -1, -1)[None, :]).ravel())
                    at = at[(at >= 0) & (at + window <= n)]
                    at = at[at + window <= end_of[at]]
                    total = words[at] * np.uint64(tk.BASE)
                    for j in range(1, window):
                        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + words[at + j]
                    mark(at[has(tk.mix(total), window)], window)
                for size in short:
                    g = tk.gram_hashes(words, size)
                    at = np.flatnonzero(has(g, size))
                    mark(at[at + size <= end_of[at]], size)
                covered = np.cumsum(cover[:n]) > 0
                if covered.any():
                    edge = np.zeros(n + 1, bool)
                    edge[1:n] = covered[1:] != covered[:-1]
                    edge[first] = True
                    edge[[0, n]] = True
                    cuts = np.flatnonzero(edge)
                    for i, j in zip(cuts[:-1], cuts[1:]):
                        if covered[i]:
                            d = int(np.searchsorted(first, i, side="right")) - 1
                            runs[a + d].append({"at": int(i - first[d]), "words": _joined(part, starts, ends, i, j)})
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + m)), batch.column(0), pa.array(counts), pa.array(runs, run_type)], names=["row", "doc_id", "n_words", "runs"])
            row += m
        tk.trim()

    return docs.mapInArrow(run, "row bigint, doc_id bigint, n_words bigint, runs array<struct<at bigint, words string>>")


def _run_windows(runs: DataFrame, sizes: list[int]) -> DataFrame:
    """(run, at, length, hash, words): every window of a run, of each length."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b, part, starts, ends, first, words in _words(batch.column(0)):
                out: list[list] = [[], [], [], [], []]
                for d in range(a, b):
                    i, j = int(first[d - a]), int(first[d - a + 1])
                    for size in sizes:
                        if j - i >= size:
                            hashes = _salted(tk.gram_hashes(words[i:j], size), size).view(np.int64).tolist()
                            for k, h in enumerate(hashes):
                                for c, v in zip(out, (texts[d], k, size, h, _joined(part, starts, ends, i + k, i + k + size))):
                                    c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:4]), pa.array(out[4], pa.string())], names=["run", "at", "length", "hash", "words"])

    return runs.mapInArrow(run, "run string, at bigint, length bigint, hash bigint, words string")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), contaminated and hits for every document.

    Words are runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z lowered. A window is ``window`` consecutive words of an item; an
    item of fewer words, but not none, is one window. A document's word is hit
    when it lies in an occurrence of a window. ``hits`` lists the matched runs:
    first word, words hit, text; null without any. A null text has no words.
    Repeated item_ids are one item by their text form; an item with a null id
    hits like others and is not listed. Repeated rows stay. An empty benchmark hits nothing; an empty table gives no rows.
    Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    scratch.bound_batches(docs)
    bits = sketches.bits_for(scratch.size_in_bytes(items), 4, least=20)
    windows = scratch.keep(_item_windows(items, window), "windows")
    sizes = sorted(r.length for r in windows.select("length").distinct().collect())  # at most `window` rows
    table = sketches.gather_bits(_item_prints(items, window, gram, bits), bits)
    found = scratch.keep(_document_runs(docs, window, gram, bits, table, [x for x in sizes if x < window]), "runs")
    held = found.select("row", F.posexplode("runs").alias("k", "r")).select("row", "k", F.col("r.at").alias("at"), F.col("r.words").alias("run"))
    hit = _run_windows(held.select("run").distinct(), sizes)
    known = windows.select("length", "hash", "words").distinct()
    hit = hit.join(known, ["length", "hash", "words"])
    of_item = windows.select("hash", "words", "item_id").distinct()
    matched = hit.groupBy("run").agg(
        F.array_sort(F.collect_list(F.struct("at", "length"))).alias("p"), F.collect_set(F.struct("hash", "words")).alias("w"))
    # Words of a run that some matched window covers, window after window.
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("p", start, lambda acc, x: F.struct(
        F.greatest(acc["end"], x["at"] + x["length"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(acc["end"], x["at"]))).alias("n")), lambda acc: acc["n"])
    named = matched.select("run", F.explode("w").alias("w")).select("run", "w.hash", "w.words").join(of_item, ["hash", "words"])
    named = named.groupBy("run").agg(F.collect_set("item_id").alias("items"))
    outcome = matched.select("run", covered.alias("n_hit")).join(named, "run")
    per_doc = held.join(outcome, "run").groupBy("row").agg(
        F.sum("n_hit").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.collect_list(F.struct("at", F.col("n_hit").alias("n_hit"), "run"))).alias("hits"))
    none = F.array().cast("array<string>")
    return found.select("row", "doc_id", "n_words").join(per_doc, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "hits")
