"""Exact n-gram Jaccard join of documents, down to the components of its links.

The method is a blocked sparse product of the document by n-gram incidence
matrix with its transpose. Only blocks that can hold a link are multiplied:

1. Equal n-gram sets are one class; classes are joined, not documents.
2. N-grams are ordered from rare to frequent. Two sets that reach the
   threshold share an n-gram among the first ``n - ceil(t n) + 1`` of either,
   so only these columns can bring documents together. Frequencies are counted
   over all documents in a table that grows with the input within fixed bounds,
   in which frequent n-grams stand out; the order may be rough, the argument
   holds for any order.
3. A column's classes, sorted by size, fall into runs whose neighbours' sizes
   allow the threshold; no link leaves a run. A run of at most ``SMALL_COLUMN``
   classes gives its pairs, and a pair stays only if the sizes allow the
   threshold and so does the overlap that both sets' counts by hash range bound.
   A longer run is chained. What is linked so forms clusters, and no link leaves
   a cluster.
4. A cluster's classes meet in one task, or, when there are many, in tiles of
   one band of sizes, of which only those of the same and the next band meet.
   There the product is accumulated block by block, pairs whose sizes rule a
   link out are left aside, and what links is merged. Of a large cluster only
   tiles that are not yet in one component are multiplied further, and a text
   goes there only if its counts by hash range allow a link with a class of
   another component: counts move to all pairs of tiles, texts to few.

Rows grow with the columns, never with the pairs of a group: a small column has
a bounded number of pairs, and a task returns each class with its root.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrain.llm import scratch, sketches
from kinegrain.llm import textkernel as tk
from kinegrain.llm.components import connected, local_components

#: Classes, and n-grams, of a tile.
TILE_CLASSES = 256
TILE_GRAMS = 1_000_000
#: Classes of a column's run up to which its pairs are looked at one by one.
SMALL_COLUMN = 6
#: log2 of the slots of the frequency table: least, most, and bytes of ids and texts in files for a slot in between.
TABLE_BITS, MOST_TABLE_BITS, SLOT_BYTES = 22, 26, 64
#: log2 of the slots of a table of documents' ids.
MEMBER_BITS = 22
#: (n-grams up to which it serves, hash ranges) of the counts that bound an overlap.
RANGES = ((1 << 10, 64), (1 << 13, 256), (1 << 62, 1024))
#: Expected rows of a column from which it is dealt over several tasks.
HOT_ROWS = 1 << 15
#: Cells of a dense block of the product.
BLOCK_CELLS = 4_000_000
#: Parts of a doubling that the frequency order tells apart.
STEPS = 8


def document_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text's k-word shingles.

    Words are runs without ASCII white space, A-Z lowered; with fewer than k
    words the whole sequence is one shingle, without words there is none.
    """
    raw, offsets = tk.utf8_buffer(column)
    for a, b in tk.slices(offsets):
        part = tk.LOWER[raw[offsets[a]: offsets[b]]]
        starts, ends, first = tk.word_spans(part, offsets[a: b + 1] - offsets[a], tk.SPACE_WORD)
        words = tk.span_hashes(part, starts, ends)
        grams = tk.gram_hashes(words, k)
        for d in range(b - a):
            i, j = first[d], first[d + 1]
            if j - i >= k:
                yield a + d, np.unique(grams[i: j - k + 1])
            elif j > i:
                # Shorter than a shingle: told apart from shingles by its length.
                yield a + d, tk.mix(tk.gram_hashes(words[i:j], j - i) + np.uint64(j - i))
            else:
                yield a + d, np.zeros(0, np.uint64)


def signature(grams: np.ndarray) -> int:
    """64 bits of a set, as a signed integer."""
    x = tk.mix(np.array([grams.sum() + np.uint64(len(grams)), np.bitwise_xor.reduce(tk.mix(grams ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64))
    return int(tk.mix(x[:1] ^ (x[1:] << np.uint64(1))).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def range_counts(grams: np.ndarray) -> bytes:
    """How many n-grams lie in each of equal ranges of hashes; a byte each, or four where that is not enough."""
    ranges = next(r for most, r in RANGES if len(grams) <= most)
    counts = np.bincount((grams >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64), minlength=ranges)
    return b"\1" + counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b"\4" + counts.astype("<u4").tobytes()


def most_overlap(a: bytes, b: bytes) -> int:
    """The largest overlap two sets with these counts can have."""
    x, y = (np.frombuffer(c, np.uint8 if c[0] == 1 else "<u4", offset=1).astype(np.int64) for c in (a, b))
    ranges = min(len(x), len(y))
    return int(np.minimum(x.reshape(ranges, -1).sum(axis=1), y.reshape(ranges, -1).sum(axis=1)).sum())


def _summaries(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """A row per document (doc_id, t, n, s, ranges), and each task's n-gram counts as chunks."""
    names = ["doc_id", "t", "n", "s", "ranges", "chunk", "counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = sketches.Counter(bits)
        for batch in batches:
            n, s, ranges, pending, held = [], [], [], [], 0
            for _, grams in document_sets(batch.column(1), k):
                n.append(len(grams))
                s.append(signature(grams) if len(grams) else None)
                ranges.append(range_counts(grams) if len(grams) else None)
                pending.append(grams)
                held += len(grams)
                if held > 1_000_000:
                    counter.add(np.concatenate(pending))
                    pending, held = [], 0
            if pending:
                counter.add(np.concatenate(pending))
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(ranges, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())],
                names=names)
        for rows in counter.rows():
            null = pa.nulls(rows.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([null, null, null, null, pa.nulls(rows.num_rows, pa.binary()), *rows.columns], names=names)
        tk.trim()

    return docs.mapInArrow(run, "doc_id bigint, t bigint, n bigint, s bigint, ranges binary, chunk bigint, counts binary")


def table_bits(size_in_bytes: int) -> int:
    """log2 of the slots of the frequency table for an input of this size."""
    return sketches.bits_for(size_in_bytes, SLOT_BYTES, least=TABLE_BITS, most=max(TABLE_BITS, MOST_TABLE_BITS))


def _order(counts: np.ndarray) -> np.ndarray:
    """A byte by which counts are ordered."""
    return np.minimum(np.rint(np.log2(counts.astype(np.float32) + 1) * STEPS), 255).astype(np.uint8)


def _columns(docs: DataFrame, k: int, percent: int, order: np.ndarray, bits: int, reps: bytes, rep_bits: int) -> DataFrame:
    """(h, salt, salted, n, s): the rare end of the n-grams of every document in the bit table ``reps``.

    The table holds a document of every class; what it lets through besides only repeats classes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(order.tobytes())
    sent_reps = docs.sparkSession.sparkContext.broadcast(reps)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(sent.value, np.uint8)
        shares = np.maximum(1, np.ceil(2.0 ** (np.arange(256) / STEPS) / HOT_ROWS)).astype(np.uint64)

        def flush(held: list) -> pa.RecordBatch:
            grams = np.concatenate([x[0] for x in held])
            sizes = [len(x[0]) for x in held]
            s = np.repeat(np.array([x[1] for x in held], np.int64), sizes)
            n = np.repeat(np.array([x[2] for x in held], np.int64), sizes)
            share = shares[rank[sketches.slots_of(grams, bits)]]
            salt = (tk.mix(s.view(np.uint64)) % share).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(grams.view(np.int64)), pa.array(salt), pa.array(share > 1), pa.array(n), pa.array(s)], names=["h", "salt", "salted", "n", "s"])

        held, size = [], 0
        table = sketches.Bits(sent_reps.value, rep_bits)
        for batch in batches:
            batch = batch.filter(pa.array(table.has(_id_hashes(batch))))
            for _, grams in document_sets(batch.column(1), k):
                if len(grams):
                    key = (rank[sketches.slots_of(grams, bits)].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
                    first = np.argsort(key, kind="stable")[: prefix_size(len(grams), percent)]
                    held.append((grams[first], signature(grams), len(grams)))
                    size += len(first)
                    if size > 50_000:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)
        tk.trim()

    return docs.mapInArrow(run, "h bigint, salt bigint, salted boolean, n bigint, s bigint")


def _chain(columns: DataFrame, percent: int, partitions: int, pairs: bool) -> DataFrame:
    """Links (u, v) between classes of a column; ``h`` is set on rows for a second pass.

    With ``pairs`` a small run of sizes gives all its pairs whose sizes fit, to
    be tested (``test``); other links are between neighbours by size and stand.
    Copies of a class count once. A column dealt over several tasks gives, for every class of sizes, its first
    and last row. Chained again without the dealing, these connect what the
    parts have separately connected.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "salt", "salted", "n", "s"]
        width = np.log(100 / (percent + 1)) if percent < 99 else np.log(1.005)

        def scan(x: dict, begun: bool, ended: bool) -> pa.RecordBatch:
            """Whole columns, but that the first may have begun before and the last may go on."""
            rows = len(x["h"])
            same = (x["h"][1:] == x["h"][:-1]) & (x["salt"][1:] == x["salt"][:-1])
            number = np.concatenate(([0], np.cumsum(~(same & (x["n"][:-1] * 100 >= percent * x["n"][1:])))))
            size = np.bincount(number)
            if begun:
                size[0] += SMALL_COLUMN
            if not ended:
                size[-1] += SMALL_COLUMN
            small = (size <= SMALL_COLUMN)[number] & ~x["salted"] if pairs else np.zeros(rows, bool)
            us, vs, tests = [], [], []
            for step in range(1, max(SMALL_COLUMN, 2) if small.any() else 2):
                fits = (number[step:] == number[:-step]) & (x["n"][:-step] * 100 >= percent * x["n"][step:]) & (x["s"][step:] != x["s"][:-step])
                at = np.flatnonzero(fits if step == 1 else fits & small[step:])
                us.append(x["s"][at])
                vs.append(x["s"][at + step])
                tests.append(small[at])
            size_class = np.floor(np.log(x["n"]) / width)
            cut = ~same | (size_class[1:] != size_class[:-1])
            edge = np.zeros(rows, bool)
            edge[1:] |= cut
            edge[:-1] |= cut
            edge[0] |= not begun
            edge[-1] |= ended
            rep = np.flatnonzero(edge & x["salted"])
            u, v, test = np.concatenate((*us, x["s"][rep])), np.concatenate((*vs, x["n"][rep])), np.concatenate((*tests, np.zeros(len(rep), bool)))
            links = len(u) - len(rep)
            # One order of a pair's sides, so that equal pairs meet; by hash, so that no class is always on one side.
            low, high = np.minimum(u[:links], v[:links]), np.maximum(u[:links], v[:links])
            turn = (tk.mix((low ^ high).view(np.uint64)) & np.uint64(1)).astype(bool)
            u[:links], v[:links] = np.where(turn, high, low), np.where(turn, low, high)
            h = np.concatenate((np.zeros(links, np.int64), x["h"][rep]))
            again = np.arange(len(u)) >= links
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(h), pa.array(again), pa.array(test)], names=["u", "v", "h", "again", "test"])

        held, begun = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            if held is not None:
                new = {c: np.concatenate((held[c], new[c])) for c in names}
            once = np.ones(len(new["h"]), bool)
            once[1:] = (new["h"][1:] != new["h"][:-1]) | (new["salt"][1:] != new["salt"][:-1]) | (new["s"][1:] != new["s"][:-1])
            if not once.all():
                new = {c: v[once] for c, v in new.items()}
            # The last column waits for the next batch, but for one that is large already.
            changes = np.flatnonzero((new["h"][1:] != new["h"][:-1]) | (new["salt"][1:] != new["salt"][:-1]))
            last = int(changes[-1]) + 1 if len(changes) else 0
            if len(new["h"]) - last > SMALL_COLUMN or begun and not last:
                yield scan(new, begun, False)
                held, begun = {c: new[c][-1:] for c in names}, True
            else:
                if last:
                    yield scan({c: new[c][:last] for c in names}, begun, True)
                held, begun = {c: new[c][last:] for c in names}, begun and not last
        if held is not None:
            yield scan(held, begun, True)
        tk.trim()

    dealt = columns.repartition(partitions, "h", "salt").sortWithinPartitions("h", "salt", "n", "s")
    return dealt.mapInArrow(run, "u bigint, v bigint, h bigint, again boolean, test boolean")


def _tested(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that their sets' counts by hash range allow to reach the threshold."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, m = (batch.column(i).to_numpy() for i in range(4))
            need = -(-percent * (n + m) // (100 + percent))  # of 100 o >= percent (n + m - o)
            x, y = batch.column(4), batch.column(5)
            short = pc.and_(*(pc.equal(pc.binary_length(c), RANGES[0][1] + 1) for c in (x, y))).to_numpy(zero_copy_only=False)
            most = np.zeros(len(u), np.int64)
            if short.any():
                rows = pa.array(short)
                a, b = (np.frombuffer(b"".join(c.filter(rows).to_pylist()), np.uint8).reshape(-1, RANGES[0][1] + 1)[:, 1:] for c in (x, y))
                most[short] = np.minimum(a, b).sum(axis=1)
            for i in np.flatnonzero(~short).tolist():
                most[i] = most_overlap(x[i].as_py(), y[i].as_py())
            keep = most >= need
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])
        tk.trim()

    one = classes.select(F.col("s").alias("u"), F.col("n").alias("n_u"), F.col("ranges").alias("r_u"))
    two = classes.select(F.col("s").alias("v"), F.col("n").alias("n_v"), F.col("ranges").alias("r_v"))
    both = pairs.join(one, "u").join(two, "v").select("u", "v", "n_u", "n_v", "r_u", "r_v")
    return both.mapInArrow(run, "u bigint, v bigint")


def link_pairs(sets: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of sets that reach the threshold, each once, by blocked products.

    Rows are sorted by size, so the partners a size allows are a band. Columns
    of the incidence matrix that occur once cannot add to an overlap.
    """
    m = len(sets)
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    grams, column, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = count > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    row, column = row[kept], number[column[kept]]
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    total = int(shared.sum())
    step = 256
    for a in range(0, m, step):
        b = min(a + step, m)
        reach = int(np.searchsorted(sizes * percent, sizes[b - 1] * 100, side="right"))
        overlap = np.zeros((b - a, reach - a), np.float32)
        width = max(64, BLOCK_CELLS // max(reach - a, 1))
        for c in range(0, total, width):
            i, j = np.searchsorted(column, [c, c + width])
            r, k = row[i:j], column[i:j] - c
            band = (r >= a) & (r < reach)
            block = np.zeros((reach - a, min(width, total - c)), np.float32)
            block[r[band] - a, k[band]] = 1
            overlap += block[: b - a] @ block.T
        both = np.rint(overlap).astype(np.int64)
        x, y = np.nonzero(100 * both >= percent * (sizes[a:b, None] + sizes[None, a:reach] - both))
        ahead = x < y
        yield order[x[ahead] + a], order[y[ahead] + a]


def link_roots(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Position of the root of each set's component under the threshold."""
    root = np.arange(len(sets))
    left, right = zip(*link_pairs(sets, percent))
    u, v = np.concatenate(left), np.concatenate(right)
    if len(u):
        nodes, least = local_components(u, v)
        root[nodes] = least
    return root


def _resolve(rows: DataFrame, k: int, percent: int, partitions: int) -> DataFrame:
    """(s, root) for linked classes of every task of (c, i, j, s, text)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sigs, sets = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(sets) < 2:
                return
            if len(sets) == 2:
                a, b = sets
                both = len(np.intersect1d(a, b, assume_unique=True))
                root = np.array([0, 0 if 100 * both >= percent * (len(a) + len(b) - both) else 1])
            else:
                root = link_roots(sets, percent)
            at = np.flatnonzero(root != np.arange(len(root)))
            if len(at):
                s = np.array(sigs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), pa.int64()), pa.array(s[at]), pa.array(s[root[at]])], names=["c", "u", "v"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            want = batch.column(3).to_pylist()
            for now, s, (_, grams) in zip(keys, want, document_sets(tk.unsqueeze(batch.column(4)), k)):
                if now != key:
                    yield from close()
                    key, sigs, sets = now, [], []
                # A repeated doc_id may bring another text; only the class's own counts, once.
                if len(grams) and signature(grams) == s and (not sigs or sigs[-1] != s):
                    sigs.append(s)
                    sets.append(grams)
        yield from close()
        tk.trim()

    dealt = rows.repartition(partitions, "c", "i", "j").sortWithinPartitions("c", "i", "j", "s")
    return dealt.mapInArrow(run, "c bigint, u bigint, v bigint")


def may_link(a: list[tuple[int, bytes]], b: list[tuple[int, bytes]], percent: int) -> np.ndarray:
    """Which pairs of (n, counts by hash range) the bound on the overlap allows to reach the threshold."""
    def of_ranges(part: list[tuple[int, bytes]]) -> dict[int, list[int]]:
        held: dict[int, list[int]] = {}
        for i, (_, c) in enumerate(part):
            held.setdefault((len(c) - 1) // c[0], []).append(i)
        return held

    def table(part: list[tuple[int, bytes]], at: list[int], ranges: int) -> np.ndarray:
        rows = (np.frombuffer(part[i][1], np.uint8 if part[i][1][0] == 1 else "<u4", offset=1).astype(np.int32) for i in at)
        return np.stack([x.reshape(ranges, -1).sum(axis=1) for x in rows])

    n, m = (np.array([x[0] for x in part], np.int64) for part in (a, b))
    need = -(-percent * (n[:, None] + m[None, :]) // (100 + percent))  # of 100 o >= percent (n + m - o)
    out = np.zeros(need.shape, bool)
    ours, theirs = of_ranges(a), of_ranges(b)
    for r, at in ours.items():
        for q, to in theirs.items():
            x, y = table(a, at, min(r, q)), table(b, to, min(r, q))
            for i, row in zip(at, x):
                out[i, to] = np.minimum(row, y).sum(axis=1) >= need[i, to]
    return out


def _worth(rows: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(c, i, j, tile, s): of (c, i, j, tile, s, comp, n, ranges) the classes that may link with one of another component in the task's other tile, or in its only one."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            tile, comp = (np.array([x[k] for x in held], np.int64) for k in (0, 2))
            one, two = np.flatnonzero(tile == key[1]), np.flatnonzero(tile == key[2])
            may = may_link([held[i][3:] for i in one], [held[i][3:] for i in two], percent) & (comp[one][:, None] != comp[two][None, :])
            at = np.union1d(one[may.any(axis=1)], two[may.any(axis=0)])
            if len(at):
                fixed = [pa.array([k] * len(at), pa.int64()) for k in key]
                s = pa.array([held[i][1] for i in at], pa.int64())
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(tile[at]), s], names=["c", "i", "j", "tile", "s"])

        for batch in batches:
            for now, row in zip(zip(*(batch.column(i).to_pylist() for i in range(3))), zip(*(batch.column(i).to_pylist() for i in range(3, 8)))):
                if now != key:
                    yield from close()
                    key, held = now, []
                held.append(row)
        yield from close()
        tk.trim()

    dealt = rows.repartition(partitions, "c", "i", "j").sortWithinPartitions("c", "i", "j")
    return dealt.mapInArrow(run, "c bigint, i bigint, j bigint, tile bigint, s bigint")


def _degrees(rows: DataFrame, k: int, percent: int, partitions: int) -> DataFrame:
    """(s, links): over all tasks of (c, i, j, tile, s, w, text), the weights ``w`` of the classes each class links with.

    There is a task for every pair of a cluster's tiles and one for each tile
    with itself; a pair of classes counts in one task only.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sigs, sets, tiles, weights = None, [], [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(sets) < 2:
                return
            tile, weight, links = np.array(tiles), np.array(weights, np.int64), np.zeros(len(sets), np.int64)
            for x, y in link_pairs(sets, percent):
                if key[1] != key[2]:
                    across = tile[x] != tile[y]
                    x, y = x[across], y[across]
                np.add.at(links, x, weight[y])
                np.add.at(links, y, weight[x])
            at = np.flatnonzero(links)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(sigs, np.int64)[at]), pa.array(links[at])], names=["s", "links"])

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
            rest = zip(*(batch.column(i).to_pylist() for i in range(3, 6)))
            for now, (tile, s, w), (_, grams) in zip(keys, rest, document_sets(tk.unsqueeze(batch.column(6)), k)):
                if now != key:
                    yield from close()
                    key, sigs, sets, tiles, weights = now, [], [], [], []
                if len(grams) and signature(grams) == s and (not sigs or sigs[-1] != s):
                    sigs.append(s)
                    sets.append(grams)
                    tiles.append(tile)
                    weights.append(w)
        yield from close()
        tk.trim()

    dealt = rows.repartition(partitions, "c", "i", "j").sortWithinPartitions("c", "i", "j", "s")
    return dealt.mapInArrow(run, "s bigint, links bigint").groupBy("s").agg(F.sum("links").alias("links"))


def _id_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """A hash of each row's doc_id (first column), or of its text's hash (third) where it has none."""
    return tk.mix(pc.coalesce(batch.column(0), batch.column(2)).fill_null(0).to_numpy().view(np.uint64))


def _tile_pairs(cells: DataFrame, first: bool) -> DataFrame:
    """(c, i, j): the tiles of ``cells`` (c, band, tile, part) that may hold a link, each pair once, a tile with itself included.

    Links lie within a band of sizes or between neighbouring ones. The first
    pairs join every tile with its band's first one, and those of neighbouring bands.
    """
    two = cells.select(F.col("c").alias("c2"), F.col("band").alias("band2"), F.col("tile").alias("tile2"), F.col("part").alias("part2"))
    # Bands meet by equality, so a cluster's tiles are not all set against each other.
    one = cells.withColumn("next", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    met = one.join(two, (F.col("c") == F.col("c2")) & (F.col("next") == F.col("band2"))).where("band < band2 OR part <= part2")
    leading = (F.col("part") == 0) & ((F.col("band") == F.col("band2")) | (F.col("part2") == 0))
    # A band's first tile meets itself with any other tile.
    return met.where(leading if first else ~leading).select("c", F.col("tile").alias("i"), F.col("tile2").alias("j"))


def _sides(pairs: DataFrame) -> DataFrame:
    """(c, i, j, tile) for both tiles of a pair."""
    return pairs.select("c", "i", "j", F.col("i").alias("tile")).unionByName(pairs.where("i <> j").select("c", "i", "j", F.col("j").alias("tile")))


def _with_member_texts(docs: DataFrame, members: DataFrame, bits: int) -> DataFrame:
    """(s, c, tile, alone, text) of ``members`` (rep, t, s, c, tile, alone).

    A bit table of fixed size, made of the members' ids, keeps the texts of
    other documents out of the shuffle. A class without any doc_id is found by
    its text's hash ``t``, of which equal texts leave one before they move.
    """
    seen = sketches.member_bits(members.select(F.coalesce("rep", "t").alias("rep")), bits)
    sent = docs.sparkSession.sparkContext.broadcast(seen)

    def member(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketches.Bits(sent.value, bits)
        for batch in batches:
            near = batch.filter(pa.array(table.has(_id_hashes(batch))))
            yield pa.RecordBatch.from_arrays([near.column(0), near.column(2), tk.squeeze(near.column(1))], names=["doc_id", "t", "text"])
        tk.trim()

    near = docs.mapInArrow(member, "doc_id bigint, t bigint, text binary")
    named = near.where("doc_id IS NOT NULL").join(members.where("rep IS NOT NULL").drop("t"), F.col("doc_id") == F.col("rep")).select("s", "c", "tile", "alone", "text")
    unnamed = near.where("doc_id IS NULL").groupBy("t").agg(F.min("text").alias("text"))
    return named.unionByName(unnamed.join(members.where("rep IS NULL").drop("rep"), "t").select("s", "c", "tile", "alone", "text"))


def text_hash(text: Column) -> Column:
    """64 bits of a text, by which rows without a doc_id are told apart."""
    return F.xxhash64(text.cast("string"))


def components(docs: DataFrame, k: int = 4, percent: int = 85, with_links: bool = False, with_hash: bool = False) -> DataFrame:
    """Every row's doc_id with n_shingles and component_id.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets
    of k-word shingles; component_id is the smallest doc_id that links reach.
    A null text, or one without words, has no set and links with nothing.
    Repeated rows stay; rows that share a doc_id but not a text are separate
    documents. Documents without a doc_id link like others and carry links on;
    their rows get their component's smallest doc_id, or null if it has none.
    Other columns are ignored; an empty table gives no rows. ``with_links`` adds
    n_links, the other rows with a doc_id that a row links with, copies
    included; for this all tiles are multiplied. ``with_hash`` adds
    ``text_hash``, the `text_hash` of rows without a doc_id, null elsewhere.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("t", F.when(F.col("doc_id").isNull(), text_hash(F.col("text"))))
    scratch.bound_batches(docs)
    size = scratch.size_in_bytes(docs)
    bits, member_bits = table_bits(size), sketches.bits_for(size, 256, least=MEMBER_BITS)
    partitions = scratch.partitions_for(docs, 16)
    summary = scratch.keep(_summaries(docs, k, bits), "summary")
    order = sketches.gather(summary.where("chunk IS NOT NULL").select("chunk", "counts"), bits, _order, np.uint8)
    sets = summary.where("chunk IS NULL").select("doc_id", F.col("t").alias("text_hash"), "n", "s")
    classes = summary.where("chunk IS NULL AND n > 0").groupBy("s").agg(
        F.min("doc_id").alias("rep"), F.min("t").alias("t"), F.max("n").alias("n"), F.count("doc_id").alias("w"))
    # Copies of a class have equal counts and become one row before they move.
    ranges = summary.where("chunk IS NULL AND n > 0").groupBy("s").agg(F.max("n").alias("n"), F.max("ranges").alias("ranges"))

    reps = sketches.member_bits(classes.select(F.coalesce("rep", "t").alias("rep")), member_bits)
    chained = scratch.keep(_chain(_columns(docs, k, percent, order, bits, reps, member_bits), percent, partitions, True).distinct(), "chains")
    again = chained.where("again").select("h", F.lit(0).cast("bigint").alias("salt"), F.lit(False).alias("salted"), F.col("v").alias("n"), F.col("u").alias("s"))
    pairs = chained.where("test").select("u", "v")
    wanted = pairs.select(F.col("u").alias("s")).unionByName(pairs.select(F.col("v").alias("s"))).distinct()
    tested = scratch.keep(_tested(pairs, ranges.join(wanted, "s", "left_semi"), percent), "tested")
    links = chained.where("NOT again AND NOT test").select("u", "v").unionByName(_chain(again, percent, partitions, False).select("u", "v")).unionByName(tested)
    # Distinct also puts an exchange between two Python steps, so a task never holds two workers.
    links = links.distinct()
    found = connected(links)
    cluster = found.select(F.col("node").alias("s"), F.col("root").alias("c")).unionByName(found.select(F.col("root").alias("s"), F.col("root").alias("c")).distinct())
    cluster = cluster.join(classes, "s")
    # A link's sizes lie in one band or in neighbouring ones; only clusters of several tiles are cut by bands.
    full = lambda: F.greatest(F.ceil(F.count("*") / TILE_CLASSES), F.ceil(F.sum("n") / TILE_GRAMS)).cast("bigint")
    width = float(np.log(100 / percent)) * 1.001 + 1e-9
    tiles = cluster.groupBy("c").agg(full().alias("tiles"))
    cluster = cluster.join(tiles, "c").withColumn("band", F.when(F.col("tiles") > 1, F.floor(F.log("n") / width)).otherwise(0).cast("bigint"))
    parts = cluster.groupBy("c", "band").agg(full().alias("parts"))
    # A tile's number holds its band and its place there; no band has 2^24 tiles.
    part = F.pmod(F.xxhash64("s"), F.col("parts"))
    members = scratch.keep(cluster.join(parts, ["c", "band"]).withColumn("part", part).select(
        "rep", "t", "s", "c", "band", "part", (F.col("band") * (1 << 24) + F.col("part")).alias("tile"), "tiles"), "members")
    texts = scratch.keep(_with_member_texts(docs, members.select("rep", "t", "s", "c", "tile", (F.col("tiles") == 1).alias("alone")), member_bits), "texts")
    cells = members.groupBy("c", "band", "part", "tile").agg(F.max("tiles").alias("tiles"))

    # First every tile against the first one of its band; a cluster of one tile is then done.
    several = _sides(_tile_pairs(cells.where("tiles > 1"), True))
    alone = texts.where("alone").select("c", F.col("tile").alias("i"), F.col("tile").alias("j"), "s", "text")
    tasks = alone.unionByName(texts.join(several, ["c", "tile"]).select("c", "i", "j", "s", "text"))
    first = scratch.keep(_resolve(tasks, k, percent, partitions), "first")
    large = members.where("tiles > 1")
    roots = first.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if not large.isEmpty():
        of_large = large.select("c").distinct()
        done = roots.join(first.select(F.col("u").alias("node"), "c").join(of_large, "c", "left_anti").select("node"), "node", "left_semi")
        partial = first.join(of_large, "c", "left_semi").select("u", "v")
        state = connected(partial)
        labelled = large.join(state, large.s == state.node, "left").select("c", "tile", "s", F.coalesce("root", "s").alias("comp"))
        tile_state = labelled.groupBy("c", "tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        one = tile_state.withColumnsRenamed({"tile": "i"})
        two = tile_state.withColumnsRenamed({"tile": "j", "low": "low2", "high": "high2"})
        todo = _tile_pairs(cells.where("tiles > 1"), False).join(one, ["c", "i"]).join(two, ["c", "j"]).where(
            "NOT (low = high AND low2 = high2 AND low = low2)").select("c", "i", "j")
        # Counts are a small part of a text, so it is they that meet in every pair of tiles.
        counts = labelled.join(ranges.join(large.select("s"), "s", "left_semi"), "s").join(_sides(todo), ["c", "tile"])
        worth = scratch.keep(_worth(counts.select("c", "i", "j", "tile", "s", "comp", "n", "ranges"), percent, partitions), "worth")
        rest = scratch.keep(_resolve(texts.join(worth, ["c", "tile", "s"]).select("c", "i", "j", "s", "text"), k, percent, partitions), "rest")
        roots = done.unionByName(connected(partial.unionByName(rest.select("u", "v"))))
    if not with_links:
        return _finish(sets, classes, roots, None, with_hash)
    every = _sides(_tile_pairs(cells, True).unionByName(_tile_pairs(cells, False)))
    every = texts.join(classes.select("s", "w"), "s").join(every, ["c", "tile"]).select("c", "i", "j", "tile", "s", "w", "text")
    return _finish(sets, classes, roots, scratch.keep(_degrees(every, k, percent, partitions), "degrees"), with_hash)


def _finish(sets: DataFrame, classes: DataFrame, roots: DataFrame, degrees: DataFrame | None, with_hash: bool) -> DataFrame:
    """Name each component by its smallest doc_id; with ``degrees`` also count each row's links."""
    rooted = classes.join(roots, classes.s == roots.node, "left").select("s", "rep", F.coalesce("root", "s").alias("root"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = rooted.join(named, "root").select(F.col("s").alias("ls"), "component_id")
    out = sets.join(label, sets.s == F.col("ls"), "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *(["text_hash"] if with_hash else [])]
    if degrees is not None:
        # Of the rows of its own class a row with a doc_id is one itself.
        own = classes.join(degrees, "s", "left").select(F.col("s").alias("os"), (F.col("w") + F.coalesce("links", F.lit(0))).alias("reach"))
        out = out.join(own, out.s == F.col("os"), "left")
        columns.append(F.when(F.col("n") == 0, 0).otherwise(F.col("reach") - F.col("doc_id").isNotNull().cast("bigint")).cast("bigint").alias("n_links"))
    return out.select(*columns)
