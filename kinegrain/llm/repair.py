"""Re-Pair grammar compression of one shard of token ids.

Frequent pairs of neighbouring symbols are replaced by new symbols, round by
round, until no pair occurs ``LEAST_COUNT`` times. A rule never spans two documents, so
each document is a run of symbols of its own and can be decoded alone; the
stored expansion lengths tell where inside the ids a symbol lands.

Shard file, all little-endian: magic ``KGR1``; five u32 (documents, rules,
symbols, first rule id, null ids); rule left sides u32, right sides u32,
expansion lengths u32; symbols u16 or u32 (u32 if the flag in bit 0 of a
following u32 is set); doc_id i64, null flag u8, first symbol u32 and one end,
first token u64 and one end, relative to the file; crc32 of all before, u32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"KGR1"
#: A pair must occur this often in a shard to become a rule.
LEAST_COUNT = 12
#: Pairs of at least this share of the round's most frequent pair are replaced together; rarer ones wait for a later round.
ROUND_SHARE = 0.05
_NONE = np.iinfo(np.int32).max


def build(ids: np.ndarray, first: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Compress ``ids`` whose documents begin at ``first`` (with one end).

    Gives (symbols, first symbol of each document with one end, rule left
    sides, rule right sides, id of the first rule).

    Only ``at``, the places whose pair may still be frequent, is looked at: all
    of them first, then those of pairs that were frequent and those beside a
    new symbol, since any other pair only becomes rarer. Every round replaces
    at least the most frequent pair, so the loop ends, and it ends when no pair
    occurs ``least`` times.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)  # the last symbol of its document
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    made = 0
    at = np.flatnonzero(~last)
    ranks = np.full(len(seq) + 2, _NONE, np.int32)  # of the pair at each place, one further right
    while len(at) >= least:
        at, count = _frequent(seq, at, base + made, least)
        if not len(at):
            break
        order = np.argsort(-count, kind="stable")
        chosen = int(np.searchsorted(-count[order], -max(least, int(count[order[0]] * ROUND_SHARE)), side="right"))
        rank_of = np.full(len(count), _NONE, np.int32)
        rank_of[order[:chosen]] = np.arange(chosen, dtype=np.int32)
        now = np.repeat(rank_of < chosen, count)
        place, rank = at[now], np.repeat(rank_of[rank_of < chosen], count[rank_of < chosen])
        # Of overlapping pairs the more frequent one goes first.
        ranks[place + 1] = rank
        take = (rank <= ranks[place]) & (rank <= ranks[place + 2])
        ranks[place + 1] = _NONE
        place, rank = place[take], rank[take]
        # A pair of equal symbols may overlap itself: of such a run every second one goes, from the left.
        head = at[(np.cumsum(count) - count)[order[:chosen]]]
        head_left, head_right = seq[head], seq[head + 1]
        twin = np.flatnonzero((head_left == head_right)[rank])
        if len(twin):
            x, y = place[twin], rank[twin]
            opens = np.concatenate(([True], (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1])))
            step = np.arange(len(x))
            keep = np.ones(len(place), bool)
            keep[twin[(step - np.maximum.accumulate(np.where(opens, step, 0))) % 2 == 1]] = False
            place, rank = place[keep], rank[keep]
        good = np.bincount(rank, minlength=chosen) >= max(least // 2, 1)
        number = (base + made + np.cumsum(good) - 1).astype(np.uint32)
        used = good[rank]
        place, rank = place[used], rank[used]
        left.append(head_left[good])
        right.append(head_right[good])
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        seq[place] = number[rank]
        last[place] = last[place + 1]
        made += int(good.sum())
        live = np.zeros(len(seq) + 1, bool)  # the spare end takes what is left of place 0
        live[at] = True
        live[place] = True
        # The pair before a new symbol; what stands there may itself have just lost its right side.
        before = place - 1
        before[~stay[before]] -= 1
        live[before] = True
        seq, last = seq[stay], last[stay]
        at = np.flatnonzero(live[:-1][stay] & ~last)
    # Documents without ids have no symbol; the others end where `last` says.
    closing = np.flatnonzero(last) + 1
    begins = np.zeros(len(first), np.int64)
    filled = first[1:] > first[:-1]
    begins[1:][filled] = closing
    np.maximum.accumulate(begins, out=begins)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    return seq, begins, cat(left), cat(right), base


def _frequent(seq: np.ndarray, at: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places by pair, from the left in each; count of each pair) for pairs at ``at`` that occur ``least`` times."""
    wide, long = symbols.bit_length(), len(seq).bit_length()
    pair = (seq[at].astype(np.uint64) << np.uint64(wide)) | seq[at + 1]
    if 2 * wide + long <= 64:
        both = np.sort((pair << np.uint64(long)) | at.astype(np.uint64))
        pair = both >> np.uint64(long)
        at = (both & np.uint64((1 << long) - 1)).astype(np.int64)
    else:
        order = np.argsort(pair, kind="stable")
        pair, at = pair[order], at[order]
    edge = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1], [True])))
    count = np.diff(edge)
    frequent = count >= least
    return at[np.repeat(frequent, count)], count[frequent]


def expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for. Rules refer to earlier rules only."""
    out = np.zeros(len(left), np.int64)
    level = rule_levels(left, right, base)
    for k in range(int(level.max()) + 1 if len(level) else 0):
        i = np.flatnonzero(level == k)
        out[i] = _size(left[i], out, base) + _size(right[i], out, base)
    return out


def _size(symbols: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    size = np.ones(len(symbols), np.int64)
    rule = symbols >= base
    size[rule] = lengths[symbols[rule].astype(np.int64) - base]
    return size


def rule_levels(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    level = np.zeros(len(left), np.int64)
    while len(left):
        new = np.zeros(len(left), np.int64)
        for side in (left, right):
            rule = side >= base
            new[rule] = np.maximum(new[rule], level[side[rule].astype(np.int64) - base] + 1)
        if (new == level).all():
            break
        level = new
    return level


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    """The ids of a run of symbols.

    A rule's place in the ids is known from the lengths, so each step splits
    the rules that are left into their sides and writes what is an id.
    """
    size = _size(symbols, lengths, base)
    out = np.empty(int(size.sum()), np.uint32)
    place = np.cumsum(size) - size
    while len(symbols):
        rule = symbols >= base if len(left) else np.zeros(len(symbols), bool)
        done = ~rule
        out[place[done]] = symbols[done]
        k, place = symbols[rule].astype(np.int64) - base, place[rule]
        one, two = left[k], right[k]
        place = np.concatenate((place, place + _size(one, lengths, base)))
        symbols = np.concatenate((one, two))
    return out


def write_shard(doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, first: np.ndarray) -> bytes:
    """The file of one shard."""
    seq, begins, left, right, base = build(ids, first)
    lengths = expansion_lengths(left, right, base)
    wide = int(len(seq) > 0 and int(seq.max()) > 0xFFFF)
    body = b"".join((
        MAGIC, struct.pack("<6I", len(doc_ids), len(left), len(seq), base, int(null.sum()), wide),
        left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
        seq.astype("<u4" if wide else "<u2").tobytes(),
        doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), begins.astype("<u4").tobytes(), first.astype("<u8").tobytes()))
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard file in memory."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
            raise ValueError("not a whole shard file")
        docs, rules, symbols, self.base, _, wide = struct.unpack_from("<6I", data, 4)
        at = 28

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right, self.lengths = read("<u4", rules), read("<u4", rules), read("<u4", rules)
        self.symbols = read("<u4" if wide else "<u2", symbols)
        self.doc_ids, self.null = read("<i8", docs), read("u1", docs).astype(bool)
        self.begins, self.first = read("<u4", docs + 1), read("<u8", docs + 1).astype(np.int64)

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        return expand(self.symbols, self.left, self.right, self.base, self.lengths)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; touches its own symbols only."""
        return expand(self.symbols[self.begins[k]: self.begins[k + 1]], self.left, self.right, self.base, self.lengths)

    def slice(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of a document; symbols outside are skipped by their lengths."""
        run = self.symbols[self.begins[k]: self.begins[k + 1]].astype(np.uint32)
        ends = np.cumsum(_size(run, self.lengths.astype(np.int64), self.base))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return expand(run[a:b], self.left, self.right, self.base, self.lengths)[start - before: stop - before]
