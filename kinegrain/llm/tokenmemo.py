"""Tokenizer ids of whole texts, with each distinct chunk encoded once per worker.

A text is cut before single spaces that stand between other characters. Such a
cut is a boundary of the tokenizers' own pre-tokenization, so the ids of the
chunks, joined, are the ids of the text; where a space meets other white space
there is no cut and the chunk is longer. Chunks are looked up by a 64-bit hash
of their bytes in a table of bounded size, a whole batch at a time, and every
hit is compared with the stored bytes. The chunks that are new are encoded
together by the tokenizers library; long ones, and any whose hash another chunk
has taken, are encoded anew each time and never stored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from kinegrain.llm import textkernel as tk

#: log2 of the table's slots; at most half are filled before it starts afresh.
TABLE_BITS = 21
PROBES = 16
#: Characters of new chunks encoded in one call.
JOIN_CHARS = 50_000
#: Longest chunk in bytes that is stored, and ids stored, before the table starts afresh.
LONGEST = 64
POOL_IDS = 1 << 23

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
#: First bytes of UTF-8 sequences among which there is white space.
_MAY_BLANK = np.zeros(256, bool)
_MAY_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True


_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def latin_letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of the two-byte letters from U+00C0 to U+00FF."""
    out = _LETTER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = True
    return out


def chunk_starts(raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Where chunks begin: at documents' first bytes and where a token must begin.

    That is at a single space or line feed between other characters, after
    such a line feed, and at a stop that follows a letter.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    at = at[(at > 0) & (at + 1 < n)]
    before, after = raw[at - 1], raw[at + 1]
    safe = ~(_BLANK[before] | _BLANK[after] | _MAY_BLANK[after])
    # The character before may itself be wide white space.
    wide = before >= 0x80
    safe &= ~(wide & (_MAY_BLANK[raw[np.maximum(at - 2, 0)]] | _MAY_BLANK[raw[np.maximum(at - 3, 0)]]))
    at = at[safe]
    # Blanks at a document's edge have nothing on one side there.
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    at = at[~edge[at] & ~edge[at + 1]]
    cut[at] = True
    cut[at[raw[at] == 0x0A] + 1] = True
    stop = np.flatnonzero(_STOP[raw])
    stop = stop[stop > 0]
    cut[stop[letters[stop - 1]]] = True
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts by one vocabulary file.

    ``spaced`` says that the tokenizer keeps a leading space as part of the
    following token (byte-level pre-tokenization); otherwise white space is
    dropped by it and only separates tokens. Control strings inside a text are
    ordinary text.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.closes = np.zeros(len(self.starts), bool)
        self.starts[[i for t, i in vocab.items() if t[0] == "Ġ"]] = True
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # Separators of joined chunks; each is one id that no chunk joined by it can have.
        line, mark = self._ids(["\n", "\x00"])
        self.line, self.mark = line[0] if line else -1, mark[0]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.at = np.zeros(1 << TABLE_BITS, np.int32)
        self.size = np.zeros(1 << TABLE_BITS, np.uint16)
        # A chunk's bytes: where they lie in a pool of eight-byte words, and how many there are.
        self.text_at = np.zeros(1 << TABLE_BITS, np.int32)
        self.text_size = np.zeros(1 << TABLE_BITS, np.uint8)
        self.words = np.zeros(1 << 16, np.uint64)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = self.words_used = self.filled = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        mask = (1 << TABLE_BITS) - 1
        slot = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.where(self.keys[slot] == hashes, slot, -1)
        open_ = np.flatnonzero(out < 0)
        for probe in range(1, PROBES):
            if not len(open_):
                break
            at = (slot[open_] + probe) & mask
            hit = self.keys[at] == hashes[open_]
            out[open_[hit]] = at[hit]
            open_ = open_[~hit & (self.keys[at] != 0)]
        return out

    def _same(self, slot: np.ndarray, eight: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each slot holds exactly the chunk's bytes."""
        out = self.text_size[slot] == size
        at = np.flatnonzero(out)
        done = 0
        while len(at):
            rest = size[at] - done
            out[at] = (eight[starts[at] + done] & tk._MASKS[np.minimum(rest, 8)]) == self.words[self.text_at[slot[at]] + (done >> 3)]
            at = at[(rest > 8) & out[at]]
            done += 8
        return out

    def _insert(self, hashes: np.ndarray, counts: np.ndarray, ids: np.ndarray, eight: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        mask = (1 << TABLE_BITS) - 1
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
        self.pool[self.used: self.used + len(ids)] = ids
        at = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        wide = -(-size // 8)
        total = int(wide.sum())
        while self.words_used + total > len(self.words):
            self.words = np.concatenate((self.words, np.zeros(len(self.words), np.uint64)))
        word_at = self.words_used + np.cumsum(wide) - wide
        inside = tk.ragged(np.zeros(len(wide), np.int64), wide)
        rest = np.repeat(size, wide) - 8 * inside
        self.words[self.words_used: self.words_used + total] = eight[np.repeat(starts, wide) + 8 * inside] & tk._MASKS[np.minimum(rest, 8)]
        self.words_used += total
        home = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        left = np.arange(len(hashes))
        for probe in range(PROBES):
            slot = (home[left] + probe) & mask
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            won = free & (self.keys[slot] == hashes[left])
            into, of = slot[won], left[won]
            self.at[into], self.size[into] = at[of], counts[of]
            self.text_at[into], self.text_size[into] = word_at[of], size[of]
            self.filled += int(won.sum())
            left = left[~won]

    def _encode_new(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New chunks in some order, the ids of each, joined, and their counts."""
        size = ends - starts
        at = tk.ragged(starts, size)
        raw, letters = raw[at], letters[at]
        ends = np.cumsum(size)
        starts = ends - size
        count = lambda flag: np.concatenate(([0], np.cumsum(flag)))
        inside = lambda c: c[ends] - c[starts]
        spaces, blanks, zeros = inside(count(raw == 0x20)), inside(count(_BLANK[raw])), inside(count(raw == 0))
        leads = raw[starts] == 0x20
        if self.spaced:
            # The only blank is a space in front: such chunks are told apart by it.
            plain = leads & (spaces == 1) & (blanks == 1)
            rest = ~plain & (blanks == 0)
            mark, cut_at = b"\n", self.line
        else:
            # A space and letters: one token run that ends a word.
            plain = leads & (inside(count(letters)) == size - 1)
            rest = ~plain & (zeros == 0)
            mark, cut_at = b" \x00 ", self.mark
        order, ids, counts = [], [], []

        def alone(index: np.ndarray) -> None:
            data = raw.tobytes()
            for i, x in zip(index.tolist(), self._ids([data[starts[i]: ends[i]].decode() for i in index.tolist()])):
                order.append(np.array([i]))
                ids.append(np.array(x, np.uint32))
                counts.append(np.array([len(x)]))

        def groups(index: np.ndarray, width: int):
            total = np.cumsum(size[index] + width)
            edges = np.unique(np.searchsorted(total, np.arange(0, total[-1] + JOIN_CHARS, JOIN_CHARS))) if len(index) else []
            edges = np.unique(np.concatenate(([0], edges, [len(index)]))).astype(np.int64)
            for i, j in zip(edges[:-1], edges[1:]):
                yield index[i:j]

        for group in groups(np.flatnonzero(plain), 0):
            text = raw[tk.ragged(starts[group], size[group])].tobytes().decode()
            x = np.array(self._ids([text])[0], np.uint32)
            cuts = np.flatnonzero(self.starts[x]) if self.spaced else np.flatnonzero(self.closes[x]) + 1
            n = np.diff(np.append(cuts, len(x))) if self.spaced else np.diff(np.concatenate(([0], cuts)))
            if len(cuts) != len(group) or n.sum() != len(x):
                alone(group)
                continue
            order.append(group)
            ids.append(x)
            counts.append(n)
        data = raw.tobytes() if rest.any() else b""
        for group in groups(np.flatnonzero(rest), len(mark)):
            text = mark.join([data[i:j] for i, j in zip(starts[group].tolist(), ends[group].tolist())]).decode()
            x = np.array(self._ids([text])[0], np.uint32)
            cuts = np.flatnonzero(x == cut_at)
            if len(cuts) != len(group) - 1:
                alone(group)
                continue
            order.append(group)
            ids.append(x[x != cut_at])
            counts.append(np.diff(np.concatenate(([-1], cuts, [len(x)]))) - 1)
        alone(np.flatnonzero(~plain & ~rest))
        return np.concatenate(order), np.concatenate(ids), np.concatenate(counts)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of all texts, ``end_id`` after each one's, and where each begins."""
        raw, offsets = tk.utf8_buffer(column)
        ids, counts = [], []
        for a, b in tk.slices(offsets):
            x, n = self._encode(raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], end_id)
            ids.append(x)
            counts.append(n)
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(counts))))

    def _encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        letters = latin_letters(raw)
        starts = chunk_starts(raw, offsets, letters)
        ends = np.append(starts[1:], len(raw))
        length = ends - starts
        padded = np.zeros(len(raw) + 8, np.uint8)
        padded[: len(raw)] = raw
        eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
        hashes = tk.span_hashes(raw, starts, ends) | np.uint64(1)
        short = length <= LONGEST
        slot = self._find(hashes)
        new, index = np.unique(hashes[(slot < 0) & short], return_index=True)
        if len(new):
            if self.filled + len(new) > 1 << (TABLE_BITS - 1) or self.used > POOL_IDS:
                self._clear()
                index = np.flatnonzero(short)[np.unique(hashes[short], return_index=True)[1]]
            else:
                index = np.flatnonzero((slot < 0) & short)[index]
            order, ids, counts = self._encode_new(raw, starts[index], ends[index], letters)
            index = index[order]
            self._insert(hashes[index], counts, ids, eight, starts[index], length[index])
            slot = self._find(hashes)
        known = (slot >= 0) & short
        known[known] = self._same(slot[known], eight, starts[known], length[known])
        size = np.zeros(len(hashes), np.int64)
        size[known] = self.size[slot[known]]
        at = np.zeros(len(hashes), np.int64)
        at[known] = self.at[slot[known]]
        pool = self.pool
        other = np.flatnonzero(~known)
        if len(other):
            # Long chunks, and the few that found no slot or another chunk's hash in theirs.
            data = raw.tobytes()
            texts = [data[i:j] for i, j in zip(starts[other].tolist(), ends[other].tolist())]
            number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
            encoded = self._ids([t.decode() for t in number])
            counts = np.array([len(x) for x in encoded])
            lost = np.array([number[t] for t in texts])
            size[other] = counts[lost]
            at[other] = self.used + (np.cumsum(counts) - counts)[lost]
            pool = np.concatenate((pool[: self.used], *(np.array(x, np.uint32) for x in encoded)))
        docs = len(offsets) - 1
        of_doc = np.searchsorted(starts, offsets[:-1])
        upto = np.concatenate(([0], np.cumsum(size)))
        per_doc = upto[np.append(of_doc[1:], len(starts))] - upto[of_doc]
        per_doc[offsets[1:] == offsets[:-1]] = 0
        out = np.empty(int(upto[-1]) + docs, np.uint32)
        closing = np.cumsum(per_doc + 1) - 1
        body = np.ones(len(out), bool)
        body[closing] = False
        out[closing] = end_id
        out[body] = pool[tk.ragged(at, size)]
        return out, per_doc + 1


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    key = (path, spaced)
    if key not in _encoders:
        tk.keep_pages()
        _encoders[key] = Encoder(path, spaced)
    return _encoders[key]
