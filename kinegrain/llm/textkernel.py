"""Array kernels over whole batches of UTF-8 text.

Everything here works on the raw byte buffer of an Arrow string column, so a
batch of documents costs a fixed number of numpy passes instead of a Python
loop over words. Nothing is truncated: a document of any length is one slice
of the buffer, and a batch is cut between documents only.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multiplier of the rolling hash of k-grams and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer document is a batch of its own.
BATCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Bytes from which a span is digested as a whole.
LONG_SPAN = 128
#: By number of bytes, the bits of a little-endian word that they take.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BATCH_BYTES + 1)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row when that is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def byte_class(members: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in members]] = True
    return table


#: A-Z to a-z, and the two word definitions used by the queries.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x41:0x5B] = ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[0x20] = False
SPACE_WORD[0x09:0x0E] = False


def word_spans(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) of the words, and where each document's words begin.

    The third array has one entry more than there are documents, so the words
    of document d are ``[first[d], first[d + 1])``. Words never cross documents.
    """
    inside = member[raw]
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[[0, n]] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    begins, ends = cuts[:-1], cuts[1:]
    keep = inside[begins] if n else np.zeros(0, bool)
    starts, ends = begins[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes anywhere.

    Spans are mixed eight bytes at a time, every step a bijection of what came
    before; those of over ``LONG_SPAN`` bytes get a BLAKE2b digest. No span is
    told from another by a sum of powers, so repetitive bytes do not collide by
    construction.
    """
    size = ends - starts
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    out = mix(size.astype(U64) * U64(BASE) + U64(1))
    at = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    done = 0
    while len(at):
        rest = size[at] - done
        block = eight[starts[at] + done] & _MASKS[np.minimum(rest, 8)]
        out[at] = mix(out[at] ^ (block + U64(BASE)))
        at = at[rest > 8]
        done += 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]: ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, also across documents."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = words[:n] * U64(BASE)
    for j in range(1, k):
        total = (total ^ (total >> U64(29))) * U64(0xD6E8FEB86659FD93) + words[j: j + n]
    return mix(total)


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges [first, first + count)."""
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def squeeze(column: pa.Array) -> pa.Array:
    """Each text as compressed bytes, its size in front; for texts that a shuffle moves."""
    codec = pa.Codec("zstd", compression_level=3)
    data = [t.as_buffer() if t.is_valid else pa.py_buffer(b"") for t in column]
    return pa.array([len(d).to_bytes(8, "little") + codec.compress(d, asbytes=True) for d in data], pa.binary())


def unsqueeze(column: pa.Array) -> pa.Array:
    """The texts that `squeeze` made small."""
    codec = pa.Codec("zstd")
    parts = [b.as_py() for b in column]
    return pa.array([codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True) for p in parts], pa.large_binary()).cast(pa.large_string())


def trim() -> None:
    """Give freed memory back at the end of a task; workers live on and share their machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def keep_pages() -> None:
    """Let the allocator reuse arrays of up to 32 MB within a task instead of asking for fresh pages each time."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        return
